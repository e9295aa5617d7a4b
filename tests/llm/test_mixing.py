"""Mixing against its definition: targets by repeated resharing, near-exact totals, permutations, whole blocks."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tomewright.llm.mixing import mix_sources, mixed_blocks, permuted

SCHEMA = "doc_id bigint, text string, source string, sid int, size string, block int"


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, target, live = 1.5 * sum(sizes.values()), {}, set(order)
    while live:
        level = left / sum(weight[s] for s in live)
        over = {s for s in live if level * weight[s] >= 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in live}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        live -= over
    return target


def rows():
    rng = random.Random(2)
    out = [(i, " ".join(["w"] * rng.randint(0, 300)), f"src{min(i % 17, rng.randint(0, 16))}", 0, "x", 1) for i in range(900)]
    out += [(1000, None, "src1", 0, "x", 1), (1001, "  ", None, 0, "x", 1), (1002, "a b c d e f g", None, 0, "x", 1), (1003, "", "empty", 0, "x", 1), (1004, "w " * 30000, "src3", 0, "x", 1), (2005, "w w w", "src2", 0, "x", 1), (2005, "w w w", "src2", 0, "x", 1), (None, "q " * 80, "z", 0, "x", 1)]
    return out


def test_mix_sources(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA)
    got = mix_sources(df.repartition(7)).collect()
    assert len(got) == len(data)
    again = mix_sources(df.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    sizes, source = Counter(), {}
    for d, t, s, *_ in data:
        sizes[s] += len((t or "").split())
        source[d] = s
    target, taken = plain_targets(sizes), Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) < 64
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixed_blocks_hold_what_is_taken(spark):
    df = spark.createDataFrame([(i, " ".join(f"d{i}_{k}" for k in range(37 + 11 * (i % 9))), f"s{i % 4}") for i in range(80)], "doc_id bigint, text string, source string")
    taken = {r.doc_id: r.taken for r in mix_sources(df).collect()}
    words, slots = Counter(), defaultdict(int)
    for r in mixed_blocks(df).collect():
        words[r.doc_id] += len(r.words)
        slots[r.sid, r.slot] += len(r.words)
        assert all(w.startswith(f"d{r.doc_id}_") for w in r.words)
    assert {d: words[d] for d in taken} == taken
    assert max(slots.values()) == 64


def test_sources_of_a_shard_follow_the_draw(spark):
    """Counts by shard and source are spread as a multinomial draw; documents tell the shards that their words go to."""
    from tomewright.llm.mixing import mixture_slots, source_targets

    sizes = spark.createDataFrame([(f"s{i % 4}", 900 + 300 * (i % 4)) for i in range(1200)], "source string, size bigint")
    sources = source_targets(sizes)
    counts = mixture_slots(sources, shard_slots=256).groupBy("shard", "sid").agg(F.count("*").alias("n")).toPandas().pivot(index="shard", columns="sid", values="n").fillna(0)
    slots, shards = counts.sum(), len(counts)
    target = {r.sid: r.target for r in sources.collect()}
    assert all(abs(slots[s] - t / 64) <= 3 for s, t in target.items())
    assert len(set(map(tuple, counts.to_numpy().tolist()))) > 0.9 * shards
    for s in counts.columns:  # a binomial's variance, give or take
        expected = slots[s] / shards
        assert 0.6 < counts[s].var() / (expected * (1 - 1 / shards)) < 1.6
    df = spark.createDataFrame([(i, "w " * (50 + i % 300), f"s{i % 4}") for i in range(400)], "doc_id bigint, text string, source string")
    met = mixed_blocks(df).groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).collect()
    assert {r.doc_id: r.n_shards for r in mix_sources(df).collect() if r.n_shards} == {r.doc_id: r.n for r in met}
    assert "shard" in mix_sources(df)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permuted_is_a_permutation(spark, n):
    df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("y"))
    got = [r.y for r in df.collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != list(range(n))


def test_mix_of_nothing(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shards_take_ranges_of_slots_by_drawn_counts(spark):
    from tomewright.llm.mixing import drawn_counts, mixture_slots, source_targets

    sizes = spark.createDataFrame([(f"s{i % 3}", 500 + 400 * (i % 3)) for i in range(600)], "source string, size bigint")
    ranges = defaultdict(dict)
    for r in mixture_slots(source_targets(sizes), shard_slots=128).collect():
        ranges[r.sid].setdefault(r.shard, []).append(r.slot)
    for by_shard in ranges.values():
        at = 0
        for shard in sorted(by_shard):
            assert sorted(by_shard[shard]) == list(range(at, at + len(by_shard[shard])))
            at += len(by_shard[shard])
    chunks = spark.createDataFrame([(0, 9, 0, 5000, 8, c) for c in (0, 1)], "sid int, blocks long, rest long, slots long, shards long, chunk long")
    drawn = drawn_counts(chunks, 1).orderBy("shard").collect()
    assert [r.start for r in drawn] == [sum(r.n for r in drawn[:k]) for k in range(8)] and sum(r.n for r in drawn) == 5000
    assert len({r.n for r in drawn}) > 3 and max(abs(r.n - 625) for r in drawn) < 130
