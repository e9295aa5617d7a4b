"""Sharding, hard negatives and turn reassembly against plain definitions, over odd tables."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewright.llm import hard_negatives as hn
from tomewright.llm import hash_ring, language_id, quality_classifier
from tomewright.llm.features import row_key, sample_per_class
from tomewright.llm.hash_ring import assign_shards, place_points, ring_nodes
from tomewright.llm.language_id import fit_language_model, identify_language
from tomewright.llm.quality_classifier import fit_quality_index
from tomewright.llm.turn_reassembly import reassemble_conversations, turn_batches

DOCS = "doc_id bigint, text string, size string, shard string, h string"


def walk(keys, shards, nodes, points):
    """Row by row: home rows first, then round by round to the next node clockwise while a shard has room."""
    at, owner = ring_nodes(shards, nodes)
    room = [len(keys) // shards + (s < len(keys) % shards) for s in range(shards)]
    homes = [next((i for i, x in enumerate(at) if (int(x) * points >> 64) >= p), 0) for p in range(points)]
    waiting, out, step = sorted(keys), [], 0
    while waiting:
        still = []
        for point, key in waiting:
            to = owner[(homes[point] + step) % len(at)]
            if room[to]:
                room[to] -= 1
                out.append((key, to))
            else:
                still.append((point, key))
        waiting, step = still, step + 1
    return sorted(out)


def test_points_are_placed_as_a_row_by_row_walk_places_them():
    rng = random.Random(4)
    for rows, shards, nodes, points in ((0, 3, 4, 64), (1, 3, 4, 64), (200, 7, 4, 64), (97, 5, 1, 8), (300, 2, 8, 16)):
        keys = [(rng.randrange(points) if rng.random() < 0.7 else 5 % points, i) for i in range(rows)]
        keys = [(p, k) for k, (p, _) in enumerate(sorted(keys))]
        counts = np.bincount([p for p, _ in keys], minlength=points)
        first = np.cumsum(counts) - counts
        plan = place_points(counts, shards, nodes)
        got = sorted((int(first[r.point]) + k, r.shard) for r in plan.itertuples() for k in range(r.lo, r.hi))
        assert got == walk(keys, shards, nodes, points)


def test_shards_are_even_and_slots_gapless_for_any_rows(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["a", "été", "c"], k=rng.randint(0, 30))), "x", "y", "z") for i in range(700)]
    rows += [(7, "same", "x", "y", "z")] * 400 + [(None, None, None, None, None)] * 50 + [(None, f"t{i}", "", "", "") for i in range(50)] + [(9, "é" * 300_000, "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = assign_shards(docs, 11, nodes=16, copies=64).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, size(r[1])) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 11 and {len(x) for x in by.values()} <= {len(rows) // 11, len(rows) // 11 + 1}
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert {r.text_crc32 for r in got} == {zlib.crc32((r[1] or "").encode()) for r in rows}
    assert sorted(map(str, got)) == sorted(map(str, assign_shards(docs.repartition(5), 11, nodes=16, copies=64).collect()))
    assert assign_shards(docs.limit(0), 11).count() == 0
    with pytest.raises(ValueError):
        assign_shards(docs, 11, nodes=16, points=64)


def test_a_further_shard_moves_few_rows(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    old, new = (assign_shards(docs, n) for n in (40, 41))
    both = old.join(new.select("doc_id", F.col("shard").alias("to"), F.col("home").alias("new_home")), "doc_id")
    # at home a row moves to the new shard alone; a bounded share of rows goes on from full shards
    assert both.where("home <> new_home and new_home <> 40").count() == 0
    assert both.where("shard <> to").count() < 0.08 * 20000
    assert old.where("shard <> home").count() < 0.05 * 20000
    slack = place_points(np.full(hash_ring.POINTS, 3), 40, slack=0.1)
    assert (slack.assign(n=slack.hi - slack.lo).groupby("shard").n.sum() <= 1.1 * 3 * hash_ring.POINTS / 40 + 1).all()


def brute_negatives(rows, anchors_by, most, window):
    use = [(i, lab, [math.floor(256 * float(np.float32(c))) for c in v]) for i, lab, v in rows if None not in (i, lab, v) and all(c is not None and math.isfinite(c) for c in v)]
    use = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in use]
    out = []
    for a, (aid, alab, av) in enumerate(use):
        if aid % anchors_by:
            continue
        scored = sorted((-sum(x * y for x, y in zip(av, v)), i, lab == alab) for c, (i, lab, v) in enumerate(use) if c != a)
        for p, pid, _ in [x for x in scored if x[2]][:most]:
            hits = [(s, i) for s, i, same in scored if not same and window[0] * -p <= 100 * -s <= window[1] * -p]
            out += [(aid, pid, k + 1, i, -p, -s) for k, (s, i) in enumerate(hits[:most])]
    return sorted(out)


@pytest.mark.parametrize("wave", [1 << 20, 300])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, wave):
    rng = random.Random(6)
    hot = [0.5, -0.25, 0.125, 1.0]
    rows = [(i, rng.randrange(4), [round(rng.uniform(-1, 1), 1) for _ in range(rng.choice([0, 2, 4, 4, 4]))]) for i in range(150)]
    rows += [(1000 + i, rng.randrange(4), hot) for i in range(60)]  # ties
    rows += [(20, 1, hot)] * 9 + [(20, 1, [1.0, 2.0, 3.0, 4.0])] + [(41, 2, hot)] * 8  # repeated anchors and candidates
    rows += [(30, None, hot), (30, 1, None), (None, 1, hot), (40, 1, [1.0, float("nan")]), (40, 1, [float("inf"), 0.0]), (50, 1, [None, 0.5])]
    schema = "vec_id bigint, label int, embedding array<float>, n string, score string, anchor string"
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r) for r in hn.hard_negatives(df, label, F.col("vec_id") % 10 == 0, wave_bytes=wave).select(names).collect())
    assert got == brute_negatives(rows, 10, 5, (80, 100)) and len(got) > 300
    assert hn.hard_negatives(df.where("false"), label, F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(df, label, F.lit(None).cast("boolean")).count() == 0


def test_products_are_exact_beyond_doubles():
    a, b = np.array([[float(2**40), 3.0]]), np.array([[float(2**14), 1.0], [1e300, 0.0]])
    assert hn.products(a, b[:1]).tolist() == [[2**54 + 3]]
    assert hn.products(a, b).tolist() == [[2**54 + 3, hn.MOST]]
    assert hn.products(np.zeros((2, 3)), np.zeros((0, 0))).shape == (2, 0)


def brute_reassembly(rows, batches, silent):
    """Conversation by conversation, batch by batch; rows are (batch, conv, turn, role, payload)."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    out = []
    for conv in {r[1] for r in rows if r[2] is not None}:
        own = [r for r in rows if r[1] == conv and r[2] is not None]
        first = nxt = min(r[2] for r in own)
        kept, last, closed = {}, None, False

        def close(at):
            left = sorted(t for t in kept if t >= nxt)
            breaks = sum(t - 1 in kept and kept[t - 1][0] == kept[t][0] for t in kept)
            out.append(("close", conv, -1, at, sha(",".join(map(str, left))), max(kept) - first + 1 - len(kept), breaks))

        for b in range(batches):
            now = {}
            for _, _, turn, role, payload in sorted((r for r in own if r[0] == b), key=lambda r: (r[4].encode(), r[3].encode()), reverse=True):
                now[turn] = (role, payload)
            if closed:
                out += [("reject", conv, t, b, sha(p), None, None) for t, (_, p) in now.items()]
                continue
            if now:
                last = b
            for t, x in now.items():
                kept.setdefault(t, x)
            while nxt in kept:
                out.append(("release", conv, nxt, b, sha(kept[nxt][1]), None, None))
                nxt += 1
            if last is not None and b - last >= silent:
                closed = True
                close(b)
        if not closed and last is not None:
            close(batches)
    return sorted(out, key=str)


def test_turn_reassembly_equals_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for conv in range(14):
        start = rng.choice([0, 0, 3, -5, 10**12])
        turns = [start + k for k in range(rng.randint(1, 12)) if k == 0 or rng.random() < 0.85]
        times = sorted(rng.sample(range(7), rng.randint(1, 4)))
        for t in turns:
            for _ in range(rng.choice([1, 1, 2, 3])):
                role = rng.choice(["user", "assistant", ""])
                rows.append((rng.choice(times), str(conv), t, role, f"{role}|{rng.choice('aéz')}"))
    rows += [(2, "5", None, "user", "user|x"), (0, "null", 4, "a|b", "a|b|c"), (0, "null", 4, "a", "a|b|c"), (0, "null", 4, "a", "a|b|c")]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "batch int, conv string, turn long, role string, payload string, first string, span string, digest string")
    want = brute_reassembly(rows, 7, 2)
    assert {r[0] for r in want} == {"release", "reject", "close"} and any(r[5] for r in want) and any(r[6] for r in want)
    for bits in (12, 1):  # of two turns a span, most conversations have many
        got = reassemble_conversations(df, 7, bits).select("event", "conv", "turn", "batch", "digest", "n_missing", "n_breaks").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_turn_batches_take_odd_rows_and_no_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, batch string, payload string"
    rows = [(1, 0, None, None, "x", "y"), (1, None, "user", "t", "x", "y"), (None, 3, "user", "é" * 100_000, "x", "y"), (1, 1, "user", "", "x", "y")]
    got = turn_batches(spark.createDataFrame(rows, schema)).collect()
    assert {(r.conv, r.turn) for r in got} == {("1", 0), ("1", 1), ("null", 3)} and all(0 <= r.batch < 10 for r in got)
    assert {r.payload for r in got if r.turn == 0} <= {"|", "user|"}
    empty = turn_batches(spark.createDataFrame([], schema))
    assert reassemble_conversations(empty, 1).count() == 0


def test_samples_are_bounded_in_rows_and_learn_every_language(spark):
    rows = [(1, "hot", f"der die das {i}", "x") for i in range(3000)] + [(2, "hot", "the same", "x")] * 3000
    rows += [(1, "rare", f"el la los {i}", "x") for i in range(40)] + [(None, "none", f"le la les {i}", "x") for i in range(40)]
    rows += [(10 + i, f"l{i}", f"abc{i}", "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, key string").repartition(5)
    model = fit_language_model(df)
    assert {"hot", "rare", "none", "l0", "l299"} <= set(model.languages) and len(model.languages) == 303
    keyed = df.select("lang", row_key("doc_id", "text").alias("key"))
    counts = {r.lang: r["count"] for r in sample_per_class(keyed, "lang", "key", 100, 10**6).distinct().groupBy("lang").count().collect()}
    assert 60 < counts["hot"] < 140 and counts["rare"] == counts["none"] == 40
    few = sample_per_class(keyed, "lang", "key", 100, 606).distinct().groupBy("lang").count()
    assert few.agg(F.sum("count")).first()[0] < 800
    labels = df.select("doc_id", F.lit(1).alias("quality")).distinct().union(spark.createDataFrame([(10, 0), (11, 0)], "doc_id bigint, quality int"))
    index = fit_quality_index(df, labels)
    assert len(index.vectors) < 1.2 * quality_classifier.PER_CLASS


def plain_averages(text):
    """Bucket shares of a text's byte n-grams, by the definition."""
    raw = bytes(32 if c in b" \t\n\x0b\x0c\r" else c + 32 if 65 <= c <= 90 else c for c in text.encode())
    counts = np.zeros(1 << language_id.BITS)
    for size in language_id.SIZES:
        for k in range(len(raw) - size + 1):
            code = 0
            for c in raw[k : k + size]:
                code = (code * 257 + c) % 2**32
            counts[(code + size) * 2654435761 % 2**32 >> (32 - language_id.BITS)] += 1
    return counts / max(1, counts.sum())


def test_language_scores_equal_plain_averages_and_softmax(spark):
    rng = random.Random(9)
    words = {"aa": ["der", "die", "Das", "und"], "bb": ["the", "of", "AND", "été"], "cc": ["los", "que"]}
    rows = [(i, lang, " ".join(rng.choices(words[lang], k=rng.randint(1, 20))), "x") for i, lang in enumerate(rng.choices(list(words), k=300))]
    odd = [(900, None, None, "x"), (901, None, "", "x"), (902, None, "12 !", "x"), (903, None, "über die " * 50_000, "x"), (None, None, "the\tof", "x")] + [(904, None, "que", "x")] * 1500
    schema = "doc_id bigint, lang string, text string, score string"
    model = fit_language_model(spark.createDataFrame(rows, schema))
    for r in identify_language(spark.createDataFrame(rows[:40] + odd, schema), model).distinct().collect():
        text = {x[0]: x[2] for x in rows + odd}[r.doc_id]
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.accepted) == ("und", 0.0, False)
            continue
        z = (plain_averages(text) @ model.embedding.astype(float) @ model.weight.astype(float) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.languages[p.argmax()] and abs(r.score - p.max()) < 1e-3
        assert r.accepted == (r.score >= model.threshold)


def test_language_training_follows_the_gradient(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((30, 64)).astype(np.float32)
    x /= x.sum(1, keepdims=True)
    y = rng.integers(0, 3, 30)
    monkeypatch.setattr(language_id, "EPOCHS", 2)
    got = language_id.train(x, y, ["a", "b", "c"])
    draw = np.random.default_rng(language_id.SEED)
    order = draw.permutation(30)
    fit = order[6:]
    e = draw.normal(0, 0.1, (64, language_id.WIDTH)).astype(np.float32).astype(float)
    w, b = draw.normal(0, 0.1, (language_id.WIDTH, 3)).astype(np.float32).astype(float), np.zeros(3)

    def loss(e, w, b, rows):
        z = x[rows].astype(float) @ e @ w + b
        return np.mean([np.log(np.exp(z[i]).sum()) - z[i, y[r]] for i, r in enumerate(rows)])

    def slope(at, rows):
        out = [np.zeros_like(p) for p in at]
        for p, g in zip(at, out):
            for k in np.ndindex(p.shape):
                p[k] += 1e-5
                high = loss(*at, rows)
                p[k] -= 2e-5
                g[k] = (high - loss(*at, rows)) / 2e-5
                p[k] += 1e-5
        return out

    for epoch in range(2):
        rate = language_id.RATE * (1 - epoch / 2)
        fit = draw.permutation(fit)
        for k in range(0, len(fit), language_id.BATCH):
            ge, gw, gb = slope([e, w, b], fit[k : k + language_id.BATCH])
            e, w, b = e - 10 * rate * ge, w - 0.1 * rate * gw, b - 0.1 * rate * gb
    for mine, plain in ((got.embedding, e), (got.weight, w), (got.bias, b)):
        assert np.allclose(mine, plain, atol=2e-3)
