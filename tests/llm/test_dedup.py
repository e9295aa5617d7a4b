"""Substring and SimHash deduplication against brute force on small tables."""

import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tomewright.llm.simhash_dedup import fingerprint, simhash_components, simhash_dedup
from tomewright.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id bigint, text string, start int, least string"  # columns beyond the first two clash with ours


def texts():
    rng = random.Random(5)
    words = ["the", "of", *[f"w{i}" for i in range(400)]]
    base = [rng.choices(words, k=rng.randint(30, 200)) for _ in range(12)]
    out = []
    for k in range(60):
        own = rng.choices(words, k=rng.randint(0, 90))
        if k % 3:
            b = rng.choice(base)
            i = rng.randrange(0, len(b) - 20)
            own[len(own) // 2 : len(own) // 2] = b[i : i + rng.randint(15, 80)]
        if k % 7 == 0 and own:
            own[rng.randrange(len(own))] = "changed"
        if k % 11 == 0:
            own = own + own
        out.append((k * 3, rng.choice([" ", "\n", "\t "]).join(own)))
    copy = out[20][1]
    out += [(900 + i, copy) for i in range(8)] + [(950, ""), (951, None), (952, " \n "), (953, "a " * 70), (954, "été " * 25), (955, " ".join(rng.choices(words, k=6000)))]
    out += [(300 + i, out[31][1] + f" x{i}") for i in range(5)]
    rng.shuffle(out)
    return [(d, t, 1, "x") for d, t in out]


def brute_removal(rows, window):
    seen, where = {}, {}
    for d, t, *_ in rows:
        w = (t or "").split()
        where[d] = w
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            seen[key] = min(seen.get(key, (d, i)), (d, i))
    out = {}
    for d, w in where.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] != (d, i):
                gone |= set(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("window", [20, 8])
def test_substring_dedup_equals_brute_force(spark, window):
    rows = texts()
    got = substring_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), window=window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_removal(rows, window)


def test_substring_dedup_original_layout(spark):
    a = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"one\n{a}\ntwo"), (2, f"three\n\n{a}\nfour five"), (3, None), (4, "  as\tit is ")]
    got = {r.doc_id: r.kept_text for r in substring_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), layout="original").collect()}
    assert got == {1: rows[0][1], 2: "three\n\nfour five", 3: None, 4: "  as\tit is "}


def test_substring_dedup_odd_tables(spark):
    assert substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    long = " ".join(f"q{i}" for i in range(30))
    got = substring_dedup(spark.createDataFrame([(None, long), (5, long), (5, long), (None, None)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got) == [(-1, 0, 0), (-1, 30, 0), (5, 30, 30), (5, 30, 30)]


def plain_fingerprint(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    up = {d: d for d in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {d: root(d) for d in prints}


def test_simhash_components_equal_brute_force(spark):
    rows = texts()
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = {d: plain_fingerprint(t) for d, t, *_ in rows}
    assert {d: fp for d, (fp, _) in got.items()} == prints
    assert {d: c for d, (_, c) in got.items()} == plain_components(prints, 3)


@pytest.mark.parametrize(("near", "shard", "planned"), [(0.0, 16384, 2048), (0.9, 16384, 2048), (0.9, 300, 2048), (0.9, 16384, 16), (0.9, 30, 64)])
def test_hamming_links_are_whole(spark, near, shard, planned):
    from tomewright.llm.components import connected_components
    from tomewright.llm.simhash_dedup import hamming_links

    rng = random.Random(3)
    prints = [rng.getrandbits(64)]
    while len(prints) < 900:
        x = prints[rng.randrange(len(prints))] if rng.random() < near else rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    prints = sorted(set(prints), key=lambda x: x - (x >> 63 << 64))
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in prints], "fp bigint")
    stars = {r.u: r.v for r in connected_components(hamming_links(df, shard=shard, planned=planned)).collect()}
    want = plain_components({x - (x >> 63 << 64): x for x in prints}, 3)
    assert {x: stars.get(x, x) for x in want} == want


def test_vantage_points_shard_and_prune():
    """Pairs near in a half meet in a shard of it, rows grow by a seventh a cut, and trees leave most pairs aside."""
    from tomewright.llm import simhash_dedup as module

    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 6000, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64)) for _ in range(3000)]
    x[3000:] = x[:3000] ^ np.array(flips, np.uint64)
    points = module.vantage_points(6)
    assert all(np.bitwise_count((points[i] ^ points[j]) & m) == 16 for i in range(6) for j in range(i) for m in module.HALVES)
    met = np.zeros(3000, bool)
    for mask in module.HALVES:
        counts = np.array([np.bincount(np.bitwise_count((x ^ v) & mask), minlength=33) for v in points])
        at, shard = module.shards_of(x, mask, points, module.cuts_at(counts[None])[0], 1)
        assert len(at) < 1.2**6 * len(x) and np.bincount(shard).max() < len(x) / 10
        keys = set(zip(at.tolist(), shard.tolist(), strict=True))
        both = [any((i + 3000, s) in keys for s in shard[at == i].tolist()) for i in range(3000)]
        close = np.bitwise_count((x[:3000] ^ x[3000:]) & mask) <= 1
        assert np.array(both)[close].all()
        met |= close
        sets = module._Union(len(x))
        compared = module.vantage_tree(x & mask, np.arange(len(x)), 1, sets)
        sets.flatten()
        assert (sets.up[:3000] == sets.up[3000:])[close].all()
        assert compared < 0.1 * len(x) ** 2
    assert met.all()


def test_simhash_odd_tables(spark):
    assert fingerprint(b"") == 0
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "A b  c\td"), (3, None), (4, ""), (5, "ein anderer Text ganz ohne Bezug")]
    got = simhash_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 7), (3, 3), (4, 3), (5, 5), (7, 7), (7, 7)]
    kept = simhash_dedup(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)).collect()
    assert sorted(r.doc_id for r in kept) == [3, 5, 7, 7]
    assert set(kept[0].asDict()) == {"doc_id", "text", "start", "least"}




@pytest.mark.parametrize("shard", [4096, 8])
def test_near_copies_by_jaccard(spark, monkeypatch, shard):
    """Each pair of texts that are clearly alike or unlike, against Jaccard similarities of five-word shingles."""
    from tomewright.llm import simhash_dedup as module

    monkeypatch.setattr(module.near_links, "__defaults__", (shard,))
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randint(3, 8)))
    texts = []
    for g in range(40):
        base = [word() for _ in range(rng.choice([60, 200, 700]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(len(base) // 150 if g % 2 else len(base) // 12):  # few edits or many
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    sets, up = [shingles(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            same = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            if same >= 0.83:
                lo, hi = sorted((up[a], up[b]))
                up = [lo if x == hi else x for x in up]
            else:
                assert same < 0.74 or up[a] == up[b]  # none is near the limit
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    kept = {r.doc_id for r in simhash_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {i for i, x in enumerate(up) if x == i} and len(kept) < len(texts)


@pytest.mark.parametrize("shard", [4096, 8])
def test_near_copies_about_the_limit_by_exact_jaccard(spark, monkeypatch, shard):
    """Pairs on both sides of 0.8, close to it and at it, short texts too: the groups are those of all exact pairs."""
    from tomewright.llm import simhash_dedup as module

    monkeypatch.setattr(module.near_links, "__defaults__", (shard,))
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijk", k=rng.randint(4, 9)))
    texts = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice([8, 9, 12, 60, 200, 500]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(1, 5)):
            cut = round(len(base) * rng.uniform(0.02, 0.26))  # an end that is other or is missing: similarities of 0.6 to 0.98
            texts.append(" ".join(base[: len(base) - cut] + [word() for _ in range(cut * rng.randint(0, 1))]))
    hub = [word() for _ in range(104)]  # 100 shingles; a group of over 64, all about the limit
    texts += [" ".join(hub[k : 104 - (n - k)]) for n in range(16, 26) for k in range(0, n, 2)]

    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    up, near, at = list(range(len(texts))), 0, 0
    for b in range(len(texts)):
        for a in range(b):
            both, one = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            near, at = near + (0.77 <= both / one < 0.8), at + (5 * both == 4 * one)
            if 5 * both >= 4 * one:
                lo, hi = sorted((up[a], up[b]))
                up = [lo if x == hi else x for x in up]
    assert near > 20 and at > 2
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    kept = {r.doc_id for r in simhash_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {i for i, x in enumerate(up) if x == i}
