"""SimHash near-duplicates: exact pairs within a Hamming radius by sharded vantage-point trees.

Fingerprints are partitioned by their Hamming distances to vantage points, cut at the median of each; by the triangle
bound a pair's distances to a vantage point differ by no more than the pair's own, so a fingerprint just above a cut
also queries the shard below it. Each shard is searched through a vantage-point tree, whose branches meet only about
their boundary. Distances of unrelated 64-bit fingerprints lie within 32 +- 4, where a radius of 3 prunes little: a cut
leaves 0.78 of all pairs. But of two halves of the bits, a pair within 3 bits differs in one bit at most in one of
them. So each half is searched for pairs within half the radius, where a cut adds a seventh to the rows and leaves 0.57
of all pairs, and what is found is checked over all bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import textnum as tn
from tomewright.llm.common import drop_table, only, read_table, stage_table
from tomewright.llm.components import connected_components

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Points of a tree's leaf; of a shard, as planned by the number of cuts; of a shard before it is split.
LEAF, PLANNED, SHARD = 128, 2048, 16384
#: The bits of either half.
HALVES = (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF << 32))
#: Near copies: bits of a wide fingerprint, bands and minima of each; points and bytes of a shard before it is split.
#: Points of a candidate group before its exact check is split.
WIDE, BANDS, BAND_ROWS, WIDE_SHARD, WIDE_BYTES, GROUP_SHARD = 4096, 20, 4, 4096, 64_000_000, 512


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased words' shingles: a bit is 1 if it is set in over half of their XXH64 hashes."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words]) - 1
    begins = np.r_[0, ends[:-1] + 1]
    k = min(shingle, len(words))
    spans = zip(begins[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in spans), "<u8", len(words) - k + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col, fp``: 64-bit SimHash of every whole text, as a signed long. Null and empty texts give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=[id_col, "fp"])

    return only(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


class _Union:
    """Disjoint sets over 0..n-1, joined a block of pairs at a time."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self.flatten()
            a, b = self.up[a], self.up[b]
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))

    def flatten(self) -> None:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return
            self.up = up


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances, broadcast; wide fingerprints are rows of 64-bit words (a word at a time: memory stays that of one)."""
    if a.ndim == b.ndim == 1:
        return np.bitwise_count(a[:, None] ^ b[None])
    out = np.zeros((len(a), len(b)), np.uint16)
    for c in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, c] ^ b[None, :, c])
    return out


#: Tells which pairs (a, b) of points are truly alike.
Check = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _join_checked(a: np.ndarray, b: np.ndarray, bits: np.ndarray, sets: _Union, alike: Check) -> None:
    """Join the alike pairs, each point's nearest first; pairs that are joined by then need no check."""
    order = np.lexsort((bits, a))
    a, b, take = a[order], b[order], 1
    while len(a):
        sets.flatten()
        apart = sets.up[a] != sets.up[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return
        begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        now = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)])) < take
        ok = alike(a[now], b[now])
        sets.join(a[now][ok], b[now][ok])
        a, b, take = a[~now], b[~now], take * 2


def _brute(x: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int, sets: _Union, alike: Check | None = None) -> None:
    for k in range(0, len(i), 256):
        bits = _apart(x[i[k : k + 256]], x[j])
        a, b = np.nonzero(bits <= radius)
        if alike is None:
            sets.join(i[k : k + 256][a], j[b])
        else:
            once = (a + k < b) if i is j else np.ones(len(a), bool)
            _join_checked(i[k : k + 256][a[once]], j[b[once]], bits[a[once], b[once]], sets, alike)


def vantage_tree(x: np.ndarray, at: np.ndarray, radius: int, sets: _Union, alike: Check | None = None) -> int:
    """Join all points x[at] within radius bits (and alike): inner and outer branch, then only the pairs about the
    boundary. Returns how many pairs were compared."""
    if len(at) <= LEAF:
        _brute(x, at, at, radius, sets, alike)
        return len(at) ** 2
    d = _apart(x[at], x[at[len(at) // 2 : len(at) // 2 + 1]])[:, 0].astype(np.int64)
    edge = np.median(d)
    inner = d <= edge
    if inner.all():
        inner = d < edge
    if not inner.any():  # all are as far from the vantage point
        _brute(x, at, at, radius, sets, alike)
        return len(at) ** 2
    n = vantage_tree(x, at[inner], radius, sets, alike) + vantage_tree(x, at[~inner], radius, sets, alike)
    last, first = d[inner].max(), d[~inner].min()
    low, high = at[inner & (d >= first - radius)], at[~inner & (d <= last + radius)]
    if len(low) and len(high):
        _brute(x, low, high, radius, sets, alike)
    return n + len(low) * len(high)


def vantage_points(n: int) -> np.ndarray:
    """``n`` points, at most 31, of which each two differ in half the bits of either half: rows of a Hadamard matrix."""
    i = np.arange(32)
    rows = np.bitwise_count(i[1 : n + 1, None] & i[None]) & 1
    half = (rows.astype(np.uint64) << i.astype(np.uint64)).sum(1, dtype=np.uint64)
    return half | half << np.uint64(32)


def distance_counts(prints: DataFrame, points: np.ndarray) -> np.ndarray:
    """Halves x points x 33: how many fingerprints have each distance, over all of them."""
    shape = (len(HALVES), len(points), 33)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape, np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for h, mask in enumerate(HALVES):
                for k, v in enumerate(points):
                    out[h, k] += np.bincount(np.bitwise_count((x ^ v) & mask), minlength=33)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["at", "n"])

    rows = prints.select("fp").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(np.prod(shape)), np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(shape)


def cuts_at(counts: np.ndarray) -> np.ndarray:
    """Halves x points: the distance at which a cut is nearest to halving the fingerprints."""
    below = np.cumsum(counts, axis=2)
    return 1 + np.abs(2 * below[:, :, :-1] - below[:, :, -1:]).argmin(axis=2)


def shards_of(x: np.ndarray, mask: np.uint64, points: np.ndarray, cuts: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, shard) of every shard of the fingerprints x: a bit for each cut; ``near`` above one, on both sides of it."""
    at, shard = np.arange(len(x)), np.zeros(len(x), np.int64)
    for v, cut in zip(points, cuts, strict=True):
        d = np.bitwise_count((x[at] ^ v) & mask)
        both = (d >= cut) & (d < cut + near)
        shard = np.r_[2 * shard + (d >= cut), 2 * shard[both]]
        at = np.r_[at, at[both]]
    return at, shard


def hamming_links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, planned: int = PLANNED) -> DataFrame:
    """Links (u, v) among distinct fingerprints ``fp`` that join exactly the pairs within ``radius`` bits.

    A pair is within half the radius in one half of the bits. There are as many cuts as halve all fingerprints to
    ``planned`` a shard, at the medians of their distances to the vantage points. A shard gives a spanning forest of
    its pairs, not each pair. One of over ``shard`` points is cut by hash into parts, and each two parts meet in a task
    of their own.
    """
    near = radius // 2
    n = prints.count()
    points = vantage_points(min(31, max(0, int(np.ceil(np.log2(max(n, 1) / planned))))))
    cuts = cuts_at(distance_counts(prints, points)) if len(points) else np.zeros((len(HALVES), 0), np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for h, mask in enumerate(HALVES):
                at, of = shards_of(x, mask, points, cuts[h], near)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), h, np.int32)), pa.array(of), pa.array(x[at].view(np.int64))], names=["half", "shard", "fp"])

    rows = prints.select("fp").mapInArrow(deal, "half int, shard bigint, fp bigint")
    large = rows.groupBy("half", "shard").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    large = large.withColumn("parts", F.ceil(F.col("n") * 2 / shard).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    split = rows.join(large, ["half", "shard"], "left").withColumn("own", own)
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    split = split.select("half", "shard", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "fp")

    def links(cut: np.ndarray, keys: list[np.ndarray], held: list[np.ndarray]) -> pa.RecordBatch:
        x = held[0].view(np.uint64)
        half = np.where(keys[0] == 0, HALVES[0], HALVES[1])
        alike = lambda a, b: np.bitwise_count(x[a] ^ x[b]) <= radius
        return _shard_links(cut, held[0], x & half, near, alike)

    return _search(split, ["half", "shard", "p", "q"], links)


def _set_check(grams: np.ndarray, similarity: float) -> Check:
    """Whether sets, given as bytes of sorted hashes, reach a Jaccard similarity."""
    size = np.array([len(x) for x in grams], np.int64) // 8
    flat, first = np.frombuffer(b"".join(grams), np.uint64), np.r_[0, np.cumsum(size)]

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        live = np.flatnonzero(np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-9)
        live = live[np.argsort(a[live], kind="stable")]
        for same in np.split(live, np.flatnonzero(np.diff(a[live])) + 1) if len(live) else []:
            own = flat[first[a[same[0]]] : first[a[same[0]] + 1]]
            for k in range(0, len(same), 64):
                at = same[k : k + 64]
                other = np.concatenate([flat[first[j] : first[j + 1]] for j in b[at]])
                hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                both = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(size[b[at]])[:-1]])
                out[at] = both >= similarity * (len(own) + size[b[at]] - both) - 1e-9
        return out

    return alike


def _shard_links(cut: np.ndarray, nodes: np.ndarray, x: np.ndarray, radius: int, alike: Check | None = None) -> pa.RecordBatch:
    """Spanning forests of the pairs within ``radius`` bits (and alike) inside the shards cut[g]:cut[g + 1]."""
    sets, size = _Union(len(x)), np.diff(cut)
    of = np.repeat(np.arange(len(size)), size)
    i, step = np.flatnonzero((size > 1)[of] & (size <= 64)[of]), 1
    while len(i):
        i = i[i + step < cut[of[i] + 1]]
        bits = np.bitwise_count(x[i] ^ x[i + step])
        near = i[(bits if x.ndim == 1 else bits.sum(1, dtype=np.int64)) <= radius]
        if alike is not None:
            sets.flatten()
            near = near[sets.up[near] != sets.up[near + step]]
            near = near[alike(near, near + step)]
        sets.join(near, near + step)
        step += 1
    for g in np.flatnonzero(size > 64):
        vantage_tree(x, np.arange(cut[g], cut[g + 1]), radius, sets, alike)
    sets.flatten()
    u, v = nodes, nodes[sets.up]
    apart = u != v
    return pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], names=["u", "v"])


def _search(split: DataFrame, key: list[str], links: Callable[[np.ndarray, list[np.ndarray], list[np.ndarray]], pa.RecordBatch]) -> DataFrame:
    """What ``links`` makes of shards of equal ``key``, each whole in one task: the shards' bounds, the key's columns and
    the others."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def made(cut: np.ndarray, n: int) -> pa.RecordBatch:
            part = [c[:n] for c in held]
            return links(cut, part[: len(key)], part[len(key) :])

        for batch in batches:
            if not len(batch):
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in held[: len(key)]], axis=0))
            if len(change):  # the last shard may go on in the next batch
                stop = change[-1] + 1
                yield made(np.r_[0, change + 1], stop)
                held = [c[stop:] for c in held]
        if held is not None:
            yield made(np.array([0, len(held[0])]), len(held[0]))

    return split.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "u bigint, v bigint")


def _near_search(split: DataFrame, key: list[str], radius: int, similarity: float = 0.0) -> DataFrame:
    """Links (u, v) inside shards by wide fingerprints, and by the sets of hashes where ``similarity`` is given. After
    the key come the node, the fingerprint and the set."""

    def links(cut: np.ndarray, keys: list[np.ndarray], held: list[np.ndarray]) -> pa.RecordBatch:
        nodes, prints, *grams = held
        x = np.frombuffer(b"".join(prints), np.uint64).reshape(len(nodes), -1)
        return _shard_links(cut, nodes, x, radius, _set_check(grams[0], similarity) if grams else None)

    return _search(split, key, links)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``id_col, fp, component_id``: the least id reachable over links of ``radius`` bits or fewer.

    Equal fingerprints are one node, so a group of copies, however large, is one row of the search. Null and empty
    texts have fingerprint 0 and link like any other. Null ids don't count for the least id (a component of none
    but null ids has a null id). Repeated rows are all returned; an empty table gives an empty result; further
    columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    prints = stage_table(simhash_fingerprints(docs, id_col, text_col, shingle).toDF("id", "fp"), "fingerprints")
    kinds = stage_table(prints.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-kinds")
    stars = connected_components(hamming_links(kinds.select("fp"), radius))
    member = stars.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    member = kinds.join(member, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage_table(member.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(named, "fp").select(F.col("id").cast(kind).alias(id_col), "fp", "component_id")


def _shingle_sets(w: tn.Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and where each text's begin (texts + 1); a shorter text is one shingle."""
    lengths, owner = np.diff(w.first), tn.owners(w.first)
    grams = tn.window_hashes(w.hashes, shingle)
    at = np.flatnonzero(owner[: len(grams)] == owner[shingle - 1 :]) if len(grams) else np.zeros(0, np.int64)
    few = np.flatnonzero((lengths > 0) & (lengths < shingle))
    hashes = np.r_[grams[at], tn.span_hashes(w.hashes, w.first[few], w.first[few + 1])] if len(few) else grams[at]
    of = np.r_[owner[at], few]
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.r_[True, (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])] if len(of) else np.zeros(0, bool)
    hashes, of = hashes[new], of[new]
    return hashes, np.searchsorted(of, np.arange(len(lengths) + 1))


def _set_keys(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash for each set: equal for equal sets."""
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(tn.mix(g), dtype=np.uint64)]
    return tn.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))


def _multipliers(n: int) -> np.ndarray:
    return tn.mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def _bands(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sets x bands: hashes of ``BAND_ROWS`` minima each; sets must not be empty."""
    out = []
    for k, m in enumerate(_multipliers(BANDS * BAND_ROWS)):
        least = np.minimum.reduceat(g * m, first[:-1])
        if k % BAND_ROWS == 0:
            out.append(np.full(len(least), k, np.uint64))
        out[-1] = tn.mix(out[-1] * np.uint64(tn.BASE) + least)
    return np.stack(out, axis=1)


def _wide_print(g: np.ndarray) -> bytes:
    """SimHash of ``WIDE`` bits of one set."""
    out = []
    for m in _multipliers(WIDE // 64):
        ones, h = np.zeros(64, np.int64), tn.mix(g * m)
        for i in range(0, len(h), 65536):
            ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(g)).tobytes())
    return b"".join(out)


def similarity_radius(similarity: float) -> int:
    """Bits of ``WIDE`` in which sets of a Jaccard similarity may differ: its cosine's angle, a quarter more (sets of
    a few shingles differ in more bits: of 4 and 5 shingles in 3/16), and four standard deviations."""
    part = 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(WIDE * part + 4 * np.sqrt(WIDE * part * (1 - part))))


def _meet(rows: DataFrame, shard: str, parts: Column, *carried: str) -> DataFrame:
    """``shard, p, q, key`` and the carried columns: shards cut by hash into parts of which each two meet."""
    out = rows.withColumn("parts", parts.cast("int")).withColumn("own", F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts").cast("long")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.select(shard, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "key", *carried)


def near_links(kinds: DataFrame, docs: DataFrame, shingle: int, similarity: float, shard: int = WIDE_SHARD) -> DataFrame:
    """Links (u, v) among the keys of ``kinds`` (key, least, bands) whose sets are alike; ``docs`` has id and text.

    Shards are equal bands; only texts that share one get a wide fingerprint. Each shard is searched by a
    vantage-point tree with a radius that holds every alike pair; a large one is cut into parts that meet in pairs.
    What is linked so is a candidate group: it is searched again with its sets at hand, and links by their exact
    similarity, so each set travels once for its group and not once a band.
    """
    radius = similarity_radius(similarity)
    spread = kinds.where("least is not null").select("key", "least", F.explode("bands").alias("band"))
    shared = stage_table(spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-shards")
    rows = stage_table(spread.join(shared, "band"), "near-candidates")
    some = rows.select("key", "least").distinct()
    texts = docs.join(some, docs.id == some.least).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in tn.token_pieces(batch.column(1), lower=True):
                g, first = _shingle_sets(w, shingle)
                keys = batch.column(0).slice(i, j - i).to_numpy()
                own = np.flatnonzero(_set_keys(g, first).view(np.int64) == keys)  # not another row of the same id
                of = [g[first[t] : first[t + 1]] for t in own]
                yield pa.RecordBatch.from_arrays([pa.array(keys[own]), pa.array([_wide_print(x) for x in of], pa.binary()), pa.array([x.tobytes() for x in of], pa.binary())], names=["key", "print", "grams"])

    made = texts.mapInArrow(run, "key bigint, print binary, grams binary")
    prints = stage_table(made.groupBy("key").agg(F.first(F.struct("print", "grams")).alias("of")).select("key", "of.*"), "near-prints")
    parts = F.when(F.col("n") > shard, F.ceil(F.col("n") * 2 / shard)).otherwise(1)
    loose = connected_components(_near_search(_meet(rows.join(prints.select("key", "print"), "key"), "band", parts, "print"), ["band", "p", "q"], radius))
    drop_table(rows)
    drop_table(shared)
    roots = loose.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(loose.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())
    weight = (F.octet_length("print") + F.octet_length("grams")).cast("long")
    sizes = stage_table(roots.join(prints.select("key", weight.alias("bytes")), "key").groupBy("root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")), "near-groups")
    load = F.greatest(F.col("n") / min(shard, GROUP_SHARD), F.col("bytes") / WIDE_BYTES)
    groups = roots.join(sizes, "root").join(prints, "key")
    return _near_search(_meet(groups, "root", F.when(load > 1, F.ceil(load * 2)).otherwise(1), "print", "grams"), ["root", "p", "q"], radius, similarity)


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with the least id of their group of near copies, all columns.

    Texts with the same set of shingles are one node. Others link where the Jaccard similarity of their sets of
    64-bit shingle hashes reaches ``similarity``, exactly; candidates come from ``WIDE`` bits of SimHash. A radius that
    holds such pairs is far too wide for shards by distance, so these are bands of minima, which a pair at 0.8 shares
    but for once in 38,000 times.

    Null and empty texts are one group. Of rows that repeat the least id each stays. Rows with a null id stay where
    no other id has their set, and aren't compared further. Ties go by id; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in tn.token_pieces(batch.column(1), lower=True):
                g, first = _shingle_sets(w, shingle)
                real = np.flatnonzero(np.diff(first))
                sizes = np.zeros(j - i + 1, np.int32)
                sizes[real + 1] = BANDS
                bands = _bands(g, np.r_[first[real], len(g)]).ravel().view(np.int64) if len(real) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(bands))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(_set_keys(g, first).view(np.int64)), lists], names=["id", "key", "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = only(docs, id_col, text_col).toDF("id", "text")
    signed = stage_table(texts.mapInArrow(run, f"id {kind}, key bigint, bands array<bigint>"), "near-signatures")
    kinds = stage_table(signed.groupBy("key").agg(F.min("id").alias("least"), F.first("bands").alias("bands")), "near-kinds")
    stars = connected_components(near_links(kinds, texts, shingle, similarity))
    roots = stars.select(F.col("u").alias("key"), F.col("v").alias("root"))
    member = kinds.select("key", "least").join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    # a document stays if it has its set's least id, and that is the least one of the group
    stay = stage_table(member.join(least, "root").where(F.col("least").eqNullSafe(F.col("component_id"))).select("key", "least"), "near-kept")
    drop_table(kinds)
    keep = signed.join(stay, "key").where(F.col("id").eqNullSafe(F.col("least"))).select(F.col("id").alias("_keep")).distinct()
    return docs.join(keep, docs[f"`{id_col}`"].eqNullSafe(keep["_keep"]), "left_semi")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
