"""Benchmark decontamination by latent semantic retrieval, then word sequence and answer checks.

1. Document frequencies of hashed words over the whole corpus give the TF-IDF weights.
2. Benchmark items are cut into passages; a randomised SVD of their TF-IDF matrix, multiplied in Spark, gives a
   latent space of fixed rank. Scores are divided by the part of an item that the rank holds. (Fitted on corpus
   passages, the leading directions are languages and stop words, and passages of a language are all alike.) A
   benchmark of over ``PART_WORDS`` words is cut into parts by a hash, each with an index of its own, so that no index
   is larger than one of so many words.
3. Every passage of every document is scored by cosine: its projection against the items' passages, over its whole
   TF-IDF norm. The cosine can't exceed the share of the norm that words of the benchmark's vocabulary have
   (Cauchy-Schwarz); where a bound of that share, which counts a repeated word with its square, is below the
   threshold, the passage isn't projected.
4. That norm is of the whole passage, so words beside a short item, or an item whose words are common, can hide a copy.
   Passages are therefore also searched for the rarer half of each item's words, one of which any accepted match has,
   and are candidates if enough of the item's words stand within the item's length, in any order. Only a match that is
   stretched further than that depends on the cosine.
5. A candidate counts if the longest common subsequence of words covers enough of the item, or less of it with the
   item's answer (its last clause) in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tomewright.llm import textnum as tn
from tomewright.llm.common import WORD, only, read_table, stage_table

#: Hash buckets of words; latent rank; words of a passage; words from one to the next, in items and in documents.
BUCKETS, RANK, PASSAGE, ITEM_STRIDE, STRIDE = 1 << 17, 128, 24, 8, 8
#: Least cosine of a candidate; least share of an item's words in the common subsequence, alone and with the answer.
COSINE, SEQUENCE, WITH_ANSWER, ANSWER_WORDS = 0.45, 0.7, 0.5, 8
#: Words of a part of the benchmark, about: what the driver holds and executors are sent at once.
PART_WORDS, SEED = 500_000, 7


class Index(NamedTuple):
    """What is sent to executors: bounded by the buckets, the rank and the benchmark's size."""

    weight: np.ndarray  # by bucket: idf
    row: np.ndarray  # by bucket: row of latent, or -1
    latent: np.ndarray  # benchmark vocabulary x rank
    passages: np.ndarray  # benchmark passages x rank, scaled so that a copy of the passage scores 1
    item_of: np.ndarray  # by passage
    items: list[np.ndarray]  # word hashes by item
    ids: list
    vocabulary: np.ndarray  # word hashes of all items
    words: list[np.ndarray]  # by item: its words as places in vocabulary
    keys: list[np.ndarray]  # by item: its rarest words, one more than an accepted match can lack


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(47)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket, df``: documents in which a hashed word occurs, over all documents; bucket -1 counts the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, _, w in tn.token_pieces(batch.column(0), lower=True):
                keys = np.unique(_bucket(w.hashes) + tn.owners(w.first) * BUCKETS)
                df += np.bincount(keys % BUCKETS, minlength=BUCKETS)
            n += len(batch)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["bucket", "df"])

    return only(docs, text_col).mapInArrow(count, "bucket bigint, df bigint").groupBy("bucket").agg(F.sum("df").alias("df"))


def _cuts(n: int) -> np.ndarray:
    """First words of the passages of an item of n words; the last passage ends the text."""
    return np.unique(np.r_[np.arange(0, max(1, n - PASSAGE + 1), ITEM_STRIDE), max(0, n - PASSAGE)])


def _passages(hashes: list[np.ndarray]) -> list[np.ndarray]:
    return [h[a : a + PASSAGE] for h in hashes for a in _cuts(len(h))]


def randomised_svd(rows: DataFrame, size: int, rank: int, turns: int = 2, seed: int = SEED) -> np.ndarray:
    """Leading right singular vectors of a sparse matrix given as rows ``at array<int>, value array<float>``.

    A is multiplied where its rows are: each turn sends a size x rank block out and adds up A'AX by columns of A in
    a shuffle; size x rank (both fixed by the caller) reach the driver.
    """
    rank = min(rank + 8, size)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0].astype(np.float32)
    for _ in range(turns):
        sent = rows.sparkSession.sparkContext.broadcast(x)

        def multiply(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = np.zeros(sent.value.shape, np.float32)
            for batch in batches:
                for at, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    v = np.array(value, np.float32)
                    np.add.at(out, at, np.outer(v, v @ sent.value[at]))
            at = np.flatnonzero(out.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(out[at]), pa.list_(pa.float32()))], names=["at", "sums"])

        def add(batches: Iterator[pa.RecordBatch], shape=x.shape) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape, np.float64)
            for batch in batches:
                np.add.at(out, batch.column(0).to_numpy(), np.array(batch.column(1).flatten()).reshape(-1, shape[1]))
            at = np.flatnonzero(out.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(out[at].astype(np.float32)), pa.list_(pa.float32()))], names=["at", "sums"])

        found = rows.mapInArrow(multiply, "at bigint, sums array<float>").repartition("at").mapInArrow(add, "at bigint, sums array<float>").toPandas()
        y = np.zeros(x.shape)
        if len(found):
            y[found["at"].to_numpy()] = np.stack(found["sums"].to_numpy())
        x = np.linalg.qr(y)[0].astype(np.float32)
        sent.unpersist()
    return x[:, : max(1, rank - 8)]


def term_weights(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """idf by bucket, of all documents."""
    df = document_frequencies(docs, text_col).toPandas()
    counts = np.zeros(BUCKETS)
    at = df["bucket"].to_numpy()
    counts[at[at >= 0]] = df["df"].to_numpy()[at >= 0]
    total = int(df["df"].to_numpy()[at < 0].sum())
    return np.log((total + 1) / (counts + 0.5)).astype(np.float32).clip(0.01)


def benchmark_parts(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", most: int = PART_WORDS) -> list[DataFrame]:
    """The items with an id and a word as relations ``id, text`` of about ``most`` words each."""
    items = only(benchmark, item_col, text_col).toDF("id", "text").where(F.col("id").isNotNull() & F.col("text").isNotNull())
    words = items.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    parts = max(1, -(-words // most))
    part = F.pmod(F.xxhash64("id", "text", F.lit(5)), F.lit(parts))
    return [items.where(part == k) for k in range(parts)] if parts > 1 else [items]


def fit_index(weight: np.ndarray, items: DataFrame) -> Index:
    """The latent index of a part of the benchmark, ``id, text``. It is held whole by the driver and each worker."""
    spark, found = items.sparkSession, items.collect()
    hashes, ids = [], []
    for i, text in sorted(found, key=lambda x: x[0]):
        raw = np.frombuffer(text.encode(), np.uint8)
        w = tn.tokenise(raw, np.array([0, len(raw)]), lower=True)
        if len(w.hashes):
            hashes.append(w.hashes)
            ids.append(i)
    every = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    words = [np.searchsorted(every, h) for h in hashes]
    rare = [v[np.argsort(-weight[_bucket(h)], kind="stable")] for v, h in zip(words, hashes, strict=True)]
    keys = [np.unique(v[: len(v) - int(np.ceil(WITH_ANSWER * len(v))) + 1]) for v in rare]
    parts = _passages(hashes)
    item_of = np.repeat(np.arange(len(hashes)), [len(_cuts(len(h))) for h in hashes]).astype(np.int64)
    vocabulary = np.unique(_bucket(np.concatenate(parts))) if parts else np.zeros(0, np.int64)
    row = np.full(BUCKETS, -1, np.int64)
    row[vocabulary] = np.arange(len(vocabulary))
    if not parts:
        return Index(weight, row, np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32), item_of, hashes, ids, every, words, keys)
    norms = np.array([np.linalg.norm(np.bincount(row[_bucket(p)], weights=weight[_bucket(p)])) for p in parts])
    matrix = spark.createDataFrame([(row[_bucket(p)].tolist(), (weight[_bucket(p)] / n).tolist()) for p, n in zip(parts, norms, strict=True)], "at array<int>, value array<float>")
    latent = randomised_svd(matrix.repartition(max(1, len(parts) // 500)), len(vocabulary), RANK)
    reduced = np.stack([(weight[_bucket(p)][:, None] * latent[row[_bucket(p)]]).sum(0) for p in parts])
    # divided by its length (cosine) and by the part of the passage that the rank holds: a copy scores 1
    reduced *= norms[:, None] / (np.linalg.norm(reduced, axis=1, keepdims=True) ** 2).clip(1e-9)
    return Index(weight, row, latent, reduced.astype(np.float32), item_of, hashes, ids, every, words, keys)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit rows (Hyyro): a word of b a step."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = v & places.get(x, 0)
        v = ((v + m) | (v - m)) & full
    return len(a) - v.bit_count()


def has_answer(item: np.ndarray, near: np.ndarray, words: int = ANSWER_WORDS) -> bool:
    """Whether the item's last words stand in the text in order, with half as many others between them at most."""
    answer = item[-words:]
    span = len(answer) + max(1, len(answer) // 2)
    ends = np.flatnonzero(near == answer[-1])
    return any(common_subsequence(answer, near[max(0, e + 1 - span) : e + 1]) == len(answer) for e in ends)


def _by_keys(w: tn.Words, index: Index, bucket: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items and first words of the passages with a key of the item and, near it, enough of the item's words in any order."""
    n, size = len(w.hashes), len(index.vocabulary)
    at = np.flatnonzero(index.row[bucket] >= 0)
    v = np.searchsorted(index.vocabulary, w.hashes[at]).clip(max=size - 1)
    exact = index.vocabulary[v] == w.hashes[at]
    at, v = at[exact], v[exact]
    own = np.full(n, size)
    own[at] = v
    # by word: where the same word stood before in the text, so that a window counts each word once
    before = np.full(n, -1)
    group = owner[at] * size + v
    order = np.argsort(group, kind="stable")
    again = group[order[1:]] == group[order[:-1]]
    before[at[order[1:]][again]] = at[order[:-1]][again]
    is_key = np.zeros(size, bool)
    is_key[np.concatenate(index.keys)] = True
    at, v = at[is_key[v]], v[is_key[v]]
    hit = np.unique(v * n + at - (at - w.first[owner[at]]) % STRIDE)
    hit_word, hit_at = hit // n, hit % n
    ends = np.searchsorted(hit_word, np.arange(size + 1))
    items, places = [], []
    weigh = np.zeros(size + 1, np.int64)
    for item, (words, keys) in enumerate(zip(index.words, index.keys, strict=True)):
        keys = keys[ends[keys + 1] > ends[keys]]
        if not len(keys):
            continue
        at = np.unique(np.concatenate([hit_at[ends[k] : ends[k + 1]] for k in keys.tolist()]))
        length, answer = len(words), np.unique(words[-ANSWER_WORDS:])
        weigh[:size] = np.bincount(words, minlength=size)
        weigh[answer] += 1 << 32
        low = np.maximum(w.first[owner[at]], at - length)
        high = np.minimum(w.first[owner[at] + 1], at + PASSAGE + length)
        width = PASSAGE + 2 * length
        step = max(1, (1 << 20) // width)
        for k in range(0, len(at), step):
            lo, hi = low[k : k + step, None], high[k : k + step, None]
            near = lo + np.arange(width)
            fresh = near < hi
            np.minimum(near, n - 1, out=near)
            total = (weigh[own[near]] * (fresh & (before[near] < lo))).sum(1)
            share = (total & 0xFFFFFFFF) / length
            ok = (share >= SEQUENCE) | ((share >= WITH_ANSWER) & (total >> 32 == len(answer)))
            places.append(at[k : k + step][ok])
            items.append(np.full(len(places[-1]), item))
        weigh[words] = 0
    return (np.concatenate(items), np.concatenate(places)) if items else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _earlier_equal(w: tn.Words, bucket: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places of the benchmark's words, and how many words of the same bucket stand within a passage before each.

    The square of a word that a passage holds m times is m squared: m, and two for each pair.
    """
    at = np.flatnonzero(index.row[bucket] >= 0)
    key = index.row[bucket[at]] * np.int64(len(bucket)) + at
    order = np.argsort(key, kind="stable")
    key = key[order]
    out = np.zeros(len(at), np.int64)
    # across texts, too: that can only raise the bound
    out[order] = np.arange(len(at)) - np.maximum(np.searchsorted(key, key - PASSAGE + 1), np.searchsorted(key, key - key % len(bucket))) if len(at) else 0
    return at, out


def _search(w: tn.Words, index: Index) -> list[tuple[int, int, float, float, bool]]:
    """(text, item, cosine, share, answer) of the accepted pairs of a piece."""
    n = len(w.hashes)
    if not n or not len(index.item_of):
        return []
    bucket = _bucket(w.hashes)
    heavy = index.weight[bucket].astype(np.float64) ** 2
    known = np.where(index.row[bucket] >= 0, heavy, 0)
    at, earlier = _earlier_equal(w, bucket, index)
    more = np.zeros(n)
    more[at] = 2 * earlier * heavy[at]
    all_sum, known_sum, more_sum = (np.r_[0, np.cumsum(x)] for x in (heavy, known, known + more))
    lengths = np.diff(w.first)
    owner, word = tn.owners(w.first), np.arange(n) - np.repeat(w.first[:-1], lengths)
    length = lengths[owner]
    first = np.flatnonzero(((word % STRIDE == 0) & (word + PASSAGE <= length)) | (word == np.maximum(length - PASSAGE, 0)))
    last = np.minimum(first + PASSAGE, first - word[first] + length[first])
    whole, inside, most = all_sum[last] - all_sum[first], known_sum[last] - known_sum[first], more_sum[last] - more_sum[first]
    live = most >= COSINE**2 * (most + whole - inside) * (1 - 1e-9)
    first, last, whole = first[live], last[live], whole[live]
    item, place = _by_keys(w, index, bucket, owner)
    # passages of the keys are projected for their cosine, however small
    a = np.unique(place)
    b = np.minimum(a + PASSAGE, w.first[owner[a] + 1])
    first, last, forced = np.r_[first, a], np.r_[last, b], np.r_[np.zeros(len(first), bool), np.ones(len(a), bool)]
    whole = np.r_[whole, all_sum[b] - all_sum[a]]
    by_passage = np.argsort(place, kind="stable")
    item, place = item[by_passage], place[by_passage]
    begin = np.flatnonzero(np.r_[True, index.item_of[1:] != index.item_of[:-1]])
    found = []
    for k in range(0, len(first), 4096):
        a, b, c = first[k : k + 4096], last[k : k + 4096], forced[k : k + 4096]
        at = np.minimum(a[:, None] + np.arange(PASSAGE), n - 1)
        rows = index.row[bucket[at]]
        value = np.where((at < b[:, None]) & (rows >= 0), index.weight[bucket[at]], 0).astype(np.float32)
        x = np.zeros((len(a), index.latent.shape[1]), np.float32)
        for j in range(PASSAGE):
            x += value[:, j, None] * index.latent[rows[:, j]]
        cosine = (x @ index.passages.T) / np.sqrt(whole[k : k + 4096]).astype(np.float32)[:, None]
        p, q = np.nonzero((cosine >= COSINE) & ~c[:, None])
        # whole sums each word's square alone; where a word is repeated the norm is larger
        near, back = np.unique(np.r_[p, np.flatnonzero(c)], return_inverse=True)
        heavy_near = np.where(at[near] < b[near, None], index.weight[bucket[at[near]]], 0)
        alike = bucket[at[near]][:, :, None] == bucket[at[near]][:, None, :]
        exact = np.einsum("ni,nij,nj->n", heavy_near, alike, heavy_near)
        scale = np.sqrt(whole[k : k + 4096][near] / np.maximum(exact, 1e-9))
        true = cosine[p, q] * scale[back[: len(p)]]
        p, q, true = p[true >= COSINE], q[true >= COSINE], true[true >= COSINE]
        found.append(np.c_[owner[a[p]], index.item_of[q], a[p], true * 1e6].astype(np.int64))
        p = np.flatnonzero(c)
        if len(p):
            lo, hi = np.searchsorted(place, [a[p[0]], a[p[-1]] + 1])
            best = np.maximum.reduceat(cosine[p], begin, axis=1) * scale[np.searchsorted(near, p), None]
            true = best[np.searchsorted(a[p], place[lo:hi]), item[lo:hi]]
            found.append(np.c_[owner[place[lo:hi]], item[lo:hi], place[lo:hi], true * 1e6].astype(np.int64))
    if not found:
        return []
    found = np.concatenate(found)
    found = found[np.lexsort((-found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    out: dict[tuple[int, int], tuple[float, float, bool]] = {}
    seen: dict[tuple[int, int], int] = {}
    for text, item, at, cosine in found.tolist():
        words = index.items[item]
        if seen.get((text, item), -1) >= at:
            continue
        lo, hi = max(w.first[text], at - len(words)), min(w.first[text + 1], at + PASSAGE + len(words))
        near = w.hashes[lo:hi]
        seen[text, item] = at
        if np.isin(words, near).mean() < WITH_ANSWER:
            continue
        share, answer = common_subsequence(words, near) / len(words), has_answer(words, near)
        if share >= SEQUENCE or (share >= WITH_ANSWER and answer):
            out[text, item] = max(out.get((text, item), (0.0, 0.0, False)), (share, cosine / 1e6, answer))
    return [(text, item, cosine, share, answer) for (text, item), (share, cosine, answer) in out.items()]


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS
) -> DataFrame:
    """``id_col, item_id, cosine, share, answer``: a row for each document and benchmark item found in it.

    Whole texts are searched. Null and empty texts and items match nothing, and so do items with a null id; ids may be
    of any type. Repeated rows are each searched and repeated items each found; equal items are all found; an empty
    table gives an empty result; further columns are dropped. Sent out is the index alone: bounded by 2**17 buckets,
    the rank, and ``part_words`` words of the benchmark; a larger one is searched part by part.
    """
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    weight, out = term_weights(docs, text_col), None
    for items in benchmark_parts(benchmark, item_col, item_text_col, part_words):
        sent = docs.sparkSession.sparkContext.broadcast(fit_index(weight, items))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, names = sent.value, [id_col, "item_id", "cosine", "share", "answer"]
            item_type = to_arrow_type(item_kind)
            for batch in batches:
                for i, _, w in tn.token_pieces(batch.column(1), lower=True):
                    text, item, cosine, share, answer = map(list, zip(*got, strict=True)) if (got := _search(w, index)) else ([],) * 5
                    ids = batch.column(0).take(pa.array([i + t for t in text], pa.int64()))
                    columns = [ids, pa.array([index.ids[k] for k in item], item_type), pa.array(cosine, pa.float64()), pa.array(share, pa.float64())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(answer, pa.bool_())], names=names)

        schema = f"`{id_col}` {kind.simpleString()}, item_id {item_kind.simpleString()}, cosine double, share double, answer boolean"
        found = only(docs, id_col, text_col).mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_words: int = PART_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark item is found; a pass a part of the benchmark, no join.

    Each row is judged by its own text, whatever its id: null and repeated ids don't matter. Null and empty texts stay;
    an empty table, or an empty benchmark, takes nothing away.
    """
    at, out, weight = docs.columns.index(text_col), docs, term_weights(docs, text_col)
    for k, items in enumerate(benchmark_parts(benchmark, item_col, item_text_col, part_words)):
        sent = docs.sparkSession.sparkContext.broadcast(fit_index(weight, items))
        out = stage_table(out, "clean-documents") if k else out  # so that a worker holds one index

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for batch in batches:
                for i, j, w in tn.token_pieces(batch.column(at), lower=True):
                    clean = np.ones(j - i, bool)
                    clean[[text for text, *_ in _search(w, index)]] = False
                    yield batch.slice(i, j - i).filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), F.round("share", 4).alias("share"), "answer")
