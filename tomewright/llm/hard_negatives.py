"""Hard-negative mining by blocked dense matrix products.

Anchors go out in waves of bounded size: a wave's matrix is broadcast, and every task multiplies it, block by block, with
its candidates' in float64, which is exact below 2**53. The first pass keeps the best rows of the anchor's own label,
the second those of other labels whose score lies in the window of each of these positives. A task keeps a bounded list
for each anchor of the wave; such lists merge by score and id, in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.llm.common import drop_table, only, read_table, stage_table

POSITIVES, NEGATIVES, WINDOW, SCALE = 5, 5, (80, 100), 256
#: Bytes of a wave's matrix; anchors and candidates of a block; what a product may reach at most.
WAVE_BYTES, ANCHORS, CANDIDATES = 32 << 20, 512, 4096
#: Results of a repeated anchor that are unfolded at a time.
COPIES = 1024
EXACT, MOST = float(1 << 53), 1 << 56

PAIRS = "uid long, q long, id long, score long"


def prepared_vectors(vectors: DataFrame, label: Column, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``id, label, v, anchor, n``: usable rows with components floor(scale * x) as doubles; equal rows are one, n times."""
    x = F.col(vector_col)
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), x.alias("x"), is_anchor.alias("anchor"), usable.alias("ok"))
    rows = rows.where("id is not null and label is not null and x is not null and ok")
    v = F.transform("x", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    rows = rows.select("id", "label", F.coalesce("anchor", F.lit(False)).alias("anchor"), v.alias("v"))
    return rows.groupBy("id", "label", "anchor", "v").agg(F.count("*").alias("n"))


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of lists as a float64 matrix, at least ``width`` wide; shorter rows end in zeros."""
    offsets = vectors.offsets.to_numpy()
    flat, lengths = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole-numbered rows: float64 where no sum can reach 2**53, else Python's integers, which stop at
    2**56 either way."""
    wide = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) if x.shape[1] < wide else x for x in (a, b))
    with np.errstate(over="ignore"):
        most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * wide
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(c) for c in row] for row in x], object).reshape(x.shape) for x in (a, b)]
    return np.clip(whole[0].dot(whole[1].T), -MOST, MOST).astype(np.int64).reshape(len(a), len(b))


def best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's first ``most`` allowed entries by score, equal ones by column."""
    if scores.shape[1] > most:
        low = np.iinfo(np.int64).min
        masked = np.where(allowed, scores, low)
        least = np.partition(masked, -most, axis=1)[:, -most][:, None]
        level = allowed & (masked == least)
        allowed = allowed & (masked > least) | level & (np.cumsum(level, axis=1, dtype=np.int32) <= most)
    row, col = np.nonzero(allowed)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < most], col[nth < most]


class Lists:
    """The best (score, id) of each query seen so far: score falling, then id rising."""

    def __init__(self, most: int):
        self.most, self.rows = most, np.zeros((3, 0), np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([query, score, ids])], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        self.rows = rows[:, np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0]) < self.most]


def _blocks(batches: Iterator[pa.RecordBatch], copies: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates in blocks, ascending by id: ids, labels, matrix, and which copy of an equal row this is."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            cut = batch.slice(at, CANDIDATES)
            ids, label, n = (cut[c].to_numpy() for c in ("id", "label", "n"))
            row = np.repeat(np.arange(len(ids)), np.minimum(n, copies))
            row = row[np.argsort(ids[row], kind="stable")]
            copy = np.arange(len(row)) - np.searchsorted(row, row) if (np.diff(row) >= 0).all() else _copy_numbers(row)
            yield ids[row], label[row], matrix(cut["v"])[row], copy


def _copy_numbers(row: np.ndarray) -> np.ndarray:
    order = np.argsort(row, kind="stable")
    out = np.empty(len(row), np.int64)
    out[order] = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    return out


def _search(wave, second: bool, most: int, window: tuple[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best rows of each query of the wave in one partition: queries are anchors, or (second pass) their positives."""
    uid, ids, labels, vectors, known = wave.value
    ways = known.shape[1] if second else 1
    lists = {at: Lists(most) for at in range(0, len(uid), ANCHORS)}
    for block in _blocks(batches, most + 1):
        for at, kept in lists.items():
            cut = slice(at, at + ANCHORS)
            for value in np.unique(labels[cut]):  # anchors are in the order of their labels
                rows = at + np.flatnonzero(labels[cut] == value)
                cid, c, copy = (x[(block[1] == value) != second] for x in (block[0], block[2], block[3]))
                scores = products(vectors[rows], c)
                if second:
                    for k in range(ways):
                        limit = known[rows, k][:, None]  # the score of the k-th positive; none: nothing is in its window
                        inside = (100 * scores <= window[1] * limit) & (100 * scores >= window[0] * limit) & (limit >= -MOST)
                        if inside.any():
                            row, col = best(scores, inside, most)
                            kept.add(rows[row] * ways + k, scores[row, col], cid[col])
                    continue
                other = np.ones(scores.shape, bool)
                for i, j in np.argwhere((ids[rows][:, None] == cid[None, :]) & (copy == 0)):  # few: the same id
                    w = min(vectors.shape[1], c.shape[1])
                    other[i, j] = not np.array_equal(vectors[rows[i], :w], c[j, :w]) or vectors[rows[i], w:].any() or c[j, w:].any()
                row, col = best(scores, other, most)
                kept.add(rows[row], scores[row, col], cid[col])
    query, score, found = np.concatenate([x.rows for x in lists.values()], axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[query // ways], query % ways, found, score)], ["uid", "q", "id", "score"])


def merged(pairs: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each query's rows, with their rank from 1."""
    order = Window.partitionBy("uid", "q").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def wave_bounds(anchors: DataFrame, most: int) -> list[tuple[int, int]]:
    """Ranges of ``uid`` with at most ``most`` anchors each; the rows of each partition are numbered from its number << 33."""
    sizes = anchors.groupBy(F.shiftright("uid", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    cuts = [((r.part << 33) + at, min(most, r.n - at)) for r in sizes for at in range(0, r.n, most)]
    out: list[list[int]] = []
    for at, n in cuts:
        if out and out[-1][2] + n <= most:
            out[-1][1:] = [at + n, out[-1][2] + n]
        else:
            out.append([at, at + n, n])
    return [(lo, hi) for lo, hi, _ in out]


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows that ``is_anchor`` names.

    Components are floor(scale * x), a score is an inner product; higher scores come first, ties by smaller id. An
    anchor's positives are its first ``positives`` other rows of the same label; a positive's negatives the first
    ``negatives`` rows of another label from window[0] to window[1] percent of its score. Rows with a null id, label or
    vector, or a null or non-finite component, take no part. Repeated rows are rows of their own, other to each other,
    and each repeated anchor has its own results. A shorter vector ends in zeros; scores stop at 2**56. An empty table,
    or none of the anchors, gives an empty result; further columns are dropped.

    Each wave of anchors (``wave_bytes`` of matrix, broadcast and then destroyed) reads all candidates twice. What the
    driver sees is a wave and its positives.
    """
    spark = vectors.sparkSession
    rows = stage_table(prepared_vectors(vectors, label, is_anchor, id_col, vector_col, scale), "vectors")
    anchors = rows.where("anchor").withColumn("uid", F.monotonically_increasing_id())
    anchors = stage_table(anchors.select("uid", "id", "label", "v", "n"), "anchors")
    width = max(1, anchors.agg(F.max(F.size("v"))).first()[0] or 1)
    candidates, out = rows.select("id", "label", "v", "n"), []
    for lo, hi in wave_bounds(anchors, max(1, wave_bytes // (8 * width))):
        own = anchors.where(F.col("uid").between(lo, hi - 1))
        table = own.select("uid", "id", "label", "v").orderBy("label", "uid").toArrow().combine_chunks()
        uid, ids, labels = (table[c].to_numpy() for c in ("uid", "id", "label"))
        a = matrix(pa.concat_arrays(table["v"].chunks), width)
        wave = [spark.sparkContext.broadcast((uid, ids, labels, a, np.zeros((len(uid), 0), np.int64)))]
        found = candidates.mapInArrow(partial(_search, wave[0], False, positives, window), PAIRS)
        found = stage_table(merged(found, positives).select("uid", F.col("rank").alias("k"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        got, by_uid = found.select("uid", "k", "positive_score").toArrow(), np.argsort(uid)
        known = np.full((len(uid), positives), -MOST - 1, np.int64)
        known[by_uid[np.searchsorted(uid, got["uid"].to_numpy(), sorter=by_uid)], got["k"].to_numpy() - 1] = got["positive_score"].to_numpy()
        wave.append(spark.sparkContext.broadcast((uid, ids, labels, a, known)))
        pairs = candidates.mapInArrow(partial(_search, wave[1], True, negatives, window), PAIRS)
        pairs = merged(pairs, negatives).select("uid", (F.col("q") + 1).alias("k"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        result = found.join(pairs, ["uid", "k"]).join(own.select("uid", F.col("id").alias("anchor_id"), "n"), "uid")
        # an anchor that occurs n times has its results n times
        result = result.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score", "n")
        out.append(stage_table(result, "hard-negatives"))
        for b in wave:
            b.destroy()
        drop_table(found)
    drop_table(anchors)
    drop_table(rows)
    final = out[0] if out else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long, n long")
    for part in out[1:]:
        final = final.unionByName(part)
    chunk = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))
    final = final.withColumn("chunk", F.explode(chunk))
    more = F.array_repeat(F.lit(0), F.least(F.col("n") - F.col("chunk") * COPIES, F.lit(COPIES)).cast("int"))
    return final.withColumn("more", F.explode(more)).drop("n", "chunk", "more")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth of every tenth id is an anchor; labels of ids divisible by 7 are moved on by one."""
    vectors = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, label, F.col("vec_id") % 100 == 0)


OP11_SQL = """
with r as (select row_number() over () as u, vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.u as au, a.id as anchor_id, c.u as cu, c.id, a.label = c.label as same,
    coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::bigint as score
  from r a, r c where a.id % 100 = 0 and a.u <> c.u),
p as (select * from s where same qualify row_number() over (partition by au order by score desc, id) <= 5),
n as (select p.anchor_id, p.id as positive_id, s.id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.au, p.cu order by s.score desc, s.id) as rank
  from p join s on s.au = p.au and not s.same and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5"""
