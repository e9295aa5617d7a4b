"""Quality classification by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm import textnum as tn
from tomewright.llm.common import crc_mod, only, read_table
from tomewright.llm.features import row_key, sample_per_class, subword_counts

#: log2 of byte trigram buckets, latent rank, neighbours, power of the similarity in a vote, labelled rows of a class.
BITS, RANK, NEIGHBOURS, POWER, PER_CLASS = 10, 48, 15, 4, 1500
#: Word shapes (256), then two repetition terms, after the trigram buckets.
SHAPES = 258
TERMS = (1 << BITS) + SHAPES
#: Documents whose products with all labelled vectors are computed at once.
BLOCK = 512

_UPPER, _SIGN, _DIGIT = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN[np.frombuffer(b"#*$%&|<>!@^~=+_\\/{}[]", np.uint8)] = True
_DIGIT[48:58] = True


class Index(NamedTuple):
    weight: np.ndarray  # by term: idf
    latent: np.ndarray  # terms x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1
    labels: np.ndarray


def _some(mask: np.ndarray, w: tn.Words) -> np.ndarray:
    sums = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(mask[w.data], out=sums[1:])
    return np.minimum(sums[w.ends] - sums[w.starts], 2)


def term_counts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Texts x terms: byte trigrams, word shapes, words equal to the one before, words in repeated 3-word windows."""
    grams = subword_counts(data, bounds, (3,), BITS, False)
    w = tn.tokenise(data, bounds)
    n, owner = len(bounds) - 1, tn.owners(w.first)
    length = w.ends - w.starts
    size = np.searchsorted([1, 2, 3, 6, 10, 15, 25], length)
    shape = ((np.minimum(_some(_UPPER, w), 2) * 3 + _some(_SIGN, w)) * 3 + _some(_DIGIT, w)) * 8 + size
    extra = np.bincount(owner * SHAPES + shape, minlength=n * SHAPES).reshape(n, SHAPES)
    if len(owner) > 1:
        same = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
        extra[:, 256] = np.bincount(owner[1:][same], minlength=n)
    if len(owner) >= 3:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        twice, _ = tn.repeats(tn.window_hashes(w.hashes, 3)[at] ^ tn.mix(owner[at].astype(np.uint64) + np.uint64(1)))
        extra[:, 257] = np.bincount(owner[at[twice]], minlength=n)
    return np.hstack([grams, extra])


def _vectors(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """TF-IDF rows of length 1: root shares of the trigrams, and of the shapes, times idf."""
    cut = 1 << BITS
    x = counts.astype(np.float32)
    for part in (x[:, :cut], x[:, cut:]):
        part /= np.maximum(part.sum(1, keepdims=True), 1)
    x = np.sqrt(x, out=x) * weight
    for part in (x[:, :cut], x[:, cut:]):
        part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return x


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray]]:
    data, bounds = tn.buffers(batch.column(column))
    for i, j in tn.pieces(data, bounds, 1_000_000):
        for a in range(i, j, 2048):
            b = min(j, a + 2048)
            yield a, b, term_counts(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])


def term_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, _, x in _pieces(batch, 0):
                df += (x > 0).sum(0)
            n += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS)), pa.array(np.r_[n, df])], names=["term", "df"])

    rows = only(docs, text_col).mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(TERMS + 1, np.int64)
    df[rows["term"].to_numpy() + 1] = rows["df"].to_numpy()
    return df[1:], int(df[0])


def fit_quality_index(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Index | None:
    """Latent vectors of about ``PER_CLASS`` labelled documents of either label; idf is that of all documents."""
    df, total = term_frequencies(docs, text_col)
    weight = np.log((total + 1) / (df + 0.5)).clip(0.05).astype(np.float32)
    rows = only(labels, id_col, label_col).toDF("id", "label").where(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    keyed = only(docs, id_col, text_col).toDF("id", "text").withColumn("key", row_key("id", "text"))
    # about PER_CLASS keys of either label, whatever their ids
    chosen = sample_per_class(keyed.select("id", "key").join(rows, "id"), "label", "key", PER_CLASS, 2 * PER_CLASS).select("label", "key").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in _pieces(batch, 1):
                rows = [r.tobytes() for r in _vectors(x, weight)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(rows, pa.binary())], names=["label", "x"])

    texts = keyed.join(F.broadcast(chosen), "key").groupBy("key").agg(F.first("label").cast("int").alias("label"), F.first("text").alias("text")).select("label", "text")
    sample = texts.mapInArrow(count, "label int, x binary").toPandas().sort_values(["label", "x"])
    if not len(sample):
        return None
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(len(sample), -1)
    latent = np.linalg.svd(x.T @ x, hermitian=True)[0][:, :RANK].astype(np.float32)
    vectors = x @ latent
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True).clip(1e-9)
    return Index(weight, latent, vectors, sample["label"].to_numpy(np.float32))


def vote(vectors: np.ndarray, index: Index) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by a power of their cosine; 0 without any."""
    out = np.zeros(len(vectors))
    k = min(NEIGHBOURS, len(index.vectors))
    for a in range(0, len(vectors), BLOCK):
        cosine = vectors[a : a + BLOCK] @ index.vectors.T
        at = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.take_along_axis(cosine, at, 1).clip(0).astype(np.float64) ** POWER
        total = weight.sum(1)
        out[a : a + BLOCK] = np.where(total > 0, (weight * index.labels[at]).sum(1) / np.maximum(total, 1e-12), 0)
    return out.clip(0, 1)


def classify_quality(docs: DataFrame, index: Index | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted``: the vote for label 1, and 1 if it is at least a half.

    Texts without a word (null, empty, blank) hold nothing and score 0, and so do all if nothing was labelled. Null
    ids pass through, repeated rows are each scored, an empty table gives an empty result; further columns are dropped.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for i, j, x in _pieces(batch, 1):
                score = np.zeros(j - i)
                if index is not None:
                    v = _vectors(x, index.weight) @ index.latent
                    v /= np.linalg.norm(v, axis=1, keepdims=True).clip(1e-9)
                    score = np.where(x[:, 1 << BITS :].any(1), vote(v, index), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return only(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    index = fit_quality_index(docs, labels.where(~held_out))
    return classify_quality(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted")
