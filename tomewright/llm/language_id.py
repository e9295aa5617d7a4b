"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy."""

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

#: log2 of subword buckets, byte n-gram sizes, embedding width, and rows of a language that the model is fitted on.
BITS, SIZES, WIDTH, PER_LANGUAGE = 11, (2, 3), 16, 600
#: Rows of the sample of all languages; texts whose dense counts a task holds at a time.
ROWS, TEXTS = 20_000, 1024
EPOCHS, BATCH, RATE, SEED = 40, 64, 8.0, 13
#: Accuracy on calibration rows that accepted predictions must reach.
ACCEPT_ACCURACY = 0.995


class Model(NamedTuple):
    languages: list[str]
    embedding: np.ndarray  # buckets x width
    weight: np.ndarray  # width x languages
    bias: np.ndarray
    temperature: float
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _averages(counts: np.ndarray) -> np.ndarray:
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = SEED) -> Model:
    """SGD on four fifths of the rows; temperature and rejection threshold are set on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, fit = order[: len(x) // 5], order[len(x) // 5 :]
    e = rng.normal(0, 0.1, (x.shape[1], WIDTH)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        fit = rng.permutation(fit)
        for k in range(0, len(fit), BATCH):
            rows = fit[k : k + BATCH]
            h = x[rows] @ e
            g = _softmax(h @ w + b)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            back = x[rows].T @ (g @ w.T)
            w -= 0.1 * rate * (h.T @ g)
            b -= 0.1 * rate * g.sum(0)
            e -= 10 * rate * back
    temperature, threshold = 1.0, 0.0
    if len(held):
        z = x[held] @ e @ w + b
        loss = {t: -np.log(_softmax(z / t)[np.arange(len(held)), y[held]].clip(1e-12)).mean() for t in np.geomspace(0.25, 8, 21)}
        temperature = float(min(loss, key=loss.get))
        p = _softmax(z / temperature)
        score, right = p.max(1), p.argmax(1) == y[held]
        by = np.argsort(-score)
        good = np.flatnonzero(np.cumsum(right[by]) >= ACCEPT_ACCURACY * np.arange(1, len(by) + 1))
        threshold = float(score[by[good[-1]]]) if len(good) else 1.0
    return Model(languages, e, w, b, temperature, threshold)


def fit_language_model(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model from different texts with a known language: about ``PER_LANGUAGE`` of each, of fewer where there are so many
    languages that they would pass ``ROWS``."""
    rows = only(rows, id_col, lang_col, text_col).toDF("id", "lang", "text").withColumn("key", row_key("id", "text"))
    chosen = sample_per_class(rows, "lang", "key", PER_LANGUAGE, ROWS).groupBy("lang", "key").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = tn.buffers(batch.column(1))
            for i, j in tn.pieces(data, bounds, texts=TEXTS):
                x = subword_counts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], SIZES, BITS, True)
                x = [row.tobytes() for row in _averages(x)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(x, pa.binary())], names=["lang", "x"])

    sample = chosen.select("lang", "text").mapInArrow(count, "lang string, x binary").toPandas()
    if not len(sample):
        return None
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(len(sample), -1)
    order = sorted(range(len(sample)), key=lambda k: (sample["lang"][k], sample["x"][k]))
    languages = sorted(set(sample["lang"]))
    y = np.array([languages.index(v) for v in sample["lang"]])
    return train(x[order], y[order], languages)


def identify_language(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, accepted`` for every whole text.

    ``lang_pred`` is the likeliest learned language and ``score`` its calibrated probability; ``accepted`` tells
    whether the score reaches the threshold above which calibration rows were right. A text that is null or has
    no letter (and any, if there was nothing to learn from) is ``und``, score 0, not accepted. Null ids pass through,
    repeated rows are each judged, an empty table gives an empty result; further columns are dropped.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            data, bounds = tn.buffers(batch.column(1))
            letter = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for i, j in tn.pieces(data, bounds, texts=TEXTS):
                best, score = np.zeros(j - i, np.int64), np.zeros(j - i)
                known = letter[i:j] & (m is not None)
                if m is not None:
                    x = _averages(subword_counts(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], SIZES, BITS, True))
                    p = _softmax(((x @ m.embedding) @ m.weight + m.bias) / m.temperature)
                    best, score = p.argmax(1), np.where(known, p.max(1), 0).astype(np.float64)
                names = [m.languages[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                accepted = known & (score >= (m.threshold if m else 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score), pa.array(accepted)], names=[id_col, "lang_pred", "score", "accepted"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    rows = only(docs, id_col, text_col).toDF("id", "text").select("id", "text", letter)
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, accepted boolean")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = fit_language_model(docs.where(~held_out))
    return identify_language(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
