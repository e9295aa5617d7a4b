"""Hashed features of whole texts as dense count matrices, and bounded samples to fit classifiers on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.llm import textnum as tn
from tomewright.llm.common import stage_table

_MULTIPLIER = np.uint32(2654435761)


def subword_counts(data: np.ndarray, bounds: np.ndarray, sizes: tuple[int, ...], bits: int, lower: bool) -> np.ndarray:
    """Texts x 2**bits counts of hashed byte n-grams of the given sizes; white space counts as one kind of byte."""
    n = len(bounds) - 1
    raw = tn._LOWER[data] if lower else data
    raw = np.where(tn._SPACE[raw], np.uint8(32), raw).astype(np.uint32)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    out = np.zeros(n << bits, np.int64)
    for size in sizes:
        if len(raw) < size:
            continue
        code = np.zeros(len(raw) - size + 1, np.uint32)
        for k in range(size):
            code = code * np.uint32(257) + raw[k : len(raw) - size + 1 + k]
        code = (code + np.uint32(size)) * _MULTIPLIER
        keys = (owner[: len(code)] << bits) + (code >> np.uint32(32 - bits))
        out += np.bincount(keys[owner[: len(code)] == owner[size - 1 :]], minlength=n << bits)
    return out.reshape(n, 1 << bits)


def row_key(id_col: str, text_col: str) -> Column:
    """A row's number for drawing: rows of one id and different texts differ, equal rows don't."""
    return F.xxhash64(id_col, text_col, F.lit(99))


def sample_per_class(rows: DataFrame, class_col: str, key_col: str, most: int, total: int) -> DataFrame:
    """The rows of about ``most`` keys of each class, of fewer where there are so many classes that all together would
    pass ``total``. Drawn by the key, so the same rows give the same sample whatever their partitions; classes are
    counted in keys, so repeated rows neither crowd others out nor add up."""
    rows = rows.where(F.col(class_col).isNotNull())
    sizes = stage_table(rows.groupBy(class_col).agg(F.approx_count_distinct(key_col, 0.01).alias("_n")), "class-sizes")
    classes = sizes.count()
    most = min(most, max(1, total // max(1, classes)))
    # of more classes than rows may be drawn, a part
    sizes = sizes.where(F.pmod(F.xxhash64(class_col), F.lit(1 << 20)) < F.lit(min(1.0, total / max(1, classes)) * (1 << 20)))
    draw = F.pmod(F.col(key_col), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return rows.join(sizes, class_col).where(draw * F.col("_n") < most).drop("_n")
