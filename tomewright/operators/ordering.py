"""Orders of any number of rows without a sort in one task: ranges of the order, written once, with their counts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.sources.shared import new_path


def ranged(df: DataFrame, order: list[Column], name: str, parts: int | None = None) -> DataFrame:
    """``df`` dealt to ranges of the order, from a sample of it, and written so: column ``_part`` numbers the ranges, which
    are as many as asked for, or else follow from the rows' size.

    What is written stays as it is, so a lost executor can't deal the rows anew. Rows that the order doesn't tell apart
    are in one range; give it an id as its last column.
    """
    path = new_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    rows = dealt.withColumn("_part", F.spark_partition_id())
    rows.write.mode("append").partitionBy("_part").option("compression", "zstd").parquet(path)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.sparkSession.read.schema(f"{fields}, _part int").parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "k", parts: int | None = None) -> DataFrame:
    """Rows with their number from 1 among those of equal keys, in an order: as ``row_number``, for keys of any size.

    Rows are numbered inside a range of keys and order; what the ranges before it hold of a key is added.
    """
    rows = ranged(df, [*map(F.col, keys), *order], "numbered", parts)
    counts = rows.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row a range and key
    inside = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    same = [inside[k].eqNullSafe(counts[k]) for k in ("_part", *keys)]
    return inside.join(counts, same).select(*[inside[c] for c in df.columns], (F.col("_k") + F.col("_before")).cast("bigint").alias(name))


class Pages:
    """The rows of a search in an order, for pages at any depth: a page reads the ranges that hold it, and no others."""

    def __init__(self, df: DataFrame, order: list[Column], parts: int | None = None):
        self.order, self.columns = order, df.columns
        self.rows = ranged(df, order, "pages", parts)
        sizes = self.rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a range
        self.ranges, self.total = [], 0
        for r in sizes:
            self.ranges.append((r["_part"], self.total, self.total + r.n))
            self.total += r.n

    def parts(self, limit: int, offset: int) -> list[tuple[int, int]]:
        """The ranges of a page, and how many rows stand before each."""
        return [(part, lo) for part, lo, hi in self.ranges if lo < offset + limit and hi > offset]

    def page(self, limit: int, offset: int = 0) -> DataFrame:
        """As ``offset(...).limit(...)`` of the ordered rows."""
        met = self.parts(limit, offset)
        rows = self.rows.where(F.col("_part").isin(*[part for part, _ in met])) if met else self.rows.where("false")
        first = offset - met[0][1] if met else 0
        return rows.select(*self.columns).orderBy(*self.order).offset(first).limit(limit)
