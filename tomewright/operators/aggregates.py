"""Counts, facets and the stage funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.sources.catalogue import STAGES


def stage_counts(files: DataFrame) -> DataFrame:
    """A row for each known stage, 0 where none."""
    known = files.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    counts = files.groupBy("stage").agg(F.count("*").alias("n"))
    return known.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def counts_by(df: DataFrame, key: Column | str, name: str = "key") -> DataFrame:
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias("n"))


def summary(files: DataFrame, metadata: DataFrame, tags: DataFrame) -> DataFrame:
    """``section, key, n``: totals, and counts by stage, category, format and custom tag.

    One scan of the files feeds totals, stages and formats through grouping sets.
    """
    marks = files.groupingSets([[], ["stage"], ["format"]], "stage", "format").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count(F.when(F.col("is_master") == 1, 1)).alias("masters"), F.count(F.when(F.col("is_master") == 0, 1)).alias("duplicates")
    )
    section = F.when(F.col("g") == 1, "stage").when(F.col("g") == 2, "format").otherwise("total")
    by_file = marks.select(section.alias("section"), F.coalesce("stage", "format", F.lit("files")).alias("key"), "n")
    total = marks.where("g = 3").selectExpr("stack(2, 'masters', masters, 'duplicates', duplicates) as (key, n)").select(F.lit("total").alias("section"), "key", "n")
    udc = counts_by(files.join(metadata, files.id == metadata.file_id), F.coalesce("udc_code", F.lit("?"))).select(F.lit("udc").alias("section"), "key", "n")
    custom = tags.where("tag_type = 'custom'")
    tag = counts_by(custom.join(files, custom.file_id == files.id).join(metadata, "file_id"), "tag").select(F.lit("tag").alias("section"), "key", "n")
    bare = files.join(custom, files.id == custom.file_id, "left_anti").agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit("untagged").alias("key"), "n")
    out = by_file
    for part in (total, udc, tag, bare):
        out = out.unionByName(part)
    return out


def funnel(files: DataFrame) -> DataFrame:
    """Files at each stage and at it or beyond; shares of all counted, in percent.

    Skipped files count in the total only, quarantined and merged ones nowhere.
    """
    counts = stage_counts(files).withColumn("ord", F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")))
    total = F.sum("n").over(Window.partitionBy())
    beyond = Window.orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("total", total).where("stage <> 'skipped'").withColumn("cumulative", F.sum("n").over(beyond))
    share = F.when(F.col("total") > 0, F.bround(F.col("cumulative") / F.col("total") * 100, 1)).otherwise(0.0)
    return rows.select("stage", F.col("n").alias("stuck"), "cumulative", "total", share.alias("pct"))


def series_facets(books: DataFrame, like: str = "", limit: int = 200) -> DataFrame:
    """Series without regard to case, the least spelling of each, by name."""
    rows = books.where("series is not null and series <> ''").where(F.col("series").ilike(f"%{like}%"))
    return rows.groupBy(F.lower("series").alias("low")).agg(F.min("series").alias("series"), F.count("*").alias("n")).orderBy("low").limit(limit).drop("low")


def category_facets(books: DataFrame, limit: int | None = 30) -> DataFrame:
    out = books.where("udc_code is not null").groupBy("udc_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "udc_code")
    return out.limit(limit) if limit else out


def groups_of_two(df: DataFrame, key: str, member: str) -> DataFrame:
    """Keys with two rows or more: how many, least and greatest member; the members stay rows of ``df``."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(member).alias("first"), F.max(member).alias("last")).where("n >= 2")


def folder_counts(files: DataFrame, root: str) -> DataFrame:
    from tomewright.functions.text import folder_tag

    return counts_by(files, folder_tag(F.col("source_path"), root), "folder").where("folder is not null")


def index_health(books: DataFrame, indexed: DataFrame, least: float = 0.9) -> DataFrame:
    """Indexed documents against rows with a title; a warning below nine tenths."""
    titled = books.agg(F.count(F.when(F.coalesce("title", F.lit("")) != "", 1)).alias("titled"))
    return titled.crossJoin(indexed.agg(F.count("*").alias("indexed"))).select("titled", "indexed", (F.col("indexed") < least * F.col("titled")).alias("warn"))


def folder_sizes(listing: DataFrame) -> DataFrame:
    return listing.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def shares(scores: DataFrame, top: int = 5) -> DataFrame:
    """Top scores of each id with weights that sum to 100: half-even shares, the rest to the best."""
    order = Window.partitionBy("id").orderBy(F.desc("score"), "ord")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    whole = Window.partitionBy("id")
    rounded = F.bround(F.col("score") / F.sum("score").over(whole) * 100).cast("int")
    ranked = ranked.withColumn("share", rounded).withColumn("spare", 100 - F.sum("share").over(whole))
    return ranked.withColumn("weight", (F.col("share") + F.when(F.col("rank") == 1, F.col("spare")).otherwise(0)).cast("int")).drop("share", "spare")


def outcomes(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of an enrichment run by outcome: updated, unchanged, failed (no result)."""
    new = after.select(F.col("file_id").alias("new_id"), *[F.col(c).alias(f"new_{c}") for c in columns])
    changed = F.lit(False)
    for c in columns:
        changed |= ~F.col(c).eqNullSafe(F.coalesce(F.col(f"new_{c}"), F.col(c)))
    joined = before.join(new, before.file_id == new.new_id, "left")
    return counts_by(joined, F.when(F.col("new_id").isNull(), "failed").when(changed, "updated").otherwise("unchanged"), "outcome")
