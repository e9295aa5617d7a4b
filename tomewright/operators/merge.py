"""Merges into a new snapshot: null-aware upserts, fills, replacements, retention. Nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomewright.functions.text import truthy


def _both(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    a = old.select(F.col(key).alias("_key"), F.struct(*old.columns).alias("o"))
    b = new.select(F.col(key).alias("_new"), F.struct(*new.columns).alias("n"))
    return a.join(b, F.col("_key") == F.col("_new"), "full_outer")


def _snapshot(joined: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return joined.select(*[c.alias(k) for k, c in rules.items()])


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """By source path: the old id stays, name, size, hash and format are the new row's; a null group doesn't clear."""
    both = _both(old, new, "source_path")
    there = F.col("_new").isNotNull()
    rules = {}
    for c in old.columns:
        if c in ("id", "source_path"):
            rules[c] = F.coalesce(f"o.{c}", f"n.{c}")
        elif c == "source_group" or c not in ("filename", "file_size", "file_hash", "format"):
            rules[c] = F.coalesce(f"n.{c}", f"o.{c}")
        else:
            rules[c] = F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return _snapshot(both, rules)


def upsert_metadata(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """Column by column: a new value wins, null and empty ones clear nothing."""
    text = {f.name for f in new.schema if f.dataType.simpleString() == "string"}
    value = lambda c: F.nullif(F.col(f"n.{c}"), F.lit("")) if c in text and c != key else F.col(f"n.{c}")
    return _snapshot(_both(old, new, key), {c: F.coalesce(value(c), F.col(f"o.{c}")) for c in old.columns})


def fill_empty(old: DataFrame, new: DataFrame, columns: list[str], key: str = "file_id") -> DataFrame:
    """Only blank fields of ``old`` take the new value."""
    fresh = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(fresh, old[key] == fresh["_key"], "left")
    return joined.select(*[(F.when(truthy(F.col(c).cast("string")), F.col(c)).otherwise(F.col(f"_{c}")) if c in columns else F.col(c)).alias(c) for c in old.columns])


def keep_manual(old: DataFrame, new: DataFrame, key: str = "file_id") -> DataFrame:
    """Upsert in which rows edited by hand stay as they are."""
    merged = upsert_metadata(old, new, key)
    manual = old.where("enrich_source = 'manual'")
    return merged.join(manual.select(key), key, "left_anti").select(*old.columns).unionByName(manual)


def replace_column(old: DataFrame, changes: DataFrame, columns: list[str], key: str = "file_id") -> DataFrame:
    """Set columns from ``changes``, nulls too; rows without a change stay."""
    fresh = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(fresh, old[key] == fresh["_key"], "left")
    return joined.select(*[(F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) if c in columns else F.col(c)).alias(c) for c in old.columns])


def replace_set(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of the keys that ``new`` holds give way to its rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to add: those of ``new`` whose keys are missing, once each."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*new.columns)


def last_write(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key, that of the greatest order; a partial aggregate, so no key is sorted."""
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return latest.select("r.*")


def delete_cascade(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Each table without the rows of the given ids; a table comes with the name of its id column."""
    return {name: df.join(ids.select(F.col("id").alias(column)), column, "left_anti").select(*df.columns) for name, (df, column) in tables.items()}


def compact_log(log: DataFrame, stage: str = "survivor") -> DataFrame:
    """Of a stage's events only the latest of each file; other stages stay whole."""
    chosen = log.where(F.col("stage") == stage)
    return log.where(~F.col("stage").eqNullSafe(stage)).unionByName(last_write(chosen, "file_id", "id"))


def retain_log(log: DataFrame, now: str, days: int = 90, column: str = "logged_at") -> DataFrame:
    """Events not older than so many days before ``now``; compared as timestamps."""
    return log.where(F.col(column) >= F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def rewrite_prefix(df: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    """Paths that start with one prefix start with another."""
    swap = lambda c: F.when(F.col(c).startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))).otherwise(F.col(c))
    return df.withColumns({c: swap(c) for c in columns})


def revert_uncopied(files: DataFrame) -> DataFrame:
    """After a failed copy: survivors are catalogued again."""
    return files.withColumn("stage", F.when(F.col("stage") == "survivor", F.lit("cataloged")).otherwise(F.col("stage")))


def merge_books(files: DataFrame, target: int, into: int) -> DataFrame:
    """One book becomes a merged duplicate of another; a book isn't merged into itself."""
    hit = (F.col("id") == target) & (F.lit(target) != into)
    return files.withColumns({"stage": F.when(hit, F.lit("merged")).otherwise(F.col("stage")), "master_id": F.when(hit, F.lit(into).cast("bigint")).otherwise(F.col("master_id"))})


#: What a review action makes of ``reviewed`` and of the file's stage; None: as it is, "gone": the row is deleted.
REVIEW = {"resolve": (1, None), "dismiss": (2, "gone"), "keep_both": (1, "survivor"), "undo": (0, "quarantined")}


def review(quarantined: DataFrame, files: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarantine rows and files after review ``actions`` (file_id, action)."""
    spark = files.sparkSession
    rules = F.broadcast(spark.createDataFrame([(k, r, s) for k, (r, s) in REVIEW.items()], "action string, to_reviewed int, to_stage string"))
    acts = actions.join(rules, "action").select(F.col("file_id").alias("a_id"), "to_reviewed", "to_stage")
    rows = quarantined.join(acts, quarantined.file_id == acts.a_id, "left").where("to_stage is null or to_stage <> 'gone'")
    rows = rows.withColumn("reviewed", F.coalesce("to_reviewed", "reviewed")).select(*quarantined.columns)
    stages = acts.where("to_stage in ('survivor', 'quarantined')")
    moved = files.join(stages, files.id == stages.a_id, "left").withColumn("stage", F.coalesce("to_stage", "stage"))
    return rows, moved.select(*files.columns)


def repair_sizes(files: DataFrame, listing: DataFrame) -> DataFrame:
    """File sizes as found on disk; files that aren't there keep theirs."""
    disk = listing.select(F.col("path").alias("_path"), F.col("length").alias("_length"))
    joined = files.join(disk, files.source_path == disk["_path"], "left")
    return joined.withColumn("file_size", F.coalesce("_length", "file_size")).select(*files.columns)


def move_covers(metadata: DataFrame, listing: DataFrame, old_dir: str, new_dir: str) -> DataFrame:
    """``file_id, cover_path, action``: keep, copy and repoint, repoint to the numbered name, or leave."""
    names = listing.select(F.col("path").alias("_p")).distinct()
    own = F.concat(F.lit(f"{new_dir}/"), F.col("file_id").cast("string"), F.lit(".jpg"))
    rows = metadata.where(truthy(F.col("cover_path"))).withColumn("own", own)
    rows = rows.join(names.select(F.col("_p").alias("own"), F.lit(True).alias("own_there")), "own", "left")
    rows = rows.join(names.select(F.col("_p").alias("cover_path"), F.lit(True).alias("old_there")), "cover_path", "left")
    action = F.when(F.col("cover_path").startswith(f"{new_dir}/") & F.col("old_there"), "keep").when(F.col("own_there"), "repoint").when(F.col("cover_path").startswith(f"{old_dir}/") & F.col("old_there"), "copy").otherwise("leave")
    rows = rows.withColumn("action", action)
    return rows.select("file_id", F.when(F.col("action").isin("repoint", "copy"), F.col("own")).otherwise(F.col("cover_path")).alias("cover_path"), "action")
