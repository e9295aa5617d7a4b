"""Integrity checks of the library against a listing of its files, layout plans, and point lookups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow.fs import FileType, copy_files

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.functions.text import clean_filename, extension, folder_tag, from_filename, stem, truthy
from tomewright.operators.aggregates import stage_counts
from tomewright.operators.dedup import duplicate_groups, equal_titles, shelf_titles, similar_titles
from tomewright.operators.ordering import numbered
from tomewright.sources.shared import file_system, staged


#: What a file can tell of a book.
REEXTRACTED = ("title", "authors", "publisher", "isbn", "language", "pages", "year", "description")


def orphans(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Files on disk that no row names."""
    return listing.join(files, listing.path == files.source_path, "left_anti")


def missing(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows whose file isn't on disk."""
    return files.join(listing, files.source_path == listing.path, "left_anti")


def cover_differences(metadata: DataFrame, covers: DataFrame) -> DataFrame:
    """``name, side``: cover names in the database only, or on disk only."""
    base = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    db = metadata.where(truthy(F.col("cover_path"))).select(base("cover_path").alias("name")).distinct().withColumn("in_db", F.lit(True))
    disk = covers.select(base("path").alias("name")).distinct().withColumn("on_disk", F.lit(True))
    both = db.join(disk, "name", "full_outer").where("in_db is null or on_disk is null")
    return both.select("name", F.when(F.col("in_db").isNull(), "disk").otherwise("db").alias("side"))


def audit(books: DataFrame, listing: DataFrame) -> DataFrame:
    """``finding, id, path, detail``: missing, size_mismatch, metadata_issues, orphan, duplicate, equal_title and similar
    rows (of titles that differ, by their least ids; the detail is the other one)."""
    disk = listing.select(F.col("path").alias("_path"), F.col("length").alias("_length"))
    seen = books.join(disk, books.source_path == disk["_path"], "left")
    there = F.col("_path").isNotNull()
    reasons = F.array_compact(F.array(F.when(F.coalesce("pages", F.lit(0)) == 0, "pages"), F.when(~truthy(F.col("cover_path")), "cover")))
    findings = F.array_compact(
        F.array(
            F.when(~there, F.struct(F.lit("missing").alias("finding"), F.lit("").alias("detail"))),
            F.when(there & (F.col("_length") != F.col("file_size")), F.struct(F.lit("size_mismatch").alias("finding"), F.concat_ws(" ", "file_size", "_length").alias("detail"))),
            F.when(there & (F.size(reasons) > 0), F.struct(F.lit("metadata_issues").alias("finding"), F.array_join(reasons, ",").alias("detail"))),
        )
    )
    rows = seen.select("id", F.col("source_path").alias("path"), F.explode(findings).alias("f")).select("f.finding", "id", "path", "f.detail")
    lost = orphans(listing, books).select(F.lit("orphan").alias("finding"), F.lit(None).cast("bigint").alias("id"), "path", F.col("length").cast("string").alias("detail"))
    same = duplicate_groups(books).select(F.lit("duplicate").alias("finding"), F.col("first_id").alias("id"), F.lit("").alias("path"), F.col("n").cast("string").alias("detail"))
    titles = shelf_titles(books)
    like = similar_titles(titles).select(F.lit("similar").alias("finding"), F.col("id_a").alias("id"), F.lit("").alias("path"), F.col("id_b").cast("string").alias("detail"))
    named = equal_titles(titles).select(F.lit("equal_title").alias("finding"), "id", F.lit("").alias("path"), F.col("master_id").cast("string").alias("detail"))
    return rows.unionByName(lost).unionByName(same).unionByName(named).unionByName(like)


def audit_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("finding").agg(F.count("*").alias("n"))


def preview(found: DataFrame, top: int = 20) -> DataFrame:
    """The first findings of each kind."""
    order = Window.partitionBy("finding").orderBy(F.col("id").asc_nulls_last(), "path", "detail")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).drop("k")


def reconcile(files: DataFrame, listing: DataFrame) -> DataFrame:
    """By folder: files found, rows that name them, files that no row names; rows without a file, by their folder."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    rows = files.select("source_path", "is_master").withColumn("in_db", F.lit(1))
    both = rows.join(listing.select("path"), rows.source_path == listing.path, "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    disk, db = F.col("path").isNotNull(), F.col("in_db").isNotNull()
    return both.groupBy(folder(F.coalesce("path", "source_path")).alias("folder")).agg(
        count(disk).alias("found"), count(disk & db).alias("in_db"), count(disk & ~db).alias("not_in_db"), count(db & ~disk).alias("no_file"), count(F.col("is_master") == 1).alias("masters"), count(F.col("is_master") == 0).alias("duplicates")
    )


def reconcile_stages(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``stage, books, masters, duplicates, no_file``: rows by stage, and how many of them have no file on disk."""
    rows = files.join(listing.select(F.col("path").alias("_path")).distinct(), F.col("source_path") == F.col("_path"), "left")
    count = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("stage").agg(F.count("*").alias("books"), count(F.col("is_master") == 1).alias("masters"), count(F.col("is_master") == 0).alias("duplicates"), count(F.col("_path").isNull()).alias("no_file"))


def anomalies(files: DataFrame, metadata: DataFrame, listing: DataFrame, covers: DataFrame) -> DataFrame:
    """``kind, id, path`` of what doesn't agree: a book without its file, a file without a row, a book without its cover, a
    cover that no book names, a duplicate whose master is missing or is none."""
    none, disk = F.lit(None).cast("bigint"), listing.select("path").distinct()
    named = metadata.where(truthy(F.col("cover_path"))).select("file_id", F.col("cover_path").alias("path"))
    pictures = covers.select("path").distinct()
    masters = files.where("is_master = 1").select(F.col("id").alias("master_id"))
    astray = files.where("is_master = 0").join(masters, "master_id", "left_anti")
    parts = [
        missing(files, disk).select(F.lit("no_file").alias("kind"), "id", F.col("source_path").alias("path")),
        orphans(disk, files).select(F.lit("not_in_db").alias("kind"), none.alias("id"), "path"),
        named.join(pictures, "path", "left_anti").select(F.lit("no_cover").alias("kind"), F.col("file_id").alias("id"), "path"),
        pictures.join(named, "path", "left_anti").select(F.lit("stray_cover").alias("kind"), none.alias("id"), "path"),
        astray.select(F.lit("no_master").alias("kind"), "id", F.col("source_path").alias("path")),
    ]
    return reduce(DataFrame.unionByName, parts)


def relation_health(relations: dict[str, DataFrame]) -> DataFrame:
    """``relation, rows, ok``: how many rows each relation has; one without any isn't ok."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("relation"), "rows") for name, df in sorted(relations.items())]
    return reduce(DataFrame.unionByName, counts).withColumn("ok", F.col("rows") > 0)


def diagnostics(files: DataFrame, metadata: DataFrame, indexed: DataFrame, required: dict[str, DataFrame]) -> DataFrame:
    """``check, value, ok``: rows of the required relations, unique ids, metadata without a file, index coverage."""
    health = relation_health(required)
    parts = [health.select(F.concat(F.lit("relation "), "relation").alias("check"), F.col("rows").cast("double").alias("value"), "ok")]
    twice = files.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").cast("double").alias("value"))
    parts.append(twice.select(F.lit("repeated ids").alias("check"), "value", (F.col("value") == 0).alias("ok")))
    stray = metadata.join(files, metadata.file_id == files.id, "left_anti").agg(F.count("*").cast("double").alias("value"))
    parts.append(stray.select(F.lit("metadata without file").alias("check"), "value", (F.col("value") == 0).alias("ok")))
    titled = metadata.where(truthy(F.col("title"))).agg(F.count("*").alias("titled"))
    cover = titled.crossJoin(indexed.agg(F.count("*").alias("indexed"))).select((F.col("indexed") / F.greatest("titled", F.lit(1))).alias("value"))
    parts.append(cover.select(F.lit("index coverage").alias("check"), "value", (F.col("value") >= 0.9).alias("ok")))
    return reduce(DataFrame.unionByName, parts)


def copy_plan(survivors: DataFrame) -> DataFrame:
    """``id, src, dest``: clean names in one flat folder; of equal names (case aside) all but the least id get ``_id``."""
    name = clean_filename(F.col("filename"))
    rows = survivors.select("id", F.col("source_path").alias("src"), name.alias("name"))
    first = rows.groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("first"))
    tagged = F.concat(stem(F.col("name")), F.lit("_"), F.col("id").cast("string"), extension(F.col("name")))
    rows = rows.join(first, F.lower(rows["name"]) == first["low"])
    return rows.select("id", "src", F.when(F.col("id") == F.col("first"), F.col("name")).otherwise(tagged).alias("dest"))


def carry_out(plan: DataFrame, base: str, remove: bool = False) -> DataFrame:
    """``id, src, dest, outcome, bytes, error`` of a plan (id, src, dest below ``base``) once its files are copied, or moved.

    Files are copied where the tasks run, each under a name of the attempt's own and then renamed, so that a repeated or
    lost attempt leaves no half file; what is there already in the same size is ``present`` and not copied again. A file
    that can't be copied is a row with its error, never the end of the job. Outcomes are written once, so looking at them
    does nothing again. Paths have to be such as Arrow's file systems can open.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, src, dest, *copy_file(src, f"{base.rstrip('/')}/{dest}", remove)) for i, src, dest in zip(batch["id"], batch["src"], batch["dest"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", "src", "dest", "outcome", "bytes", "error"]).astype({"bytes": "Int64"})

    done = plan.select(F.col("id").cast("long").alias("id"), "src", "dest").repartition("dest")
    return staged(done.mapInPandas(run, "id long, src string, dest string, outcome string, bytes long, error string"), "carried-out")


def copy_file(src: str, dest: str, remove: bool) -> tuple[str, int | None, str | None]:
    """Outcome, bytes and error of one copy or move."""
    own = f"{dest}.{uuid.uuid4().hex}.part"
    try:
        (fs, at), (out, to), (_, part) = map(file_system, (src, dest, own))
        here, there = fs.get_file_info(at), out.get_file_info(to)
        if there.type == FileType.File and (here.type != FileType.File or here.size == there.size):
            outcome = "present"
        else:
            out.create_dir(to.rpartition("/")[0], recursive=True)
            try:
                copy_files(at, part, source_filesystem=fs, destination_filesystem=out)
                out.move(part, to)
            except Exception:
                if out.get_file_info(part).type == FileType.File:
                    out.delete_file(part)
                raise
            outcome = "moved" if remove else "copied"
        if remove and here.type == FileType.File and at != to:
            fs.delete_file(at)
        return outcome, out.get_file_info(to).size, None
    except Exception as e:  # noqa: BLE001  any file that can't be copied
        return "failed", None, f"{type(e).__name__}: {e}"[:300]


def move_plan(files: DataFrame, root: str, taken: DataFrame | None = None) -> DataFrame:
    """Originals to ``processed/`` once copied, else to ``archive/``, below which paths stay relative to the root. Where
    ``taken`` (a column dest) has that path already, the name gets ``_id``."""
    inside = files.where(F.col("source_path").startswith(root.rstrip("/") + "/"))
    target = F.when(F.col("stage") == "copied", "processed").otherwise("archive")
    plan = inside.select("id", F.col("source_path").alias("src"), F.concat(target, F.lit("/"), F.substring("source_path", len(root.rstrip("/")) + 2, 1 << 20)).alias("dest"))
    if taken is None:
        return plan
    held = taken.select("dest", F.lit(True).alias("_held")).distinct()
    name = F.regexp_extract("dest", r"([^/]*)$", 1)
    other = F.concat(F.regexp_replace("dest", r"[^/]*$", ""), stem(name), F.lit("_"), F.col("id").cast("string"), extension(name))
    return plan.join(held, "dest", "left").select("id", "src", F.when(F.col("_held"), other).otherwise(F.col("dest")).alias("dest"))


def layout_plan(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``path, action, dest``: rows go to ``master/`` or ``archive/``; orphans equal to a master by hash are deleted,
    others moved to ``orphans/``. Names are claimed without regard to case; later claims get `` (n)``.
    """
    known = files.select(F.col("source_path").alias("path"), F.when(F.col("is_master") == 1, "master").otherwise("archive").alias("target"))
    lost = orphans(listing, files)
    masters = files.where("is_master = 1").select("file_hash").distinct()
    twin = lost.join(masters, "file_hash", "left_semi").select("path", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("dest"))
    moved = lost.join(masters, "file_hash", "left_anti").select("path", F.lit("orphans").alias("target"))
    claims = known.unionByName(moved).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1))
    claims = numbered(claims.withColumn("low", F.lower("name")), ["target", "low"], [F.col("path")])
    later = F.concat(stem(F.col("name")), F.lit(" ("), (F.col("k") - 1).cast("string"), F.lit(")"), extension(F.col("name")))
    dest = F.concat("target", F.lit("/"), F.when(F.col("k") == 1, F.col("name")).otherwise(later))
    return claims.select("path", F.lit("move").alias("action"), dest.alias("dest")).unionByName(twin)


def ancestors(path: Column, root: str) -> Column:
    """All folders above a path, below the root, the highest first; none for what lies elsewhere."""
    top = root.rstrip("/") + "/"
    parts = F.split(F.substring(path, len(top) + 1, 1 << 20), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.concat(F.lit(top), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(path.startswith(top) & (F.size(parts) > 1), above).otherwise(F.array().cast("array<string>"))


def folder_tree(listing: DataFrame, root: str, gone: DataFrame) -> DataFrame:
    """``folder, depth, files, leaving``: for each folder below the root, how many files lie in it or below it, and how
    many of these ``gone`` (by path) takes away. A file counts for all folders above it, by partial aggregates."""
    rows = listing.select("path").join(gone.select("path", F.lit(1).alias("_gone")).distinct(), "path", "left")
    each = rows.select(F.explode(ancestors(F.col("path"), root)).alias("folder"), "_gone")
    counts = each.groupBy("folder").agg(F.count("*").alias("files"), F.count("_gone").alias("leaving"))
    depth = F.size(F.split("folder", "/")) - len(root.rstrip("/").split("/"))
    return counts.select("folder", depth.alias("depth"), "files", "leaving")


def emptied_folders(listing: DataFrame, root: str, gone: DataFrame) -> DataFrame:
    """``step, folder, depth``: folders that are empty once ``gone`` has left, the deepest first, so that each is empty
    when its turn comes."""
    empty = folder_tree(listing, root, gone).where("files = leaving").select("folder", "depth")
    return numbered(empty.withColumn("_all", F.lit(0)), ["_all"], [F.desc("depth"), F.col("folder")], "step").select("step", "folder", "depth")


def remove_folders(spark: SparkSession, steps: DataFrame) -> list[tuple[str, str]]:
    """Remove the folders of ``emptied_folders`` by depth; what isn't empty after all stays. ``(folder, outcome)``."""
    jvm, out = spark.sparkContext._jvm, []
    for r in steps.orderBy("step").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(r.folder)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            out.append((r.folder, "absent"))
        elif len(fs.listStatus(at)):
            out.append((r.folder, "kept"))
        else:
            out.append((r.folder, "removed" if fs.delete(at, False) else "failed"))
    return out


def backfill_series(books: DataFrame) -> DataFrame:
    """``id, series, series_num, volume, issue`` parsed from file names, only where that changes something."""
    names = ("series", "series_num", "volume", "issue")
    lacking = " or ".join(f"coalesce({c}, '') = ''" for c in names)
    rows = books.where(F.col("stage").isin("cataloged", "survivor", "copied")).where(lacking)
    rows = rows.where(~F.col("filename").rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-")).withColumn("p", from_filename(F.col("filename")))
    rows = rows.where((F.length("p.series") <= 60) & ~F.col("p.series").rlike(r"(?i)www\.|https?:|\.com\b"))
    parsed = {"series": "p.series", "series_num": "p.num", "volume": "p.volume", "issue": "p.issue"}
    rows = rows.select("id", *[F.coalesce(parsed[c], c).alias(c) for c in names], F.struct(*names).alias("old"))
    return rows.where(~F.struct(*names).eqNullSafe(F.col("old"))).drop("old")


def folder_tags(files: DataFrame, tags: DataFrame, root: str) -> DataFrame:
    """Custom tags to add from the first folder below the root: those a file doesn't have."""
    new = files.select(F.col("id").alias("file_id"), folder_tag(F.col("source_path"), root).alias("tag")).where("tag is not null")
    old = tags.where("tag_type = 'custom'").select("file_id", "tag")
    return new.join(old, ["file_id", "tag"], "left_anti")


def without_custom_tags(tags: DataFrame) -> DataFrame:
    """The tags after ``folder_tags`` is taken back: no custom tag stays."""
    return tags.where(~F.col("tag_type").eqNullSafe(F.lit("custom")))


# --- lookups --------------------------------------------------------------------------------------


def tags_of(tags: DataFrame, file_id: int) -> DataFrame:
    return tags.where(F.col("file_id") == file_id).orderBy("tag_type", F.desc("score"), "tag")


def log_of(log: DataFrame, file_id: int) -> DataFrame:
    return log.where(F.col("file_id") == file_id).orderBy("id")


def recent_log(log: DataFrame, files: DataFrame, limit: int = 100) -> DataFrame:
    """Latest events of known files, with the file's name."""
    met = log.join(files.select(F.col("id").alias("fid"), "filename"), log.file_id == F.col("fid"))
    return met.select("id", "file_id", "filename", "stage", "status").orderBy(F.desc("id")).limit(limit)


def reextracted(old: DataFrame, found: DataFrame) -> DataFrame:
    """Metadata of books after their files were read anew: ``old`` (file_id, the metadata, enrich_source) and ``found``
    (file_id and what ``catalogued`` gives of the file).

    What the file gives replaces what was there, and blanks don't; a book that was corrected by hand keeps its row. A
    file that couldn't be read changes nothing. ``enrich_source`` tells whether the title is the file's or its name's.
    """
    new = found.where("error is null").select("file_id", *[F.col(c).alias(f"_{c}") for c in REEXTRACTED], F.col("title_is_stem").alias("_stem"))
    by_hand = F.coalesce(F.col("enrich_source") == "manual", F.lit(False))
    value = lambda c: F.coalesce(F.when(~by_hand & truthy(F.col(f"_{c}").cast("string")), F.col(f"_{c}")), F.col(c)).alias(c)
    source = F.when(F.col("_stem").isNull() | by_hand, F.col("enrich_source")).when(F.col("_stem"), "filename").otherwise("embedded")
    rest = [c for c in old.columns if c not in (*REEXTRACTED, "enrich_source")]
    return old.join(new, "file_id", "left").select(*rest, *map(value, REEXTRACTED), source.alias("enrich_source"))


def survivors(files: DataFrame, metadata: DataFrame) -> DataFrame:
    return files.where("stage = 'survivor'").join(metadata, files.id == metadata.file_id).select("id", "filename", "title", "authors")


def latest_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("r")).select(*keys, "r.*")


def update_note(notes: DataFrame, note_id: int, **changes: str | None) -> DataFrame:
    """Only the supplied fields change; a blank one is cleared."""
    hit = F.col("id") == note_id
    return notes.withColumns({k: F.when(hit, F.lit(v.strip() or None if isinstance(v, str) else v)).otherwise(F.col(k)) for k, v in changes.items()})


def backlinks(notes: DataFrame) -> DataFrame:
    """``from_id, to_id``: notes that name another note of the same book by its number ``BKb-Nn``; found by an equi-join."""
    named = notes.select(F.col("book_id"), F.col("id").alias("from_id"), F.explode(F.array_distinct(F.regexp_extract_all("note", F.lit(r"BK\d+-N\d+"), F.lit(0)))).alias("zid"))
    return named.join(notes.select("book_id", F.col("id").alias("to_id"), "zid"), ["book_id", "zid"]).where("from_id <> to_id").select("from_id", "to_id")


def reading_home(books: DataFrame, state: DataFrame, limit: int = 10) -> DataFrame:
    """Books begun: in progress or completed (100 %), the latest 2 x limit."""
    rows = books.join(state, books.id == state.book_id).where("progress_pct > 1")
    section = F.when(F.col("progress_pct") >= 100, "completed").otherwise("in_progress")
    return rows.select("id", "title", "progress_pct", "updated_at", section.alias("section")).orderBy(F.desc("updated_at"), "id").limit(2 * limit)


def reading_list(entries: DataFrame, files: DataFrame, metadata: DataFrame, state: DataFrame) -> DataFrame:
    rows = entries.join(files, entries.book_id == files.id).join(metadata, files.id == metadata.file_id, "left").join(state.withColumnRenamed("book_id", "state_book"), F.col("state_book") == files.id, "left")
    return rows.select(entries.book_id, "status", "title", F.coalesce("progress_pct", F.lit(0.0)).alias("progress_pct"))


def status(files: DataFrame, log: DataFrame) -> DataFrame:
    """One row with the stage counts as JSON, files, and the latest event's number."""
    counts = stage_counts(files).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n"))))).alias("stages"))
    return counts.crossJoin(files.agg(F.count("*").alias("files"))).crossJoin(log.agg(F.max("id").alias("last_event")))
