"""Output forms: feeds, exports, notes as Markdown, JSON rows, snapshots."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions.text import xml_escape
from tomewright.sources.catalogue import SIDE_STAGES, STAGES

# Media types by format.
BOOK_TYPES = {
    "epub": "application/epub+zip",
    "pdf": "application/pdf",
    "mobi": "application/x-mobipocket-ebook",
    "azw": "application/vnd.amazon.ebook",
    "azw3": "application/vnd.amazon.ebook",
    "kfx": "application/vnd.amazon.ebook",
    "fb2": "application/x-fictionbook+xml",
    "djvu": "image/vnd.djvu",
    "cbz": "application/vnd.comicbook+zip",
    "cbr": "application/x-cbr",
    "cbt": "application/x-cbt",
    "txt": "text/plain",
    "html": "text/html",
    "htm": "text/html",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "rtf": "application/rtf",
    "odt": "application/vnd.oasis.opendocument.text",
}
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, F.lower(key)), F.lit(default))


def book_type(fmt: Column) -> Column:
    return _lookup(fmt, BOOK_TYPES, "application/octet-stream")


def cover_type(path: Column) -> Column:
    return _lookup(F.regexp_extract(F.coalesce(path, F.lit("")), r"\.([^./]*)$", 1), IMAGE_TYPES, "image/jpeg")


# Media types and relations of catalogue feeds.
NAVIGATION = "application/atom+xml;profile=opds-catalog;kind=navigation"
ACQUISITION = "application/atom+xml;profile=opds-catalog;kind=acquisition"
SEARCH_TYPE = "application/opensearchdescription+xml"
ATOM, OPDS, OPENSEARCH = "http://www.w3.org/2005/Atom", "http://opds-spec.org/2010/catalog", "http://a9.com/-/spec/opensearch/1.1/"
IMAGE, ACQUIRE = "http://opds-spec.org/image", "http://opds-spec.org/acquisition"
#: Letters of a description that an entry shows.
SUMMARY = 400


def _link(rel: str, kind: Column | str, *href: Column | str) -> Column:
    """A link whose address is its parts, escaped and put together."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    address = [xml_escape(F.lit(h) if isinstance(h, str) else h) for h in href]
    return F.concat(F.lit(f'<link rel="{rel}" type="'), kind, F.lit('" href="'), *address, F.lit('"/>'))


def _element(name: str, text: Column | str, kind: str = "") -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.concat(F.lit(f"<{name}{kind}>"), text, F.lit(f"</{name}>"))


def feed_entries(books: DataFrame, updated: Column | str, base: str = "/opds") -> DataFrame:
    """``id, title, entry``: an Atom acquisition entry for each book; only here a description is cut."""
    name = F.col("id").cast("string")
    names = F.filter(F.transform(F.split(F.coalesce("authors", F.lit("")), r"[;&]"), lambda a: F.trim(a)), lambda a: a != "")
    authors = F.array_join(F.transform(names, lambda a: _element("author", _element("name", xml_escape(a)))), "")
    about = F.left(F.trim(F.coalesce("description", F.lit(""))), F.lit(SUMMARY))
    subject = F.col("udc_label") if "udc_label" in books.columns else F.col("udc_code")
    category = F.concat(F.lit('<category term="'), xml_escape(F.col("udc_code")), F.lit('" label="'), xml_escape(subject), F.lit('"/>'))
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), "filename")
    parts = (
        _element("id", F.concat(F.lit("urn:book:"), name)),
        _element("title", xml_escape(title)),
        _element("updated", updated),
        authors,
        F.when(about != "", _element("content", xml_escape(about), ' type="text"')),
        F.when(F.coalesce("udc_code", F.lit("")) != "", category),
        F.when(F.coalesce("cover_path", F.lit("")) != "", _link(IMAGE, cover_type(F.col("cover_path")), f"{base}/cover/", name)),
        _link(ACQUIRE, book_type(F.col("format")), f"{base}/download/", name),
    )
    return books.select("id", "title", _element("entry", F.concat(*[F.coalesce(p, F.lit("")) for p in parts])).alias("entry"))


def navigation_entries(facets: DataFrame, key: str, label: str, updated: str, base: str = "/opds") -> DataFrame:
    """An Atom navigation entry for each facet value, with the number of its books."""
    path = F.concat(F.lit(f"{base}/"), F.url_encode(F.col(key).cast("string")))
    count = F.concat(F.col("n").cast("string"), F.lit(" books"))
    parts = (
        _element("id", F.concat(F.lit("urn:shelf:"), xml_escape(F.col(key)))),
        _element("title", xml_escape(F.col(label))),
        _element("updated", updated),
        _element("content", count, ' type="text"'),
        _link("subsection", ACQUISITION, path),
    )
    return facets.select(key, _element("entry", F.concat(*parts)).alias("entry"))


def feed(entries: DataFrame, title: str, updated: str, path: str = "/opds", next_path: str | None = None, order: str = "id", kind: str = ACQUISITION, author: str = "Library", base: str = "/opds") -> DataFrame:
    """One row ``xml``: the document of one page of entries (a page is short; it was cut before)."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "entry"))), lambda e: e.entry), "")
    head = [
        _element("id", F.concat(F.lit("urn:feed:"), xml_escape(F.lit(path)))),
        _element("title", xml_escape(F.lit(title))),
        _element("updated", updated),
        _element("author", _element("name", xml_escape(F.lit(author)))),
        _link("self", kind, path),
        _link("start", NAVIGATION, base),
        _link("search", SEARCH_TYPE, f"{base}/opensearch.xml"),
        *([_link("next", kind, next_path)] if next_path else []),
    ]
    begin = F.lit(f'<?xml version="1.0" encoding="utf-8"?><feed xmlns="{ATOM}" xmlns:opds="{OPDS}">')
    return entries.agg(F.concat(begin, *head, body, F.lit("</feed>")).alias("xml"))


def search_description(spark: SparkSession, name: str = "Library", base: str = "/opds") -> DataFrame:
    """One row ``xml``: where and how clients search the catalogue."""
    address = F.concat(F.lit(f'<Url type="{ACQUISITION}" template="'), xml_escape(F.lit(f"{base}/search?q={{searchTerms}}&start={{startIndex?}}")), F.lit('"/>'))
    inner = F.concat(_element("ShortName", xml_escape(F.lit(name))), _element("Description", xml_escape(F.lit(f"Search of {name}"))), address)
    begin, end = F.lit(f'<?xml version="1.0" encoding="utf-8"?><OpenSearchDescription xmlns="{OPENSEARCH}">'), F.lit("</OpenSearchDescription>")
    return spark.range(1).select(F.concat(begin, inner, end).alias("xml"))


def export_rows(books: DataFrame) -> DataFrame:
    """The tabular export: one row a book, nulls as empty text; ``stage`` names its sheet."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    master = F.when(F.col("is_master") == 1, "Yes").when(F.col("is_master") == 0, "No").otherwise("")
    columns = ("filename", "format", "title", "authors", "publisher", "year", "isbn", "language", "pages", "udc_code", "series", "series_num", "source_group", "master_id")
    return books.select("id", "stage", *[text(c).alias(c) for c in columns], F.bround(F.col("file_size") / 2.0**20, 2).alias("size_mb"), F.left("file_hash", F.lit(16)).alias("hash"), master.alias("is_master"))


def write_export(books: DataFrame, path: str) -> None:
    """A folder of CSV for each stage, and the counts in ``0_summary``."""
    export_rows(books).write.mode("overwrite").partitionBy("stage").option("header", True).csv(f"{path}/sheets")
    known = [*STAGES, *SIDE_STAGES]
    counts = books.where(F.col("stage").isin(known)).groupBy("stage").agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").option("header", True).csv(f"{path}/0_summary")


def notes_markdown(annotations: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """``book_id, created_at, line``: highlights, notes and bookmarks as Markdown; in order of time they are the export."""
    at_page = lambda c: F.concat(F.lit("  Location: Page "), (F.col(c) + 1).cast("string"))
    both = annotations.withColumn("kind", F.col("type")).unionByName(bookmarks.withColumn("kind", F.lit("bookmark")), allowMissingColumns=True)
    highlight = F.concat_ws("\n", F.concat(F.lit("> "), "text"), F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("  — "), "note")), F.coalesce(at_page("page"), F.concat(F.lit("  Location: "), F.nullif("cfi_range", F.lit("")))))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("  Tags: "), F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), ", ")))
    body = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("\n  "), F.replace("note", F.lit("\n"), F.lit("\n  "))))
    note = F.concat_ws("\n", F.concat(F.lit("**Note:** "), F.coalesce("title", "text", F.lit("untitled")), F.coalesce(F.concat(F.lit(" `"), "zid", F.lit("`")), F.lit(""))), tags, body)
    share = F.coalesce(F.when(F.col("progress_pct") > 0, F.concat(F.lit(" ("), F.bround("progress_pct", 0).cast("int").cast("string"), F.lit("%)"))), F.lit(""))
    mark = F.concat_ws("\n", F.concat(F.lit("**Bookmark:** "), F.coalesce("label", F.lit("untitled")), share), F.coalesce(F.concat(F.lit("  Location: "), F.nullif("cfi_loc", F.lit(""))), at_page("page_num")))
    line = F.when(F.col("kind") == "bookmark", mark).when(F.col("kind") == "highlight", highlight).otherwise(note)
    return both.select("book_id", "created_at", line.alias("line"))


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_snapshot(tables: dict[str, DataFrame], path: str, name: str) -> None:
    """Every relation as Parquet under ``snapshot=name``, and a manifest; the path read from is never overwritten."""
    spark = next(iter(tables.values())).sparkSession
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{path}/snapshot={name}/{table}")
    manifest = json.dumps({"snapshot": name, "tables": sorted(tables)})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/snapshot={name}/manifest")


def read_snapshot(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame]:
    manifest = json.loads(spark.read.text(f"{path}/snapshot={name}/manifest").first()[0])
    return {t: spark.read.parquet(f"{path}/snapshot={name}/{t}") for t in manifest["tables"]}


def snapshots_to_drop(snapshots: DataFrame, keep: int = 14) -> DataFrame:
    """All but the newest ones by time, then name."""
    return snapshots.orderBy(F.desc("created_at"), F.desc("name")).offset(keep)
