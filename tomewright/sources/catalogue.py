"""Catalogue relations as views over Parquet tables; both engines share the select lists below."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("arrived", "extracted", "cleaned", "cataloged", "survivor", "copied", "skipped")
SIDE_STAGES = ("quarantined", "merged")

#: relation -> (source table, select list, filter); {sha256} is the engine's hash function on a string.
VIEWS = {
    "files": (
        "documents",
        """doc_id as id, '/lib/' || source || '/' || source || '_' || cast(doc_id as string) || '.' || fmt as source_path,
        source || '_' || cast(doc_id as string) || '.' || fmt as filename, n_chars as file_size, sha as file_hash, fmt as format,
        case when doc_id % 11 = 3 then 'arrived' when doc_id % 11 = 5 then 'skipped' when doc_id % 11 = 6 then 'survivor'
             when doc_id % 11 = 7 then 'copied' when doc_id % 11 = 9 then 'quarantined' else 'cataloged' end as stage,
        case when doc_id % 3 = 0 then 1 when doc_id % 3 = 1 then 0 end as is_master,
        case when doc_id % 3 = 1 then doc_id - 1 end as master_id,
        case when doc_id % 13 = 0 then null else source end as source_group""",
        None,
    ),
    "metadata": (
        "documents",
        """doc_id as file_id, trim(split_part(text, chr(10), 1)) as title,
        case when doc_id % 4 = 0 then null when doc_id % 4 = 1 then '' else 'Author ' || cast(doc_id % 7 as string) end as authors,
        case when doc_id % 5 = 0 then ' ' when doc_id % 5 = 1 then null else 'Press ' || cast(doc_id % 3 as string) end as publisher,
        case when doc_id % 6 = 0 then null when doc_id % 6 = 1 then ' 978-' || cast(doc_id % 50 as string) || ' ' else '978' || cast(doc_id % 50 as string) end as isbn,
        lang as language, text as description, lang || '; ' || source as subjects,
        case when doc_id % 5 = 0 then '000' when doc_id % 5 = 1 then '004' when doc_id % 5 = 2 then '510' when doc_id % 5 = 3 then '820' end as udc_code,
        case when doc_id % 7 = 0 then null when doc_id % 7 = 1 then '' else '/covers/' || cast(doc_id as string) || '.jpg' end as cover_path,
        case when doc_id % 17 = 0 then 'manual' end as enrich_source,
        case when doc_id % 9 = 0 then null else cast(1990 + doc_id % 30 as int) end as year,
        cast(ceil(n_chars / 1800.0) as int) as pages,
        case when doc_id % 3 = 0 then null when doc_id % 3 = 1 then 'saga ' || lang else 'Saga ' || lang end as series,
        case when doc_id % 4 = 0 then 'IV' when doc_id % 4 = 1 then null else cast(doc_id % 12 as string) end as series_num,
        cast(doc_id % 3 as string) as volume, cast(null as string) as issue""",
        None,
    ),
    "custom_tags": ("labels", "doc_id as file_id, 'good' as tag, 'custom' as tag_type, 'good' as tag_label, 1.0 as score", "quality = 1 and doc_id % 2 = 0"),
    "udc_tags": ("labels", "doc_id as file_id, case when toxic = 1 then '170' else '004' end as tag, 'udc' as tag_type, 'label' as tag_label, 0.5 as score", "doc_id % 3 <> 0"),
    "pipeline_log": ("events", "event_id as id, user_id as file_id, case when event_type = 'view' then 'survivor' else event_type end as stage, 'done' as status, ts as logged_at", None),
    "reader_events": ("events", "user_id as book_id, event_id, value as progress_pct, ts as updated_at", None),
    "quarantined": ("documents", "doc_id as file_id, case when doc_id % 2 = 0 then 'NO_METADATA_EMPTY' else 'DEDUP_AMBIGUOUS' end as error_code, 'detail ' || cast(doc_id % 20 as string) as detail, cast(doc_id % 3 as int) as reviewed", "doc_id % 11 = 9"),
    "stages": ("orders", "o_orderkey as id, case when o_orderstatus = 'F' then 'copied' when o_orderstatus = 'O' then 'arrived' else 'skipped' end as stage, o_custkey as owner", None),
    "reading_list": ("customer", "c_custkey as book_id, case when c_custkey % 3 = 0 then 'reading' when c_custkey % 3 = 1 then 'to_read' else 'finished' end as status, c_acctbal as added", None),
}


class Catalogue:
    """The relations above as lazy DataFrames over ``sf_dir``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        source, columns, where = VIEWS[name]
        df = self.table(source)
        if name == "files":
            df = df.withColumns({"sha": F.sha2("text", 256), "fmt": F.element_at(F.array(*map(F.lit, ("epub", "pdf", "mobi", "cbz"))), (F.col("doc_id") % 4 + 1).cast("int"))})
        df = df.where(where) if where else df
        return self.spark.sql(f"select {columns} from {{df}}", df=df)

    @cached_property
    def files(self) -> DataFrame:
        return self.view("files")

    @cached_property
    def metadata(self) -> DataFrame:
        return self.view("metadata")

    @cached_property
    def tags(self) -> DataFrame:
        return self.view("custom_tags").unionByName(self.view("udc_tags"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)

    @cached_property
    def books(self) -> DataFrame:
        """Files with their metadata, kept if they have none."""
        return self.files.join(self.metadata, self.files.id == self.metadata.file_id, "left").drop("file_id")

    @cached_property
    def reader_state(self) -> DataFrame:
        """Last write for each book."""
        last = F.max_by(F.struct("progress_pct", "updated_at"), F.struct("updated_at", "event_id"))
        rows = self.reader_events.groupBy("book_id").agg(last.alias("s"))
        return rows.select("book_id", F.least("s.progress_pct", F.lit(100.0)).alias("progress_pct"), F.col("s.updated_at").alias("updated_at"))


def duck_views() -> str:
    """The same relations as a WITH list for DuckDB."""
    out = []
    for name, (source, columns, where) in VIEWS.items():
        table = source
        if name == "files":
            table = "(select *, sha256(text) as sha, (['epub', 'pdf', 'mobi', 'cbz'])[doc_id % 4 + 1] as fmt from documents)"
        out.append(f"{name} as (select {columns} from {table}" + (f" where {where})" if where else ")"))
    out.append("tags as (select * from custom_tags union all select * from udc_tags)")
    out.append("books as (select files.*, metadata.* exclude (file_id) from files left join metadata on files.id = metadata.file_id)")
    out.append("reader_state as (select book_id, least(arg_max(progress_pct, (updated_at, event_id)), 100.0) as progress_pct, max(updated_at) as updated_at from reader_events group by book_id)")
    return "with recursive " + ",\n".join(out) + "\n"
