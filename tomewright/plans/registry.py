"""Queries of the catalogue operators over the driver tables, with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.functions import text as tx
from tomewright.operators import aggregates as ag
from tomewright.operators import audit as au
from tomewright.operators import classify as cl
from tomewright.operators import dedup as dd
from tomewright.operators import feeds as fd
from tomewright.operators import merge as mg
from tomewright.operators import ordering as od
from tomewright.operators import search as se
from tomewright.operators import textindex as ti
from tomewright.sources.catalogue import Catalogue, duck_views
from tomewright.sources.shared import new_path, staged
from tomewright.plans.shelf import write_tree
from tomewright.sources.config import exported, imported, resolved
from tomewright.sources.files import catalogued, count_files, extract, from_paths, full_text, listing, lookup, unique_names
from tomewright.streaming import inbox

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

NORM = r"substring(trim(regexp_replace(regexp_replace(lower(trim(coalesce(title, ''))), '[^\p{L}\p{N}_\s''\-]', '', 'g'), '\s+', ' ', 'g')), 1, 200)"
RICH = "(" + " + ".join(f"(coalesce(cast({c} as varchar), '') not in ('', '0'))::int" for c in ("title", "authors", "isbn", "description", "publisher", "year", "language", "pages")) + ")"
ISBN = "nullif(replace(trim(isbn), '-', ''), '')"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Catalogue], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = duck_views() + (", " + sql[5:] if sql.lstrip().startswith("with ") else sql)
        return f

    return add


# --- aggregates -----------------------------------------------------------------------------------

STAGE_LIST = "(select unnest(['arrived', 'extracted', 'cleaned', 'cataloged', 'survivor', 'copied', 'skipped']) as stage, unnest(range(1, 8)) as ord)"


@query("agg1_stage_counts", f"select s.stage, count(f.id) as n from {STAGE_LIST} s left join files f using (stage) group by s.stage")
def _(c):
    return ag.stage_counts(c.files)


@query("agg2_summary", """
select 'total' as section, 'files' as key, count(*) as n from files
union all select 'total', 'masters', count(*) filter (is_master = 1) from files
union all select 'total', 'duplicates', count(*) filter (is_master = 0) from files
union all select 'total', 'untagged', count(*) from files where id not in (select file_id from custom_tags)
union all select 'stage', stage, count(*) from files group by stage
union all select 'format', format, count(*) from files group by format
union all select 'udc', coalesce(udc_code, '?'), count(*) from files join metadata on id = file_id group by 2
union all select 'tag', tag, count(*) from custom_tags t join files f on t.file_id = f.id join metadata m on m.file_id = f.id group by tag""")
def _(c):
    return ag.summary(c.files, c.metadata, c.tags)


FUNNEL = """with s as (select st.stage, st.ord, count(f.id) as n from {stages} st left join {files} f using (stage) group by all),
w as (select *, sum(n) over () as total from s)
select stage, n as stuck, sum(n) over (order by ord desc)::bigint as cumulative, total::bigint as total,
  case when total > 0 then round_even(sum(n) over (order by ord desc) / total * 100, 1) else 0.0 end as pct from w where stage <> 'skipped'"""


@query("agg3_funnel", FUNNEL.format(stages=STAGE_LIST, files="files"))
def _(c):
    return ag.funnel(c.files)


@query("agg3_funnel_orders", FUNNEL.format(stages=STAGE_LIST, files="stages"))
def _(c):
    return ag.funnel(c.stages)


@query("agg4_count_distinct", "select count(distinct file_id) as n from tags")
def _(c):
    return c.tags.agg(F.count_distinct("file_id").alias("n"))


@query("agg5_source_groups", "select source_group as key, count(*) as n from files where source_group is not null group by 1 order by n desc, key")
def _(c):
    return ag.counts_by(c.files.where("source_group is not null"), "source_group").orderBy(F.desc("n"), "key")


@query("agg6_series_facets", "select min(series) as series, count(*) as n from books where series <> '' and series ilike '%e%' group by lower(series) order by lower(series) limit 200")
def _(c):
    return ag.series_facets(c.books, "e")


@query("agg7_category_facets", "select udc_code, count(*) as n from books where udc_code is not null group by 1 order by n desc, udc_code limit 30")
def _(c):
    return ag.category_facets(c.books)


@query("agg8_quarantine_counts", "select error_code, format, count(*) as n from quarantined q join files f on q.file_id = f.id group by all")
def _(c):
    return c.quarantined.join(c.files, F.col("file_id") == F.col("id")).groupBy("error_code", "format").agg(F.count("*").alias("n"))


@query("agg9_latest_per_key", "select user_id, max(event_id) as last_event, arg_max(event_type, event_id) as last_type from events group by 1")
def _(c):
    return c.table("events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("last_type"))


@query("agg10_groups", "select file_hash, count(*) as n, min(id) as first, max(id) as last from files where file_hash is not null group by 1 having count(*) >= 2")
def _(c):
    return ag.groups_of_two(c.files, "file_hash", "id")


@query("agg11_folder_counts", "select split_part(substring(source_path, 6), '/', 1) as folder, count(*) as n from files group by 1")
def _(c):
    return ag.folder_counts(c.files, "/lib")


@query("agg13_folder_sizes", "select regexp_extract(source_path, '^(.*)/[^/]*$', 1) as folder, sum(file_size)::bigint as bytes, count(*) as files from files group by 1")
def _(c):
    return ag.folder_sizes(c.files.select(F.col("source_path").alias("path"), F.col("file_size").alias("length")))


@query("agg14_richness", f"select id, {RICH} as richness from books")
def _(c):
    return dd.with_richness(c.books).select("id", "richness")


@query("agg15_shares", """with s as (select o_custkey as id, o_orderkey as ord, round(o_totalprice, 2) as score from orders),
r as (select *, row_number() over (partition by id order by score desc, ord) as rank from s),
w as (select *, round_even(score / sum(score) over (partition by id) * 100, 0)::int as share from r where rank <= 5)
select id, ord, score, rank::int as rank, (share + case when rank = 1 then 100 - sum(share) over (partition by id) else 0 end)::int as weight from w""")
def _(c):
    return ag.shares(c.table("orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.round("o_totalprice", 2).alias("score")))


@query("agg16_outcomes", "select case when file_id % 4 = 0 then 'failed' when file_id % 3 = 0 and publisher is distinct from 'Found' then 'updated' else 'unchanged' end as outcome, count(*) as n from metadata group by 1")
def _(c):
    new = c.metadata.where("file_id % 4 <> 0").select("file_id", F.expr("case when file_id % 3 = 0 then 'Found' end").alias("publisher"))
    return ag.outcomes(c.metadata, new, ["publisher"])


# --- filters, projections, sorts, paging ----------------------------------------------------------


@query("flt1_faceted_search", "select id, stage, format, year, file_size from books where stage = 'cataloged' and format = 'pdf' and year >= 1995 and year <= 2015 and file_size >= 200 and lower(series) = 'saga en'")
def _(c):
    r = se.SearchRequest(stage="cataloged", format=".pdf", year_from=1995, year_to=2015, size_from=200, series="SAGA EN")
    return se.search(c.books, c.tags, r).select("id", "stage", "format", "year", "file_size")


@query("flt1_masters_tag", "select id from books where is_master = 1 and source_group = 'src0' and id in (select file_id from custom_tags where tag = 'good')")
def _(c):
    return se.search(c.books, c.tags, se.SearchRequest(masters=True, source_group="src0", tag="good")).select("id")


@query("flt1_untagged_duplicates", "select id from books where is_master = 0 and source_path like '/lib/src2/%' and id not in (select file_id from custom_tags)")
def _(c):
    return se.search(c.books, c.tags, se.SearchRequest(duplicates=True, untagged=True, path_prefix="/lib/src2/")).select("id")


def _like_sql(*terms: str) -> str:
    one = lambda t: "(" + " or ".join(f"coalesce({c} ilike '%{t}%', false)" for c in se.SEARCHED) + f" or exists (select 1 from tags where tags.file_id = books.id and tag ilike '%{t}%'))"
    return " and ".join(map(one, terms))


@query("flt2_substring_search", f"select id, title from books where {_like_sql('en', 'src1')}")
def _(c):
    return se.search(c.books, c.tags, se.SearchRequest(text='en "src1"')).select("id", "title")


@query("flt2_kept_grams", f"select id, title from books where {_like_sql('%tion', 'src1_')}")
def _(c):
    return se.search(c.books, c.tags, se.SearchRequest(text="%tion src1_"), _index(c, True)).select("id", "title")


@query("flt3_book_list", "select id, title, stage from books where stage = 'copied' and is_master = 1 and (title ilike '%the%' or authors ilike '%the%' or filename ilike '%the%')")
def _(c):
    return c.books.where(se.facet_predicate(se.SearchRequest(stage="copied", masters=True)) & se.like_predicate("the", ("title", "authors", "filename"))).select("id", "title", "stage")


@query("flt4_quarantine_filter", "select f.id, error_code, format from quarantined q join files f on q.file_id = f.id where reviewed = 0 and format = 'pdf' and filename ilike '%src%'")
def _(c):
    rows = c.quarantined.where("reviewed = 0").join(c.files, F.col("file_id") == F.col("id"))
    return rows.where(se.facet_predicate(se.SearchRequest(format=".pdf")) & se.like_predicate("src", ("filename",))).select("id", "error_code", "format")


@query("flt5_review_state", "select file_id from quarantined where reviewed = 1 and error_code = 'NO_METADATA_EMPTY'")
def _(c):
    return c.quarantined.where("reviewed = 1 and error_code = 'NO_METADATA_EMPTY'").select("file_id")


@query("flt6_with_cover", "select id, cover_path from books where cover_path <> '' order by id desc limit 200")
def _(c):
    return c.books.where("cover_path <> ''").select("id", "cover_path").orderBy(F.desc("id")).limit(200)


@query("flt7_missing_metadata", "select id, is_master from books where coalesce(cover_path, '') = '' or coalesce(description, '') = '' or coalesce(title, '') = '' order by is_master desc nulls last, id limit 100")
def _(c):
    blank = "coalesce(cover_path, '') = '' or coalesce(description, '') = '' or coalesce(title, '') = ''"
    return c.books.where(blank).select("id", "is_master").orderBy(F.desc_nulls_last("is_master"), "id").limit(100)


@query("flt8_uncategorised_masters", "select id from books where is_master = 1 and coalesce(udc_code, '') in ('', '000')")
def _(c):
    return c.books.where("is_master = 1 and coalesce(udc_code, '') in ('', '000')").select("id")


@query("flt9_reading_home", "select id, title, progress_pct, updated_at, case when progress_pct >= 100 then 'completed' else 'in_progress' end as section from books join reader_state on id = book_id where progress_pct > 1 order by updated_at desc, id limit 20")
def _(c):
    return au.reading_home(c.books, c.reader_state)


@query("flt10_feed_visible", "select id from files where stage in ('cataloged', 'copied', 'survivor')")
def _(c):
    return c.files.where(F.col("stage").isin(*se.VISIBLE)).select("id")


@query("prj1_columns", "select id, coalesce(udc_code, '?') as code, left(file_hash, 16) as hash, coalesce(pages, 0) as pages from books")
def _(c):
    return c.books.select("id", F.coalesce("udc_code", F.lit("?")).alias("code"), F.left("file_hash", F.lit(16)).alias("hash"), F.coalesce("pages", F.lit(0)).alias("pages"))


@query("prj2_point_lookup", "select id, filename, title, authors from books where id = 42")
def _(c):
    return c.books.where("id = 42").select("id", "filename", "title", "authors")


@query("prj3_defaults", "select c_custkey as book_id, coalesce(progress_pct, 0) as progress from customer left join reader_state on book_id = c_custkey")
def _(c):
    state = c.reader_state
    return c.table("customer").join(state, F.col("c_custkey") == state.book_id, "left").select(F.col("c_custkey").alias("book_id"), F.coalesce("progress_pct", F.lit(0.0)).alias("progress"))


@query("srt1_sorted_page", "select id, title, year from books order by year desc nulls last, id desc limit 50 offset 20")
def _(c):
    return se.search_page(c.books, c.tags, se.SearchRequest(sort="year", offset=20))[0].select("id", "title", "year")


NUM = r"case when {0} is not null then coalesce(try_cast(regexp_extract({0}, '^\s*([+-]?\d+)', 1) as bigint), 0) end asc nulls first"


@query("srt2_series_order", f"select id, series, series_num from books order by series is null, series nulls first, {', '.join(NUM.format(x) for x in ('series_num', 'volume', 'issue'))}, title nulls first, id limit 60")
def _(c):
    return c.books.orderBy(*se.order_by(se.SearchRequest(sort="series"))).select("id", "series", "series_num").limit(60)


@query("srt3_offset", "select id from files order by id offset 100 limit 25")
def _(c):
    return se.page(c.files.select("id").orderBy("id"), 25, 100)


@query("srt3_deep_page", "select id, title from books order by title desc nulls last, id limit 25 offset 333")
def _(c):
    return od.Pages(c.books.select("id", "title"), [F.desc_nulls_last("title"), F.asc("id")]).page(25, 333)


@query("srt4_look_ahead", "select id, true as has_next from files order by id limit 10")
def _(c):
    return se.page_with_next(c.files.select("id"), [F.asc("id")], 10)


@query("srt5_recent", "select book_id, updated_at from reader_state order by updated_at desc, book_id limit 15")
def _(c):
    return c.reader_state.select("book_id", "updated_at").orderBy(F.desc("updated_at"), "book_id").limit(15)


@query("srt6_case_blind_order", "select id, series from books where series is not null order by lower(series), id limit 40")
def _(c):
    return c.books.where("series is not null").select("id", "series").orderBy(F.lower("series"), "id").limit(40)


@query("srt7_top_per_group", "select source_group, id, file_size from files where source_group is not null qualify row_number() over (partition by source_group order by file_size desc, id) <= 5")
def _(c):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("source_group").orderBy(F.desc("file_size"), "id"))
    return c.files.where("source_group is not null").withColumn("k", k).where("k <= 5").select("source_group", "id", "file_size")


@query("srt8_keep_best", f"select file_hash, first(id order by {RICH} desc, id) as id from books group by 1")
def _(c):
    return dd.with_richness(c.books).groupBy("file_hash").agg(F.max_by("id", F.struct("richness", -F.col("id"))).alias("id"))


@query("srt9_natural_order", r"select filename, array_to_string(list_transform(regexp_extract_all(filename, '(\d+|\D+)'), lambda p: case when regexp_matches(p, '^\d') then lpad(len(len(ltrim(p[:-2], '0') || right(p, 1))::varchar)::varchar, 2, '0') || len(ltrim(p[:-2], '0') || right(p, 1)) || ltrim(p[:-2], '0') || right(p, 1) else lower(p) end), '') as key from files")
def _(c):
    return c.files.select("filename", tx.natural_key(F.col("filename")).alias("key"))


# --- joins ----------------------------------------------------------------------------------------


@query("jn1_left_join", "select id, title from files left join metadata on id = file_id")
def _(c):
    return c.books.select("id", "title")


@query("jn2_inner_join", "select f.id, f.filename, m.title, m.authors from files f join metadata m on f.id = m.file_id where stage = 'survivor'")
def _(c):
    return au.survivors(c.files, c.metadata)


@query("jn3_predicate_in_on", "select distinct f.id, t.tag from files f left join tags t on t.file_id = f.id and t.tag_type = 'custom'")
def _(c):
    custom = c.tags.where("tag_type = 'custom'")
    return c.files.join(custom, F.col("id") == F.col("file_id"), "left").select("id", "tag").distinct()


@query("jn4_stage_in_on", "select m.file_id, m.series from metadata m join files f on f.id = m.file_id and f.stage = 'cataloged' where series is not null")
def _(c):
    return c.metadata.where("series is not null").join(c.files.where("stage = 'cataloged'"), F.col("id") == F.col("file_id"), "left_semi").select("file_id", "series")


@query("jn5_reading_list", "select r.book_id, r.status, m.title, coalesce(s.progress_pct, 0) as progress_pct from reading_list r join files f on f.id = r.book_id left join metadata m on m.file_id = f.id left join reader_state s on s.book_id = f.id")
def _(c):
    return au.reading_list(c.reading_list, c.files, c.metadata, c.reader_state)


@query("jn6_three_way", "select f.id, m.title, s.progress_pct from files f join metadata m on m.file_id = f.id join reader_state s on s.book_id = f.id")
def _(c):
    return c.files.join(c.metadata, F.col("id") == F.col("file_id")).join(c.reader_state, F.col("id") == F.col("book_id")).select("id", "title", "progress_pct")


@query("jn7_quarantine_join", "select q.file_id, q.error_code, b.filename, b.title from quarantined q join books b on b.id = q.file_id")
def _(c):
    return c.quarantined.join(c.books, F.col("file_id") == F.col("id")).select("file_id", "error_code", "filename", "title")


@query("jn8_log_join", "select l.id, l.file_id, f.filename, l.stage, l.status from pipeline_log l join files f on f.id = l.file_id order by l.id desc limit 100")
def _(c):
    return au.recent_log(c.pipeline_log, c.files)


@query("jn9_tag_join", "select t.file_id, t.tag, m.title from tags t join files f on f.id = t.file_id join metadata m on m.file_id = f.id")
def _(c):
    return c.tags.join(c.metadata, "file_id").join(c.files.select(F.col("id").alias("file_id")), "file_id", "left_semi").select("file_id", "tag", "title")


@query("jn10_semi_join", "select id from files where id in (select file_id from tags where tag = '170')")
def _(c):
    return c.files.join(c.tags.where("tag = '170'"), F.col("id") == F.col("file_id"), "left_semi").select("id")


@query("jn11_exists_in_or", "select id from books where title ilike '%zz%' or exists (select 1 from tags where file_id = books.id and tag ilike '%17%')")
def _(c):
    rows = se.with_tag_list(c.books, c.tags)
    return rows.where(F.coalesce(F.col("title").ilike("%zz%"), F.lit(False)) | F.coalesce(F.exists("tag_list", lambda t: t.ilike("%17%")), F.lit(False))).select("id")


@query("jn12_anti_join", "select id from files where not exists (select 1 from custom_tags where file_id = files.id)")
def _(c):
    return c.files.join(c.tags.where("tag_type = 'custom'"), F.col("id") == F.col("file_id"), "left_anti").select("id")


@query("jn13_latest_row", "select * from pipeline_log where id in (select max(id) from pipeline_log group by file_id)")
def _(c):
    return mg.last_write(c.pipeline_log, "file_id", "id")


def _disk(c: Catalogue) -> DataFrame:
    """A listing to audit against: some files gone, some resized, some unknown."""
    known = c.files.where("id % 10 <> 4").select(F.col("source_path").alias("path"), F.expr("case when id % 10 = 5 then file_size + 1 else file_size end").alias("length"), "file_hash")
    return known.unionByName(c.files.where("id % 10 = 4").select(F.concat(F.lit("/lib/new/x"), "id", F.lit(".pdf")).alias("path"), F.col("file_size").alias("length"), "file_hash"))


DISK = """disk as (select source_path as path, case when id % 10 = 5 then file_size + 1 else file_size end as length, file_hash from files where id % 10 <> 4
union all select '/lib/new/x' || cast(id as varchar) || '.pdf', file_size, file_hash from files where id % 10 = 4)
"""


@query("jn14_orphans", f"with {DISK} select path from disk where path not in (select source_path from files)")
def _(c):
    return au.orphans(_disk(c), c.files).select("path")


@query("jn15_missing", f"with {DISK} select id from files where source_path not in (select path from disk)")
def _(c):
    return au.missing(c.files, _disk(c)).select("id")


@query("jn16_cover_differences", """with k as (select '/covers/' || cast(id + 5 as varchar) || '.jpg' as path from files),
a as (select distinct regexp_extract(cover_path, '([^/]*)$', 1) as name from metadata where trim(coalesce(cover_path, '')) <> ''),
b as (select distinct regexp_extract(path, '([^/]*)$', 1) as name from k)
select coalesce(a.name, b.name) as name, case when a.name is null then 'disk' else 'db' end as side from a full join b using (name) where a.name is null or b.name is null""")
def _(c):
    return au.cover_differences(c.metadata, c.files.select(F.concat(F.lit("/covers/"), F.col("id") + 5, F.lit(".jpg")).alias("path")))


#: The ratio of matching letters of pairs ``@cand`` (id_a, id_b, x, y), as ``@ratio``: of a piece of both texts the
#: longest common run counts (of equal runs the first), then what stands before it and what stands behind. Where y has
#: 200 letters, those that it holds more often than a hundredth of them and one begin no run, but may extend one.
RATIO = """@xs as (select id_a, id_b, unnest(range(1, length(x) + 1)) as i, unnest(string_split(x, '')) as ch from @cand),
@ys as (select id_a, id_b, unnest(range(1, length(y) + 1)) as j, unnest(string_split(y, '')) as ch, length(y) as ny from @cand),
@yc as (select *, ny >= 200 and count(*) over (partition by id_a, id_b, ch) > ny // 100 + 1 as popular from @ys),
@eq as (select id_a, id_b, i, j, not popular as rare from @xs join @yc using (id_a, id_b, ch)),
@run as (select *, i - row_number() over (partition by id_a, id_b, i - j order by i) as island,
  case when rare then i - row_number() over (partition by id_a, id_b, i - j, rare order by i) end as rare_island from @eq),
@len as (select id_a, id_b, i, j, max(i) over (partition by id_a, id_b, i - j, island) - i + 1 as fore, i - min(i) over (partition by id_a, id_b, i - j, island) + 1 as back,
  case when rare then max(i) over (partition by id_a, id_b, i - j, rare_island) - i + 1 end as own from @run),
@seg as (select id_a, id_b, 1::bigint as alo, length(x)::bigint + 1 as ahi, 1::bigint as blo, length(y)::bigint + 1 as bhi, 0::bigint as k from @cand
  union all select id_a, id_b, c.alo, c.ahi, c.blo, c.bhi, c.k from (
    select id_a, id_b, unnest([{'alo': alo, 'ahi': i0, 'blo': blo, 'bhi': j0, 'k': 0::bigint}, {'alo': i1, 'ahi': ahi, 'blo': j1, 'bhi': bhi, 'k': 0::bigint}, {'alo': 0::bigint, 'ahi': 0::bigint, 'blo': 0::bigint, 'bhi': 0::bigint, 'k': i1 - i0}]) as c
    from (select b.*, bi - least(coalesce(l.back, 0), bi - alo, bj - blo) as i0, bj - least(coalesce(l.back, 0), bi - alo, bj - blo) as j0,
        bi + bk + least(coalesce(r.fore, 0), ahi - bi - bk, bhi - bj - bk) as i1, bj + bk + least(coalesce(r.fore, 0), ahi - bi - bk, bhi - bj - bk) as j1
      from (select id_a, id_b, alo, ahi, blo, bhi, coalesce(m.bi, alo) as bi, coalesce(m.bj, blo) as bj, coalesce(m.bk, 0) as bk from (
          select s.id_a, s.id_b, alo, ahi, blo, bhi, min({'n': -least(own, ahi - i, bhi - j), 'i': i, 'j': j}) filter (own > 0) as best
          from @seg s left join @len p on p.id_a = s.id_a and p.id_b = s.id_b and i >= alo and i < ahi and j >= blo and j < bhi
          where s.k = 0 and ahi > alo and bhi > blo group by all) g, lateral (select best.i as bi, best.j as bj, -best.n as bk) m) b
      left join @len l on l.id_a = b.id_a and l.id_b = b.id_b and l.i = bi - 1 and l.j = bj - 1
      left join @len r on r.id_a = b.id_a and r.id_b = b.id_b and r.i = bi + bk and r.j = bj + bk)
    where i1 > i0) where c.k > 0 or (c.ahi > c.alo and c.bhi > c.blo)),
@ratio as (select id_a, id_b, 2.0 * coalesce(matched, 0) / (length(x) + length(y)) as ratio from @cand left join (select id_a, id_b, sum(k)::double as matched from @seg group by all) using (id_a, id_b))"""


def _ratio(prefix: str) -> str:
    return RATIO.replace("@", prefix)


def _shelf(jaccard: float) -> str:
    """Titles, their pairs alike by words, and the ratios of these."""
    return f"""shelf0 as (select id, case when coalesce(title, '') <> '' then title else filename end as title from books),
shelf1 as (select id, {NORM} as norm from shelf0),
shelf2 as (select *, list_distinct(list_filter(regexp_extract_all(norm, '[a-z0-9]+'), lambda x: length(x) >= 3)) as words from shelf1),
shelf3 as (select * from shelf2 where len(words) > 0),
shelf as (select norm, min(id) as id, count(*) as n, any_value(words) as words from shelf3 group by norm),
t_cand as (select a.id as id_a, a.n as n_a, b.id as id_b, b.n as n_b, a.norm as x, b.norm as y,
  round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 6) as jaccard
  from shelf a join shelf b on left(a.norm, 8) = left(b.norm, 8) and a.id < b.id
  where len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) >= {jaccard}),
""" + _ratio("t_")


SIMILAR = _shelf(0.8) + """,
sim as (select id_a, n_a, id_b, n_b, jaccard, round(ratio, 6) as ratio from t_cand join t_ratio using (id_a, id_b) where ratio >= 0.95),
eqt as (select id, master_id from shelf3 join (select norm, id as master_id from shelf) using (norm) where id <> master_id)
"""


@query("jn17_similar_titles", "with " + SIMILAR + "select * from sim")
def _(c):
    return dd.similar_titles(c.books)


@query("jn17_title_duplicates", "with " + SIMILAR + "select id, master_id, 'equal' as kind from eqt union all select id_b, id_a, 'similar' from sim")
def _(c):
    return dd.title_duplicates(c.books)


@query("jn20_orphans_of_masters", f"with {DISK} select path from disk where path not in (select source_path from files) and file_hash in (select file_hash from files where is_master = 1)")
def _(c):
    return au.orphans(_disk(c), c.files).join(c.files.where("is_master = 1"), "file_hash", "left_semi").select("path")


@query("jn21_backlinks", """with n as (select conv_id as book_id, conv_id * 1000 + turn as id, 'BK' || cast(conv_id as varchar) || '-N' || cast(conv_id * 1000 + turn as varchar) as zid,
  text || ' see BK' || cast(conv_id as varchar) || '-N' || cast(conv_id * 1000 + turn - 1 as varchar) as note from conversations),
e as (select distinct book_id, id, unnest(regexp_extract_all(note, 'BK\\d+-N\\d+')) as zid from n)
select e.id as from_id, n.id as to_id from e join n using (book_id, zid) where e.id <> n.id""")
def _(c):
    number = F.col("conv_id") * 1000 + F.col("turn")
    zid = lambda n: F.concat(F.lit("BK"), "conv_id", F.lit("-N"), n)
    return au.backlinks(c.table("conversations").select(F.col("conv_id").alias("book_id"), number.alias("id"), zid(number).alias("zid"), F.concat("text", F.lit(" see "), zid(number - 1)).alias("note")))


@query("jn22_cache_lookup", """with k as (select id, md5('v2|' || coalesce(isbn, '') || '|' || coalesce(title, '') || '|' || coalesce(authors, '')) as key from books)
select id, key, case when bool_or(id % 5 = 0) over (partition by key) then 'A' else 'B' end as publisher from k""")
def _(c):
    keyed = c.books.select("id", tx.cache_key(F.col("isbn"), F.col("title"), F.col("authors")).alias("key"))
    first = keyed.groupBy("key").agg(F.max(F.expr("id % 5 = 0")).alias("five"))
    answers = first.select("key", F.when(F.col("five"), F.lit("A")).otherwise(F.lit(" ")).alias("publisher"))
    return lookup(c.books, answers, first.select("key", F.lit("B").alias("publisher")), ["publisher"])


# --- merges ---------------------------------------------------------------------------------------


def _new_files(c: Catalogue) -> DataFrame:
    changed = c.files.where("id % 3 = 0").withColumns({"file_size": F.col("file_size") + 7, "source_group": F.lit(None).cast("string")})
    added = c.files.where("id % 5 = 0").withColumns({"id": F.col("id") + 10000000, "source_path": F.concat(F.lit("/new"), "source_path")})
    return changed.unionByName(added)


@query("mrg1_upsert_files", """select id, source_path, case when id % 3 = 0 then file_size + 7 else file_size end as file_size, source_group from files
union all select id + 10000000, '/new' || source_path, file_size, source_group from files where id % 5 = 0""")
def _(c):
    return mg.upsert_files(c.files, _new_files(c)).select("id", "source_path", "file_size", "source_group")


def _new_metadata(c: Catalogue) -> DataFrame:
    blank = F.lit(None).cast("string")
    return c.metadata.where("file_id % 4 < 3").withColumns({"title": F.when(F.col("file_id") % 4 == 1, F.lit("New")), "authors": F.when(F.col("file_id") % 4 == 2, F.lit("")), "publisher": F.when(F.col("file_id") % 4 == 0, F.lit("P")), "year": F.lit(None).cast("int"), "description": blank, "enrich_source": blank})


NEW = "case when file_id % 4 = 1 then 'New' else title end as title, authors, case when file_id % 4 = 0 then 'P' else publisher end as publisher, coalesce(year, 0) as year"


@query("mrg2_upsert_metadata", f"select file_id, {NEW} from metadata")
def _(c):
    return mg.upsert_metadata(c.metadata, _new_metadata(c)).select("file_id", "title", "authors", "publisher", F.coalesce("year", F.lit(0)).alias("year"))


@query("mrg3_fill_empty", "select file_id, case when trim(coalesce(publisher, '')) <> '' then publisher when file_id % 4 = 0 then 'P' end as publisher, case when trim(coalesce(title, '')) <> '' then title when file_id % 4 = 1 then 'New' end as title from metadata")
def _(c):
    return mg.fill_empty(c.metadata, _new_metadata(c), ["publisher", "title"]).select("file_id", "publisher", "title")


@query("mrg4_manual_rows_stay", f"select file_id, {NEW} from metadata where enrich_source is null union all select file_id, title, authors, publisher, coalesce(year, 0) from metadata where enrich_source = 'manual'")
def _(c):
    return mg.keep_manual(c.metadata, _new_metadata(c)).select("file_id", "title", "authors", "publisher", F.coalesce("year", F.lit(0)).alias("year"))


@query("mrg5_explicit_clear", "select file_id, case when file_id % 6 = 0 then null else series end as series from metadata")
def _(c):
    return mg.replace_column(c.metadata, c.metadata.where("file_id % 6 = 0").select("file_id", F.lit(None).cast("string").alias("series")), ["series"]).select("file_id", "series")


@query("mrg6_replace_set", "select file_id, tag, tag_type from tags where not (tag_type = 'udc' and file_id % 2 = 0) union all select distinct file_id, '999', 'udc' from tags where tag_type = 'udc' and file_id % 2 = 0")
def _(c):
    new = c.tags.where("tag_type = 'udc' and file_id % 2 = 0").select("file_id", F.lit("999").alias("tag"), "tag_type", "tag_label", "score").dropDuplicates(["file_id"])
    return mg.replace_set(c.tags, new, ["file_id", "tag_type"]).select("file_id", "tag", "tag_type")


@query("mrg7_insert_absent", "select doc_id as file_id, 'good' as tag from labels where doc_id not in (select file_id from custom_tags)")
def _(c):
    new = c.table("labels").select(F.col("doc_id").alias("file_id"), F.lit("good").alias("tag"))
    return mg.insert_absent(c.tags.where("tag_type = 'custom'"), new.unionByName(new), ["file_id", "tag"])


@query("mrg8_last_write", "select book_id, arg_max(event_id, (updated_at, event_id)) as event_id, max(updated_at) as updated_at from reader_events group by 1")
def _(c):
    return mg.last_write(c.reader_events, "book_id", "updated_at", "event_id").select("book_id", "event_id", "updated_at")


@query("mrg9_cascade_delete", "select 'files' as name, count(*) as n from files where id % 7 <> 0 union all select 'metadata', count(*) from metadata where file_id % 7 <> 0 union all select 'tags', count(*) from tags where file_id % 7 <> 0")
def _(c):
    left = mg.delete_cascade({"files": (c.files, "id"), "metadata": (c.metadata, "file_id"), "tags": (c.tags, "file_id")}, c.files.where("id % 7 = 0"))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("mrg10_compact_log", "select id, file_id, stage from pipeline_log where stage <> 'survivor' union all select max(id), file_id, 'survivor' from pipeline_log where stage = 'survivor' group by file_id")
def _(c):
    return mg.compact_log(c.pipeline_log).select("id", "file_id", "stage")


@query("mrg11_log_retention", "select id from pipeline_log where logged_at >= (select max(logged_at) from pipeline_log) - interval 10 day")
def _(c):
    now = c.pipeline_log.agg(F.max("logged_at").cast("string")).first()[0]
    return mg.retain_log(c.pipeline_log, now, 10).select("id")


@query("mrg12_rewrite_prefix", "select id, case when starts_with(source_path, '/lib/src1/') then '/mnt/x/' || substring(source_path, 11) else source_path end as source_path from files")
def _(c):
    return mg.rewrite_prefix(c.files, ["source_path"], "/lib/src1/", "/mnt/x/").select("id", "source_path")


@query("mrg13_revert_uncopied", "select case when stage = 'survivor' then 'cataloged' else stage end as stage, count(*) as n from files group by 1")
def _(c):
    return mg.revert_uncopied(c.files).groupBy("stage").agg(F.count("*").alias("n"))


@query("mrg14_merge_books", "select id, case when id = 8 then 'merged' else stage end as stage, coalesce(case when id = 8 then 3 else master_id end, -1) as master_id from files")
def _(c):
    return mg.merge_books(c.files, 8, 3).select("id", "stage", F.coalesce("master_id", F.lit(-1)).alias("master_id"))


ACTION = "(['resolve', 'dismiss', 'keep_both', 'undo'])[file_id % 4 + 1]"


@query("mrg15_review", f"select file_id, case when a = 'undo' then 0 else 1 end as reviewed, case when a = 'keep_both' then 'survivor' when a = 'undo' then 'quarantined' else stage end as stage from (select *, {ACTION} as a from quarantined) q join files f on f.id = q.file_id where a <> 'dismiss'")
def _(c):
    acts = c.quarantined.select("file_id", F.element_at(F.array(*map(F.lit, ("resolve", "dismiss", "keep_both", "undo"))), (F.col("file_id") % 4 + 1).cast("int")).alias("action"))
    rows, files = mg.review(c.quarantined, c.files, acts)
    return rows.join(files, rows.file_id == files.id).select("file_id", "reviewed", "stage")


@query("mrg16_repair_sizes", f"with {DISK} select id, coalesce(length, file_size) as file_size from files left join disk on path = source_path")
def _(c):
    return mg.repair_sizes(c.files, _disk(c)).select("id", "file_size")


@query("mrg17_move_covers", """with l as (select cover_path as p from metadata where file_id % 3 = 0 and cover_path <> '' union select '/new/' || cast(file_id as varchar) || '.jpg' from metadata where file_id % 4 = 0)
select file_id, case when a in ('repoint', 'copy') then own else cover_path end as cover_path, a as action from (select *, case when own in (select p from l) then 'repoint' when cover_path in (select p from l) then 'copy' else 'leave' end as a
from (select *, '/new/' || cast(file_id as varchar) || '.jpg' as own from metadata where trim(coalesce(cover_path, '')) <> ''))""")
def _(c):
    old = c.metadata.where("file_id % 3 = 0 and cover_path <> ''").select(F.col("cover_path").alias("path"))
    new = c.metadata.where("file_id % 4 = 0").select(F.concat(F.lit("/new/"), "file_id", F.lit(".jpg")).alias("path"))
    return mg.move_covers(c.metadata, old.unionByName(new), "/covers", "/new")


# --- duplicates -----------------------------------------------------------------------------------


def _greedy(prefix: str, rows: str, block: str, gate: str = "true") -> str:
    """``@found`` (id, master_id, ratio, ambiguous): the greedy pass over the blocks of ``rows``, a row a step. The state
    of a block is the list of rows that stand; ``hits`` has what a row is like among the earlier ones."""
    return f"""@t as (select id, rich, norm, {block} as block from {rows} where norm <> ''),
@cand as (select a.id as id_a, b.id as id_b, a.norm as x, b.norm as y, a.rich as rich_a from @t a join @t b on a.block = b.block and a.id < b.id where {gate}),
{RATIO},
@like as (select id_b as id, map(list(id_a), list({{'ratio': ratio, 'rich': rich_a}})) as hits from @ratio join @cand using (id_a, id_b) where ratio >= 0.7 group by id_b),
@turn as (select block, id, rich, hits, row_number() over (partition by block order by id) as k from @t left join @like using (id)),
@state as (select distinct block, 0::bigint as k, []::bigint[] as standing, []::struct(id bigint, master_id bigint, ratio double, ambiguous boolean)[] as made from @t
  union all select block, k, case when hit is null then list_append(standing, id) when rich <= hits[hit].rich then standing else list_append(list_filter(standing, lambda s: s <> hit), id) end,
    list_concat(made, list_transform(list_filter(case when hit is null then standing else standing[1:list_position(standing, hit) - 1] end, lambda s: hits[s].ratio >= 0.7),
        lambda s: {{'id': id, 'master_id': s, 'ratio': hits[s].ratio, 'ambiguous': true}}),
      case when hit is null then [] when rich <= hits[hit].rich then [{{'id': id, 'master_id': hit, 'ratio': hits[hit].ratio, 'ambiguous': false}}]
        else [{{'id': hit, 'master_id': id, 'ratio': hits[hit].ratio, 'ambiguous': false}}] end)
  from (select s.block, t.k, standing, made, t.id, t.rich, t.hits, list_filter(standing, lambda x: t.hits[x].ratio >= 0.85)[1] as hit from @state s join @turn t on s.block = t.block and t.k = s.k + 1)),
@last as (select block, max_by(made, k) as made from @state group by block),
@found as (select f.id, f.master_id, f.ratio, f.ambiguous from (select unnest(made) as f from @last))""".replace("@", prefix)


KEYED = f"keyed as (select id, {RICH} as rich, file_hash, {ISBN} as isbn_key, {NORM} as norm, coalesce(udc_code, '') as udc, lower(trim(coalesce(authors, ''))) as author, coalesce(year, 0) as year from books)"
BY_TITLE = {"block": "{'a': udc, 'b': left(norm, 4), 'c': author}", "gate": "abs(length(b.norm) - length(a.norm)) <= greatest(length(b.norm) // 3, 10)"}


def _resolve(rows: str) -> str:
    """All passes over ``keyed``: each sees the rows that the ones before left."""
    first = lambda key, rows: f"(select id, master_id from (select id, first_value(id) over (partition by {key} order by rich desc, id) as master_id from {rows} where {key} is not null) where id <> master_id)"
    rest = lambda rows, gone: f"(select * from {rows} where id not in (select id from {gone}))"
    return f"""with {KEYED}, r0 as (select * from keyed where {rows}), l1 as {first("file_hash", "r0")}, r1 as {rest("r0", "l1")}, l2 as {first("isbn_key", "r1")}, r2 as {rest("r1", "l2")},
{_greedy("f3_", "r2", **BY_TITLE)},
l3 as (select id, master_id from f3_found where not ambiguous), r3 as (select * from r2 where id not in (select id from l3) and author <> '' and year <> 0),
{_greedy("f4_", "r3", "{'a': author, 'b': year}")},
lost as (select *, 'duplicate_by_hash' as reason from l1 union all select *, 'duplicate_by_isbn' from l2 union all select *, 'duplicate_by_title' from l3
  union all select id, master_id, 'duplicate_by_author_year_title' from f4_found where not ambiguous)
select k.id, case when reason is null then 1 else 0 end as is_master, master_id, coalesce(reason, 'survivor') as reason from keyed k left join lost on k.id = lost.id"""


def _exact(key: str, reason: str, rows: str = "books") -> str:
    return f"""select id, master_id, '{reason}' as reason from (select id, first_value(id) over (partition by {key} order by {RICH} desc, id) as master_id from {rows} where {key} is not null) where id <> master_id"""


@query("ddp1_content_hash", _exact("file_hash", "duplicate_by_hash"))
def _(c):
    return dd.exact_losers(dd.with_richness(c.books), F.col("file_hash"), "duplicate_by_hash")


@query("ddp2_isbn", "with h as (" + _exact("file_hash", "x") + "), r as (select * from books where id not in (select id from h)) " + _exact(ISBN, "duplicate_by_isbn", "r"))
def _(c):
    rich = dd.with_richness(c.books)
    left = dd.without(rich, dd.exact_losers(rich, F.col("file_hash"), "duplicate_by_hash"))
    return dd.exact_losers(left, tx.isbn_key(F.col("isbn")), "duplicate_by_isbn")


@query("ddp3_fuzzy_title", f"with {KEYED}, {_greedy('f_', 'keyed', **BY_TITLE)} select * from f_found")
def _(c):
    return dd.by_title(dd.with_richness(c.books))


AUTHOR_YEAR = "{'a': author, 'b': year}"


@query("ddp4_author_year_title", f"with {KEYED}, given as (select * from keyed where author <> '' and year <> 0), {_greedy('f_', 'given', AUTHOR_YEAR)} select * from f_found")
def _(c):
    return dd.by_author_year(dd.with_richness(c.books))


@query("ddp5_survivors", _resolve("true"))
def _(c):
    return dd.resolve(c.books)


@query("ddp6_first_arrivals", """select id, case when row_number() over (partition by file_hash order by id) > 1 then 'duplicate_by_hash'
when title is not null and row_number() over (partition by lower(title) order by id) > 1 then 'duplicate_by_title' end as reason from books""")
def _(c):
    return dd.first_arrivals(c.books)


@query("ddp7_rematch_one", f"""with o as (select *, {NORM} as norm from books), x as (select * from o where id = 40)
select 40::bigint as id, o.id as master_id, case when o.file_hash = x.file_hash then 1 when {ISBN.replace("isbn", "o.isbn")} = {ISBN.replace("isbn", "x.isbn")} then 2
when o.norm <> '' and o.norm = x.norm and o.udc_code = x.udc_code then 3 when o.norm <> '' and o.norm = x.norm and o.authors = x.authors and o.year = x.year then 4 end as rule
from o, x where o.id <> 40 and rule is not null order by rule, master_id limit 1""")
def _(c):
    return dd.rematch_one(c.books, 40)


@query("ddp8_duplicate_groups", "select file_hash, min(id) as first_id, count(*) as n from files where file_hash is not null group by 1 having count(*) > 1")
def _(c):
    return dd.duplicate_groups(c.books)


@query("ddp9_ambiguous_pairs", "select detail, count(*) as n, min(file_id) as first, max(file_id) as last from quarantined where error_code = 'DEDUP_AMBIGUOUS' group by 1 having count(*) >= 2")
def _(c):
    return ag.groups_of_two(c.quarantined.where("error_code = 'DEDUP_AMBIGUOUS'"), "detail", "file_id")


@query("ddp10_force_keep", _resolve("id % 5 <> 0"))
def _(c):
    return dd.resolve(c.books, keep=c.files.where("id % 5 = 0").select("id"))


# --- classification -------------------------------------------------------------------------------

_SIGNALS = " union all ".join(f"select id, lower({c}) as t, {m} as m from books where coalesce({c}, '') <> ''" for c, m in cl.SIGNALS.items() if c != "filename")
def _spaced(pattern: str) -> str:
    """A word-bounded pattern as text to be found in the words of a text, each between spaces."""
    body = pattern.removeprefix(r"\b")
    return " " + (body.removesuffix(r"\b") + " " if body.endswith(r"\b") else body)


_TAXONOMY = ", ".join(f"('{code}', '{label}', {k}, '{_spaced(p)}', {w})" for code, label, k, p, w in cl.taxonomy_rows())
CLASSIFY = rf"""with s0 as ({_SIGNALS} union all select id, lower(regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '[_\-+]+', ' ', 'g')), {cl.SIGNALS["filename"]} from books),
s as (select id, m, ' ' || regexp_replace(t, '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ' as t from s0),
x(udc_code, udc_label, ord, pattern, w) as (values {_TAXONOMY}),
h as (select id, udc_code, udc_label, ord, round(sum(w * m), 6) as score from s join x on contains(t, pattern) group by all),
r as (select *, row_number() over (partition by id order by score desc, ord) as rank from h),
v as (select *, round_even(score / sum(score) over (partition by id) * 100, 0)::int as share from r where rank <= 5),
g as (select id, udc_code, udc_label, score, (share + case when rank = 1 then 100 - sum(share) over (partition by id) else 0 end)::int as weight, rank::int as rank from v),
every as (select * from g union all select id, '000', 'Generalities', 0.0, 100, 1 from books where id not in (select id from g))
"""


@query("cls3_scores", CLASSIFY + "select * from every")
def _(c):
    return cl.classify(c.books)


_LEARNED = r"""learned_words as (select id, subjects as code, unnest(list_distinct(regexp_extract_all(lower(description), '\p{L}{3,}'))) as word from books where subjects is not null),
sizes as (select subjects as code, count(*) as size, (sum(count(*)) over ())::bigint as total from books where subjects is not null group by 1),
counts as (select code, word, count(*) as books from learned_words group by all),
seen as (select word, sum(books)::bigint as seen from counts group by 1),
learned as (select code, word as pattern, books, round((books * total)::double / (seen * size)::double, 4) as weight,
    row_number() over (partition by code order by books * total - seen * size desc, word) as rank
  from counts join seen using (word) join sizes using (code) where books >= 5 and books * total > seen * size qualify rank <= 25)
"""


def _learned(c: Catalogue) -> DataFrame:
    return cl.learned_taxonomy(c.books, F.col("subjects"), F.col("description"))


@query("cls1_learned_taxonomy", f"with {_LEARNED} select code, pattern, books, weight, rank::int as rank from learned")
def _(c):
    return _learned(c)


@query("cls3_learned_scores", f"with {_LEARNED}" + rf""", s0 as ({_SIGNALS} union all select id, lower(regexp_replace(regexp_replace(filename, '\.[^.]*$', ''), '[_\-+]+', ' ', 'g')), {cl.SIGNALS["filename"]} from books),
lw as (select id, m, unnest(list_distinct(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'))) as word from s0),
h as (select id, code, round(sum(weight * m), 6) as score from lw join learned on word = pattern group by all),
r as (select *, row_number() over (partition by id order by score desc, code) as rank from h)
select id, code as udc_code, rank::int as rank, score from r where rank <= 5
union all select id, '000', 1, 0.0 from books where id not in (select id from h)""")
def _(c):
    scores = cl.classify(c.books, cl.taxonomy_of(_learned(c)))
    return scores.select("id", "udc_code", "rank", "score")


_ALPHABETS = ("абвгдежзиклмнопрстуфхцчшщэ", "αβγδεζηθικλμνξοπρστυφχψως", "日月火水木金土山川田人口目耳手足力刀心文学本村町空雨雪")
_LATIN = "abcdefghijklmnopqrstuvwxyz"


@query("cls5_scripts", "select p_partkey, case p_partkey % 4 when 0 then '891' when 1 then '880' when 2 then '895' else '000' end as udc_code from part")
def _(c):
    # titles in other scripts: the parts' names, letter for letter
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    title = F.when(kind == 3, F.col("p_partkey").cast("string"))
    for k, letters in enumerate(_ALPHABETS):
        title = title.when(kind == k, F.translate(F.lower(name), _LATIN, letters))
    blank = {k: F.lit(None).cast("string") for k in cl.SIGNALS if k != "title"}
    rows = c.table("part").select(F.col("p_partkey").alias("id"), title.alias("title")).withColumns(blank)
    return cl.classify(rows).select(F.col("id").alias("p_partkey"), "udc_code")


@query("cls6_primary", CLASSIFY + "select id, udc_code, udc_label from every where rank = 1")
def _(c):
    return cl.primary(cl.classify(c.books))


@query("cls7_reclassify_stats", CLASSIFY + "select count(*) as books, count(*) filter (udc_code <> '000' and weight >= 40) as categorized, count(*) - count(*) filter (udc_code <> '000' and weight >= 40) as uncategorized from every where rank = 1 and id in (select id from books where is_master = 1 and coalesce(enrich_source, '') <> 'manual')")
def _(c):
    return cl.reclassify_stats(cl.reclassify(c.books))


@query("cls8_categories", CLASSIFY + "select id, udc_code, weight, rank from every where id in (select id from books where is_master = 1) union all select id, udc_code, 100, 1 from books where is_master is distinct from 1 and coalesce(udc_code, '000') not in ('', '000')")
def _(c):
    return cl.categories_of(c.books, cl.classify(c.books.where("is_master = 1")))  # masters are classified, the others keep what they have


@query("cls9_set_class", "select file_id, tag, tag_type from tags where not (file_id in (2, 4, 7) and tag_type = 'udc') union all select file_id, '510', 'udc' from metadata where file_id in (2, 4, 7)")
def _(c):
    return cl.set_class(c.metadata, c.tags, [2, 4, 7], "510")[1].select("file_id", "tag", "tag_type")


# --- names ----------------------------------------------------------------------------------------

@query("iex2_year", r"select doc_id, try_cast(nullif(regexp_extract(text, '\b(1[89]\d{2}|20[0-2]\d)\b', 1), '') as int) as year from documents")
def _(c):
    return c.table("documents").select("doc_id", tx.extract_year(F.col("text")).alias("year"))


@query("iex3_normalised_title", f"select id, {NORM} as norm from books")
def _(c):
    return c.books.select("id", tx.normalize_title(F.col("title")).alias("norm"))


def _names(c: Catalogue) -> DataFrame:
    p = c.table("part")
    kind = F.col("p_partkey") % 6
    name = F.when(kind == 0, F.concat("p_brand", F.lit(" Vol. "), "p_size")).when(kind == 1, F.concat("p_type", F.lit(" #"), "p_size")).when(kind == 2, F.concat(F.lit("Jane Smith - "), "p_name"))
    name = name.when(kind == 3, F.concat("p_name", F.lit(" (2016) [scan] 720p"))).when(kind == 4, F.concat(F.lit("1999 - "), "p_name", F.lit(" v1.2 ebook"))).otherwise(F.concat("p_name", F.lit(" - "), "p_size", F.lit(" - part two")))
    return p.select("p_partkey", F.concat(name, F.lit(".pdf")).alias("name"))


def _cleaned(name: str) -> str:
    base = f"regexp_replace({name}, '[.][^.]*$', '')"
    for pattern in tx.NAME_DELETIONS:
        base = f"regexp_replace({base}, '{pattern}', '', 'gi')"
    base = f"regexp_replace(regexp_replace({base}, '\\s+', ' ', 'g'), '^[ ._-]+|[ ._-]+$', '', 'g')"
    return f"coalesce(nullif({base}, ''), 'untitled') || regexp_extract({name}, '[.][^.]*$')"


NAMES = """with nm as (select p_partkey, case p_partkey % 6 when 0 then p_brand || ' Vol. ' || p_size when 1 then p_type || ' #' || p_size when 2 then 'Jane Smith - ' || p_name
  when 3 then p_name || ' (2016) [scan] 720p' when 4 then '1999 - ' || p_name || ' v1.2 ebook' else p_name || ' - ' || p_size || ' - part two' end || '.pdf' as name from part)
"""


@query("iex1_clean_filename", NAMES + f"select p_partkey, name, {_cleaned('name')} as clean from nm")
def _(c):
    return _names(c).select("p_partkey", "name", tx.clean_filename(F.col("name")).alias("clean"))


@query("iex4_title_similarity", "with " + _shelf(0.5) + "select id_a, id_b, round(ratio, 9) as ratio from t_ratio")
def _(c):
    return dd.title_candidates(c.books, 0.5).select("id_a", "id_b", F.round(tx.title_similarity("norm_a", "norm_b"), 9).alias("ratio"))


def _re2(pattern: str) -> str:
    """A pattern of the engine as DuckDB reads it: ``U`` has another meaning there, and classes other names."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("IsUppercase", "Lu").replace("'", "''")


def _extracted(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def _removed(text: str, *patterns: str) -> str:
    for pattern in patterns:
        text = f"regexp_replace({text}, '{_re2(pattern)}', '', 'g')"
    return text


def _is_name(text: str) -> str:
    words = f"trim(replace({text}, '_', ' '))"
    like = lambda p: f"regexp_matches({words}, '{_re2(p)}')"
    return f"({like(tx.NAME_SHAPE)} and not {like(tx.NAME_NEVER)} and ({like(tx.NAME_HONOURED)} or not {like(tx.NAME_TOO_SHORT)} and not {like('(?i)' + tx.FILE_SUFFIX)}))"


def _split_names(source: str) -> str:
    """CTEs ``sp(p_partkey, author, title)`` from a relation with p_partkey and n: rows by dash and direction, scored, and
    the other two forms where none is left."""
    halves = " union all ".join(
        f"select p_partkey, n, {k} as place, regexp_extract(n, '^(.*?){_re2(dash)}(.*)$', 1) as l, regexp_extract(n, '^(.*?){_re2(dash)}(.*)$', 2) as r from {source}" for k, dash in enumerate(tx.DASHES)
    )
    score = " + ".join(f"case when regexp_matches(author, '{_re2(p)}') then {w} else 0 end" for p, w in tx.AUTHOR_SIGNALS)
    inside = f"trim(regexp_replace(trim(regexp_extract(n, '{_re2(tx.IN_PARENTHESES)}', 1)), ',\\s*#?\\d+.*', ''))"
    first, rest = "trim(split_part(n, '_', 1))", "trim(substring(n, instr(n, '_') + 1))"
    joined = f"instr(n, '_') > 0 and length({first}) > 1 and length({rest}) > 1 and length(string_split_regex({first}, '\\s+')) <= 4 and {_is_name(first)}"
    return rf"""hv as ({halves}),
dv as (select p_partkey, place, true as lefty, trim(l) as author, trim(r) as title from hv where length(l) > 1 and length(r) > 1 and not regexp_matches(n, '^\d') and not regexp_matches(trim(l), '{tx.FILE_SUFFIX}')
  union all select p_partkey, place, false, trim(r), trim(l) from hv where length(l) > 1 and length(r) > 1),
sv as (select *, {score} + lefty::int as score from dv where {_is_name("author")}),
bv as (select * from sv where score >= 0 qualify row_number() over (partition by p_partkey order by score desc, lefty, case when lefty then place else -place end) = 1),
sp as (select o.p_partkey, case when b.p_partkey is not null then b.author when {_is_name(inside)} then {inside} when {joined} then {first} end as author,
  case when b.p_partkey is not null then b.title when {_is_name(inside)} then trim({_removed("n", tx.IN_PARENTHESES)}) when {joined} then {rest} else n end as title
  from {source} o left join bv b on o.p_partkey = b.p_partkey)"""


_BASES = NAMES + ", bs as (select p_partkey, regexp_replace(name, '[.][^.]*$', '') as n from nm), "
_SERIES_CUTS = (r"[-–—]\s*[0-9]+\s*[-–—].*$", r"(?i)(?:#|No\.?|Issue)\s*\.?[0-9]+.*$", r"(?i)\b(Book|Part)\s*([0-9IVX]+).*$", r"(?i)\bVol(?:ume)?\.?\s*\.?[0-9]+.*$")
_SERIES = rf"""mk as (select p_partkey, n, {_extracted("n", r"(?i)\bVol(?:ume)?\.?\s*\.?([0-9]+)")} as volume, {_extracted("n", r"(?i)\bIssue\s*\.?([0-9]+)")} as named,
  {_extracted("n", r"(?i)(?:#|No\.?)\s*\.?([0-9]+)")} as mark, {_extracted("n", r"(?i)\bBook\s*([0-9IVX]+)")} as book, {_extracted("n", r"(?i)\bPart\s*([0-9IVX]+)")} as part, {_extracted("n", r"[-–—]\s*([0-9]+)\s*[-–—]")} as dash from bs),
nu as (select *, coalesce(mark, book, part, dash) as num, coalesce(named, case when book is null and part is null and not regexp_matches(n, '(?i)\bVol\b') then mark end) as issue from mk),
fr as (select *, case when num is not null then {_removed("n", *_SERIES_CUTS)} when volume is not null then {_removed("n", _SERIES_CUTS[3])} end as front from nu),
se as (select *, nullif({_removed("front", r"\(\s*\d{4}\s*\)", tx.EDGES)}, '') as series from fr),
sr as (select p_partkey, case when ok then series end as series, case when ok then num end as num, case when ok then volume end as volume, case when ok then issue end as issue
  from (select *, series is null or regexp_matches(series, '[A-Za-z]') as ok from se))"""


@query("iex5_author_title", _BASES + _split_names("bs") + " select p_partkey, author, title from sp")
def _(c):
    return _names(c).select("p_partkey", tx.author_title(tx.stem(F.col("name"))).alias("p")).select("p_partkey", "p.author", "p.title")


@query("iex8_series", _BASES + _SERIES + " select p_partkey, series, num, volume, issue from sr")
def _(c):
    return _names(c).select("p_partkey", tx.parse_series(tx.stem(F.col("name"))).alias("s")).select("p_partkey", "s.*")


@query("iex9_trailing_year", "select p_partkey, p_name || ' x' as plain, p_name as cut from part")
def _(c):
    return c.table("part").select("p_partkey", tx.strip_trailing_year(F.concat("p_name", F.lit(" x"))).alias("plain"), tx.strip_trailing_year(F.concat("p_name", F.lit(" - 2003"))).alias("cut"))


_MARK = _re2(tx.SERIES_MARK)
_FROM_NAME = _BASES + _SERIES + rf""", pl as (select p_partkey, case when regexp_matches(n, '{_MARK}') then trim(regexp_replace(n, '{_MARK}', '', 'g')) else n end as m from bs),
py as (select p_partkey, coalesce({_extracted("m", r"^(.*?)\s+[-–—]\s+\d{4}$")}, {_extracted("m", r"^(.*?)\s+(?:1[89]\d{2}|20[0-2]\d)$")}, m) as n from pl), {_split_names("py")}
select b.p_partkey, sp.author, sp.title, cast({_extracted("b.n", tx.YEAR)} as int) as year, sr.series, coalesce({_extracted("b.n", _MARK)}, {_extracted("b.n", _MARK, 2)}, sr.num) as num, sr.volume, sr.issue
from bs b join sp on sp.p_partkey = b.p_partkey join sr on sr.p_partkey = b.p_partkey"""


@query("iex10_from_filename", _FROM_NAME)
def _(c):
    return _names(c).select("p_partkey", tx.from_filename(F.col("name")).alias("f")).select("p_partkey", "f.*")


@query("iex11_folder_tag", "select id, split_part(substring(source_path, 6), '/', 1) as tag from files")
def _(c):
    return c.files.select("id", tx.folder_tag(F.col("source_path"), "/lib/").alias("tag"))


# --- full-text search -----------------------------------------------------------------------------

_TOKENS = r"""with tok as (select id as doc_id, 'title' as field, unnest(regexp_extract_all(lower(strip_accents(coalesce(title, ''))), '[\p{L}\p{N}]+')) as token from books where coalesce(title, '') <> '' or coalesce(authors, '') <> ''
union all select id, 'description', unnest(regexp_extract_all(lower(strip_accents(coalesce(description, ''))), '[\p{L}\p{N}]+')) from books where coalesce(title, '') <> '' or coalesce(authors, '') <> '')
"""


_KEPT: dict[tuple, ti.TextIndex] = {}


def _index(c: Catalogue, grams: bool = False) -> ti.TextIndex:
    """The catalogue's index: written once a session and folder, as long as the folder's files stay the same."""
    sources = [c.table(t) for t in ("documents", "labels")]
    files = [(f, c.spark.sparkContext.applicationId) for df in sources for f in df.inputFiles()]
    stamps = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time"))
    seen = tuple(str(df.select(F.hash(stamps).alias("h")).distinct().agg(F.sum("h")).first()[0]) for df in sources)
    key = (tuple(files), seen, grams)
    if key not in _KEPT:
        kept = ti.TextIndex.create(c.spark, new_path(c.spark, "text-index"), grams=grams)
        _KEPT[key] = kept.add(se.with_tag_list(c.books, c.tags), "tag_list") if grams else kept.add(c.books)
    return _KEPT[key]


def _stem_sql(word: str = "token") -> str:
    """The published stemmer as SQL over words of a relation ``words``: one step a relation, longest ending first. ``Y`` is
    a y that counts as a consonant: the first letter, or one behind a vowel."""
    vowel, other = "[aeiouy]", "[^aeiouy]"
    some, more = f"^{other}*{vowel}+{other}", f"^{other}*{vowel}+{other}+{vowel}+{other}"
    one = f"^{other}*{vowel}+{other}+{vowel}*$"
    has = lambda x: f"regexp_matches({x}, '{vowel}')"
    short = lambda x: f"regexp_matches({x}, '[^aeiouy][aeiouy][^aeiouwxyY]$')"

    def endings(table: dict[str, str], test: str, extra: dict[str, str] | None = None) -> str:
        out = "case"
        for end in sorted(table, key=len, reverse=True):
            base = f"left(s, length(s) - {len(end)})"
            also = f" and {(extra or {})[end].format(base)}" if end in (extra or {}) else ""
            out += f" when ends_with(s, '{end}') then case when regexp_matches({base}, '{test}'){also} then {base} || '{table[end]}' else s end"
        return out + " else s end"

    mended = """case when regexp_matches(b, '(at|bl|iz)$') then b || 'e' when regexp_matches(b, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy|YY|yY|Yy)$') then left(b, length(b) - 1)
      when regexp_matches(b, '{one}') and {short} then b || 'e' else b end""".format(one=one, short=short("b"))
    cut = lambda n: f"left(s, length(s) - {n})"
    steps = [
        "case when ends_with(s, 'sses') then left(s, length(s) - 2) when ends_with(s, 'ies') then left(s, length(s) - 2) when ends_with(s, 'ss') then s when ends_with(s, 's') then left(s, length(s) - 1) else s end",
        f"""case when ends_with(s, 'eed') then case when regexp_matches({cut(3)}, '{some}') then {cut(1)} else s end
          when ends_with(s, 'ed') and {has(cut(2))} then (select {mended} from (select {cut(2)} as b))
          when ends_with(s, 'ing') and {has(cut(3))} then (select {mended} from (select {cut(3)} as b)) else s end""",
        f"case when lower(right(s, 1)) = 'y' and {has(cut(1))} then {cut(1)} || 'i' else s end",
        endings(se._STEP2, some),
        endings(se._STEP3, some),
        endings(dict.fromkeys(se._STEP4, ""), more, {"ion": "regexp_matches({0}, '[st]$')"}),
        f"case when ends_with(s, 'e') and (regexp_matches({cut(1)}, '{more}') or regexp_matches({cut(1)}, '{one}') and not {short(cut(1))}) then {cut(1)} else s end",
        f"case when ends_with(s, 'll') and regexp_matches(s, '{more}') then {cut(1)} else s end",
    ]
    out = f"stem0 as (select {word} as word, regexp_replace({word}, '(^|[aeiou])y', '\\1Y', 'g') as s from words where regexp_full_match({word}, '[a-z]{{3,}}'))"
    for k, step in enumerate(steps):
        out += f",\nstem{k + 1} as (select word, {step} as s from stem{k})"
    return out + f",\nstems as (select word, lower(s) as stem from stem{len(steps)} union all select {word}, {word} from words where not regexp_full_match({word}, '[a-z]{{3,}}'))"


@query("fts1_index", _TOKENS + "select token, field, count(*) as tf, count(distinct doc_id) as df from tok group by all")
def _(c):
    return _index(c).word_counts(("title", "description"))


@query("fts2_stemmed_index", _TOKENS + ", words as (select distinct token from tok), " + _stem_sql() + " select stem as token, count(distinct doc_id) as df from tok join stems on word = token group by 1")
def _(c):
    return _index(c).stem_counts(("title", "description")).withColumnRenamed("stem", "token")


@query("agg12_index_health", _TOKENS + """select titled, indexed, indexed < 0.9 * titled as warn
from (select count(*) filter (coalesce(title, '') <> '') as titled from books), (select count(distinct doc_id) as indexed from tok)""")
def _(c):
    return ag.index_health(c.books, _index(c).documents(("title", "description")))


def _has(token: str) -> str:
    return f"doc_id in (select doc_id from tok where token {token})"


@query("fts3_boolean", _TOKENS + f"select distinct doc_id from tok where {_has("= 'the'")} and ({_has("= 'was'")} or {_has("like 'ent%'")}) and not {_has("= 'from'")}")
def _(c):
    return se.match(_index(c).unstemmed(), "the (was OR ent*) NOT from")


@query("fts3_column", _TOKENS + "select distinct doc_id from tok where field = 'title' and token = 'in'")
def _(c):
    return se.match(_index(c).unstemmed(), "title:in")


@query("fts3_phrase", "select id as doc_id from books where regexp_matches(lower(strip_accents(description)), '(^|[^\\p{L}\\p{N}])of[^\\p{L}\\p{N}]+the([^\\p{L}\\p{N}]|$)') and (coalesce(title, '') <> '' or coalesce(authors, '') <> '')")
def _(c):
    return se.match(_index(c).unstemmed(), 'description:"of the"')


@query("fts4_hybrid", _TOKENS.replace("'description', unnest(regexp_extract_all(lower(strip_accents(coalesce(description, '')))", "'rest', unnest(regexp_extract_all(lower(strip_accents(concat_ws(' ', description, authors, publisher, isbn)))")
  + f"select id from books where id in (select doc_id from tok where regexp_matches(token, '^heat(s|e|es|ed|ing|ings)?$')) or ({_like_sql('heated')})")
def _(c):
    return se.search(c.books, c.tags, se.SearchRequest(text="heated"), _index(c)).select("id")


@query("fts5_page_and_total", f"select id, count(*) over () as total from books where {_like_sql('tion')} order by id desc limit 20")
def _(c):
    rows, total = se.search_page(c.books, c.tags, se.SearchRequest(text="tion", limit=20))
    return rows.select("id").crossJoin(F.broadcast(total))


@query("fts6_tag_search", "select id from files where id in (select file_id from tags where tag ilike '%00%') order by id")
def _(c):
    return se.search_tags(c.files.select("id"), c.tags, "00")


@query("fts7_saved_searches", "select user_id as name, arg_max(event_type, event_id) as payload from events group by 1")
def _(c):
    # every event saves its user's search anew: the last one counts
    rows = c.table("events").select(F.col("user_id").alias("name"), F.col("event_type").alias("payload"), F.col("event_id").alias("at"))
    return mg.last_write(rows, "name", "at").select("name", "payload")


@query("fts8_feed_search", f"select id, count(*) over () > 10 as has_next from books where stage in ('cataloged', 'copied', 'survivor') and {_like_sql('er')} order by lower(title) nulls first, id limit 10")
def _(c):
    return se.feed_search(c.books, c.tags, "er", 10).select("id", "has_next")


# --- audits, plans, lookups -----------------------------------------------------------------------


AUDIT = f"with {DISK}, {SIMILAR}" + """, found as (
select 'missing' as finding, id, source_path as path, '' as detail from books where source_path not in (select path from disk)
union all select 'size_mismatch', id, source_path, file_size || ' ' || length from books join disk on path = source_path where length <> file_size
union all select 'metadata_issues', id, source_path, concat_ws(',', case when coalesce(pages, 0) = 0 then 'pages' end, case when trim(coalesce(cover_path, '')) = '' then 'cover' end)
  from books join disk on path = source_path where coalesce(pages, 0) = 0 or trim(coalesce(cover_path, '')) = ''
union all select 'orphan', null, path, length::varchar from disk where path not in (select source_path from files)
union all select 'duplicate', min(id), '', count(*)::varchar from files group by file_hash having count(*) > 1
union all select 'equal_title', id, '', master_id::varchar from eqt
union all select 'similar', id_a, '', id_b::varchar from sim)
"""


@query("aud1_audit_counts", AUDIT + "select finding, count(*) as n from found group by 1")
def _(c):
    return au.audit_counts(au.audit(c.books, _disk(c)))


@query("aud1_audit_preview", AUDIT + "select * from found qualify row_number() over (partition by finding order by id nulls last, path, detail) <= 20")
def _(c):
    return au.preview(au.audit(c.books, _disk(c)))


@query("aud2_reconcile", f"""with {DISK}, j as (select coalesce(path, source_path) as p, path, source_path, is_master from files full join disk on path = source_path)
select regexp_extract(p, '^(.*)/[^/]*$', 1) as folder, count(path) as found, count(*) filter (path is not null and source_path is not null) as in_db, count(*) filter (path is not null and source_path is null) as not_in_db,
count(*) filter (path is null) as no_file, count(*) filter (is_master = 1) as masters, count(*) filter (is_master = 0) as duplicates from j group by 1""")
def _(c):
    return au.reconcile(c.files, _disk(c))


@query("aud2_stages", f"""with {DISK} select stage, count(*) as books, count(*) filter (is_master = 1) as masters, count(*) filter (is_master = 0) as duplicates,
count(*) filter (source_path not in (select path from disk)) as no_file from files group by 1""")
def _(c):
    return au.reconcile_stages(c.files, _disk(c))


@query("aud2_anomalies", f"""with {DISK}, pictures as (select '/covers/' || cast(id + 5 as varchar) || '.jpg' as path from files),
named as (select file_id, cover_path as path from metadata where trim(coalesce(cover_path, '')) <> '')
select 'no_file' as kind, id, source_path as path from files where source_path not in (select path from disk)
union all select 'not_in_db', null, path from disk where path not in (select source_path from files)
union all select 'no_cover', file_id, path from named where path not in (select path from pictures)
union all select 'stray_cover', null, path from pictures where path not in (select path from named)
union all select 'no_master', id, source_path from files where is_master = 0 and coalesce(master_id, -1) not in (select id from files where is_master = 1)""")
def _(c):
    covers = c.files.select(F.concat(F.lit("/covers/"), F.col("id") + 5, F.lit(".jpg")).alias("path"))
    return au.anomalies(c.files, c.metadata, _disk(c), covers)


_RELATIONS = ("files", "metadata", "tags", "pipeline_log", "quarantined", "reader_state", "reading_list")
_HEALTH = " union all ".join(f"select '{r}' as relation, count(*) as rows from {r}" for r in _RELATIONS)


@query("aud3_diagnostics", f"""select 'relation ' || relation as check, rows::double as value, rows > 0 as ok from ({_HEALTH})
union all select 'repeated ids', count(*)::double, count(*) = 0 from (select id from files group by id having count(*) > 1)
union all select 'metadata without file', count(*)::double, count(*) = 0 from metadata where file_id not in (select id from files)
union all select 'index coverage', value, value >= 0.9 from (select count(*) filter (coalesce(title, '') <> '' or coalesce(authors, '') <> '') / greatest(count(*) filter (trim(coalesce(title, '')) <> ''), 1) as value from books)""")
def _(c):
    indexed = _index(c).documents(("title", "authors"))
    return au.diagnostics(c.files, c.metadata, indexed, {r: getattr(c, r) for r in _RELATIONS})


@query("aud4_health", f"select relation, rows, rows > 0 as ok from ({_HEALTH})")
def _(c):
    return au.relation_health({r: getattr(c, r) for r in _RELATIONS})


@query("aud5_layout_plan", rf"""with {DISK}, lost as (select * from disk where path not in (select source_path from files)),
cl as (select source_path as path, case when is_master = 1 then 'master' else 'archive' end as target from files
  union all select path, 'orphans' from lost where file_hash not in (select file_hash from files where is_master = 1)),
k as (select *, regexp_extract(path, '([^/]*)$', 1) as name, row_number() over (partition by target, lower(regexp_extract(path, '([^/]*)$', 1)) order by path) as k from cl)
select path, 'move' as action, target || '/' || case when k = 1 then name else regexp_replace(name, '\.[^.]*$', '') || ' (' || (k - 1) || ')' || regexp_extract(name, '(\.[^.]*)$', 1) end as dest from k
union all select path, 'delete', null from lost where file_hash in (select file_hash from files where is_master = 1)""")
def _(c):
    return au.layout_plan(c.files, _disk(c))


_SHELVES = "shelves as (select '/lib/' || p_brand || '/' || p_type || '/' || (p_partkey % 7) || '/' || p_partkey || '.pdf' as path, p_partkey % 7 = 3 or p_brand like '%1' as gone from part)"
_FOLDERS = f"with {_SHELVES}, each as (select unnest([array_to_string(string_split(path, '/')[1:k], '/') for k in range(3, 6)]) as folder, gone from shelves), " + """
tree as (select folder, len(string_split(folder, '/')) - 2 as depth, count(*) as files, count(*) filter (gone) as leaving from each group by 1)"""


def _shelves(c: Catalogue) -> tuple[DataFrame, DataFrame]:
    """A tree of folders by brand, container and number, and what leaves it."""
    rows = c.table("part").select(
        F.concat_ws("/", F.lit("/lib"), "p_brand", "p_type", F.col("p_partkey") % 7, F.concat("p_partkey", F.lit(".pdf"))).alias("path"),
        ((F.col("p_partkey") % 7 == 3) | F.col("p_brand").endswith("1")).alias("gone"),
    )
    return rows.select("path"), rows.where("gone")


@query("aud5_folder_tree", _FOLDERS + " select folder, depth::int as depth, files, leaving from tree")
def _(c):
    listing, gone = _shelves(c)
    return au.folder_tree(listing, "/lib", gone)


@query("snk2_emptied_folders", _FOLDERS + " select row_number() over (order by depth desc, folder) as step, folder, depth::int as depth from tree where files = leaving")
def _(c):
    listing, gone = _shelves(c)
    return au.emptied_folders(listing, "/lib/", gone)


@query("aud6_backfill_series", """with n as (select *, 'Saga ' || language || ' Vol. ' || (id % 9) as stem from books where stage in ('cataloged', 'survivor', 'copied')
  and (coalesce(series, '') = '' or coalesce(series_num, '') = '' or coalesce(volume, '') = '' or coalesce(issue, '') = '') and language is not null),
p as (select id, series, series_num, volume, issue, 'Saga ' || language as s, (id % 9)::varchar as k from n)
select id, s as series, k as series_num, k as volume, issue from p where (s, k, k) is distinct from (series, series_num, volume)""")
def _(c):
    return au.backfill_series(c.books.withColumn("filename", F.concat(F.lit("Saga "), F.col("language"), F.lit(" Vol. "), F.col("id") % 9, F.lit(".pdf"))))


@query("aud7_folder_tags", "select id as file_id, split_part(substring(source_path, 6), '/', 1) as tag from files")
def _(c):
    return au.folder_tags(c.files, c.tags, "/lib")


@query("aud7_revert_folder_tags", "select file_id, tag, tag_type from tags where tag_type <> 'custom'")
def _(c):
    return au.without_custom_tags(c.tags).select("file_id", "tag", "tag_type")


@query("lkp1_tags_of", "select file_id, tag, tag_type from tags where file_id = 4 order by tag_type, score desc, tag")
def _(c):
    return au.tags_of(c.tags, 4).select("file_id", "tag", "tag_type")


@query("lkp2_scores_of", CLASSIFY + "select * from every where id = 5 order by rank")
def _(c):
    return cl.classify(c.books.where("id = 5")).orderBy("rank")


@query("lkp3_log_of", "select id, stage from pipeline_log where file_id = 3 order by id")
def _(c):
    return au.log_of(c.pipeline_log, 3).select("id", "stage")


@query("lkp4_survivors", "select id, filename, title, authors from books where stage = 'survivor'")
def _(c):
    return au.survivors(c.files, c.metadata)


@query("lkp5_latest_drawing", "select conv_id, role, max(turn) as turn, arg_max(text, turn) as text from conversations group by conv_id, role")
def _(c):
    return au.latest_by(c.table("conversations"), ["conv_id", "role"], "turn")


@query("lkp6_update_note", "select conv_id as id, turn, case when conv_id = 3 then 'new' else role end as role, case when conv_id = 3 then null else text end as text from conversations")
def _(c):
    return au.update_note(c.table("conversations").withColumnRenamed("conv_id", "id"), 3, role="new", text=" ")


@query("lkp7_reextract_one", f"select id, {NORM} as norm, {RICH} as richness from books where id = 12")
def _(c):
    return dd.with_richness(c.books.where("id = 12")).select("id", tx.normalize_title(F.col("title")).alias("norm"), "richness")


@query("lkp8_recopy_one", "select id, source_path as src, filename as dest from files where id = 6 and stage = 'survivor'")
def _(c):
    plan = au.copy_plan(c.files.where("id = 6 and stage = 'survivor'"))
    return plan.select("id", "src", F.element_at(F.split("src", "/"), -1).alias("dest"))


@query("lkp9_status", f"""with k as (select s.stage, count(f.id) as n from {STAGE_LIST} s left join files f using (stage) group by 1)
select '{{' || string_agg('"' || stage || '":' || n, ',' order by stage) || '}}' as stages, (select count(*) from files) as files, (select max(id) from pipeline_log) as last_event from k""")
def _(c):
    return au.status(c.files, c.pipeline_log)


# --- sinks ----------------------------------------------------------------------------------------


@query("snk1_copy_plan", """with s as (select id, source_path as src, 'Title ' || (id % 20) || '.pdf' as name from files where stage = 'survivor')
select id, src, case when id = min(id) over (partition by lower(name)) then name else regexp_replace(name, '[.]pdf$', '') || '_' || id || '.pdf' end as dest from s""")
def _(c):
    return au.copy_plan(c.files.where("stage = 'survivor'").withColumn("filename", F.concat(F.lit("Title "), F.col("id") % 20, F.lit(" [x].pdf"))))


@query("snk2_moves_beside_taken", r"""with m as (select id, source_path as src, case when stage = 'copied' then 'processed/' else 'archive/' end || substring(source_path, 6) as dest from files)
select id, src, case when id % 3 = 0 then regexp_replace(dest, '(\.[^.]*)$', '_' || id || '\1') else dest end as dest from m""")
def _(c):
    taken = au.move_plan(c.files.where("id % 3 = 0"), "/lib")  # moved by an earlier run
    return au.move_plan(c.files, "/lib", taken)


@query("snk2_move_plan", "select id, source_path as src, case when stage = 'copied' then 'processed/' else 'archive/' end || substring(source_path, 6) as dest from files")
def _(c):
    return au.move_plan(c.files, "/lib")


@query("snk3_export", """select id, stage, coalesce(filename, '') as filename, coalesce(format, '') as format, coalesce(title, '') as title, coalesce(authors, '') as authors, coalesce(publisher, '') as publisher,
coalesce(cast(year as varchar), '') as year, coalesce(isbn, '') as isbn, coalesce(language, '') as language, coalesce(cast(pages as varchar), '') as pages, coalesce(udc_code, '') as udc_code, coalesce(series, '') as series,
coalesce(series_num, '') as series_num, coalesce(source_group, '') as source_group, coalesce(cast(master_id as varchar), '') as master_id, round_even(file_size / 1048576.0, 2)::double as size_mb, left(file_hash, 16) as hash,
case when is_master = 1 then 'Yes' when is_master = 0 then 'No' else '' end as is_master from books""")
def _(c):
    return fd.export_rows(c.books)


def _xml(text: str) -> str:
    out = rf"regexp_replace(coalesce({text}::varchar, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}]', '', 'g')"
    for a, b in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ('"', "&quot;"), ("''", "&apos;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


UPDATED = "2025-01-01T00:00:00Z"
ENTRY = f"""'<entry><id>urn:book:' || id || '</id><title>' || {_xml("coalesce(nullif(trim(title), ''), filename)")} || '</title><updated>{UPDATED}</updated>'
  || array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(coalesce(authors, ''), '[;&]'), lambda a: trim(a)), lambda a: a <> ''), lambda a: '<author><name>' || {_xml("a")} || '</name></author>'), '')
  || case when trim(coalesce(description, '')) <> '' then '<content type="text">' || {_xml("left(trim(description, ' '), 400)")} || '</content>' else '' end
  || case when coalesce(udc_code, '') <> '' then '<category term="' || {_xml("udc_code")} || '" label="' || {_xml("udc_code")} || '"/>' else '' end
  || case when coalesce(cover_path, '') <> '' then '<link rel="{fd.IMAGE}" type="image/jpeg" href="/opds/cover/' || id || '"/>' else '' end
  || '<link rel="{fd.ACQUIRE}" type="' || case format when 'epub' then 'application/epub+zip' when 'pdf' then 'application/pdf' when 'mobi' then 'application/x-mobipocket-ebook' else 'application/vnd.comicbook+zip' end
  || '" href="/opds/download/' || id || '"/></entry>'"""


@query("snk4_feed_entries", f"select id, title, {ENTRY} as entry from books where stage in ('cataloged', 'copied', 'survivor')")
def _(c):
    return fd.feed_entries(c.books.where(F.col("stage").isin(*se.VISIBLE)), UPDATED)


@query("snk4_navigation", f"""select udc_code, '<entry><id>urn:shelf:' || udc_code || '</id><title>' || udc_code || '</title><updated>{UPDATED}</updated><content type="text">' || count(*) || ' books</content>'
|| '<link rel="subsection" type="{fd.ACQUISITION}" href="/opds/' || udc_code || '"/></entry>' as entry from books where udc_code is not null group by 1""")
def _(c):
    return fd.navigation_entries(ag.category_facets(c.books, None), "udc_code", "udc_code", UPDATED)


@query("snk4_feed", f"""select '<?xml version="1.0" encoding="utf-8"?><feed xmlns="{fd.ATOM}" xmlns:opds="{fd.OPDS}"><id>urn:feed:/opds/all</id><title>Books</title><updated>{UPDATED}</updated>'
|| '<author><name>Library</name></author><link rel="self" type="{fd.ACQUISITION}" href="/opds/all"/><link rel="start" type="{fd.NAVIGATION}" href="/opds"/>'
|| '<link rel="search" type="{fd.SEARCH_TYPE}" href="/opds/opensearch.xml"/><link rel="next" type="{fd.ACQUISITION}" href="/opds/all?page=2"/>'
|| string_agg({ENTRY}, '' order by id) || '</feed>' as xml from (select * from books order by id limit 20)""")
def _(c):
    return fd.feed(fd.feed_entries(c.books.orderBy("id").limit(20), UPDATED), "Books", UPDATED, "/opds/all", "/opds/all?page=2")


@query("snk4_search_description", f"""select '<?xml version="1.0" encoding="utf-8"?><OpenSearchDescription xmlns="{fd.OPENSEARCH}"><ShortName>Library</ShortName><Description>Search of Library</Description>'
|| '<Url type="{fd.ACQUISITION}" template="/opds/search?q={{searchTerms}}&amp;start={{startIndex?}}"/></OpenSearchDescription>' as xml""")
def _(c):
    return fd.search_description(c.spark)


@query("snk6_snapshot", """select 'files' as relation, count(*) as rows, sum(id)::bigint as ids, count(distinct file_hash) as kinds from files
union all select 'metadata', count(*), sum(file_id)::bigint, count(distinct description) from metadata
union all select 'tags', count(*), sum(file_id)::bigint, count(distinct tag) from tags""")
def _(c):
    path = new_path(c.spark, "snapshots")
    fd.write_snapshot({"files": c.files, "metadata": c.metadata, "tags": c.tags}, path, "first")
    back = fd.read_snapshot(c.spark, path, "first")
    out = None
    for name, key, kind in (("files", "id", "file_hash"), ("metadata", "file_id", "description"), ("tags", "file_id", "tag")):
        rows = back[name].agg(F.count("*").alias("rows"), F.sum(key).alias("ids"), F.count_distinct(kind).alias("kinds")).select(F.lit(name).alias("relation"), "rows", "ids", "kinds")
        out = rows if out is None else out.unionByName(rows)
    return out


def _overrides(c: Catalogue) -> DataFrame:
    """Settings that the events' users have changed: the latest event of two kinds tells the value."""
    name = F.when(F.col("event_type") == "click", "log_days").when(F.col("event_type") == "view", "page_size")
    rows = c.table("events").select(name.alias("name"), F.col("event_id").cast("string").alias("value"), "event_id").where("name is not null")
    return mg.last_write(rows, "name", "event_id").select("name", "value")


@query("snk9_settings", """with v as (select max(event_id)::varchar as page_size, min(event_id)::varchar as other from events where event_type = 'view')
select 'overrides' as part, 2 as n, page_size from v union all select 'settings', 15, page_size from v union all select 'imported', 3, other from v""")
def _(c):
    overrides = _overrides(c)
    out = exported(resolved(c.spark, overrides, {}), overrides)
    parts = out.select(F.from_json("json", "overrides map<string, string>, settings map<string, string>").alias("j")).select("j.*")
    sizes = parts.select(F.explode(F.map_from_arrays(F.array(F.lit("overrides"), F.lit("settings")), F.array("overrides", "settings"))).alias("part", "m"))
    first = c.table("events").where("event_type = 'view'").agg(F.min("event_id").cast("string").alias("value")).select(F.lit("page_size").alias("name"), "value")
    other = first.unionByName(first.select(F.lit("enrich").alias("name"), F.lit("yes").alias("value")))
    back = imported(overrides, exported(resolved(c.spark, other, {}), other)).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    every = sizes.unionByName(back.select(F.lit("imported").alias("part"), "m"))
    return every.select("part", F.size("m").alias("n"), F.col("m")["page_size"].alias("page_size"))


@query("snk5_notes_markdown", """select conv_id as book_id, turn as created_at, case when turn % 3 = 0 then '> ' || text || chr(10) || '  Location: Page ' || (turn + 1)
when turn % 3 = 1 then '**Note:** ' || text || chr(10) || '  Tags: #' || role
else '**Bookmark:** ' || left(text, 20) || ' (12%)' || chr(10) || '  Location: Page 5' end as line from conversations""")
def _(c):
    t = c.table("conversations")
    none = F.lit(None).cast("string")
    notes = t.where("turn % 3 < 2").select(F.col("conv_id").alias("book_id"), F.when(F.col("turn") % 3 == 0, "highlight").otherwise("note").alias("type"), "text", "role", none.alias("note"), none.alias("title"), none.alias("zid"), none.alias("cfi_range"), F.col("turn").cast("int").alias("page"), F.array(F.col("role")).alias("tags"), F.col("turn").alias("created_at"))
    marks = t.where("turn % 3 = 2").select(F.col("conv_id").alias("book_id"), F.left("text", F.lit(20)).alias("label"), none.alias("cfi_loc"), F.lit(4).alias("page_num"), F.lit(12.5).alias("progress_pct"), F.col("turn").alias("created_at"))
    return fd.notes_markdown(notes, marks)


@query("snk7_snapshots_to_drop", "select o_orderkey as name, o_orderdate as created_at from orders order by created_at desc, name desc offset 14")
def _(c):
    return fd.snapshots_to_drop(c.table("orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("created_at")))


@query("snk8_json_rows", "select to_json({'n_nationkey': n_nationkey, 'n_name': n_name}) as json from nation")
def _(c):
    return fd.json_rows(c.table("nation").select("n_nationkey", "n_name"))


# --- sources and streams --------------------------------------------------------------------------


def _tree(c: Catalogue) -> str:
    return write_tree(c.spark, c.table("nation"))


#: The files of the tree, with what is known of each from the nation it was made of.
TREE = """with n as (select n_nationkey as k, n_regionkey as r, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') as name,
  (['epub', 'pdf', 'cbz', 'mobi', 'fb2'])[n_nationkey % 5 + 1] as format from nation),
tree as (select r::varchar as source_group, k || '.' || format as filename, format, k, name from n
  union all select r::varchar, k || '.azw3', 'azw3', k, name from n where format = 'mobi' union all select * from (values ('0', 'broken.epub', 'epub', null, null), ('0', 'comic.cbr', 'cbr', null, null), ('1', 'scan.djvu', 'djvu', null, null)))
"""


def _listed(c: Catalogue, content: bool = False) -> DataFrame:
    path = _tree(c)
    return listing(c.spark, [f"{path}/{k}" for k in range(5)], content=content)


@query("src1_listing", TREE + "select source_group, filename, format from tree")
def _(c):
    return _listed(c).select("source_group", "filename", "format")


@query("src2_scan_formats", TREE + "select source_group, filename from tree where format in ('pdf', 'cbz')")
def _(c):
    path = _tree(c)
    return listing(c.spark, [f"{path}/{k}" for k in range(5)], ("pdf", "cbz")).select("source_group", "filename")


@query("src4_from_paths", TREE + "select filename, format, null::varchar as source_group from tree where format in ('epub', 'pdf') and k is not null")
def _(c):
    path = _tree(c)
    nations = c.table("nation").where("n_nationkey % 5 < 2").select("n_regionkey", "n_nationkey").collect()  # ten of 25
    names = [f"{path}/{r.n_regionkey}/{r.n_nationkey}.{('epub', 'pdf')[r.n_nationkey % 5]}" for r in nations]
    return from_paths(c.spark, names).select("filename", "format", "source_group")


@query("lkp7_reextract", TREE + """select k as file_id,
case when k % 4 = 0 then 'old ' || k when format = 'cbz' then k::varchar else name end as title,
case when k % 4 = 0 or format = 'cbz' then 'Old Author' when format = 'epub' then 'Writer ' || k || '; Other' else 'Writer ' || k end as authors,
case when k % 4 = 0 then 'manual' when format = 'cbz' then 'filename' else 'embedded' end as enrich_source from tree where format in ('epub', 'pdf', 'cbz') and k is not null""")
def _(c):
    listed = _listed(c, content=True).where("format in ('epub', 'pdf', 'cbz') and filename <> 'broken.epub'")
    found = catalogued(listed, extract(listed)).withColumn("file_id", F.regexp_extract("filename", r"^(\d+)", 1).cast("bigint"))
    blank = {n: F.lit(None).cast(t) for n, t in (("publisher", "string"), ("isbn", "string"), ("language", "string"), ("pages", "int"), ("year", "int"), ("description", "string"))}
    key = F.col("n_nationkey")
    old = c.table("nation").where(key % 5 < 3).select(
        key.cast("bigint").alias("file_id"), F.concat(F.lit("old "), key).alias("title"), F.lit("Old Author").alias("authors"), F.when(key % 4 == 0, "manual").alias("enrich_source")
    )
    return au.reextracted(old.withColumns(blank), found).select("file_id", "title", "authors", "enrich_source")


_EXTRACTED = TREE + """select filename, case when format in ('epub', 'pdf', 'azw3') then name when format = 'cbz' then k::varchar end as title,
case format when 'epub' then 'Writer ' || k || '; Other' when 'pdf' then 'Writer ' || k end as authors, case when format = 'epub' then '9780' || k end as isbn,
case when format = 'epub' then 1900 + k end as year, case when format = 'cbz' then k when format = 'pdf' and k > 0 then k end as pages,
case when format in ('epub', 'pdf') then 's' || k end as subject, case when format = 'cbz' then 'page 1' end as cover,
case filename when 'broken.epub' then 'EXTRACT_FAIL' when 'comic.cbr' then 'NO_RAR_TOOL' end as error_code from tree"""


def _fields(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("filename", F.regexp_extract("path", "([^/]*)$", 1))
    title = F.when(~F.endswith("filename", F.lit(".mobi")), F.col("title"))  # where these hold a title, the tree's have offsets
    return rows.select("filename", title.alias("title"), "authors", "isbn", "year", "pages", F.col("subjects")[0].alias("subject"), F.col("cover_data").cast("string").alias("cover"), "error_code")


@query("src5_extract", _EXTRACTED)
def _(c):
    return _fields(extract(_listed(c, content=True)))


@query("src5_extract_ranges", _EXTRACTED)
def _(c):
    return _fields(extract(_listed(c)))


@query("src5_extract_large", TREE + "select filename, 'EXTRACT_FAIL' as error_code from tree where format in ('epub', 'cbz') and filename <> 'broken.epub'")
def _(c):
    rows = extract(_listed(c, content=True).where("format in ('epub', 'cbz') and filename <> 'broken.epub'"), most_bytes=20)
    return rows.select(F.regexp_extract("path", "([^/]*)$", 1).alias("filename"), "error_code")


@query("src11_full_text", TREE + "select filename, case format when 'mobi' then name || ' begins' else name || chr(10) || 'ends here' end as text from tree where format in ('mobi', 'fb2')")
def _(c):
    rows = _listed(c, content=True).where("format in ('mobi', 'fb2')")
    return rows.select("filename", full_text("content", "format").alias("t")).select("filename", F.col("t.text").alias("text"))


@query("iex12_precedence", TREE + """select filename, coalesce(case when format in ('epub', 'pdf', 'azw3') then name end, regexp_replace(filename, '[.][^.]*$', '')) as title,
case format when 'epub' then 'Writer ' || k || '; Other' when 'pdf' then 'Writer ' || k end as authors, case when format = 'epub' then 1900 + k end as year from tree where format <> 'mobi'""")
def _(c):
    listed = _listed(c, content=True).where("format <> 'mobi'")
    return catalogued(listed, extract(listed)).select("filename", "title", "authors", "year")


@query("str1_inbox", TREE + "select source_group as folder, filename, format from tree")
def _(c):
    path, out = _tree(c), new_path(c.spark, "inbox")
    take = lambda rows, _: rows.select("path", "format").write.mode("append").parquet(f"{out}/rows")
    for _ in range(2):  # the second run finds nothing new
        inbox.watch_inbox(c.spark, path, take, f"{out}/checkpoint", every=None).awaitTermination(120)
    rows = c.spark.read.schema("path string, format string").parquet(f"{out}/rows").where(~F.col("path").rlike(r"/(\.git|#recycle|%23recycle)/"))
    return rows.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("filename"), "format")


@query("src3_count_files", "select source_group, count(*) as files, sum(file_size)::bigint as bytes from files group by 1")
def _(c):
    return count_files(c.files.select("source_group", F.col("file_size").alias("length")))


@query("src13_unique_names", "select o_orderkey as id, 'f' || (o_orderkey % 50) || case when k = 1 then '' else '_' || (k - 1) end || '.pdf' as filename from (select *, row_number() over (partition by o_orderkey % 50 order by o_orderkey) as k from orders)")
def _(c):
    rows = c.table("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), F.col("o_orderkey") % 50, F.lit(".pdf")).alias("filename"))
    return unique_names(rows, rows.limit(0).select("filename"))


@query("src14_settings", """select case event_type when 'click' then 'log_days' else 'page_size' end as name, max(event_id)::varchar as value, 'override' as origin
from events where event_type in ('click', 'view') group by 1 union all select 'backups_kept', '14', 'default'""")
def _(c):
    return resolved(c.spark, _overrides(c), {}).where("name in ('log_days', 'page_size', 'backups_kept')")


@query("str2_bursts", """with e as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) as gap from events where user_id is not null and ts is not null),
r as (select user_id, ts, count(*) filter (gap is null or gap >= interval 6 hours) over (partition by user_id order by ts rows unbounded preceding) as run from e)
select user_id, min(ts)::varchar as first, max(ts)::varchar as last, count(*) as n from r group by user_id, run""")
def _(c):
    events = c.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = inbox.bursts(events, "user_id", "6 hours")
    text = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
    # as short as the other engine writes it
    return rows.select("user_id", F.regexp_replace(text("first"), r"\.?0+$", "").alias("first"), F.regexp_replace(text("last"), r"\.?0+$", "").alias("last"), "n")


@query("snk1_copies_carried_out", TREE + """select filename as dest, round, case round when 1 then 'copied' else 'present' end as outcome
from tree, (values (1), (2)) r(round) union all select 'none.pdf', round, 'failed' from (values (1), (2)) r(round)""")
def _(c):
    folder = new_path(c.spark, "copies")
    plan = _listed(c).select(F.monotonically_increasing_id().alias("id"), F.col("path").alias("src"), F.col("filename").alias("dest"))
    lost = c.table("region").limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("/none/none.pdf").alias("src"), F.lit("none.pdf").alias("dest"))
    plan = staged(plan.unionByName(lost), "copy-plan")
    rounds = [au.carry_out(plan, folder).select("dest", F.lit(k).alias("round"), "outcome") for k in (1, 2)]
    return rounds[0].unionByName(rounds[1])


@query("str5_heartbeats", "select user_id as instance_id, max(event_id) as id, arg_max(event_type, event_id) as status from events group by 1")
def _(c):
    return inbox.heartbeats(c.table("events").select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("id"), F.col("event_type").alias("status")))


@query("str8_expired", "select o_orderkey as folder from orders where o_orderdate < timestamp '1997-01-15' - interval 14 day")
def _(c):
    rows = c.table("orders").select(F.col("o_orderkey").alias("folder"), F.col("o_orderdate").cast("timestamp").alias("touched_at"))
    return inbox.expired(rows, "1997-01-15 00:00:00").select("folder")
