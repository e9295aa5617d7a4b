"""Removal of repeated word windows by compaction of a De Bruijn graph whose edges are word k-mers.

1. Every window of ``window`` consecutive words is an edge between its first and last ``window - 1`` words.
   Consecutive windows that share their minimiser (the least hash of the short n-grams inside) travel as one row,
   an edge run; equal windows have equal minimisers, so only runs whose minimiser occurs twice can repeat.
2. Runs of equal words are one kind of run. Runs that follow each other at every one of their occurrences make a
   nonbranching path; joins compact it, and only its first run is joined back to the occurrences.
3. Where a minimiser has several kinds of runs (ends of repeated spans, edits), the first occurrence of each kind is
   spelled out window by window; its later ones hold no window that is new.
4. Source coordinates (document, word number) tell the first occurrence; all other occurrences are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.llm import textnum as tn
from tomewright.llm.common import drop_table, only, read_table, stage_table

WINDOW, ANCHOR = 20, 6
#: A second multiplier: run and window hashes don't depend on that of words and minimisers.
BASE2 = 0xD6E8FEB86659FD93


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """For each i the place of the least of h[i:i + span], the leftmost of equals."""
    at, width = np.arange(len(h)), 1
    pick = lambda a, b: np.where(h[a] <= h[b], a, b)
    while width * 2 <= span:
        at, width = pick(at[:-width], at[width:]), width * 2
    rest = span - width
    return pick(at[: len(at) - rest], at[rest:]) if rest else at


def edge_runs(w: tn.Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimiser: text number, first word, windows, minimiser hash, content hash."""
    n = len(w.hashes)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    grams, owner = tn.window_hashes(w.hashes, anchor), tn.owners(w.first)
    place = _least(grams, window - anchor + 1)
    starts = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    p = place[starts]
    cut = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1)])
    count = np.diff(np.r_[cut, len(starts)])
    s, p = starts[cut], p[cut]
    content = tn.span_hashes(w.hashes, s, s + count + window - 1, BASE2) + tn.mix((p - s).astype(np.uint64))
    return owner[s], s - w.first[owner[s]], count, grams[p], content


def _runs_of(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, w in tn.token_pieces(batch.column(1)):
                of, start, n, least, content = edge_runs(w, window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of + i)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(least.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["doc", "start", "n", "least", "content"],
                )

    return docs.mapInArrow(spell, f"doc {docs.schema[0].dataType.simpleString()}, start int, n int, least bigint, content bigint")


def _paths(seen: DataFrame, kinds: DataFrame) -> DataFrame:
    """Nonbranching paths of repeated runs: the path's first run, its first coordinates, its windows.

    ``seen`` has every occurrence of a repeated run with the run's number of occurrences. A run and the one behind it
    are joined if they follow each other as often as each of them occurs.
    """
    along = Window.partitionBy("doc").orderBy("start")
    steps = seen.select("least", "content", "times", "start", "n", *[F.lead(c).over(along).alias(f"{c}2") for c in ("least", "content", "times", "start")])
    steps = steps.where("start2 = start + n and times2 = times").groupBy("least", "content", "times", "least2", "content2").agg(F.count("*").alias("steps"))
    inner = steps.where("steps = times").select(F.col("least2").alias("least"), F.col("content2").alias("content"), F.lit(True).alias("inner"))
    marked = kinds.join(inner, ["least", "content"], "left").withColumn("head", F.when(F.col("inner").isNull(), F.col("fstart")))
    along = Window.partitionBy("fdoc").orderBy("fstart")
    held = marked.withColumn("path", F.last("head", True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("fn").over(Window.partitionBy("fdoc", "path"))
    return held.withColumn("windows", total.cast("int")).where("head is not null").select("least", "content", "fdoc", "fstart", "windows")


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Spans of windows that also start earlier: (doc, start, n), n windows from word ``start`` on.

    ``docs`` has an id and a text. Rows travel as minimisers (about one for eight words) first and as runs only
    where a minimiser repeats, so the shuffles stay below the size of the texts.
    """
    docs = docs.toDF("doc", "text")
    everything = stage_table(_runs_of(docs, window, anchor), "edge-runs")
    # written first: a join of two plain shuffles is one whose large partitions Spark can split
    twice = stage_table(everything.groupBy("least").agg(F.count("*").alias("times")).where("times > 1").select("least"), "repeated-minimisers")
    runs = stage_table(everything.join(twice, "least", "left_semi"), "repeated-runs")
    drop_table(everything)
    drop_table(twice)
    kinds = runs.groupBy("least", "content").agg(F.count("*").alias("times"), F.min(F.struct("doc", "start", "n")).alias("at"))
    kinds = stage_table(kinds.select("least", "content", "times", F.col("at.doc").alias("fdoc"), F.col("at.start").alias("fstart"), F.col("at.n").alias("fn")), "run-kinds")
    elsewhere = ~(F.col("doc").eqNullSafe(F.col("fdoc")) & (F.col("start") == F.col("fstart")))

    repeated = kinds.where("times > 1")
    seen = stage_table(runs.select("least", "content", "doc", "start", "n").join(repeated.select("least", "content", "times"), ["least", "content"]), "run-occurrences")
    drop_table(runs)
    paths = stage_table(_paths(seen, repeated), "paths")
    along = seen.select("least", "content", "doc", "start").join(paths, ["least", "content"]).where(elsewhere).select("doc", "start", F.col("windows").alias("n"))

    several = stage_table(kinds.groupBy("least").agg(F.count("*").alias("kinds")).where("kinds > 1").select("least"), "branching-minimisers")
    unlike = kinds.join(several, "least", "left_semi").select(F.col("fdoc").alias("udoc"), F.struct(F.col("fstart").alias("start"), F.col("fn").alias("n"), "least").alias("run"))
    unlike = unlike.groupBy("udoc").agg(F.collect_list("run").alias("at"))
    some = docs.join(unlike, docs.doc.eqNullSafe(unlike.udoc)).select("doc", "text", "at")
    kind = docs.schema["doc"].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, flat = batch.column(2).offsets.to_numpy(), batch.column(2).flatten()
            cuts = cuts - cuts[0]
            start, n, least = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for i, j, w in tn.token_pieces(batch.column(1)):
                keys = tn.window_hashes(w.hashes, window, BASE2)
                part = slice(cuts[i], cuts[j])
                of, count = np.repeat(np.arange(j - i), np.diff(cuts[i : j + 1])), n[part].astype(np.int64)
                step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                of, at = np.repeat(of, count), np.repeat(start[part], count) + step
                fits = at + window <= np.diff(w.first)[of]  # rows that repeat an id with another text
                of, at, of_least = of[fits], at[fits], np.repeat(least[part], count)[fits]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of + i)), pa.array(at.astype(np.int32)), pa.array(of_least), pa.array(keys[w.first[of] + at].view(np.int64))],
                    names=["doc", "start", "least", "content"],
                )

    windows = some.mapInArrow(spell, f"doc {kind}, start int, least bigint, content bigint")
    windows = stage_table(windows, "windows")
    firsts = windows.groupBy("least", "content").agg(F.count("*").alias("times"), F.min(F.struct("doc", "start")).alias("at")).where("times > 1")
    firsts = stage_table(firsts.select("least", "content", F.col("at.doc").alias("fdoc"), F.col("at.start").alias("fstart")), "repeated-windows")
    single = windows.join(firsts, ["least", "content"]).where(elsewhere).select("doc", "start", F.lit(1).alias("n"))
    spans = stage_table(along.unionByName(single), "spans")
    for table in (kinds, seen, paths, several, windows, firsts):
        drop_table(table)
    return spans


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, layout: str = "words") -> DataFrame:
    """Remove every word covered by a window of ``window`` words that also starts earlier in the corpus.

    Returns ``id_col, n_words, n_removed, kept_text``. Earlier: in a document with a smaller id, or further to the
    front of the same one; windows are judged on the input. ``layout="words"`` joins the words kept by one space;
    ``"original"`` keeps their separators, and leaves a text without removals (a null, too) as it is.

    Null and empty texts have no words. A null id sorts first. Rows that repeat an id are taken as one document:
    windows at equal places of such rows don't remove each other, and its spans are cut from each row. Texts
    shorter than a window are kept whole; an empty table gives an empty result; further columns are dropped.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    cut = _without_spans(only(docs, id_col, text_col).toDF("doc", "text"), window, anchor, layout)
    return cut.select(F.col("doc").cast(kind).alias(id_col), "n_words", "n_removed", "kept_text")


def rewrite_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of ``docs``, all columns, with the repeated spans cut from the text (layout ``original``)."""
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[docs[f"`{c}`"].alias(f"c{k}") for k, c in enumerate(others)]).alias("row")
    cut = _without_spans(docs.select(docs[f"`{id_col}`"].alias("doc"), docs[f"`{text_col}`"].alias("text"), row), window, anchor, "original")
    place = {c: F.col(f"row.c{k}") for k, c in enumerate(others)} | {text_col: F.col("kept_text")}
    return cut.select(*[place[c].alias(c) for c in docs.columns])


def _without_spans(docs: DataFrame, window: int, anchor: int, layout: str) -> DataFrame:
    """``docs`` (doc, text, further columns) with n_words, n_removed and kept_text in place of the text."""
    spans = repeated_spans(docs.select("doc", "text"), window, anchor).groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("start", "n")).alias("_spans"))
    further = [c for c in docs.columns if c not in ("doc", "text")]
    joined = docs.join(spans, docs.doc.eqNullSafe(spans._doc), "left").select("doc", "text", "_spans", *further)
    words_only = layout == "words"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            lists = batch.column(2)
            cuts, flat = lists.offsets.to_numpy(), lists.values
            start, n = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            for k, text in enumerate(batch.column(1)):
                raw = b"" if text.as_py() is None else text.as_buffer().to_pybytes()
                words = raw.split()
                a, b = (cuts[k], cuts[k + 1]) if lists[k].is_valid else (0, 0)
                gone = np.zeros(len(words) + 1, np.int32)
                if b > a and len(words):
                    np.add.at(gone, np.minimum(start[a:b], len(words)), 1)
                    np.add.at(gone, np.minimum(start[a:b] + n[a:b] + window - 1, len(words)), -1)
                out = np.cumsum(gone[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(out.sum()))
                if words_only:
                    kept.append(b" ".join([x for x, o in zip(words, out.tolist(), strict=True) if not o] if out.any() else words).decode())
                elif not out.any():
                    kept.append(text.as_py())
                else:
                    data = np.frombuffer(raw, np.uint8)
                    begins, _, _ = tn.word_bounds(data, np.array([0, len(data)]))
                    edge = np.r_[begins, len(data)]
                    left = np.ones(len(data), bool)
                    for x in np.flatnonzero(out):
                        left[edge[x] : edge[x + 1]] = False
                    kept.append(data[left].tobytes().decode().rstrip(" \t\n\v\f\r"))
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, *batch.columns[3:]], names=["doc", "n_words", "n_removed", "kept_text", *further])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc", *further)]
    return joined.mapInArrow(cut, ", ".join([kinds[0], "n_words bigint, n_removed bigint, kept_text string", *kinds[1:]]))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = rf"""
with tok as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i
             from (select doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from documents)),
win as (select doc_id, i, word, case when lead(word, {WINDOW - 1}) over d is not null
          then md5(string_agg(word, ' ') over (partition by doc_id order by i rows between current row and {WINDOW - 1} following)) end as win
        from tok window d as (partition by doc_id order by i)),
mark as (select doc_id, i, word, win is not null and row_number() over (partition by win order by doc_id, i) > 1 as again from win),
cov as (select doc_id, i, word, bool_or(again) over (partition by doc_id order by i rows {WINDOW - 1} preceding) as gone from mark),
agg as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed,
        coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from cov group by doc_id)
select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join agg using (doc_id)"""
