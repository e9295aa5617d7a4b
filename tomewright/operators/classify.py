"""Weighted-pattern classification: presence of patterns in a book's texts, top five categories with shares."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tomewright.functions.text import stem
from tomewright.operators.textindex import pieces

TOP = 5
# How much a hit counts by where it is found.
SIGNALS = {"title": 3.0, "filename": 2.0, "subjects": 2.0, "description": 1.2, "authors": 0.9, "publisher": 0.6}
# Category of a text in another script, where no pattern hits; the first block that occurs.
SCRIPTS = [
    ("880", "Classical Greek & Latin Literature", "[Ͱ-Ͽἀ-῿]"),
    ("891", "Russian & Slavic Literatures", "[Ѐ-ԯ]"),
    ("892", "Arabic & Semitic Literatures", "[֐-ۿݐ-ݿࢠ-ࣿ]"),
    ("200", "Religion. Theology", "[ऀ-෿฀-๿]"),
    ("895", "East Asian Literatures", "[぀-ヿ一-鿿㐀-䶿가-힯]"),
]
NONE = ("000", "Generalities")

#: Our own compact taxonomy, a default only; a full one is a table (code, label, ord, pattern, weight) of the caller's.
TAXONOMY = [
    ("004", "Computing", {r"\bcomput": 3.0, r"\bsoftware\b": 3.0, r"\bprogram": 2.0, r"\bdata\b": 1.5, r"\bof\b": 0.5}),
    ("100", "Philosophy", {r"\bphilosoph": 3.0, r"\bethic": 2.0, r"\blogic\b": 1.5, r"\bthat\b": 0.5}),
    ("170", "Conduct", {r"\bmoral": 2.5, r"\bidiot\b": 1.0, r"\bstupid\b": 1.0}),
    ("400", "Languages", {r"\bgramma": 3.0, r"\blanguage": 2.5, r"\bund\b": 1.0, r"\bder\b": 1.0, r"\bdie\b": 0.7}),
    ("510", "Mathematics", {r"\bmathemat": 3.0, r"\balgebra\b": 3.0, r"\bgeometr": 2.5, r"\bin\b": 0.4}),
    ("530", "Physics", {r"\bphysic": 3.0, r"\bquantum\b": 3.0, r"\benergy\b": 1.5}),
    ("610", "Medicine", {r"\bmedic": 3.0, r"\bhealth": 2.0, r"\bdisease": 2.0}),
    ("780", "Music", {r"\bmusic": 3.0, r"\bpiano\b": 2.0}),
    ("820", "English literature", {r"\bnovel": 2.5, r"\bpoem": 2.0, r"\bthe\b": 0.6, r"\band\b": 0.6}),
    ("840", "French literature", {r"\bles\b": 1.0, r"\bdes\b": 1.0, r"\best\b": 0.8}),
    ("860", "Spanish literature", {r"\blos\b": 1.0, r"\bque\b": 1.0, r"\bdel\b": 0.8}),
    ("900", "History", {r"\bhistor": 3.0, r"\bwar\b": 2.0, r"\bempire\b": 2.0, r"\bwas\b": 0.5}),
]


def taxonomy_rows() -> list[tuple[str, str, int, str, float]]:
    return [(code, label, k, pattern, weight) for k, (code, label, words) in enumerate(TAXONOMY) for pattern, weight in words.items()]


def load_taxonomy(spark: SparkSession, path: str) -> list[tuple[str, str, int, str, float]]:
    """A taxonomy from CSV with a header; thousands of patterns, small beside any book table."""
    rows = spark.read.csv(path, header=True, schema="code string, label string, ord int, pattern string, weight double")
    return sorted(((r.code.zfill(3), r.label, r.ord, r.pattern, r.weight) for r in rows.collect()), key=lambda r: r[2])


class Patterns:
    """A taxonomy's patterns, found from a text's distinct words.

    A pattern is a word, the beginning of one, or a regular expression. The first two are looked up for each distinct word
    of a batch, however many patterns there are; a regular expression is searched only in texts that have a word with its
    literal beginning, or in all texts if it has none.
    """

    def __init__(self, taxonomy: list[tuple[str, str, int, str, float]]):
        keys = sorted({(order, code, label) for code, label, order, _, _ in taxonomy})
        place = {k: i for i, k in enumerate(keys)}
        self.categories = [(code, label) for _, code, label in keys]
        self.category = np.array([place[order, code, label] for code, label, order, _, _ in taxonomy], np.int64)
        self.weight = np.array([w for *_, w in taxonomy], float)
        self.words: dict[str, list[int]] = {}
        self.beginnings: dict[str, list[int]] = {}
        self.searched: dict[int, re.Pattern] = {}
        self.everywhere: list[int] = []
        for k, (*_, pattern, _) in enumerate(taxonomy):
            found = re.fullmatch(r"\\b(\w+)(\\b)?", pattern)
            if found:
                (self.words if found[2] else self.beginnings).setdefault(found[1], []).append(k)
                continue
            self.searched[k] = re.compile(pattern, re.IGNORECASE)
            gate = literal_beginning(pattern)
            if gate:
                self.beginnings.setdefault(gate, []).append(k)
            else:
                self.everywhere.append(k)

    def of_word(self, word: str) -> list[int]:
        out = list(self.words.get(word, ()))
        for n in range(1, len(word) + 1):
            out += self.beginnings.get(word[:n], ())
        return out

    def hits(self, words: pa.ListArray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts and of patterns: each pattern once in a text that has it."""
        offsets = words.offsets.to_numpy()
        coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        each = [self.of_word(w) for w in coded.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in each], np.int64)
        flat = np.array([k for x in each for k in x], np.int64)
        starts = np.cumsum(sizes) - sizes
        code, owner = coded.indices.to_numpy(), np.repeat(np.arange(len(words)), np.diff(offsets))
        n = sizes[code]
        at = np.repeat(starts[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        wide = max(1, len(self.weight))
        keys = np.unique(np.repeat(owner, n) * wide + flat[at])
        text, pattern = keys // wide, keys % wide
        if not self.searched:
            return text, pattern
        asked = np.isin(pattern, list(self.searched))
        more = [(t, k) for t, k in zip(text[asked].tolist(), pattern[asked].tolist()) if self.searched[k].search(texts[t])]
        more += [(t, k) for k in self.everywhere for t, x in enumerate(texts) if x and self.searched[k].search(x)]
        text, pattern = (np.r_[x[~asked], np.array([m[j] for m in more], np.int64)] for j, x in enumerate((text, pattern)))
        return text, pattern


def literal_beginning(pattern: str) -> str:
    """The letters with which a word has to begin for a pattern to match at it; empty if the pattern tells none."""
    found = re.match(r"\\b(\w+)", pattern)
    if not found or "|" in re.sub(r"\([^()]*\)", "", pattern):
        return ""
    loose = pattern[found.end() : found.end() + 1] in ("?", "*", "{")
    return found[1][:-1] if loose else found[1]


def _script(texts: Column) -> Column:
    """Number of the first script that occurs, from 0; null if none does."""
    rule = F.lit(None).cast("int")
    for k, (_, _, block) in reversed(list(enumerate(SCRIPTS))):
        rule = F.when(texts.rlike(block), k).otherwise(rule)
    return F.when(texts.rlike("|".join(block for _, _, block in SCRIPTS)), rule)


#: Words whose patterns a task holds at once.
PIECE_WORDS = 500_000


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of books (id, lists of words, ..) in pieces of a bounded number of words."""
    lists = batch.column(1)
    ends = np.append(0, np.cumsum(np.diff(lists.flatten().offsets.to_numpy())))
    edges = lists.offsets.to_numpy()
    for start, count in pieces(np.diff(ends[edges - edges[0]]), PIECE_WORDS):
        yield batch.slice(start, count)


def classify(books: DataFrame, taxonomy: list[tuple[str, str, int, str, float]] | None = None) -> DataFrame:
    """``id, udc_code, udc_label, score, weight, rank``, five rows a book at most.

    A category's score is the sum of its patterns' weights, times the weight of each kind of text that has the pattern;
    weights share 100. All of a book's texts are in its row, so scoring is one pass without a shuffle. Without any hit
    the script of the texts decides.
    """
    rows = taxonomy or taxonomy_rows()
    name = F.regexp_replace(stem(F.col("filename")), r"[_\-+]+", " ")
    texts = F.array(*[F.lower(F.coalesce(name if s == "filename" else F.col(s), F.lit(""))) for s in SIGNALS])
    known = Patterns(rows)
    searched = bool(known.searched)

    def words_of(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        # where all patterns are whole words, no other word is sent
        return F.array_distinct(found if known.beginnings or known.everywhere else F.filter(found, lambda w: w.isin(list(known.words))))

    words = F.transform("texts", words_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, kinds = Patterns(rows), len(SIGNALS)
        multiples, wide = np.array(list(SIGNALS.values())), len(patterns.categories)
        for ids, lists, script, kept in (piece.columns for batch in batches for piece in _pieces(batch)):
            books_here = len(ids)
            text, pattern = patterns.hits(lists.flatten(), kept.flatten().to_pylist() if searched else [])
            cell = text // kinds * wide + patterns.category[pattern]
            scores = np.bincount(cell, patterns.weight[pattern] * multiples[text % kinds], books_here * wide).astype(float).reshape(books_here, wide).round(6)
            best = np.argsort(-scores, axis=1, kind="stable")[:, :TOP]
            top = np.take_along_axis(scores, best, axis=1)
            total = np.rint(top * 1e6).astype(np.int64).sum(axis=1) / 1e6  # so that no order of a sum counts
            share = np.rint(top / np.where(total > 0, total, 1)[:, None] * 100).astype(np.int64)
            share[:, 0] += np.where(total > 0, 100 - share.sum(axis=1), 0)
            row, rank = np.nonzero(top > 0)
            bare = np.flatnonzero(total <= 0)
            scripts = script.take(pa.array(bare)).to_pylist()
            names = [patterns.categories[k] for k in best[row, rank]] + [NONE if k is None else SCRIPTS[k][:2] for k in scripts]
            none = np.zeros(len(bare), np.int64)
            out = [
                ids.take(pa.array(np.r_[row, bare])), pa.array([n[0] for n in names], pa.string()), pa.array([n[1] for n in names], pa.string()),
                pa.array(np.r_[top[row, rank], none]), pa.array(np.r_[share[row, rank], none + 100].astype(np.int32)), pa.array(np.r_[rank + 1, none + 1].astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(out, names=["id", "udc_code", "udc_label", "score", "weight", "rank"])

    held = books.select(F.col("id").cast("long").alias("id"), texts.alias("texts"))
    sent = F.col("texts") if searched else F.array().cast("array<string>").alias("texts")
    held = held.select("id", words.alias("words"), _script(F.array_join("texts", " ")).alias("script"), sent)
    return held.mapInArrow(run, "id bigint, udc_code string, udc_label string, score double, weight int, rank int")


def learned_taxonomy(books: DataFrame, category: Column, text: Column, each: int = 25, least: int = 5) -> DataFrame:
    """``code, pattern, books, weight, rank``: the words that tell the books of a category, ``each`` of them at the most.

    A word of three letters or more ranks by how many more of the category's books have it than if it were as frequent there as
    everywhere; its weight is how many times more frequent it is. Words in fewer than ``least`` of the category's books
    are left out, and books without a category. Counts are of books, by partial aggregates.
    """
    rows = books.select(category.alias("code"), F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("words"))
    rows = rows.where("code is not null")
    sizes = rows.groupBy("code").agg(F.count("*").alias("size"))
    counts = rows.select("code", F.explode("words").alias("word")).groupBy("code", "word").agg(F.count("*").alias("books"))
    everywhere = counts.groupBy("word").agg(F.sum("books").alias("seen"))
    total = F.sum("size").over(Window.partitionBy())  # one row a category
    sizes = sizes.withColumn("total", total)
    met = counts.where(F.col("books") >= least).join(everywhere, "word").join(sizes, "code")
    beyond = F.col("books") * F.col("total") - F.col("seen") * F.col("size")
    weight = F.round((F.col("books") * F.col("total")).cast("double") / (F.col("seen") * F.col("size")).cast("double"), 4)
    met = met.withColumns({"beyond": beyond, "weight": weight}).where("beyond > 0")
    order = Window.partitionBy("code").orderBy(F.desc("beyond"), "word")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)
    return ranked.select("code", F.col("word").alias("pattern"), "books", "weight", "rank")


def taxonomy_of(learned: DataFrame) -> list[tuple[str, str, int, str, float]]:
    """A learned taxonomy for ``classify``, by code; as many rows as categories times words."""
    rows = sorted(learned.collect(), key=lambda r: (r.code, r["rank"]))
    order = {code: k for k, code in enumerate(dict.fromkeys(r.code for r in rows))}
    return [(r.code, r.code, order[r.code], rf"\b{r.pattern}\b", r.weight) for r in rows]


def primary(scores: DataFrame) -> DataFrame:
    return scores.where("rank = 1").select("id", "udc_code", "udc_label")


def reclassify(books: DataFrame, only_uncategorised: bool = False, manual_too: bool = False) -> DataFrame:
    """New scores of masters; rows classified by hand are left alone unless ``manual_too``."""
    rows = books.where("is_master = 1")
    if only_uncategorised:
        rows = rows.where(F.coalesce("udc_code", F.lit("")).isin("", "000"))
    if not manual_too:
        rows = rows.where("coalesce(enrich_source, '') <> 'manual'")
    return classify(rows)


def reclassify_stats(scores: DataFrame) -> DataFrame:
    """``books, categorized, uncategorized``; categorized: a first category of weight 40 or more that isn't 000."""
    good = F.count(F.when((F.col("udc_code") != "000") & (F.col("weight") >= 40), 1))
    return scores.where("rank = 1").agg(F.count("*").alias("books"), good.alias("categorized")).withColumn("uncategorized", F.col("books") - F.col("categorized"))


def categories_of(books: DataFrame, scores: DataFrame) -> DataFrame:
    """Scored categories; books without any show their own code at weight 100, unless that is 000."""
    own = books.join(scores, "id", "left_anti").where("coalesce(udc_code, '000') not in ('', '000')")
    return scores.select("id", "udc_code", "weight", "rank").unionByName(own.select("id", "udc_code", F.lit(100).alias("weight"), F.lit(1).alias("rank")))


def set_class(metadata: DataFrame, tags: DataFrame, ids: list[int], code: str) -> tuple[DataFrame, DataFrame]:
    """Metadata and tags after some books are given a category by hand: their udc tags become that one."""
    label = {c: name for c, name, _ in TAXONOMY} | {c: name for c, name, _ in SCRIPTS} | dict([NONE])
    hit = F.col("file_id").isin(ids)
    chosen = metadata.withColumn("udc_code", F.when(hit, F.lit(code)).otherwise(F.col("udc_code")))
    new = metadata.where(hit).select("file_id", F.lit(code).alias("tag"), F.lit("udc").alias("tag_type"), F.lit(label.get(code, "")).alias("tag_label"), F.lit(100.0).alias("score"))
    return chosen, tags.where(~(hit & (F.col("tag_type") == "udc"))).unionByName(new)
