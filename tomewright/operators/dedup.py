"""Duplicate resolution: exact keys by windows, fuzzy titles by greedy passes over independent blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.functions.text import isbn_key, normalize_title, richness
from tomewright.sources.shared import staged

THRESHOLD, AMBIGUOUS = 0.85, 0.70
#: Titles of a meeting place that are held against as many others in one task; pairs whose letters a task compares.
MEETING, TASK_PAIRS = 512, 4096
#: Pairs of titles whose common subsequences are found at once.
TOGETHER = 16384
#: A title's letters are dealt to so many parts, common ones evenly.
PARTS = 4


def with_richness(books: DataFrame) -> DataFrame:
    return books.withColumn("richness", richness(**{c: F.col(c) for c in ("title", "authors", "isbn", "description", "publisher", "year", "language", "pages")}))


def exact_losers(books: DataFrame, key: Column, reason: str) -> DataFrame:
    """``id, master_id, reason``: rows beside the richest of their key (ties: least id). Null keys are no duplicates.

    The best row of a key is found by a partial aggregate and joined back, so a key of any size is never sorted
    or held in one task.
    """
    rows = books.select("id", "richness", key.alias("key")).where("key is not null")
    best = rows.groupBy("key").agg(F.max_by("id", F.struct("richness", -F.col("id"))).alias("master_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(best, "key").where("id <> master_id").select("id", "master_id", F.lit(reason).alias("reason"))


#: Characters are told apart by this remainder of their code points; those that agree in it only widen the bound.
KINDS = 1021


def character_kinds(text: str) -> np.ndarray:
    """A number from 1 on for each character; equal characters have equal ones."""
    return (np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) % KINDS + 1).astype(np.uint16)


def common_lengths(codes: np.ndarray, table: np.ndarray, size: int | np.ndarray, text: np.ndarray | None = None, start: np.ndarray | int = 0, least: np.ndarray | int = 0) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts, many at once by bits (Hyyrö 2004).

    ``codes`` has a text a row, as numbers of its characters, 0 behind its end; ``table`` has for each number the places
    of that character in the other text of ``size`` characters, 64 a word. Row 0 of it is empty. Each text is compared with
    that one by default; else ``text`` has the row of each pair, and the table of its other text begins at ``start``. A pair
    that can't reach its ``least`` is given up early, and has some lesser number.
    """
    text = np.arange(len(codes)) if text is None else text
    start, size, least = (np.broadcast_to(x, len(text)) for x in (start, size, least))
    columns, places, words = codes.T.astype(np.intp, order="C"), np.ascontiguousarray(table.T), table.shape[1]
    behind = np.cumsum(columns[::-1] != 0, axis=0, dtype=np.int32)[::-1]  # characters from a column on
    out = np.zeros(len(text), np.int64)
    for begin in range(0, len(text), TOGETHER):
        live = np.arange(begin, min(begin + TOGETHER, len(text)))
        v = np.full((words, len(live)), ~np.uint64(0))
        for c, column in enumerate(columns):
            if c % 16 == 0:
                out[live] = known = np.bitwise_count(~v).sum(axis=0, dtype=np.int64)
                left = behind[c][text[live]]
                on = (left > 0) & (np.minimum(known + left, size[live]) >= least[live])
                if not on.all():
                    live, v = live[on], v[:, on]
                if not len(live):
                    break
                here, starts = text[live], start[live]
            at = column[here] + starts
            for k in range(words):
                w, m = v[k], places[k][at]
                np.bitwise_and(w, m, out=m)
                total = w + m
                over = total < m if k + 1 < words else None
                if k:  # what overflows a word goes to the next one
                    total += carry
                    over = over | (total < carry) if k + 1 < words else None
                carry = None if over is None else over.astype(np.uint64)
                np.bitwise_xor(w, m, out=m)
                np.bitwise_or(total, m, out=w)
        else:
            out[live] = np.bitwise_count(~v).sum(axis=0, dtype=np.int64)
    return out


def coded(texts: list[str]) -> np.ndarray:
    """The numbers of the characters of many texts, a text a row, 0 behind its end."""
    kinds = [character_kinds(t) for t in texts]
    out = np.zeros((len(texts), max(1, *map(len, kinds))), np.uint16)
    for row, k in zip(out, kinds, strict=True):
        row[: len(k)] = k
    return out


class Letters:
    """Some letters of many texts, as numbers from 1 on, 0 for what is left out: those from row ``known`` on with the places of
    each of their letters, to be compared with any."""

    def __init__(self, codes: np.ndarray, known: int, width: int = 0):
        used = codes > 0
        row, place = np.nonzero(used)
        self.sizes = used.sum(axis=1)
        self.codes = np.zeros((len(codes), max(1, self.sizes.max())), codes.dtype)
        at = (np.cumsum(used, axis=1) - 1)[row, place]
        self.codes[row, at] = codes[row, place]
        self.known, self.width = known, width or int(codes.max()) + 1
        self.words = np.maximum(1, -(-self.sizes[known:] // 64))
        self.table = np.zeros((len(codes) - known, self.width, self.words.max()), np.uint64)
        later = row >= known
        bit = np.uint64(1) << (at % 64).astype(np.uint64)
        np.bitwise_or.at(self.table, (row[later] - known, codes[row, place][later], at[later] // 64), bit[later])

    def most(self, text: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.minimum(self.sizes[text], self.sizes[self.known + other])

    def common(self, text: np.ndarray, other: np.ndarray, least: np.ndarray) -> np.ndarray:
        """``common_lengths`` of texts and as many others, which are numbered from ``known`` on."""
        out = np.zeros(len(text), np.int64)
        for n in np.unique(self.words[other]).tolist():
            at = np.flatnonzero(self.words[other] == n)
            table = self.table[:, :, :n].reshape(-1, n)
            out[at] = common_lengths(self.codes, table, self.sizes[self.known + other[at]], text[at], other[at] * self.width, least[at])
        return out


#: Letters of a title are counted in so many kinds, up to so many of each; what is beyond counts as agreeing.
LETTERS, MOST = 32, 16


def letter_bits(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column of bits for each text, one for each of the first letters of a kind, and the number of its other letters."""
    kind = np.arange(len(codes))[:, None] * (LETTERS + 1) + np.where(codes > 0, codes % LETTERS + 1, 0)
    counts = np.bincount(kind.ravel(), minlength=len(codes) * (LETTERS + 1)).reshape(len(codes), LETTERS + 1)[:, 1:]
    bits = np.packbits(counts[:, :, None] > np.arange(MOST)).view(np.uint64).reshape(len(codes), -1)
    return np.ascontiguousarray(bits.T), np.maximum(counts - MOST, 0).sum(axis=1)


class Standing:
    """The titles of one block that stand so far. Rows come in id order; the first hit decides, so a hit's keeper stands.

    The ratio of two titles is at most twice their longest common subsequence by their lengths together, and that is at most
    the letters that they share. Both bounds are found for many rows and all standing titles at once, and only pairs that
    reach them are compared.
    """

    #: Rows whose bounds are found at once; pairs that are held for it.
    ROWS, PAIRS = 512, 1 << 20

    def __init__(self, threshold: float, ambiguous: float, gate: bool):
        self.threshold, self.ambiguous, self.gate = threshold, ambiguous, gate
        self.block: object = None
        self._clear()

    def _clear(self) -> None:
        self.rows: list[tuple[int, str, int]] = []
        self.codes, self.stands = np.zeros((0, 1), np.uint16), np.zeros(0, bool)

    def add(self, i: int, title: str, rich: int) -> Iterator[tuple[int, int, float, bool]]:
        """``id, master_id, ratio, ambiguous`` of one more row: its reports and at most one loss."""
        yield from self.add_rows([(i, title, rich, self.block)])

    def add_rows(self, rows: list[tuple[int, str, int, object]]) -> Iterator[tuple[int, int, float, bool]]:
        """The same for many rows with their blocks, each block's rows together; a new block begins with no title standing."""
        for k in range(0, len(rows), self.ROWS):
            yield from self._add(rows[k : k + self.ROWS])

    def _add(self, rows: list[tuple[int, str, int, object]]) -> Iterator[tuple[int, int, float, bool]]:
        kinds: dict[tuple[object, str], int] = {}  # equal titles of a block have the same near ones
        of = [kinds.setdefault((at, title), len(kinds)) for _, title, _, at in rows]
        codes = coded([title for _, title in kinds])
        kept, new = self._near(list(kinds), codes)
        here: list[list[int]] = [[] for _ in kinds]  # rows of a kind that stand
        matcher, continued = SequenceMatcher(None), self.block
        for n, (i, title, rich, at) in enumerate(rows):
            if at != self.block:
                self.block, here = at, [[] for _ in kinds]
                self._clear()
            tried = [(k, self.rows[k], True) for k in kept[of[n]] if self.stands[k]] if at == continued else []
            tried += [(k, rows[k][:3], False) for k in sorted(k for other in new[of[n]] for k in here[other])]
            if tried:
                matcher.set_seq2(title)
            for k, (j, other, other_rich), old in tried:
                if self.gate and abs(len(other) - len(title)) > max(len(title) // 3, 10):
                    continue
                matcher.set_seq1(other)
                ratio = matcher.ratio()
                if ratio >= self.threshold:
                    if rich <= other_rich:
                        yield i, j, ratio, False
                        break
                    yield j, i, ratio, False
                    if old:
                        self.stands[k] = False
                    else:
                        here[of[k]].remove(k)
                    here[of[n]].append(n)
                    break
                if ratio >= self.ambiguous:
                    yield i, j, ratio, True
            else:
                here[of[n]].append(n)
        self._append([(rows[k][:3], codes[of[k]]) for k in sorted(k for some in here for k in some)])

    def _near(self, kinds: list[tuple[object, str]], codes: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
        """For each title, oldest first, the kept ones of its block that may be as like as ``ambiguous``, and the numbers of
        those beside it, itself included."""
        known, wide = len(self.rows), max(self.codes.shape[1], codes.shape[1])
        pool = np.vstack([np.pad(c, ((0, 0), (0, wide - c.shape[1]))) for c in (self.codes, codes)])
        sizes, stands = np.count_nonzero(pool, axis=1), np.append(self.stands, np.ones(len(kinds), bool))
        bits, beyond = letter_bits(pool)
        each = np.bincount(codes.ravel(), minlength=KINDS + 1)
        each[0] = 0
        used = np.argsort(-each, kind="stable")[: np.count_nonzero(each)]
        number = np.zeros(KINDS + 1, np.uint16)
        number[used] = np.arange(1, len(used) + 1)
        whole = Letters(number[pool], known)
        # what all letters have in common is at most the sum over parts of them, whose texts mostly fit into a word
        deal = np.arange(len(used) + 1) % (2 * PARTS)
        part = np.minimum(deal, 2 * PARTS - 1 - deal)[whole.codes]
        parts = [Letters(np.where((part == k) & (whole.codes > 0), whole.codes, 0), known, whole.width) for k in range(PARTS)]
        kept: list[list[int]] = [[] for _ in kinds]
        new: list[list[int]] = [[k] for k in range(len(kinds))]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def compare() -> None:
            text, kind, least = (np.concatenate(x) for x in zip(*held, strict=True))
            got = sum(part.most(text, kind) for part in parts)
            for part in parts:
                most = part.most(text, kind)
                got += part.common(text, kind, least / 2 - got + most) - most
                on = got >= least / 2
                text, kind, least, got = text[on], kind[on], least[on], got[on]
            on = 2 * whole.common(text, kind, least / 2) >= least
            for a, b in zip(text[on].tolist(), kind[on].tolist(), strict=True):
                if a < known:
                    kept[b].append(a)
                else:
                    new[a - known].append(b)
                    new[b].append(a - known)
            held.clear()

        begin = waiting = 0
        for k, (at, title) in enumerate(kinds):
            if k and at != kinds[k - 1][0]:
                begin = known + k
            elif not k and at != self.block:
                begin = known
            end, size = known + k, len(title)
            others = sizes[begin:end]
            least = self.ambiguous * (others + size) - 1e-6  # a hair less, against rounding
            shared = np.bitwise_count(bits[:, begin:end] & bits[:, end, None]).sum(axis=0, dtype=np.int64) + np.minimum(beyond[begin:end], beyond[end])
            near = stands[begin:end] & (2 * np.minimum(others, size) >= least) & (2 * shared >= least)
            if self.gate:
                near &= np.abs(others - size) <= np.maximum(np.maximum(others, size) // 3, 10)
            at = np.flatnonzero(near)
            if len(at):
                held.append((at + begin, np.full(len(at), k), least[at]))
                waiting += len(at)
            if waiting >= self.PAIRS:
                compare()
                waiting = 0
        if held:
            compare()
        return kept, new

    def _append(self, rows: list[tuple[tuple[int, str, int], np.ndarray]]) -> None:
        """Leave out what doesn't stand; keep these rows behind it."""
        stay = np.flatnonzero(self.stands)
        self.rows = [self.rows[k] for k in stay.tolist()] + [row for row, _ in rows]
        codes = [self.codes[stay], *([np.stack([c for _, c in rows])] if rows else [])]
        wide = max(c.shape[1] for c in codes)
        self.codes = np.vstack([np.pad(c, ((0, 0), (0, wide - c.shape[1]))) for c in codes])
        self.stands = np.ones(len(self.rows), bool)


def fuzzy_pairs(books: DataFrame, block: list[Column], gate: bool, threshold: float = THRESHOLD, ambiguous: float = AMBIGUOUS) -> DataFrame:
    """Greedy fuzzy title matches inside blocks: ``id, master_id, ratio, ambiguous`` (those below the threshold are reports).

    Pairs are compared inside a block alone, so blocks run in parallel with the result of the sequential pass. The
    pass itself depends on its order, so one block is one task: its work is its rows times the titles that still stand,
    for which a bound is found in whole arrays, so that a row costs as little as its like titles.
    Rows stream through it as Spark has sorted them (a sort spills to disk), so that it holds these titles and one Arrow
    batch, however many rows the block has. Rows come with a ``norm`` where the caller has it.
    """
    rows = books if "norm" in books.columns else books.withColumn("norm", normalize_title(F.col("title")))
    keys = [c.alias(f"b{k}") for k, c in enumerate(block)]
    rows = rows.where("norm <> ''").select("id", "norm", "richness", *keys)
    names = [f"b{k}" for k in range(len(block))]
    paired = rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(paired, [rows[n].eqNullSafe(paired[n]) for n in names], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        standing = Standing(threshold, ambiguous, gate)
        for batch in batches:
            hits = list(standing.add_rows([(i, title, rich, tuple(at)) for i, title, rich, *at in zip(*(c.to_pylist() for c in batch.columns), strict=True)]))
            columns = list(zip(*hits, strict=True)) if hits else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "master_id", "ratio", "ambiguous"])

    # a number, else blocks of few bytes and much work would be put together; several a core, as blocks differ
    parts = max(int(books.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * books.sparkSession.sparkContext.defaultParallelism)
    ordered = rows.repartition(parts, *names).sortWithinPartitions(*names, "id").select("id", "norm", "richness", *names)
    return ordered.mapInArrow(run, "id bigint, master_id bigint, ratio double, ambiguous boolean")


def author_key() -> Column:
    return F.lower(F.trim(F.coalesce("authors", F.lit(""))))


def keyed(books: DataFrame) -> DataFrame:
    """The narrow relation that the passes work on: ``id, richness, file_hash, isbn, norm, udc_code, authors, year``."""
    rich = books if "richness" in books.columns else with_richness(books)
    return rich.select("id", "richness", "file_hash", "isbn", normalize_title(F.col("title")).alias("norm"), "udc_code", author_key().alias("authors"), "year")


def by_title(books: DataFrame, **limits: float) -> DataFrame:
    """Fuzzy titles within a category, the first four letters and the author (blank categories agree, and blank authors)."""
    norm = F.col("norm") if "norm" in books.columns else normalize_title(F.col("title"))
    return fuzzy_pairs(books, [F.coalesce("udc_code", F.lit("")), F.left(norm, F.lit(4)), author_key()], True, **limits)


def by_author_year(books: DataFrame, **limits: float) -> DataFrame:
    """Fuzzy titles of one author and year, both given."""
    rows = books.where((author_key() != "") & (F.coalesce("year", F.lit(0)) != 0))
    return fuzzy_pairs(rows, [author_key(), F.col("year")], False, **limits)


def without(books: DataFrame, losers: DataFrame) -> DataFrame:
    return books.join(losers.select("id"), "id", "left_anti")


def resolve(books: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """All four passes: ``id, is_master, master_id, reason``; a row out in one pass is unseen by the later ones.

    ``keep`` (a column id) names rows that stay masters whatever matches them. Texts and covers are read once: the
    passes work on a narrow relation, and each writes its losers, so none repeats the ones before it.
    """
    rows = staged(keyed(books), "books-keyed")
    # titles below the threshold are reports, which nobody reads here: they aren't compared
    left, losers = rows if keep is None else rows.join(keep.select("id"), "id", "left_anti"), []
    passes = (
        ("duplicate_by_hash", lambda left: exact_losers(left, F.col("file_hash"), "")),
        ("duplicate_by_isbn", lambda left: exact_losers(left, isbn_key(F.col("isbn")), "")),
        ("duplicate_by_title", lambda left: by_title(left, ambiguous=THRESHOLD)),
        ("duplicate_by_author_year_title", lambda left: by_author_year(left, ambiguous=THRESHOLD)),
    )
    for reason, search in passes:
        losers.append(staged(search(left).select("id", "master_id", F.lit(reason).alias("reason")), reason))
        left = without(left, losers[-1])
    found = reduce(DataFrame.unionByName, losers)
    out = rows.select("id").join(found, "id", "left")
    return out.select("id", F.col("reason").isNull().cast("int").alias("is_master"), "master_id", F.coalesce("reason", F.lit("survivor")).alias("reason"))


def title_ratio(norm: Column, title: str) -> Column:
    """Likeness of normalised titles to one; null for a null title."""

    @F.pandas_udf("double")
    def ratio(norms: pd.Series) -> pd.Series:
        matcher = SequenceMatcher(None, "", title)
        out = []
        for x in norms:
            if x is None:
                out.append(None)
                continue
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    return ratio(norm)


def rematch_one(books: DataFrame, file_id: int, threshold: float = THRESHOLD) -> DataFrame:
    """What one row duplicates now: the first of hash, isbn, title with category, author with year; least id first.

    Titles match from the threshold on, and only with rows that are as rich at least. The row's keys become literals,
    so the search is one scan; titles are compared where category, or author and year, agree.
    """
    keys = (F.col("file_hash"), isbn_key(F.col("isbn")), normalize_title(F.col("title")), F.coalesce("udc_code", F.lit("")), author_key(), F.coalesce("year", F.lit(0)), F.col("richness"))
    rich = with_richness(books)
    own = rich.where(F.col("id") == file_id).select(*keys).first() or (None,) * len(keys)
    same = [c == F.lit(v) for c, v in zip(keys, own, strict=True)]
    author = same[4] & same[5] & (keys[4] != "") & (keys[5] != 0)
    searched = (same[3] | author) & (keys[6] >= F.lit(own[6])) & (keys[2] != "") & F.lit(bool(own[2]))
    like = title_ratio(F.when(searched, keys[2]), own[2] or "") >= threshold
    rule = F.when(same[0], 1).when(same[1], 2).when(like & same[3], 3).when(like & author, 4)
    others = rich.where(F.col("id") != file_id).select(F.lit(file_id).cast("bigint").alias("id"), F.col("id").alias("master_id"), rule.alias("rule"))
    return others.where("rule is not null").orderBy("rule", "master_id").limit(1)


def duplicate_groups(books: DataFrame) -> DataFrame:
    """Hashes with several files: least id and number. Members stay rows; they aren't collected."""
    return books.where("file_hash is not null").groupBy("file_hash").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


def title_words() -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all("norm", F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3))


def shelf_titles(books: DataFrame) -> DataFrame:
    """``id, norm, words``, written once: normalised titles, of the file's name where there is no title; those without a
    word go. What asks for titles takes this relation in the place of books."""
    if "words" in books.columns:
        return books
    name = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("filename"))
    rows = books.select("id", normalize_title(name).alias("norm")).withColumn("words", title_words())
    return staged(rows.where(F.size("words") > 0), "shelf-titles")


def title_candidates(books: DataFrame, jaccard: float = 0.8, threshold: float = 0.0) -> DataFrame:
    """``id_a, n_a, norm_a, id_b, n_b, norm_b, jaccard``: titles with a common eight-letter beginning and like words
    (length three or more), each by its least id and the number of its files; those too unlike in length for the
    threshold are left out.

    Two sets at a Jaccard similarity s share one of the first (1 - s) n + 1 of the words of either in any one order, so
    titles meet in those: in the order of the corpus's counts, rarest first, so that no common word is a meeting place.
    """
    titles = shelf_titles(books).groupBy("norm").agg(F.min("id").alias("id"), F.first("words").alias("words"), F.count("*").alias("n"))
    titles = staged(titles.withColumn("block", F.left("norm", F.lit(8))), "title-kinds")
    counts = titles.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("seen"))
    each = titles.select("id", F.explode("words").alias("word")).join(counts, "word")
    ordered = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seen", "word"))), lambda x: x["word"]).alias("ordered"))
    # one word more than the bound asks for, against rounding
    few = F.least(F.size("words"), F.floor((1 - jaccard) * F.size("words")).cast("int") + 2)
    met = titles.select("id", "block", "words").join(ordered, "id").select("id", "block", F.slice("ordered", F.lit(1), few).alias("meets"))
    met = met.select("id", "block", "meets", F.posexplode("meets").alias("k", "meet"))
    # two titles are a pair at the first place where they meet
    met = met.select("id", "block", "meet", F.slice("meets", F.lit(1), F.col("k")).alias("before"))
    place = Window.partitionBy("block", "meet")
    chunk = lambda k: F.floor((k - 1) / MEETING).cast("int")
    met = met.withColumns({"chunk": chunk(F.row_number().over(place.orderBy("id"))), "here": F.count("*").over(place)}).where("here > 1")
    met = met.withColumn("last", chunk(F.col("here"))).drop("here").join(titles.drop("block"), "id")
    met = staged(met, "title-meetings")
    sides = ("id", "n", "norm", "words", "before")
    # two chunks meet in a task, so that a place where very many titles meet is the work of many tasks
    later, earlier = F.explode(F.sequence("chunk", "last")), F.explode(F.sequence(F.lit(0), "chunk"))
    a = met.select("block", "meet", F.col("chunk").alias("chunk_a"), later.alias("chunk_b"), *[F.col(c).alias(f"{c}_a") for c in sides])
    b = met.select("block", "meet", earlier.alias("chunk_a"), F.col("chunk").alias("chunk_b"), *[F.col(c).alias(f"{c}_b") for c in sides])
    share = F.size(F.array_intersect("words_a", "words_b")) / F.size(F.array_union("words_a", "words_b"))
    long, short = F.greatest(F.length("norm_a"), F.length("norm_b")), F.least(F.length("norm_a"), F.length("norm_b"))
    near = (F.col("id_a") < F.col("id_b")) & (2 * short >= threshold * (long + short)) & ~F.arrays_overlap("before_a", "before_b")
    pairs = a.join(b, ["block", "meet", "chunk_a", "chunk_b"]).where(near).withColumn("jaccard", share).where(F.col("jaccard") >= jaccard)
    return evenly(pairs.select("id_a", "n_a", "norm_a", "id_b", "n_b", "norm_b", F.round("jaccard", 6).alias("jaccard")), "title-pairs")


def evenly(pairs: DataFrame, name: str) -> DataFrame:
    """Pairs written once and dealt to as many tasks as their number asks for: few bytes tell nothing of the work."""
    kept = staged(pairs, name)
    return kept.repartition(max(1, -(-kept.count() // TASK_PAIRS)))


def similar_titles(books: DataFrame, jaccard: float = 0.8, threshold: float = 0.95) -> DataFrame:
    """``id_a, n_a, id_b, n_b, jaccard, ratio``: titles that differ, like by words and by the ratio of their letters.

    A title is its least id and the number of its files; ``equal_titles`` tells the files, so no group of copies makes
    pairs and no link is lost.
    """
    pairs = title_candidates(books, jaccard, threshold).withColumn("ratio", ratio_from(threshold)("norm_a", "norm_b")).where(F.col("ratio") >= threshold)
    return pairs.select("id_a", "n_a", "id_b", "n_b", "jaccard", F.round("ratio", 6).alias("ratio"))


def ratio_from(threshold: float) -> Callable[[str, str], Column]:
    """Ratio of two titles, null if it is below the threshold: compared only where so many of their letters, counted by kind,
    agree that it may reach it."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        out, matcher, counts = [], SequenceMatcher(None), lru_cache(4096)(Counter)
        for x, y in zip(a, b, strict=True):
            least = threshold * (len(x) + len(y)) - 1e-6  # a hair less, against rounding
            if 2 * (counts(x) & counts(y)).total() < least:
                out.append(None)
                continue
            if y != matcher.b:
                matcher.set_seq2(y)
            matcher.set_seq1(x)
            out.append(matcher.ratio())
        return pd.Series(out, dtype="float64")

    # else the planner would filter pairs, and so compare them, before they are dealt
    return ratio.asNondeterministic()


def equal_titles(books: DataFrame) -> DataFrame:
    """``id, master_id``: files of a title that another file of a lesser id has, and the least of these."""
    rows = shelf_titles(books)
    first = rows.groupBy("norm").agg(F.min("id").alias("master_id"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, "norm").where("id <> master_id").select("id", "master_id")


def title_duplicates(books: DataFrame, jaccard: float = 0.8, threshold: float = 0.95) -> DataFrame:
    """``id, master_id, kind``: files of like titles, by the audit's two limits: of an equal title (``equal``), by the
    least id; of titles that differ, the least ids (``similar``)."""
    titles = shelf_titles(books)
    near = similar_titles(titles, jaccard, threshold).select(F.col("id_b").alias("id"), F.col("id_a").alias("master_id"), F.lit("similar").alias("kind"))
    return equal_titles(titles).select("id", "master_id", F.lit("equal").alias("kind")).unionByName(near)


def first_arrivals(files: DataFrame) -> DataFrame:
    """Arrivals against what came before: reason duplicate_by_hash, duplicate_by_title or null, by id order."""
    title = F.lower("title")
    first_hash = files.where("file_hash is not null").groupBy("file_hash").agg(F.min("id").alias("first_hash"))
    first_title = files.where("title is not null").groupBy(title.alias("low")).agg(F.min("id").alias("first_title"))
    rows = files.select("id", "file_hash", title.alias("low")).join(first_hash, "file_hash", "left").join(first_title, "low", "left")
    return rows.select("id", F.when(F.col("first_hash") < F.col("id"), "duplicate_by_hash").when(F.col("first_title") < F.col("id"), "duplicate_by_title").alias("reason"))
