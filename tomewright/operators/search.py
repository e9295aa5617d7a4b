"""Faceted and full-text search: predicates, sorting, paging, an inverted index and its query language."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, fields
from functools import cache, reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tomewright.functions.text import leading_int

if TYPE_CHECKING:
    from tomewright.operators.textindex import Postings

SEARCHED = ("title", "authors", "publisher", "isbn", "description", "subjects", "series", "filename")
SORTS = {"id": "id", "title": "title", "authors": "authors", "year": "year", "filename": "filename", "size": "file_size", "format": "format", "stage": "stage", "publisher": "publisher", "pages": "pages"}
VISIBLE = ("cataloged", "copied", "survivor")


@dataclass
class SearchRequest:
    """One search: text, facets, order and page. Unknown sorts fall back to the id, newest first."""

    text: str = ""
    stage: str | None = None
    udc_code: str | None = None
    tag: str | None = None
    series: str | None = None
    format: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    size_from: int | None = None
    size_to: int | None = None
    masters: bool = False
    duplicates: bool = False
    untagged: bool = False
    source_group: str | None = None
    path_prefix: str | None = None
    sort: str = "id"
    descending: bool = True
    limit: int = 50
    offset: int = 0


def facet_predicate(r: SearchRequest) -> Column:
    """Conjunction of the given facets on a row of books; pushed to the scan by the planner."""
    tests = {
        "stage": lambda v: F.col("stage") == v,
        "udc_code": lambda v: F.col("udc_code") == v,
        "series": lambda v: F.lower("series") == v.lower(),
        "format": lambda v: F.col("format") == v.lower().lstrip("."),
        "year_from": lambda v: F.col("year") >= v,
        "year_to": lambda v: F.col("year") <= v,
        "size_from": lambda v: F.col("file_size") >= v,
        "size_to": lambda v: F.col("file_size") <= v,
        "masters": lambda v: F.col("is_master") == 1,
        "duplicates": lambda v: F.col("is_master") == 0,
        "source_group": lambda v: F.col("source_group") == v,
        "path_prefix": lambda v: F.col("source_path").startswith(v),
    }
    given = [tests[f.name](getattr(r, f.name)) for f in fields(r) if f.name in tests and getattr(r, f.name) not in (None, "", False)]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def like_predicate(text: str, columns: tuple[str, ...] = SEARCHED, tags: str | None = None) -> Column:
    """Every term in some column (or tag of an array column); ``%`` and ``_`` are wildcards, case doesn't count."""

    def term(t: str) -> Column:
        hits = [F.coalesce(F.col(c).ilike(f"%{t}%"), F.lit(False)) for c in columns]
        if tags:
            hits.append(F.coalesce(F.exists(F.col(tags), lambda x: x.ilike(f"%{t}%")), F.lit(False)))
        return reduce(lambda a, b: a | b, hits)

    return reduce(lambda a, b: a & b, map(term, text.replace('"', " ").split()), F.lit(True))


def with_tag_list(books: DataFrame, tags: DataFrame) -> DataFrame:
    """Books with an array of their distinct tags: one grouped join in place of an EXISTS in each OR."""
    lists = tags.groupBy(F.col("file_id").alias("id")).agg(F.collect_set("tag").alias("tag_list"))
    return books.join(lists, "id", "left")


def order_by(r: SearchRequest) -> list[Column]:
    """Sort columns; the id breaks ties. ``series``: reading order, without a series last."""
    if r.sort == "series":
        return [F.col("series").isNull(), F.col("series"), *[leading_int(F.col(c)).asc_nulls_first() for c in ("series_num", "volume", "issue")], F.col("title"), F.col("id")]
    if r.sort not in SORTS:
        return [F.desc("id")]
    column = F.col(SORTS[r.sort])
    return [column.desc() if r.descending else column.asc(), F.desc("id") if r.descending else F.asc("id")]


def page(df: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return df.offset(offset).limit(limit)


def page_with_next(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page that reads one row more, to tell whether another follows: column ``has_next``."""
    rows = df.orderBy(*order).offset(offset).limit(limit + 1)
    whole = Window.partitionBy()
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(*order))).withColumn("has_next", F.count("*").over(whole) > limit)
    return numbered.where(F.col("_n") <= limit).drop("_n")


# --- inverted index -------------------------------------------------------------------------------

INDEXED = ("title", "authors", "description", "publisher", "isbn")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, with the combining marks behind them; ``folded`` takes marks away."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\x{300}-\x{36f}]*"), F.lit(0))


@cache
def _plain_letters() -> dict[int, str]:
    """Letters of the Latin script with marks to those without, and combining marks to nothing."""
    latin = [c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if unicodedata.normalize("NFD", c) != c]
    return {ord(c): unicodedata.normalize("NFD", c)[0] for c in latin} | dict.fromkeys(range(0x300, 0x370), "")


def folded(word: str) -> str:
    """A word without the diacritics of the Latin script, composed or combining."""
    return word if word.isascii() else word.translate(_plain_letters())


_KINDS = str.maketrans(dict.fromkeys("aeiou", "v") | dict.fromkeys("bcdfghjklmnpqrstvwxz", "c"))


def _form(word: str) -> str:
    """``v`` or ``c`` for each letter; a y behind a consonant is a vowel."""
    form = word.translate(_KINDS)
    while (at := form.find("y")) >= 0:
        form = form[:at] + ("v" if at and word[at - 1] not in "aeiou" else "c") + form[at + 1 :]
    return form


def _measure(word: str) -> int:
    return _form(word).count("vc")


def _has_vowel(word: str) -> bool:
    return "v" in _form(word)


def _short_end(word: str) -> bool:
    return _form(word).endswith("cvc") and word[-1] not in "wxy"


_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


_STEP2_ENDS, _STEP3_ENDS, _STEP4_ENDS = (tuple(sorted(t, key=len, reverse=True)) for t in (_STEP2, _STEP3, _STEP4))


def porter_stem(word: str) -> str:
    """Porter's published suffix-stripping algorithm (1980)."""
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    for end, put in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + put
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and _has_vowel(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and word[-1] not in "aeioulsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for table, ends in ((_STEP2, _STEP2_ENDS), (_STEP3, _STEP3_ENDS)):
        for end in ends if word.endswith(ends) else ():
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + table[end]
                break
    for end in _STEP4_ENDS if word.endswith(_STEP4_ENDS) else ():
        if word.endswith(end):
            base = word[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _parse(query: str) -> list | None:
    """Query tree of AND (implicit), OR, NOT, "phrase", prefix* and column:term; None if it can't be read."""
    parts = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', query)
    if not parts or query.count('"') % 2:
        return None
    at = 0

    def peek() -> str | None:
        return parts[at] if at < len(parts) else None

    def take() -> str:
        nonlocal at
        at += 1
        return parts[at - 1]

    def disjunction() -> tuple:
        node = conjunction()
        while peek() == "OR":
            take()
            node = ("or", node, conjunction())
        return node

    def conjunction() -> tuple:
        node = atom()
        while peek() not in (None, "OR", ")"):
            kind = take() if peek() in ("AND", "NOT") else "AND"
            node = ("not" if kind == "NOT" else "and", node, atom())
        return node

    def atom() -> tuple:
        word = take() if peek() else ""
        if word == "(":
            node = disjunction()
            if peek() != ")":
                raise ValueError(query)
            take()
            return node
        column, mark, rest = word.partition(":")
        if mark and column in INDEXED:
            return ("in", column, term(rest or take()))
        return term(word)

    def term(word: str) -> tuple:
        if word.startswith('"'):
            return ("phrase", _plain_tokens(word[1:-1]))
        prefix = word.endswith("*")
        if not re.fullmatch(r"[\w\x80-\U0010ffff]+", word.rstrip("*") if prefix else word) or word in ("AND", "OR", "NOT"):
            raise ValueError(query)
        return ("prefix" if prefix else "word", _plain_tokens(word))

    try:
        node = disjunction()
    except (ValueError, IndexError):
        return None
    return node if at == len(parts) else None


def _plain_tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", folded(text.lower()))


def match(postings: Postings, query: str) -> DataFrame | None:
    """Documents (``doc_id``, distinct) that match a query by set algebra over postings; None for a bad query."""
    tree = _parse(query)
    return None if tree is None else _found(tree, postings, None)


def _found(node: tuple, postings: Postings, field: str | None) -> DataFrame:
    kind, ids = node[0], lambda rows: rows.select("doc_id").distinct()
    if kind == "in":
        return _found(node[2], postings, node[1])
    if kind == "prefix" and node[1]:
        return ids(postings.beginning(node[1][0], field))
    if kind in ("word", "phrase", "prefix"):
        # a query without a word finds nothing
        hit, *after = [postings.word(w, field) for w in node[1]] or [postings.word("", field)]
        if not after:
            return ids(hit)
        spread = lambda rows, k: rows.select("doc_id", "field", F.explode(F.transform("pos", lambda p: p - k)).alias("at"))
        hit = spread(hit, 0)
        for k, rows in enumerate(after, 1):
            hit = hit.join(spread(rows, k), ["doc_id", "field", "at"], "left_semi")
        return ids(hit)
    a, b = _found(node[1], postings, field), _found(node[2], postings, field)
    if kind == "or":
        return a.union(b).distinct()
    return a.join(b, "doc_id", "left_semi" if kind == "and" else "left_anti")


def search(books: DataFrame, tags: DataFrame, request: SearchRequest, postings: Postings | None = None) -> DataFrame:
    """All rows of a search, unordered: facets and (full-text match or substrings in every term).

    No join fans out, so nothing has to be made distinct: tags are semi- and anti-joins. Where the postings' index has
    grams that the terms tell, only its candidates and matches are read for substrings, else all books are.
    """
    rows = books.where(facet_predicate(request))
    custom = tags.where("tag_type = 'custom'").select(F.col("file_id").alias("id"), "tag")
    if request.tag:
        rows = rows.join(custom.where(F.col("tag") == request.tag), "id", "left_semi")
    if request.untagged:
        rows = rows.join(custom, "id", "left_anti")
    if not request.text.strip():
        return rows
    hits = match(postings, request.text) if postings is not None else None
    hits = hits.select(F.col("doc_id").alias("id")) if hits is not None else None
    near = getattr(postings, "candidates", lambda text: None)(request.text)
    if near is not None:
        near = near.select(F.col("doc_id").alias("id"))
        rows = rows.join(near if hits is None else near.union(hits), "id", "left_semi")
    wanted, flagged = like_predicate(request.text, tags="tag_list"), with_tag_list(rows, tags)
    if hits is not None:
        flagged = flagged.join(hits.withColumn("hit", F.lit(True)), "id", "left")
        wanted = F.coalesce("hit", F.lit(False)) | wanted
    return flagged.where(wanted).drop("tag_list", "hit")


def search_page(books: DataFrame, tags: DataFrame, request: SearchRequest, postings: Postings | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the page in order, a row with the total)."""
    found = search(books, tags, request, postings)
    return page(found.orderBy(*order_by(request)), request.limit, request.offset), found.agg(F.count("*").alias("total"))


def search_tags(files: DataFrame, tags: DataFrame, text: str) -> DataFrame:
    """Files with any tag that holds the text, by id."""
    return files.join(tags.where(F.col("tag").ilike(f"%{text}%")), files.id == tags.file_id, "left_semi").orderBy("id")


def feed_search(books: DataFrame, tags: DataFrame, text: str, limit: int, offset: int = 0) -> DataFrame:
    """Feed search: hidden stages go before the page is cut, so that pages are full."""
    rows = search(books.where(F.col("stage").isin(*VISIBLE)), tags, SearchRequest(text=text))
    return page_with_next(rows, [F.lower("title").asc(), F.asc("id")], limit, offset)
