"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths over each whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tomewright.llm import textnum as tn
from tomewright.llm.common import WORD, only, read_table

#: Largest share, in percent, of a text's word characters inside n-grams that occurred before, by n.
NGRAM_PERCENT = {5: 20, 7: 18, 10: 16}
#: Largest share, in percent, of a text's word characters inside lines that occurred before.
LINE_PERCENT = 30
MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _measure(w: tn.Words, lengths: list[int]) -> dict[str, np.ndarray]:
    owner, n = tn.owners(w.first), len(w.hashes)
    salt = tn.mix(owner.astype(np.uint64) + np.uint64(1))
    chars = tn.code_points(w.data, w.starts, w.ends)
    out = {"n_words": np.diff(w.first), "word_chars": tn.sums_by(chars, w.first)}
    symbols = np.zeros(len(w.data) + 1, np.int64)
    np.cumsum(_SYMBOL[w.data], out=symbols[1:])
    out["n_symbols"] = symbols[w.bounds[1:]] - symbols[w.bounds[:-1]]

    breaks = np.flatnonzero(w.data == 10)
    begins = np.union1d(w.bounds[:-1], breaks + 1)
    stops = np.minimum(np.r_[begins[1:], len(w.data)], len(w.data))
    stops = stops - ((stops > begins) & np.isin(stops - 1, breaks, assume_unique=False))
    lo, hi = np.searchsorted(w.starts, begins), np.searchsorted(w.starts, stops)
    real = hi > lo
    begins, stops, lo, hi = begins[real], stops[real], lo[real], hi[real]
    of = owner[lo] if n else lo
    _, before = tn.repeats(tn.byte_hashes(w.data, begins, stops) ^ tn.mix(of.astype(np.uint64) + np.uint64(1)))
    out["n_dup_lines"] = np.bincount(of[before], minlength=len(w.first) - 1)
    inside = np.zeros(n + 1, np.int32)
    np.add.at(inside, lo[before], 1)
    np.add.at(inside, hi[before], -1)
    out["dup_line_chars"] = tn.sums_by(chars * (np.cumsum(inside[:n]) > 0), w.first)

    for size in [REPEAT_WINDOW, *lengths]:
        keys = tn.window_hashes(w.hashes, size)
        whole = owner[: len(keys)] == owner[n - len(keys) :] if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(whole)
        twice, before = tn.repeats(keys[at] ^ salt[at])
        marks = np.zeros(len(keys), bool)
        if size == REPEAT_WINDOW:
            marks[at] = twice
            out["n_repeat_words"] = tn.sums_by(tn.covered(marks, size, n), w.first)
        if size in lengths:
            marks[at] = before
            out[f"dup_chars_{size}"] = tn.sums_by(chars * tn.covered(marks, size, n), w.first)
    return out


def _verdicts(texts: pa.Array, limits: dict[int, int], line_percent: int) -> Iterator[tuple[int, int, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    for i, j, w in tn.token_pieces(texts):
        m = _measure(w, sorted(limits))
        chars, words = m["word_chars"], m["n_words"]
        failed = (words < MIN_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * words)
        kept = ~failed & (100 * m["dup_line_chars"] <= line_percent * chars)
        for n, most in limits.items():
            kept &= 100 * m[f"dup_chars_{n}"] <= most * chars
        yield i, j, m, failed, kept


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram_percent: dict[int, int] | None = None, line_percent: int = LINE_PERCENT) -> DataFrame:
    """Word statistics and a keep-or-reject verdict for every whole text.

    A text is rejected if it has under 50 words, if over half of its words lie in 3-word windows found twice or
    more (``base_failed``), or if too large a share of its word characters lies in n-grams or lines that occurred
    earlier in the same text. One pass, no shuffle; memory is bounded by a batch and the longest text.

    Null and empty texts have no words and fail; null ids pass through as null; repeated rows are each judged
    alone; an empty table gives an empty result; further columns are dropped.
    """
    limits = dict(NGRAM_PERCENT if ngram_percent is None else ngram_percent)
    lengths = sorted(limits)
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"dup_chars_{n}" for n in lengths]]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, m, failed, kept in _verdicts(batch.column(1), limits, line_percent):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *[pa.array(m[k].astype(np.int64)) for k in longs], pa.array(failed), pa.array(kept)],
                    names=[id_col, *longs, "base_failed", "kept"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} bigint" for k in longs) + ", base_failed boolean, kept boolean"
    return only(docs, id_col, text_col).mapInArrow(judge, schema)


def keep_by_rules(docs: DataFrame, text_col: str = "text", ngram_percent: dict[int, int] | None = None, line_percent: int = LINE_PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, whose text ``quality_rules`` keeps; one pass without a join."""
    limits = dict(NGRAM_PERCENT if ngram_percent is None else ngram_percent)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, kept in _verdicts(batch.column(at), limits, line_percent):
                yield batch.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    grams = "".join(f", case when lead(word, {n - 1}) over d is not null then " + " || ' ' || ".join(f"lead(word, {k}) over d" if k else "word" for k in range(n)) + f" end g{n}" for n in [REPEAT_WINDOW, *NGRAM_PERCENT])
    marks = ", ".join(
        [f"count(*) over (partition by doc_id, g{REPEAT_WINDOW}) > 1 and g{REPEAT_WINDOW} is not null m{REPEAT_WINDOW}"]
        + [f"row_number() over (partition by doc_id, g{n} order by i) > 1 and g{n} is not null m{n}" for n in NGRAM_PERCENT]
    )
    cover = ", ".join(f"bool_or(m{n}) over (partition by doc_id order by i rows {n - 1} preceding) c{n}" for n in [REPEAT_WINDOW, *NGRAM_PERCENT])
    return rf"""
with d0 as (select doc_id, coalesce(text, '') as text from documents),
tok as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i
        from (select doc_id, regexp_extract_all(text, '{WORD}') as ws from d0)),
gram as (select doc_id, i, word{grams} from tok window d as (partition by doc_id order by i)),
mark as (select doc_id, i, word, {marks} from gram),
cov as (select doc_id, word, {cover} from mark),
cs as (select doc_id, count(*) as n_words, sum(length(word))::bigint as word_chars,
       count(*) filter (c{REPEAT_WINDOW}) as n_repeat_words,
       {", ".join(f"coalesce(sum(length(word)) filter (c{n}), 0)::bigint as dup_chars_{n}" for n in NGRAM_PERCENT)}
       from cov group by doc_id),
ln as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i
       from (select doc_id, string_split(text, chr(10)) as ls from d0)),
dup as (select doc_id, line, row_number() over (partition by doc_id, line order by i) > 1 as again
        from ln where regexp_matches(line, '{WORD}')),
ls as (select doc_id, count(*) filter (again) as n_dup_lines,
       coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) filter (again), 0)::bigint as dup_line_chars
       from dup group by doc_id),
al as (select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
       coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
       coalesce(dup_line_chars, 0)::bigint as dup_line_chars,
       {", ".join(f"coalesce(dup_chars_{n}, 0)::bigint as dup_chars_{n}" for n in NGRAM_PERCENT)}
       from d0 left join cs using (doc_id) left join ls using (doc_id)),
fl as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from al)
select *, not base_failed and 100 * dup_line_chars <= {LINE_PERCENT} * word_chars
       {"".join(f" and 100 * dup_chars_{n} <= {v} * word_chars" for n, v in NGRAM_PERCENT.items())} as kept
from fl"""


OP4_SQL = _oracle()
