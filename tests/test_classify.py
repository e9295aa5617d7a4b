"""Classification by all patterns at once against trying each on each text; learned taxonomies against plain counts."""

import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from tomewright.operators import classify as cl

COLUMNS = ("title", "filename", "subjects", "description", "authors", "publisher")


def brute(book, taxonomy):
    """(code, label, score, weight) by rank: every pattern is searched in every text."""
    texts = dict(zip(COLUMNS, book[1:]))
    texts["filename"] = re.sub(r"[_\-+]+", " ", re.sub(r"(?<=[^.])\.[^.]*$", "", texts["filename"] or ""))
    signals = [((texts[s] or "").lower(), m) for s, m in cl.SIGNALS.items()]
    scores = {}
    for code, label, order, pattern, w in taxonomy:
        scores.setdefault((order, code, label), 0.0)
        scores[order, code, label] += sum(w * m for t, m in signals if re.search(pattern, t, re.IGNORECASE))
    best = sorted(((round(v, 6), k) for k, v in scores.items() if round(v, 6) > 0), key=lambda x: (-x[0], x[1]))[: cl.TOP]
    if not best:
        joined = " ".join(t for t, _ in signals)
        code, label = next(((c, n) for c, n, block in cl.SCRIPTS if re.search(block, joined)), cl.NONE)
        return [(code, label, 0.0, 100)]
    total = sum(v for v, _ in best)
    weights = [round(v / total * 100) for v, _ in best]
    weights[0] += 100 - sum(weights)
    return [(k[1], k[2], v, w) for (v, k), w in zip(best, weights)]


def some_books(rng, n):
    words = ["data", "science", "datum", "mining", "colour", "color", "été", "über_x", "a1", "1a", "жизнь", "λόγος", "x" * 5000, "data-science", "", "naïve"]
    text = lambda: None if rng.random() < 0.2 else rng.choice([" ", ", ", "\n"]).join(rng.choices(words, k=rng.randint(0, 9)))
    books = [(i, text(), f"data_science-{i}.pdf" if rng.random() < 0.3 else "q.pdf", text(), text(), text(), text()) for i in range(n)]
    return [*books, (n, None, None, None, None, None, None), (n + 1, "жизнь", "", None, "", None, None), (n + 2, "", "日本.pdf", "", "λόγος", "", "")]


def test_all_patterns_at_once_equal_each_by_itself(spark):
    rng = random.Random(1)
    books = some_books(rng, 150)
    patterns = [r"\bdata\b", r"\bdat", r"\bdata science\b", r"\bcolou?r", r"mining", r"\b(data|science)\b", r"\bété\b", r"\bnaïv", r"\bdata (mining|science)", r"\bscience\b|\bmining\b", r"a\d", r"\bxxxx", r"\büber"]
    taxonomy = [(f"{k % 5}", f"l{k % 5}", k % 5, p, rng.choice([0.5, 1.0, 2.5])) for k, p in enumerate(patterns)]
    taxonomy += [(f"c{k}", "many", 5 + k, rf"\b{w}\b", 1.0) for k in range(60) for w in ("data", f"w{k}", f"a{k}", "science")]
    schema = "id bigint, " + ", ".join(f"{c} string" for c in COLUMNS)
    df = spark.createDataFrame(books, schema).repartition(3)
    for used in (taxonomy, [t for t in taxonomy if re.fullmatch(r"\\b\w+(\\b)?", t[3])], cl.taxonomy_rows()):
        got = {}
        for r in cl.classify(df, used).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.udc_code, r.udc_label, r.score, r.weight))
        for b in books:
            assert got[b[0]] == brute(b, used), (got[b[0]], brute(b, used))
        assert len(got) == len(books)


def test_literal_beginnings():
    for pattern, gate in ((r"\bdata (a|b)", "data"), (r"\bcolou?r", "colo"), (r"\ba|\bb", ""), (r"mining", ""), (r"\b(x|y)", ""), (r"\bx{0,2}y", ""), (r"\bab*", "a")):
        assert cl.literal_beginning(pattern) == gate


def test_learned_words_equal_plain_counts(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", "z", None]), " ".join(rng.choices(["aaa", "bbb", "ccc", "ddd", "ee", "Fff"], k=rng.randint(0, 4)))) for _ in range(300)] + [("x", None)]
    got = cl.learned_taxonomy(spark.createDataFrame(rows, "kind string, body string"), F.col("kind"), F.col("body"), each=2, least=3)
    use = [(k, set(re.findall(r"[a-z]{3,}", (t or "").lower()))) for k, t in rows if k]
    size, seen, both = Counter(k for k, _ in use), Counter(w for _, ws in use for w in ws), Counter((k, w) for k, ws in use for w in ws)
    want = []
    for k in size:
        ranked = sorted((-(n * len(use) - seen[w] * size[k]), w, n) for (c, w), n in both.items() if c == k and n >= 3 and n * len(use) > seen[w] * size[k])
        want += [(k, w, n, round(n * len(use) / (seen[w] * size[k]), 4), i + 1) for i, (_, w, n) in enumerate(ranked[:2])]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    taxonomy = cl.taxonomy_of(got)
    assert [t[2] for t in taxonomy] == sorted(t[2] for t in taxonomy) and len(taxonomy) == len(want)


def test_books_are_classified_in_pieces_of_bounded_words(monkeypatch):
    monkeypatch.setattr(cl, "PIECE_WORDS", 10)
    rng = random.Random(5)
    books = [[["w"] * rng.randint(0, 4) for _ in range(3)] for _ in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(books, pa.list_(pa.list_(pa.string())))], ["id", "words"]).slice(3)
    cut = list(cl._pieces(batch))
    assert [i for b in cut for i in b.column(0).to_pylist()] == list(range(3, 40)) and [x for b in cut for x in b.column(1).to_pylist()] == books[3:]
    assert len(cut) > 5 and all(sum(len(t) for x in b.column(1).to_pylist()[:-1] for t in x) <= 10 for b in cut)


def test_only_words_of_the_patterns_are_sent(spark):
    books = spark.createDataFrame([(1, "alpha beta", None, "alpha", "gamma delta alpha", None, None)], "id bigint, " + ", ".join(f"{c} string" for c in COLUMNS))
    whole = [("1", "a", 0, r"\balpha\b", 1.0), ("2", "b", 1, r"\bzeta\b", 1.0)]
    plan = lambda taxonomy: cl.classify(books, taxonomy)._jdf.queryExecution().optimizedPlan().toString()
    assert "zeta" in plan(whole) and "zeta" not in plan([*whole, ("3", "c", 2, r"\bgam", 1.0)])
    assert [(r.udc_code, r.score) for r in cl.classify(books, whole).collect()] == [("1", 6.2)]
