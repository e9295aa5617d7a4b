"""The kept text index and its trigrams against plain definitions."""

import random
import re
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tomewright.operators import search, textindex
from tomewright.operators.textindex import Postings, TextIndex, grams_in, postings_of

BOOK = "id bigint, title string, authors string, publisher string, isbn string, description string, subjects string, series string, filename string, tag_list array<string>"


def shelf(rng, ids):
    words = ["run", "Running", "runs", "Café", "naïve", "Tiếng", "Việt", "of", "the", "x2", "ÅNGSTRÖM", "café", "50%", "a_b"]
    some = lambda n: " ".join(rng.choices(words, k=rng.randint(0, n))) if rng.random() < 0.9 else None
    return [(i, some(3), some(1), some(1), None, some(30), some(2), None, f"file_{i}.pdf", rng.choice([None, [], ["ta_g", None, "Über"]])) for i in ids]


def plain(text):
    """Tokens by the definition: lower case, Latin letters without their marks, runs of letters and digits."""
    text = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", text)


def brute_postings(rows):
    out = set()
    for r in rows:
        if not (r[1] or r[2]):
            continue
        for field, text in zip(("title", "authors", "publisher", "isbn", "description"), r[1:6]):
            for k, token in enumerate(plain(text)):
                out.add((search.porter_stem(token), token, field, r[0], k))
    return out


def places(df):
    return {tuple(r) for r in df.select("stem", "token", "field", "doc_id", F.explode("pos")).collect()}


def test_query_language(spark):
    books = spark.createDataFrame([(1, "Running Café", "Ann"), (2, "the run of it", None), (3, "cats", "Run Zed"), (4, None, None)], "id bigint, title string, authors string")
    index = Postings(postings_of(books, ("title", "authors")))
    hit = lambda q: sorted(r.doc_id for r in search.match(index, q).collect())
    assert hit("run") == [1, 2, 3]
    assert hit("cafe") == hit("café") == [1]
    assert hit("run NOT title:run") == [3]
    assert hit('"run of"') == hit('title:"run of"') == [2]
    assert hit("ca* OR ann") == [1, 3]
    assert hit("_*") == hit('""') == []
    assert search.match(index, "c++") is None
    words = Postings(postings_of(books, ("title", "authors")), stem=False)
    assert sorted(r.doc_id for r in search.match(words, "run").collect()) == [2, 3]


def test_changes_touch_one_segment_and_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(2)
    rows = shelf(rng, range(120))
    index = TextIndex.create(spark, str(tmp_path / "index"), buckets=8, grams=True)
    assert index.live().count() == 0 and search.match(index, "run").count() == 0
    first = index.add(spark.createDataFrame(rows, BOOK), "tag_list")
    before = {p: p.stat().st_mtime_ns for p in Path(tmp_path).rglob("segment-*/**/*.parquet")}
    # one book anew, one that loses its text, two new ones, one removed
    new = [(5, "Fresh words", "the", None, None, "run", None, None, "f", ["new"]), (6, None, None, None, None, "gone", None, None, "g", None), *shelf(rng, [500, 501])]
    second = first.add(spark.createDataFrame(new, BOOK), "tag_list").remove(spark.createDataFrame([(7,)], "id bigint"))
    assert {p: p.stat().st_mtime_ns for p in before} == before and len(second.segments) == 3
    now = [r for r in rows if r[0] not in (5, 6, 7)] + new
    want = brute_postings(now)
    assert places(second.live()) == want and places(first.live()) == brute_postings(rows)
    assert second.live("grams").select("gram", "doc_id").distinct().count() == second.live("grams").count()
    merged = TextIndex.open(spark, str(tmp_path / "index")).merge()
    assert len(merged.segments) == 1 and places(merged.live()) == want
    assert sorted(map(tuple, merged.live("grams").collect())) == sorted(map(tuple, second.live("grams").collect()))
    merged.clean()
    assert places(TextIndex.open(spark, str(tmp_path / "index")).live()) == want
    # of two writers on one version the second fails, and changes nothing
    merged.add(spark.createDataFrame(new, BOOK), "tag_list")
    with pytest.raises(Exception, match="exist"):
        merged.add(spark.createDataFrame(new, BOOK), "tag_list")


def test_a_word_reads_its_bucket_and_places_are_coded_as_differences(spark, tmp_path):
    rows = shelf(random.Random(3), range(200))
    index = TextIndex.create(spark, str(tmp_path / "index"), buckets=16).add(spark.createDataFrame(rows, BOOK))
    hits = index.word("running")
    assert {Path(f).parent.name for f in hits.inputFiles()} <= {p.name for p in Path(tmp_path).rglob("bucket=*")}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+", plan) and "EqualTo(stem,run)" in plan
    read = [m for m in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if m]
    assert read and all("xxhash" not in m for m in read)
    assert sorted(r.doc_id for r in hits.select("doc_id").distinct().collect()) == sorted({r[0] for r in rows if (r[1] or r[2]) and any(search.porter_stem(t) == "run" for x in r[1:6] for t in plain(x))})
    file = next(p for p in Path(tmp_path).rglob("postings/**/*.parquet"))
    meta = pq.read_metadata(file).row_group(0)
    assert any("DELTA_BINARY_PACKED" in meta.column(k).encodings for k in range(meta.num_columns) if "pos" in meta.column(k).path_in_schema)


TERMS = ["run", "ning", "café", "CAF", "50%", "a_b", "t%g of", "tiế", "of", "r_n", '"the run"', "xyz", "file_1", "über", "new", "\\%run", "run the 50%"]


def test_substring_candidates_give_the_rows_of_a_scan(spark, tmp_path):
    rows = shelf(random.Random(4), range(150)) + [(900, "x", "y", None, None, "é" * 70_000 + "run", None, None, None, None), (901, None, None, None, None, None, None, None, None, None)]
    books = spark.createDataFrame(rows, BOOK)
    tags = books.select(F.col("id").alias("file_id"), F.explode("tag_list").alias("tag")).withColumn("tag_type", F.lit("custom"))
    index = TextIndex.create(spark, str(tmp_path / "index"), buckets=4, grams=True).add(books, "tag_list")
    used = 0
    for text in TERMS:
        request = search.SearchRequest(text=text)
        bare = books.drop("tag_list")
        scan = {r.id for r in bare.join(search.search(bare, tags, request).select("id"), "id", "left_semi").collect()}
        match = search.match(index, text)
        hits = set() if match is None else {r.doc_id for r in match.collect()}
        got = [r.id for r in search.search(bare, tags, request, index).collect()]
        assert sorted(got) == sorted(scan | hits), text
        near = index.candidates(text)
        assert (near is None) == (grams_in(text) is None)
        if near is not None:
            used += 1
            assert scan <= {r.doc_id for r in near.collect()}, text
    assert used >= 8 and grams_in("r_n") is None and grams_in("of") is None and grams_in("\\%run") is None


def test_a_word_is_one_row_for_the_books_of_a_part_and_counts_are_exact(spark, tmp_path):
    rows = shelf(random.Random(6), range(300))
    index = TextIndex.create(spark, str(tmp_path / "index"), buckets=4, grams=True).add(spark.createDataFrame(rows, BOOK).coalesce(1), "tag_list")
    for kind, key in (("postings", ["token", "field"]), ("grams", ["gram"])):
        kept = spark.read.parquet(f"{index.path}/{index.segments[0].name}/{kind}")
        assert kept.count() == kept.select(*key).distinct().count() < index.live(kind).count() / 5
    again = index.add(spark.createDataFrame([(5, "runs run", "x", None, None, "running", None, None, "f", None)], BOOK))
    for of in (index, again, again.merge()):
        places_of = {tuple(r) for r in of.live().where("field in ('title', 'description')").select("stem", "token", "field", "doc_id", F.explode("pos")).collect()}
        tf, df, stems = {}, {}, {}
        for stem, token, field, i, _ in places_of:
            tf[token, field] = tf.get((token, field), 0) + 1
            df.setdefault((token, field), set()).add(i)
            stems.setdefault(stem, set()).add(i)
        assert {(r.token, r.field): (r.tf, r.df) for r in of.word_counts(("title", "description")).collect()} == {k: (tf[k], len(df[k])) for k in tf}
        assert {r.stem: r.df for r in of.stem_counts(("title", "description")).collect()} == {k: len(v) for k, v in stems.items()}
        assert sorted(r.doc_id for r in of.documents(("title", "description")).collect()) == sorted({p[3] for p in places_of})


def test_counts_of_repeated_ids(spark, tmp_path):
    rows = [(1, "runs run", "x", None, None, "running", None, None, "f", None)] * 2 + [(2, "run", "x", None, None, "", None, None, "f", None)]
    index = TextIndex.create(spark, str(tmp_path / "index"), buckets=2).add(spark.createDataFrame(rows, BOOK).repartition(3))
    assert index.segments[0].repeated == 1
    counts = {(r.token, r.field): (r.tf, r.df) for r in index.word_counts(("title", "description")).collect()}
    assert counts == {("runs", "title"): (2, 1), ("run", "title"): (3, 2), ("running", "description"): (2, 1)}
    assert [tuple(r) for r in index.stem_counts(("title", "description")).collect()] == [("run", 2)]


def test_pieces_bound_what_is_grouped_at_once(monkeypatch, spark):
    sizes = [3, 0, 9, 1, 1, 1, 30, 0, 2]
    cut = list(textindex.pieces(np.array(sizes), 5))
    assert [s for s, _ in cut] == [0] + [s + n for s, n in cut[:-1]] and sum(n for _, n in cut) == len(sizes)
    assert all(sum(sizes[s : s + n - 1]) <= 5 for s, n in cut) and list(textindex.pieces(np.array([], np.int64), 5)) == []

    class Task:  # the functions run here
        @staticmethod
        def partitionId():
            return 1

    monkeypatch.setattr(textindex.TaskContext, "get", staticmethod(Task))
    monkeypatch.setattr(textindex, "PIECE", 10)
    texts = [["abcabc", "ab"], ["", "xabc"], [None], ["zzzz zzzz zzzz"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts, pa.list_(pa.string()))], ["doc_id", "texts"])
    out = list(textindex.gram_blocks(iter([batch])))
    got = sorted((g, d) for b in out for g, ds in zip(b.column(0).to_pylist(), b.column(2).to_pylist()) for d in ds)
    want = sorted({(textindex._gram(*map(ord, t[k : k + 3])), i) for i, ts in enumerate(texts) for t in ts if t for k in range(len(t) - 2)})
    assert got == want and len(out) > 1
