"""The catalogue engine: queries against DuckDB, scalar rules, dedup against a sequential model, files, streams."""

import io
import os
import random
import struct
import zipfile
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tomewright.functions import text as tx
from tomewright.operators import dedup, feeds, search
from tomewright.plans import registry
from tomewright.sources import catalogue, config, files
from tomewright.streaming import inbox

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(df: pd.DataFrame) -> list[str]:
    plain = lambda v: None if v is None or v is pd.NA or v is pd.NaT or v != v else float(v) if hasattr(v, "__float__") else str(v)
    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@needs_data
def test_entry_has_rows(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("name", "clean"), [("[abc].pdf", "untitled.pdf"), ("My_Book (2005) v1.0.epub", "MyBook.epub"), ("1999 - A Tale 720p.pdf", "A Tale.pdf"), ("Ä  tale - free download.pdf", "Ä tale.pdf")])
def test_clean_filename(spark, name, clean):
    assert one(spark, tx.clean_filename, name) == clean


def test_scalars(spark):
    assert [one(spark, tx.extract_year, x) for x in ("x 1999 y 2005", "1799", None)] == [1999, None, None]
    assert one(spark, tx.normalize_title, "  Été-x! «a» ж_1 o'b ") == "été-x a ж_1 o'b"
    assert [one(spark, tx.leading_int, x) for x in ("10", "IV", None, "12a")] == [10, 0, None, 12]
    names = ["p2", "p10", "p0010a", "p10b", "page1234567890123", "page1234567890124", f"page{'9' * 120}"]
    assert sorted(reversed(names), key=lambda x: one(spark, tx.natural_key, x)) == names
    assert one(spark, tx.natural_key, "p007") == one(spark, tx.natural_key, "P7") != one(spark, tx.natural_key, "p0")
    assert one(spark, tx.xml_escape, "a<b>&\"'\x01") == "a&lt;b&gt;&amp;&quot;&apos;"
    assert one(spark, tx.isbn_key, " 978-1-23 ") == one(spark, tx.isbn_key, "978123")
    assert one(spark, lambda c: tx.folder_tag(c, "/lib"), "/lib/a/b.pdf") == "a"


SERIES = {
    "Batman (2016) #024": ("Batman", "024", None, "024"),
    "Saga Vol. 3": ("Saga", None, "3", None),
    "Dune Book II": ("Dune", "II", None, None),
    "X - 06 - Name": ("X", "06", None, None),
    "12345 No. 3": (None, None, None, None),
    "Plain": (None, None, None, None),
    "A Part 2 Issue 7": ("A", "2", None, "7"),
    "5Issue 3#024": (None, None, None, None),
}


@pytest.mark.parametrize("name", SERIES)
def test_series_forms(spark, name):
    row = one(spark, tx.parse_series, name)
    assert (tuple(row) if row else (None,) * 4) == SERIES[name]


SPLITS = {
    "Jane Smith - Deep River": ("Jane Smith", "Deep River"),
    "the deep river - Jane Smith": ("Jane Smith", "the deep river"),
    "Deep River (Jane Smith)": ("Jane Smith", "Deep River"),
    "Deep River (Jane Smith, #2)": ("Jane Smith", "Deep River"),
    "Deep River - Smith, Jane": ("Smith, Jane", "Deep River"),
    "A Long Tale - J. K. Smith": ("J. K. Smith", "A Long Tale"),
    "Jane Smith_Deep River": ("Jane Smith", "Deep River"),
    "Jane Smith -Deep river": ("Jane Smith", "Deep river"),
    "Jane_Smith - 3 words": (None, "Jane_Smith - 3 words"),
    "1984 - Jane Smith": ("Jane Smith", "1984"),
    "Modern History - the rest": (None, "Modern History - the rest"),
    "Dr. Who - x1": ("Dr. Who", "x1"),
    "J. S - the end": (None, "J. S - the end"),
    "only words here": (None, "only words here"),
    "": (None, ""),
}


@pytest.mark.parametrize("name", SPLITS)
def test_author_title(spark, name):
    assert tuple(one(spark, tx.author_title, name)) == SPLITS[name]


def test_from_filename_asks_the_recogniser_where_no_author_is_found(spark):
    person = lambda text: F.nullif(F.regexp_extract(text, "Ada [A-Z][a-z]+", 0), F.lit(""))
    parse = lambda name: tuple(one(spark, lambda c: tx.from_filename(c, person), name))[:2]
    assert parse("letters of Ada Byron, collected.pdf") == ("Ada Byron", "letters of , collected")
    assert parse("Jane Smith - Ada Byron.pdf") == ("Jane Smith", "Ada Byron")
    assert parse("no one.pdf") == (None, "no one")
    assert one(spark, lambda c: tx.from_filename(c, person), None) is None


def sequential(rows, gate, threshold=dedup.THRESHOLD, ambiguous=dedup.AMBIGUOUS):
    """The greedy pass as the rule states it: every row against earlier survivors in order, each compared in full."""
    gone, out = set(), []
    for k, (i, title, rich) in enumerate(rows):
        for j, other, other_rich in rows[:k]:
            if j in gone or gate and (abs(len(title) - len(other)) > max(len(title) // 3, 10)):
                continue
            ratio = SequenceMatcher(None, other, title).ratio()
            if ratio >= threshold:
                loser, keeper = (i, j) if rich <= other_rich else (j, i)
                gone.add(loser)
                out.append((loser, keeper, ratio, False))
                break
            if ratio >= ambiguous:
                out.append((i, j, ratio, True))
    return out


def varied_titles(rng, n, letters="abcdefgh ijklmnop"):
    """Titles of 1 to 200 characters: some near copies of a few, some of their own."""
    base = ["".join(rng.choices(letters, k=k)) for k in (17, 40, 64, 65, 127, 128, 129, 200)]
    near = lambda t: "".join(c if rng.random() > rng.choice([0.02, 0.1, 0.2]) else rng.choice("xyzß ж") for c in t)
    return [near(rng.choice(base)) if rng.random() < 0.6 else "".join(rng.choices(letters, k=rng.randint(1, 200))) for _ in range(n)]


@pytest.mark.parametrize("gate", [True, False])
def test_standing_titles_equal_sequential_rule(gate):
    rng = random.Random(1)
    rows = [(i, title, rng.randint(1, 3)) for i, title in enumerate(varied_titles(rng, 260))]
    standing = dedup.Standing(dedup.THRESHOLD, dedup.AMBIGUOUS, gate)
    got = [hit for row in rows for hit in standing.add(*row)]
    assert got == sequential(rows, gate) and len(got) > 100 and any(h[3] for h in got)


def test_common_lengths_equal_the_plain_table():
    rng = random.Random(5)
    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
            row = new
        return row[-1]

    for size in (1, 63, 64, 65, 128, 130, 200):
        one = "".join(rng.choices("abcde", k=size))
        many = ["".join(rng.choices("abcdef", k=rng.randint(0, 210))) for _ in range(40)] + [one, one[::-1], ""]
        codes = np.zeros((len(many), 210), np.uint16)
        for k, t in enumerate(many):
            codes[k, : len(t)] = dedup.character_kinds(t)
        places = np.zeros((dedup.KINDS + 1, -(-size // 64)), np.uint64)
        for place, c in enumerate(dedup.character_kinds(one).tolist()):
            places[c, place // 64] |= np.uint64(1 << place % 64)
        assert dedup.common_lengths(codes, places, size).tolist() == [table(t, one) for t in many]


def test_blocks_stream_over_many_batches(spark):
    """A block that holds most rows, and small ones beside it, read 16 rows at a time: the pass over each block whole."""
    rng = random.Random(2)
    title = lambda: "".join(c if rng.random() > 0.08 else rng.choice("xyz ") for c in "abcdefgh ijkl mnop qr")
    rows = [(i, title(), rng.randint(1, 3), "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])) for i in range(300)]
    books = spark.createDataFrame(rows, "id bigint, norm string, richness int, block string").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = dedup.fuzzy_pairs(books, [F.col("block")], True).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = []
    for block in ("hot", "a", "b", None):
        want += sequential([r[:3] for r in rows if r[3] == block], True)
    assert len(want) > 100
    assert sorted(tuple(r) for r in got) == sorted(want)


@needs_data
def test_resolution_keeps_every_row_once(spark):
    books = catalogue.Catalogue(spark, DATA).books
    found = {r.id: r for r in dedup.resolve(books).collect()}
    assert len(found) == books.count()
    assert all((r.is_master == 1) == (r.master_id is None) for r in found.values())
    again = dedup.resolve(books.join(spark.createDataFrame([(i,) for i, r in found.items() if r.is_master], "id bigint"), "id", "left_semi")).where("is_master = 0")
    assert again.count() == 0


@pytest.mark.parametrize(("word", "stem"), [("running", "run"), ("runs", "run"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("agreed", "agre"), ("happy", "happi"), ("controll", "control"), ("rate", "rate"), ("lyoned", "lyon"), ("enjoyed", "enjoi"), ("filing", "file")])
def test_porter(word, stem):
    assert search.porter_stem(word) == stem


def epub():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
        z.writestr("o/p.opf", '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:identifier>urn:isbn:978-1-2</dc:identifier><dc:date>2004-05</dc:date><dc:subject>s</dc:subject><meta name="cover" content="c1"/></metadata><manifest><item id="c1" href="c.jpg"/></manifest></package>')
        z.writestr("o/c.jpg", b"jpg")
    return out.getvalue()


def test_files_are_listed_and_read(spark, tmp_path):
    box = tmp_path / "shelf" / ".git"
    box.mkdir(parents=True)
    (box / "x.pdf").write_bytes(b"")
    cbz = io.BytesIO()
    with zipfile.ZipFile(cbz, "w") as z:
        z.writestr("p10.png", b"ten")
        z.writestr("p2.png", b"two")
    text = b"hello <b>world</b>"
    header = struct.pack(">HHIHHI", 1, 0, len(text), 1, 4096, 0)
    mobi = bytearray(78 + 16)
    struct.pack_into(">H", mobi, 76, 2)
    struct.pack_into(">I", mobi, 78, 94)
    struct.pack_into(">I", mobi, 86, 94 + len(header))
    made = {"a.epub": epub(), "b.pdf": b"%PDF /Title (My Title) /Author (Me) /Subject (S) /Type /Page /Type /Pages /Type /Page", "c.cbz": cbz.getvalue(), "d.cbr": b"x", "e.epub": b"broken", "f.djvu": b"x", "g.mobi": bytes(mobi) + header + text, "h.fb2": b"<FictionBook><body><p>One</p><p>Two  x</p></body></FictionBook>", "n.txt": b"no"}
    for name, data in made.items():
        (tmp_path / "shelf" / name).write_bytes(data)
    listed = files.listing(spark, [str(tmp_path / "shelf")], content=True)
    assert sorted(r.filename for r in listed.collect()) == [n for n in made if n != "n.txt"]
    assert {r.source_group for r in listed.collect()} == {"shelf"}
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.extract(listed).collect()}
    a = got["a.epub"]
    assert (a.title, a.authors, a.isbn, a.year, list(a.subjects), bytes(a.cover_data)) == ("T", "A; B", "97812", 2004, ["s"], b"jpg")
    assert (got["b.pdf"].title, got["b.pdf"].authors, got["b.pdf"].pages, list(got["b.pdf"].subjects)) == ("My Title", "Me", 2, ["S"])
    assert (got["c.cbz"].title, got["c.cbz"].pages, bytes(got["c.cbz"].cover_data), got["c.cbz"].title_is_stem) == ("c", 2, b"two", True)
    assert got["d.cbr"].error_code == "NO_RAR_TOOL" and got["e.epub"].error_code == "EXTRACT_FAIL" and got["f.djvu"].title is None
    texts = {r.filename: r.t.text for r in listed.select("filename", files.full_text("content", "format").alias("t")).collect()}
    assert texts["g.mobi"] == "hello world" and texts["h.fb2"] == "One\nTwo x"
    assert files.palmdoc(b"abc\x80\x1b\xf4") == b"abcabcabc t"[:9] + b" t"
    whole = {r.filename: r for r in files.catalogued(listed, files.extract(listed)).collect()}
    assert whole["f.djvu"].title == "f" and whole["a.epub"].title == "T"


def test_settings(spark):
    assert config.load({"log_days": "7"}, {"TOMEWRIGHT_LOG_DAYS": "3", "TOMEWRIGHT_ENRICH": "yes"}).log_days == 7
    assert config.load({}, {"TOMEWRIGHT_ENRICH": "yes"}).enrich is True
    with pytest.raises(ValueError):
        config.load({"log_days": "x"}, {})


def test_inbox_takes_each_file_once(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    seen = []

    def run():
        q = inbox.watch_inbox(spark, str(box), lambda df, _: seen.extend(r.path.rsplit("/", 1)[-1] for r in df.collect()), str(tmp_path / "cp"), every=None)
        q.awaitTermination(60)

    (box / "a.pdf").write_bytes(b"1")
    (box / "n.txt").write_bytes(b"1")
    run()
    (box / "b.epub").write_bytes(b"2")
    run()
    run()
    assert seen == ["a.pdf", "b.epub"]


def test_snapshot_round_trip(spark, tmp_path):
    tables = {"a": spark.range(3), "b": spark.createDataFrame([("x",)], "v string")}
    feeds.write_snapshot(tables, str(tmp_path), "1")
    back = feeds.read_snapshot(spark, str(tmp_path), "1")
    assert {k: sorted(map(tuple, v.collect())) for k, v in back.items()} == {k: sorted(map(tuple, v.collect())) for k, v in tables.items()}


BOOK = "id bigint, title string, authors string, isbn string, description string, publisher string, year int, language string, pages int, udc_code string, file_hash string"


def test_rematch_equals_brute_force(spark):
    rng = random.Random(14)
    base = ["a long tale of the sea", "history of the old world", "on rivers and stones"]
    rows = []
    for i in range(60):
        title = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 2, 6])):
            title[rng.randrange(len(title))] = rng.choice("abcdxyz")
        author = rng.choice([None, "", "Ann Bee", " ann bee ", "Cid"])
        rows.append((i, rng.choice(["".join(title)] * 9 + [None]), author, None, rng.choice([None, "d"]), rng.choice([None, "p"]), rng.choice([None, 0, 1990, 1991]), "en", 3, rng.choice([None, "", *"123456789"]), f"h{i}"))
    rich = lambda r: sum(str(v or "") not in ("", "0") for v in (r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8]))
    df = spark.createDataFrame(rows, BOOK).cache()
    rules = set()
    for own in rows[::6]:
        want = []
        for r in rows:
            if r[0] == own[0] or not r[1] or not own[1] or SequenceMatcher(None, r[1], own[1]).ratio() < 0.85 or rich(own) > rich(r):
                continue
            writer = (own[2] or "").strip().lower()
            if (own[9] or "") == (r[9] or ""):
                want.append((3, r[0]))
            elif writer and own[6] and writer == (r[2] or "").strip().lower() and own[6] == r[6]:
                want.append((4, r[0]))
        got = [(r.rule, r.master_id) for r in dedup.rematch_one(df, own[0]).collect()]
        assert got == sorted(want)[:1]
        rules |= {rule for rule, _ in got}
    assert rules >= {3}
    assert dedup.rematch_one(df, 999).count() == 0


@needs_data
def test_force_keep_returns_every_row(spark):
    got = registry.QUERIES["ddp10_force_keep"](spark, DATA).toPandas()
    assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert got[got.id % 5 == 0].is_master.all() and not got[got.id % 5 != 0].is_master.all()


def test_author_year_pass_folds_authors(spark):
    rows = [(i, "a long tale of the sea", a, None, None, None, y, "en", 3, None, f"h{i}") for i, (a, y) in enumerate([("Ann Bee", 1990), (" ann bee", 1990), ("ANN BEE ", 1991), ("Cid", 1990)])]
    got = dedup.by_author_year(dedup.with_richness(spark.createDataFrame(rows, BOOK))).collect()
    assert [(r.id, r.master_id, r.ratio, r.ambiguous) for r in got] == [(1, 0, 1.0, False)]


def test_title_duplicates_follow_the_audit(spark):
    titles = ["A long tale of the grey sea, told anew", "a long tale of the grey sea told anew", "a long tale of the grey sea told anew", "a long tale of the grey sea told anex", None, "", "a long tale of the grey sea told anew and once more", "of a b", "of a b"]
    rows = [(i, t, f"quiet harvest in the hills {'' if i == 4 else 'x'}") for i, t in enumerate(titles)]
    df = spark.createDataFrame([*rows, (20, "quiet harvest in the hills x", "z")], "id bigint, title string, filename string")
    got = {(r.id, r.master_id, r.kind) for r in dedup.title_duplicates(df).collect()}
    names = {i: (t or f).lower().replace(",", "").strip() for i, t, f in [*rows, (20, "quiet harvest in the hills x", "z")]}
    split = {i: {w for w in n.split() if len(w) >= 3} for i, n in names.items()}
    want = set()
    for i in names:
        for j in names:
            if i < j and names[i][:8] == names[j][:8] and split[i] and len(split[i] & split[j]) / len(split[i] | split[j]) >= 0.8 and SequenceMatcher(None, names[i], names[j]).ratio() >= 0.95:
                want.add((i, j))
    first = {i: min([m for k, m, kind in got if k == i and kind == "equal"], default=i) for i in names}
    like = {(m, i) for i, m, kind in got if kind == "similar"}
    assert {(i, j) for i in names for j in names if i < j and split[i] and (first[i] == first[j] or tuple(sorted((first[i], first[j]))) in like)} == want
    assert {(1, 0, "equal"), (2, 0, "equal"), (20, 5, "equal")} <= got


def test_title_pass_takes_blank_categories_as_one(spark):
    rows = [(1, "A long tale of the sea", None, None, None, None, None, "en", 3, None, "a"), (2, "A long tale of the sea!", "", None, None, None, None, "en", 3, "", "b"), (3, "A long tale of the seas", " ", None, None, None, None, "en", 3, "5", "c")]
    got = dedup.by_title(dedup.with_richness(spark.createDataFrame(rows, BOOK))).collect()
    assert [(r.id, r.master_id, r.ambiguous) for r in got] == [(2, 1, False)]


def test_resolution_with_a_block_of_half_of_all_rows(spark):
    rng = random.Random(3)
    rows = []
    for i in range(240):
        title = list("the old house by the river and the quiet garden behind it")
        for _ in range(rng.choice([0, 1, 4, 30])):
            title[rng.randrange(4, len(title))] = rng.choice("abcdxyz ")
        hot = i % 2
        rows.append((i, "".join(title), None if hot else f"writer {i % 5}", None, None, rng.choice([None, "p"]), None if hot else 1990 + i % 2, "en", 3, None if hot else str(i % 3), f"h{i // 3 if i < 12 else i}"))
    df = spark.createDataFrame(rows, BOOK)
    got = {r.id: (r.is_master, r.master_id, r.reason) for r in dedup.resolve(df.repartition(3)).collect()}
    rich = {r[0]: sum(str(v or "") not in ("", "0") for v in (r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8])) for r in rows}
    norm = {r[0]: " ".join(r[1].split()) for r in rows}
    lost = {}
    by = lambda key: [sorted(x for x in norm if x not in lost and key(rows[x]) == k) for k in sorted({key(r) for r in rows if key(r)})]
    for group in by(lambda r: (r[10],)):
        best = min(group, key=lambda i: (-rich[i], i))
        lost |= {i: (best, "duplicate_by_hash") for i in group if i != best}
    for group in by(lambda r: (r[9] or "", norm[r[0]][:4], (r[2] or ""))):
        lost |= {a: (b, "duplicate_by_title") for a, b, _, report in sequential([(i, norm[i], rich[i]) for i in group], True) if not report}
    for group in by(lambda r: (r[2], r[6]) if r[2] and r[6] else None):
        lost |= {a: (b, "duplicate_by_author_year_title") for a, b, _, report in sequential([(i, norm[i], rich[i]) for i in group], False) if not report}
    assert got == {i: (0, *lost[i]) if i in lost else (1, None, "survivor") for i in norm}
    assert {r for _, r in lost.values()} == {"duplicate_by_hash", "duplicate_by_title", "duplicate_by_author_year_title"}


def test_unique_names_pass_over_taken_numbers(spark):
    arrivals = spark.createDataFrame([(1, "f.pdf"), (2, "f.pdf"), (3, "f.pdf"), (4, "f_2.pdf"), (5, "g"), (6, "g"), (7, "new.txt")], "id bigint, filename string")
    taken = spark.createDataFrame([("f.pdf",), ("f.pdf",), ("f_1.pdf",), ("g_1",)], "filename string")
    got = {r.id: r.filename for r in files.unique_names(arrivals, taken).collect()}
    assert got == {1: "f_3.pdf", 2: "f_4.pdf", 3: "f_5.pdf", 4: "f_2.pdf", 5: "g", 6: "g_2", 7: "new.txt"}


def test_settings_by_origin(spark):
    overrides = spark.createDataFrame([("log_days", "30")], "name string, value string")
    env, machine = {"TOMEWRIGHT_LOG_DAYS": "5", "TOMEWRIGHT_PAGE_SIZE": "9"}, {"page_size": "8", "enrich": "yes"}
    got = {r.name: (r.value, r.origin) for r in config.resolved(spark, overrides, env, machine).collect()}
    assert len(got) == 15 and (got["log_days"], got["page_size"], got["enrich"]) == (("30", "override"), ("9", "environment"), ("yes", "machine"))
    settings = config.load({"log_days": "30"}, env, machine)
    assert (settings.log_days, settings.page_size, settings.enrich) == (30, 9, True)


def test_feed_is_wellformed(spark):
    from xml.etree import ElementTree

    books = spark.createDataFrame([(1, 'A <b> & "c"', None, " x", None, "820", "pdf", "f.pdf"), (2, None, "Ann; Bo & Cy", None, "/c/2.png", None, "zzz", "g.zzz")], "id bigint, title string, authors string, description string, cover_path string, udc_code string, format string, filename string")
    root = ElementTree.fromstring(feeds.feed(feeds.feed_entries(books, "2025-01-01T00:00:00Z"), "All & more", "2025-01-01T00:00:00Z", next_path="/opds?a=1&b=2").first().xml.encode())
    at = "{http://www.w3.org/2005/Atom}"
    assert [root.find(at + k) is not None for k in ("id", "title", "updated", "author")] == [True] * 4
    assert [x.attrib["rel"] for x in root.findall(at + "link")] == ["self", "start", "search", "next"] and root.findall(at + "link")[3].attrib["href"] == "/opds?a=1&b=2"
    one, two = root.findall(at + "entry")
    assert one.find(at + "title").text == 'A <b> & "c"' and one.find(at + "category").attrib["term"] == "820"
    assert [a.find(at + "name").text for a in two.findall(at + "author")] == ["Ann", "Bo", "Cy"] and two.find(at + "title").text == "g.zzz"
    assert ElementTree.fromstring(feeds.search_description(spark).first().xml.encode()).find("{http://a9.com/-/spec/opensearch/1.1/}Url") is not None


def test_similar_titles_meet_in_chunks_and_once(spark, monkeypatch):
    rng = random.Random(8)
    words = ["tale", "river", "night", "winter", "garden", "letter"]
    rows = [(i, "common beginning " + " ".join(rng.sample(words, 5)) + rng.choice(["", " x", " the end"]), f"f{i}") for i in range(90)]
    books = spark.createDataFrame(rows, "id bigint, title string, filename string")
    monkeypatch.setattr(dedup, "MEETING", 7)
    monkeypatch.setattr(dedup, "TASK_PAIRS", 50)
    first = {}
    for i, t, _ in rows:
        first.setdefault(t, i)
    kinds = sorted((i, t) for t, i in first.items())
    bag = lambda t: {w for w in t.split() if len(w) >= 3}
    like = {(a, b): len(bag(x) & bag(y)) / len(bag(x) | bag(y)) for a, x in kinds for b, y in kinds if a < b}
    for jaccard, threshold in ((0.5, 0.0), (0.8, 0.7)):
        near = {p: j for p, j in like.items() if j >= jaccard}
        found = dedup.title_candidates(books, jaccard)
        assert found.rdd.getNumPartitions() == -(-len(near) // 50)
        assert sorted((r.id_a, r.id_b, r.jaccard) for r in found.collect()) == sorted((*p, round(j, 6)) for p, j in near.items())
        ratio = {p: SequenceMatcher(None, rows[p[0]][1], rows[p[1]][1]).ratio() for p in near}
        want = {p: round(r, 6) for p, r in ratio.items() if r >= threshold}
        got = dedup.similar_titles(books, jaccard, threshold).collect()
        assert {(r.id_a, r.id_b): r.ratio for r in got} == want and len(got) == len(want)
        plan = dedup.similar_titles(books, jaccard, threshold)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("ratio(norm_a") < plan.index("Repartition")


def test_resolution_compares_no_titles_for_reports(spark, monkeypatch):
    asked, plain = [], dedup.fuzzy_pairs
    monkeypatch.setattr(dedup, "fuzzy_pairs", lambda *a, **k: asked.append(k.get("ambiguous")) or plain(*a, **k))
    dedup.resolve(catalogue.Catalogue(spark, entry.SMOKE_DIR).books)
    assert asked == [dedup.THRESHOLD, dedup.THRESHOLD]
    rng = random.Random(9)
    titles = ["".join(rng.choices("abcd ", k=rng.randint(10, 40))) for _ in range(60)]
    titles += [t[:-2] + rng.choice("xyz") for t in titles] + [t[: len(t) * 2 // 3] for t in titles]
    both = [dedup.Standing(0.85, least, True) for least in (0.7, 0.85)]
    some, all_ = ([h for i, t in enumerate(titles) for h in s.add(i, t, i % 5)] for s in reversed(both))
    assert some == [h for h in all_ if not h[3]] and some and len(some) < len(all_)


@pytest.mark.parametrize("gate", [True, False])
def test_rows_of_many_blocks_at_once_equal_the_sequential_rule(gate, monkeypatch):
    """Bounds are found for runs of rows, over blocks that end and go on in them, in pieces of any size."""
    for seed, (rows_at_once, held, together) in enumerate([(7, 1, 3), (40, 50, 8192), (512, 1 << 20, 64)]):
        monkeypatch.setattr(dedup.Standing, "ROWS", rows_at_once)
        monkeypatch.setattr(dedup.Standing, "PAIRS", held)
        monkeypatch.setattr(dedup, "TOGETHER", together)
        rng, rows, want = random.Random(seed), [], []
        for block in range(5):
            titles = varied_titles(rng, rng.choice([1, 30, 90]))
            titles += rng.choices(titles, k=len(titles) // 3) + ["a" * 250]
            some = [(len(rows) + k, t, rng.randint(1, 3)) for k, t in enumerate(rng.sample(titles, len(titles)))]
            rows += [(*r, (block,)) for r in some]
            want += sequential(some, gate)
        standing, cut = dedup.Standing(dedup.THRESHOLD, dedup.AMBIGUOUS, gate), len(rows) // 2
        assert [*standing.add_rows(rows[:cut]), *standing.add_rows(rows[cut:])] == want and want


def test_few_unlike_titles_are_compared_in_full(monkeypatch):
    """Of 300 unlike titles all pairs have a bound; bounds of many rows are few calls, and letters rule out most pairs before."""
    rng, calls, plain = random.Random(4), [], dedup.common_lengths
    monkeypatch.setattr(dedup, "common_lengths", lambda *a, **k: calls.append(len(a[3])) or plain(*a, **k))
    rows = [(i, "".join(rng.choices("abcdefghijklm" if i % 2 else "nopqrstuvwxyz", k=60)), 1, (0,)) for i in range(300)]
    assert list(dedup.Standing(dedup.THRESHOLD, dedup.AMBIGUOUS, False).add_rows(rows)) == []
    assert len(calls) <= 20 and 2 * max(calls) < 300 * 299 // 2


def test_blocks_of_few_bytes_are_many_tasks(spark):
    books = spark.createDataFrame([(i, f"title {i}", 1, i % 40) for i in range(400)], "id bigint, norm string, richness int, block int")
    assert dedup.fuzzy_pairs(books, [F.col("block")], False).rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
