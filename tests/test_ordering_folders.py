"""Numbers and pages of large orders, folders as a tree, moves, progress logs, files by their heads, re-extraction."""

import random
import time
import zipfile
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from tomewright.operators import audit, search
from tomewright.operators.ordering import Pages, numbered
from tomewright.operators.textindex import TextIndex
from tomewright.sources import files
from tomewright.streaming import inbox
from tomewright.streaming.inbox import ProgressLog


def test_numbers_of_a_hot_key_equal_row_numbers_and_no_task_has_them_all(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, name string").repartition(3)
    got = numbered(df, ["name"], [F.desc("id")], parts=7)
    seen, want = Counter(), []
    for i, name in sorted(rows, reverse=True):
        seen[name] += 1
        want.append((i, name, seen[name]))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert numbered(df.where("false"), ["name"], [F.col("id")]).count() == 0
    pages = Pages(df, [F.asc_nulls_last("name"), F.col("id")], 7)
    hot = pages.rows.where("name = 'hot'").groupBy("_part").count().collect()
    assert len(hot) > 1 and max(r["count"] for r in hot) < 0.8 * sum(r["count"] for r in hot)


def test_deep_pages_equal_offsets_and_read_their_ranges_alone(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice(["x", "y", None]), rng.random()) for i in range(800)], "id bigint, name string, v double").repartition(4)
    order = [F.desc_nulls_first("name"), F.asc("id")]
    pages, whole = Pages(df, order, 6), [r.id for r in df.orderBy(*order).collect()]
    assert pages.total == 800 and len(pages.ranges) > 1
    for limit, offset in ((10, 0), (25, 395), (300, 333), (10, 795), (10, 800), (10, 5000), (0, 3)):
        page = pages.page(limit, offset)
        assert [r.id for r in page.collect()] == whole[offset : offset + limit]
    assert len(pages.parts(10, 0)) == 1
    first = f"/_part={pages.parts(10, 0)[0][0]}/"
    for f in pages.rows.inputFiles():
        if first not in f:
            Path(f.removeprefix("file://")).unlink()
    assert [r.id for r in pages.page(10, 0).collect()] == whole[:10]
    assert Pages(df.where("false"), order).page(5).count() == 0


def test_folders_go_when_all_below_them_has_left(spark, tmp_path):
    names = ["a/1.pdf", "a/b/2.pdf", "a/b/c/3.pdf", "d/4.pdf", "d/e/5.pdf", "f/g/h/6.pdf", "7.pdf"]
    root = str(tmp_path / "root")
    listing = spark.createDataFrame([(f"{root}/{n}",) for n in names], "path string")
    gone = listing.where(F.col("path").rlike("/(2|3|5|6)[.]pdf$")).union(listing.where("path like '%/6.pdf'"))
    tree = {r.folder.removeprefix(f"{root}/"): (r.depth, r.files, r.leaving) for r in audit.folder_tree(listing, root, gone).collect()}
    assert tree == {"a": (1, 3, 2), "a/b": (2, 2, 2), "a/b/c": (3, 1, 1), "d": (1, 2, 1), "d/e": (2, 1, 1), "f": (1, 1, 1), "f/g": (2, 1, 1), "f/g/h": (3, 1, 1)}
    steps = audit.emptied_folders(listing, root + "/", gone)
    assert [r.folder.removeprefix(f"{root}/") for r in steps.orderBy("step").collect()] == ["a/b/c", "f/g/h", "a/b", "d/e", "f/g", "f"]
    for folder in ("a/b/c", "d/e", "f/g/h"):
        (tmp_path / "root" / folder).mkdir(parents=True)
    (tmp_path / "root/d/e/unlisted.txt").write_text("x")
    done = {folder.removeprefix(f"{root}/"): outcome for folder, outcome in audit.remove_folders(spark, steps)}
    assert done == {"a/b/c": "removed", "a/b": "removed", "f/g/h": "removed", "f/g": "removed", "f": "removed", "d/e": "kept"}
    assert (tmp_path / "root/a").exists() and (tmp_path / "root/d/e").exists()
    assert audit.emptied_folders(listing.where("false"), root, gone).count() == 0


def test_moves_pass_over_taken_names(spark):
    rows = [(1, "/lib/x/a.pdf", "copied"), (2, "/lib/x/b.tar.gz", "arrived"), (3, "/lib/c", "copied"), (4, "/other/d", "copied")]
    df = spark.createDataFrame(rows, "id bigint, source_path string, stage string")
    taken = spark.createDataFrame([("processed/x/a.pdf",), ("archive/x/b.tar.gz",), ("processed/c",), ("processed/c",)], "dest string")
    assert sorted((r.id, r.dest) for r in audit.move_plan(df, "/lib", taken).collect()) == [(1, "processed/x/a_1.pdf"), (2, "archive/x/b.tar_2.gz"), (3, "processed/c_3")]
    assert {r.dest for r in audit.move_plan(df, "/lib").collect()} == {"processed/x/a.pdf", "archive/x/b.tar.gz", "processed/c"}


def test_progress_logs_stay_bounded_over_many_batches(spark, tmp_path):
    now = [0.0]
    log = ProgressLog(messages=7, stages=5, phases=3, clock=lambda: now[0])
    for k in range(20):
        log.begin("phase", f"p{k}")
        log.begin("stage", f"s{k}")
        now[0] += k
        log.say(f"m{k}")
    log.end("stage")
    log.end("stage")
    got = log.snapshot(4)
    assert [m["text"] for m in got["messages"]] == ["m16", "m17", "m18", "m19"] and len(log.messages) == 7
    assert [(x["name"], x["seconds"]) for x in got["phases"]] == [("p16", 16), ("p17", 17), ("p18", 18)]
    assert [x["name"] for x in got["stages"]] == ["s15", "s16", "s17", "s18", "s19"] and got["open"] == {"phase": {"name": "p19", "seconds": 19.0}}

    heard = ProgressLog(messages=6, stages=4)
    spark.streams.addListener(heard)
    try:
        for k in range(8):
            spark.range(k, k + 2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = stream.writeStream.queryName("taking").foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(100):
            if not heard.running and heard.counts:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    got = heard.snapshot()
    assert got["counts"] == {"taking": 16} and len(got["stages"]) == 4 and len(got["messages"]) == 6
    assert got["messages"][-1]["text"] == "ended taking" and got["running"] == {}


def test_files_of_any_size_are_read_in_ranges(spark, tmp_path):
    with open(tmp_path / "big é 1.pdf", "wb") as f:
        f.write(b"%PDF /Title (Large) /Author (A)")
        f.truncate(3 << 30)
    (tmp_path / "b.azw3").write_bytes(bytes(76) + (32).to_bytes(4, "big") + b"Named".ljust(30) + bytes(5000))
    (tmp_path / "c.epub").write_bytes(b"x" * 5000)
    (tmp_path / "d.djvu").write_bytes(b"x" * 5000)
    with zipfile.ZipFile(tmp_path / "e.cbz", "w") as z:
        for k in range(40):
            z.writestr(f"p{k}.png", random.Random(k).randbytes(100_000))
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.listing(spark, [str(tmp_path)], content=False)).collect()}
    assert (got["big é 1.pdf"].title, got["big é 1.pdf"].authors, got["big é 1.pdf"].error) == ("Large", "A", None)
    assert got["big é 1.pdf"].bytes_read <= 410_000 and got["b.azw3"].title == "Named" and got["b.azw3"].bytes_read <= 334
    assert got["e.cbz"].pages == 40 and len(got["e.cbz"].cover_data) == 100_000 and got["e.cbz"].bytes_read < 200_000
    assert got["c.epub"].error_code == "EXTRACT_FAIL" and (got["d.djvu"].title, got["d.djvu"].bytes_read) == (None, 0)
    gone = spark.createDataFrame([(f"file:{tmp_path}/none.pdf", "pdf")], "path string, format string")
    assert files.extract(gone).first().error_code == "EXTRACT_FAIL"
    (tmp_path / "big é 1.pdf").unlink()
    listed = files.listing(spark, [str(tmp_path)], content=True)
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(listed, most_bytes=6000).collect()}
    assert got["b.azw3"].title == "Named" and got["e.cbz"].error_code == "EXTRACT_FAIL" and "6000 at most" in got["e.cbz"].error


def test_a_book_extracted_anew_is_found_by_its_new_words(spark, tmp_path):
    schema = "file_id bigint, title string, authors string, publisher string, isbn string, language string, pages int, year int, description string, enrich_source string, note string"
    old = spark.createDataFrame([(1, "old words", "X", "P", None, None, None, 1990, "d", None, "n"), (2, "by hand", None, None, None, None, None, None, None, "manual", "n"), (3, "lost", None, None, None, None, None, None, None, None, "n"), (4, "same", None, None, None, None, None, None, None, None, "n")], schema)
    found = spark.createDataFrame(
        [(1, "fresh title", "", None, "97", "en", 3, None, None, False, None), (2, "file title", "Y", None, None, None, 9, None, None, False, None), (3, None, None, None, None, None, None, None, None, None, "broken"), (4, "stem", None, None, None, None, None, None, None, True, None)],
        "file_id bigint, title string, authors string, publisher string, isbn string, language string, pages int, year int, description string, title_is_stem boolean, error string",
    )
    new = audit.reextracted(old, found)
    got = {r.file_id: (r.title, r.authors, r.publisher, r.isbn, r.pages, r.year, r.enrich_source) for r in new.collect()}
    assert got == {1: ("fresh title", "X", "P", "97", 3, 1990, "embedded"), 2: ("by hand", None, None, None, None, None, "manual"), 3: ("lost", None, None, None, None, None, None), 4: ("stem", None, None, None, None, None, "filename")}
    shelf = lambda df: df.withColumnRenamed("file_id", "id").withColumns({"subjects": F.lit(None).cast("string"), "series": F.lit(None).cast("string"), "filename": F.lit("f")})
    index = TextIndex.create(spark, str(tmp_path / "index"), buckets=4).add(shelf(old))
    after = index.add(shelf(new.where("file_id = 1")))
    hits = lambda i, q: sorted(r.doc_id for r in search.match(i, q).collect())
    assert hits(index, "old") == [1] and hits(after, "old") == [] and hits(after, "fresh") == [1] and hits(after, "hand") == [2]
    assert len(after.segments) == 2 and after.segments[1].dead == 1


def test_copies_are_carried_out_once_and_failures_are_rows(spark, tmp_path):
    src, base = tmp_path / "src", tmp_path / "out é"
    src.mkdir()
    for k in range(6):
        (src / f"{k} ü.bin").write_bytes(random.Random(k).randbytes(1000 + k))
    rows = [(k, f"file:{src}/{k} ü.bin", f"d{k % 2}/{k}.bin") for k in range(6)] + [(9, f"{src}/none", "x/none"), (10, f"{src}/0 ü.bin", "d0/0.bin")]
    plan = spark.createDataFrame(rows, "id bigint, src string, dest string")
    first = audit.carry_out(plan.where("id < 10"), str(base))
    got = {r.id: (r.outcome, r.bytes) for r in first.collect()}
    assert got == {k: ("copied", 1000 + k) for k in range(6)} | {9: ("failed", None)}
    assert all((base / r[2]).read_bytes() == (src / f"{r[0]} ü.bin").read_bytes() for r in rows[:6])
    stamps = {p: p.stat().st_mtime_ns for p in base.rglob("*.bin")}
    assert first.count() == first.count() == 7  # looking again copies nothing
    again = audit.carry_out(plan, str(base))
    assert {r.outcome for r in again.where("id <> 9").collect()} == {"present"} and again.where("id = 9").first().error
    assert {p: p.stat().st_mtime_ns for p in base.rglob("*.bin")} == stamps
    (base / "d0/0.bin").write_bytes(b"cut short")  # as a lost writer without the rename would leave it
    assert audit.carry_out(plan.where("id = 0"), str(base)).first().outcome == "copied"
    moved = audit.carry_out(plan.where("id < 6"), str(tmp_path / "moved"), remove=True)
    assert {r.outcome for r in moved.collect()} == {"moved"} and not list(src.iterdir())
    assert {r.outcome for r in audit.carry_out(plan.where("id < 6"), str(tmp_path / "moved"), remove=True).collect()} == {"present"}
    assert not [p for p in tmp_path.rglob("*.part")]
    assert audit.carry_out(plan.where("false"), str(base)).count() == 0


def test_bursts_on_a_stream_are_those_of_the_table(spark, tmp_path):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = sorted((start + timedelta(seconds=rng.randrange(20_000)), rng.choice(["a", "b", "c"])) for _ in range(200))
    rows += [(None, "a"), (rows[-1][0], None)]
    schema = "ts timestamp, folder string"
    want = sorted(tuple(r) for r in inbox.bursts(spark.createDataFrame(rows, schema), "folder", "5 minutes").collect())
    plain = []
    for folder in "abc":
        times, run = [t for t, f in rows if f == folder and t], []
        for t in times:
            if run and t - run[-1] >= timedelta(minutes=5):
                plain.append((folder, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        plain.append((folder, run[0], run[-1], len(run)))
    assert want == sorted(plain)
    for k in range(0, len(rows), 45):  # then an event of another folder lets the last runs end
        spark.createDataFrame(rows[k : k + 45], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run = inbox.bursts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "folder", "5 minutes", late="1 second").writeStream.format("parquet")
        run.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    spark.createDataFrame([(rows[-1][0] + timedelta(days=1), "end")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = inbox.bursts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "folder", "5 minutes", late="1 second").writeStream.format("parquet")
    run.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).where("folder <> 'end'").collect()) == want


def test_reconciliation_by_stage_and_anomalies(spark):
    rows = [(1, "/a", "copied", 1, None), (2, "/b", "copied", 0, 1), (3, "/c", "arrived", 0, 2), (4, "/d", "arrived", None, None), (5, "/e", None, 0, None)]
    shelf = spark.createDataFrame(rows, "id bigint, source_path string, stage string, is_master int, master_id bigint")
    disk = spark.createDataFrame([("/a",), ("/c",), ("/c",), ("/x",)], "path string")
    got = {r.stage: (r.books, r.masters, r.duplicates, r.no_file) for r in audit.reconcile_stages(shelf, disk).collect()}
    assert got == {"copied": (2, 1, 1, 1), "arrived": (2, 0, 1, 1), None: (1, 0, 1, 1)}
    covers = spark.createDataFrame([("/k1",), ("/k9",), ("/k9",)], "path string")
    named = spark.createDataFrame([(1, "/k1"), (2, "/k2"), (3, " "), (4, None)], "file_id bigint, cover_path string")
    found = sorted((r.kind, r.id or 0, r.path) for r in audit.anomalies(shelf, named, disk, covers).collect())
    assert found == [("no_cover", 2, "/k2"), ("no_file", 2, "/b"), ("no_file", 4, "/d"), ("no_file", 5, "/e"), ("no_master", 3, "/c"), ("no_master", 5, "/e"), ("not_in_db", 0, "/x"), ("stray_cover", 0, "/k9")]
