"""A kept full-text index: segments of positional postings in a folder, read by bucket and token.

A segment is written once: postings partitioned by a hash of the stem and sorted by it, the ids it holds, and those of them
that it takes over from older segments. The postings of a word in some thousand books (a part) are one row, so that a word
is shuffled, sorted and written once a part and not once a book. A book that comes anew or is extracted again makes a small segment; its older
postings are dead from then on, and a merge folds all segments into one. Each change is a new manifest that names the
live segments; a reader of an older one goes on undisturbed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.operators.search import INDEXED, SEARCHED, folded, porter_stem, tokens

GRAMS = "gram long, doc_id long"
POSTINGS = "stem string, token string, field string, doc_id long, pos array<int>"
GRAM_BLOCKS = "gram long, part long, docs array<long>"
BLOCKS = "stem string, token string, field string, part long, docs array<long>, ends array<int>, pos array<int>"
BUCKETS = 32
#: Books whose postings share the files of a bucket; of more, a bucket is that many more files.
SPLIT_BOOKS = 250_000
#: Words, or characters, that a task groups at once; books of a part where segments are merged.
PIECE, PART_BOOKS = 2_000_000, 4096

_stem = lru_cache(1 << 18)(porter_stem)


def bucket_of(stem: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stem), F.lit(buckets)).cast("int")


def pieces(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First row and number of rows of successive pieces that hold some ``most`` of what ``sizes`` counts by row."""
    before = np.cumsum(sizes) - sizes
    starts = np.flatnonzero(np.diff(before // most, prepend=-1))
    yield from zip(starts.tolist(), np.diff(np.append(starts, len(sizes))).tolist(), strict=True)


def word_blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id and the token lists of its fields to blocks: each distinct word of a field once a piece of a batch,
    with the books that have it and its places in them, in order.

    Words are numbered a piece at a time, so only distinct ones lose their marks and are stemmed.
    """
    part, names, width = TaskContext.get().partitionId() << 32, pa.array(columns), len(columns)
    for batch in batches:
        sizes = np.diff(batch.column(1).flatten().offsets.to_numpy()).reshape(-1, width).sum(axis=1)
        for start, count in pieces(sizes, PIECE):
            ids, lists = batch.column(0).slice(start, count), batch.column(1).slice(start, count).flatten()
            offsets = lists.offsets.to_numpy()
            words = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            if not len(words):
                continue
            row = np.repeat(np.arange(len(lists)), np.diff(offsets))
            place = (np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]).astype(np.int32)
            plain = pa.array([folded(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
            kinds, code = plain.dictionary, plain.indices.to_numpy()[words.indices.to_numpy()].astype(np.int64)
            key = (code * width + row % width) * count + row // width
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))  # a word in a field of a book
            block, book = np.divmod(key[at], count)
            first = np.flatnonzero(np.diff(block, prepend=-1))  # a word in a field
            edges = np.append(first, len(at)).astype(np.int32)
            begins = np.append(at, len(key))[edges].astype(np.int32)
            ends = np.append(at[1:], len(key)) - np.repeat(begins[:-1], np.diff(edges))
            code, field = np.divmod(block[first], width)
            token, stems = kinds.take(pa.array(code)), pa.array([_stem(w) for w in kinds.to_pylist()], pa.string())
            docs = pa.ListArray.from_arrays(pa.array(edges), ids.take(pa.array(book)))
            held = pa.ListArray.from_arrays(pa.array(edges), pa.array(ends.astype(np.int32)))
            pos = pa.ListArray.from_arrays(pa.array(begins), pa.array(place))
            out = [stems.take(pa.array(code)), token, names.take(pa.array(field)), pa.array(np.full(len(first), part)), docs, held, pos]
            yield pa.RecordBatch.from_arrays(out, ["stem", "token", "field", "part", "docs", "ends", "pos"])
            part += 1


def blocks_of(books: DataFrame, columns: tuple[str, ...] = INDEXED) -> DataFrame:
    """``stem, token, field, part, docs, ends, pos`` of the books that have a title or authors, in one pass without a
    shuffle. ``pos`` has the places in all ``docs``, those in each up to its ``ends``; a book's words are of one part."""
    rows = books.where("coalesce(title, '') <> '' or coalesce(authors, '') <> ''")
    texts = F.array(*[tokens(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    return rows.select(F.col("id").cast("long").alias("doc_id"), texts.alias("tokens")).mapInArrow(lambda batches: word_blocks(batches, columns), BLOCKS)


def _begin(k: Column) -> Column:
    return F.when(k == 0, 0).otherwise(F.get("ends", k - 1))


def spread(blocks: DataFrame) -> DataFrame:
    """Blocks of words to postings, blocks of grams to their books; further columns stay."""
    if "ends" not in blocks.columns:
        return blocks.withColumn("doc_id", F.explode("docs")).drop("part", "docs")
    each = F.transform("docs", lambda d, k: F.struct(d.alias("doc_id"), F.slice("pos", _begin(k) + 1, F.get("ends", k) - _begin(k)).alias("pos")))
    rest = [c for c in blocks.columns if c not in ("part", "docs", "ends", "pos", "bucket")]
    return blocks.select(*rest, F.inline(each), *[c for c in blocks.columns if c == "bucket"])


def blocked(postings: DataFrame, parts: int) -> DataFrame:
    """Postings, or grams and books, as blocks again: parts by a hash of the book."""
    rows = postings.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long"))
    if "pos" not in rows.columns:
        return rows.groupBy("gram", "part").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))
    all_of = F.sort_array(F.collect_list(F.struct("doc_id", "pos")))
    lists = rows.groupBy("stem", "token", "field", "part").agg(all_of.alias("e")).select("stem", "token", "field", "part", F.col("e.doc_id").alias("docs"), F.col("e.pos").alias("pos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, docs, pos = batch.columns
            each, edges = pos.flatten(), np.append(0, np.cumsum(np.diff(pos.offsets.to_numpy()))).astype(np.int32)
            total = np.append(0, np.cumsum(np.diff(each.offsets.to_numpy())))
            ends = total[1:] - np.repeat(total[edges[:-1]], np.diff(edges))
            held = pa.ListArray.from_arrays(pa.array(edges), pa.array(ends.astype(np.int32)))
            flat = pa.ListArray.from_arrays(pa.array(total[edges].astype(np.int32)), each.flatten())
            yield pa.RecordBatch.from_arrays([*keys, docs, held, flat], ["stem", "token", "field", "part", "docs", "ends", "pos"])

    return lists.mapInArrow(run, BLOCKS)


def postings_of(books: DataFrame, columns: tuple[str, ...] = INDEXED) -> DataFrame:
    """``stem, token, field, doc_id, pos`` of the books that have a title or authors, in one pass without a shuffle."""
    return spread(blocks_of(books, columns))


def gram_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id and its texts to ``gram, part, docs``: the books of a piece of a batch that have these three
    successive characters in a text, each once."""
    part = TaskContext.get().partitionId() << 32
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(1).flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(1).offsets.to_numpy()))
        for start, count in pieces(np.bincount(owner, lengths, batch.num_rows).astype(np.int64), PIECE):
            ids, lists = batch.column(0).slice(start, count), batch.column(1).slice(start, count)
            texts = lists.flatten().fill_null("").to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
            inside = text[2:] == text[:-2]
            row = np.repeat(np.arange(count, dtype=np.int32), np.diff(lists.offsets.to_numpy()))[text[2:][inside]]
            gram = _gram(points[:-2], points[1:-1], points[2:])[inside]
            order = np.lexsort((row, gram))
            gram, row = gram[order], row[order]
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
            gram, row = gram[fresh], row[fresh]
            first = np.flatnonzero(np.diff(gram, prepend=-1))
            docs = pa.ListArray.from_arrays(pa.array(np.append(first, len(gram)).astype(np.int32)), ids.take(pa.array(row)))
            yield pa.RecordBatch.from_arrays([pa.array(gram[first]), pa.array(np.full(len(first), part)), docs], ["gram", "part", "docs"])
            part += 1


def _gram(a, b, c):
    """Three code points of 21 bits as one number."""
    return (a << 42) | (b << 21) | c


def grams_of(books: DataFrame, columns: tuple[str, ...] = SEARCHED, tags: str | None = None) -> DataFrame:
    """``gram, part, docs`` of the lower-cased columns, and of an array column of tags, in one pass without a shuffle."""
    texts = F.array(*[F.lower(F.col(c)) for c in columns])
    if tags:
        texts = F.concat(texts, F.coalesce(F.transform(F.col(tags), F.lower), F.array().cast("array<string>")))
    return books.where("id is not null").select(F.col("id").cast("long").alias("doc_id"), texts.alias("texts")).mapInArrow(gram_blocks, GRAM_BLOCKS)


def grams_in(text: str) -> set[int] | None:
    """The grams that a row has if it has every term of a substring search; None where a term tells none: one without
    three successive letters that aren't wildcards, or with an escape."""
    terms = text.lower().replace('"', " ").split()
    runs = [re.split("[%_]", t) for t in terms]
    if not terms or "\\" in text or any(max(map(len, r)) < 3 for r in runs):
        return None
    return {_gram(*map(ord, run[k : k + 3])) for r in runs for run in r for k in range(len(run) - 2)}


class Postings:
    """Postings of a DataFrame, found by a filter; ``TextIndex`` finds them by its files."""

    def __init__(self, rows: DataFrame, stem: bool = True):
        self.rows, self.stem = rows, stem

    def word(self, word: str, field: str | None = None) -> DataFrame:
        """``doc_id, field, pos`` of a word: of all words of its stem, or of itself alone."""
        test = F.col("stem") == _stem(word) if self.stem else F.col("token") == word
        return self._rows(test, field, _stem(word))

    def beginning(self, prefix: str, field: str | None = None) -> DataFrame:
        """``doc_id, field, pos`` of the words, or stems, that begin so."""
        return self._rows(F.col("stem" if self.stem else "token").startswith(prefix), field)

    def _rows(self, test: Column, field: str | None, stem: str | None = None) -> DataFrame:
        return self._narrow(self.rows.where(test), field)

    def _narrow(self, rows: DataFrame, field: str | None) -> DataFrame:
        return (rows if field is None else rows.where(F.col("field") == field)).select("doc_id", "field", "pos")


@dataclass(frozen=True)
class Segment:
    name: str
    dead: int  # how many ids it takes over from older segments
    repeated: int = 0  # how many of its ids came in several rows


class TextIndex(Postings):
    """One version of the index in a folder. ``stem`` tells whether words or stems are asked for; both are kept."""

    def __init__(self, spark: SparkSession, path: str, version: int, segments: tuple[Segment, ...], columns: tuple[str, ...], buckets: int, grams: bool = False, stem: bool = True):
        self.spark, self.path, self.version, self.segments = spark, path, version, segments
        self.columns, self.buckets, self.grams, self.stem = columns, buckets, grams, stem

    # --- versions ---------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, columns: tuple[str, ...] = INDEXED, buckets: int = BUCKETS, grams: bool = False) -> TextIndex:
        """An empty index in a folder that has none; with ``grams`` it also serves substring searches."""
        return cls(spark, path, -1, (), columns, buckets, grams)._commit(())

    @classmethod
    def open(cls, spark: SparkSession, path: str, stem: bool = True) -> TextIndex:
        """The latest version in a folder."""
        fs, at = _folder(spark, f"{path}/versions")
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        last = max(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))
        text = spark.read.text(f"{path}/versions/{last:08d}.json", wholetext=True).first()[0]
        said = json.loads(text)
        segments = tuple(Segment(*s) for s in said["segments"])
        return cls(spark, path, last, segments, tuple(said["columns"]), said["buckets"], said["grams"], stem)

    def unstemmed(self) -> TextIndex:
        return TextIndex(self.spark, self.path, self.version, self.segments, self.columns, self.buckets, self.grams, False)

    def _commit(self, segments: tuple[Segment, ...]) -> TextIndex:
        """The next version. Its file is created, never overwritten, so of two writers one fails and changes nothing."""
        new = TextIndex(self.spark, self.path, self.version + 1, segments, self.columns, self.buckets, self.grams, self.stem)
        fs, at = _folder(self.spark, f"{self.path}/versions/{new.version:08d}.json")
        said = {"segments": [[s.name, s.dead, s.repeated] for s in segments], "columns": self.columns, "buckets": self.buckets, "grams": self.grams}
        out = fs.create(at, False)
        try:
            out.write(bytearray(json.dumps(said).encode()))
        finally:
            out.close()
        return new

    # --- changes ----------------------------------------------------------------------------------

    def add(self, books: DataFrame, tags: str | None = None) -> TextIndex:
        """The index with these books, by ``id``: new ones, and anew those that it has. Books without title and authors
        are in no posting, but what was indexed of them goes. ``tags`` names an array column for substring searches."""
        return self._add(blocks_of(books, self.columns), grams_of(books, tags=tags) if self.grams else None, books.select("id"))

    def remove(self, ids: DataFrame) -> TextIndex:
        """The index without the books of these ``id``."""
        return self._add(self._none(BLOCKS), self._none(GRAM_BLOCKS) if self.grams else None, ids.select("id"))

    def _add(self, blocks: DataFrame, grams: DataFrame | None, ids: DataFrame) -> TextIndex:
        name, dead = f"segment-{uuid.uuid4().hex}", 0
        counted = ids.groupBy(F.col("id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
        counted.where("doc_id is not null").write.parquet(f"{self.path}/{name}/ids")
        held = self._ids(Segment(name, 0), "ids")
        if self.segments:
            older = reduce(DataFrame.union, [self._ids(s, "ids") for s in self.segments])
            held.join(older, "doc_id", "left_semi").write.parquet(f"{self.path}/{name}/dead")
            dead = self._ids(Segment(name, 0), "dead").count()
        books, repeated = self._ids(Segment(name, 0), "ids", ", n long").agg(F.count("*"), F.count(F.when(F.col("n") > 1, 1))).first()
        self._write_all(blocks, grams, name, books)
        return self._commit((*self.segments, Segment(name, dead, repeated)))

    def merge(self) -> TextIndex:
        """The same postings in one segment. Older versions stay readable until ``clean``."""
        name = f"segment-{uuid.uuid4().hex}"
        reduce(DataFrame.union, [self._ids(s, "ids") for s in self.segments]).distinct().write.parquet(f"{self.path}/{name}/ids")
        books = self._ids(Segment(name, 0), "ids").count()
        parts = 1 + books // PART_BOOKS
        grams = blocked(self.live("grams").select("gram", "doc_id"), parts) if self.grams else None
        self._write_all(blocked(self.live().drop("bucket"), parts), grams, name, books)
        return self._commit((Segment(name, 0, sum(s.repeated for s in self.segments)),))

    def clean(self) -> None:
        """Delete the segments that this version doesn't read."""
        fs, at = _folder(self.spark, self.path)
        keep = {s.name for s in self.segments}
        for f in fs.listStatus(at):
            if f.getPath().getName().startswith("segment-") and f.getPath().getName() not in keep:
                fs.delete(f.getPath(), True)

    def _write_all(self, blocks: DataFrame, grams: DataFrame | None, name: str, books: int) -> None:
        splits = 1 + books // SPLIT_BOOKS
        self._write(blocks, ("stem", "token", "field", "part"), f"{self.path}/{name}/postings", splits)
        if grams is not None:
            self._write(grams, ("gram", "part"), f"{self.path}/{name}/grams", splits)

    def _write(self, rows: DataFrame, order: tuple[str, ...], path: str, splits: int) -> None:
        """Sorted files by bucket. A word that most books have is dealt to ``splits`` tasks by part. The second version of
        Parquet's pages codes the ascending places and ids as differences."""
        rows = rows.withColumn("bucket", bucket_of(F.col(order[0]), self.buckets))
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("part", F.lit("split")), F.lit(splits)))
        writer = dealt.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").option("parquet.writer.version", "v2")
        for column in ("docs", "ends", "pos"):
            writer = writer.option(f"parquet.enable.dictionary#{column}.list.element", "false")
        writer.parquet(path)

    # --- reading ----------------------------------------------------------------------------------

    def _ids(self, segment: Segment, kind: str, more: str = "") -> DataFrame:
        return self.spark.read.schema(f"doc_id long{more}").parquet(f"{self.path}/{segment.name}/{kind}")

    def _none(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def blocks(self, segment: Segment, kind: str = "postings") -> DataFrame:
        """A segment's rows as they are kept."""
        schema = f"{BLOCKS if kind == 'postings' else GRAM_BLOCKS}, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/{segment.name}/{kind}")

    def live(self, kind: str = "postings", test: Column | None = None) -> DataFrame:
        """Postings (or ``grams``) that no younger segment has taken over; ``test`` goes to the scan of each segment."""
        out = self._alive(lambda s: spread(self.blocks(s, kind) if test is None else self.blocks(s, kind).where(test)))
        columns = ("stem", "token", "field", "doc_id", "pos", "bucket") if kind == "postings" else ("gram", "doc_id", "bucket")
        return out.select(*columns) if out is not None else self._none(f"{POSTINGS if kind == 'postings' else GRAMS}, bucket int")

    def _alive(self, rows: Callable[[Segment], DataFrame]) -> DataFrame | None:
        """Rows by ``doc_id`` of all segments, without those that younger ones have taken over."""
        out, dead = [], None
        for s in reversed(self.segments):
            own = rows(s)
            out.append(own if dead is None else own.join(dead, "doc_id", "left_anti").select(own.columns))
            if s.dead:
                gone = self._ids(s, "dead")
                dead = gone if dead is None else dead.union(gone)
        return reduce(DataFrame.unionByName, out) if out else None

    def documents(self, fields: tuple[str, ...]) -> DataFrame:
        """``doc_id`` of the books with a word in these fields: those in which some word stands at place 0."""
        begun = F.filter("docs", lambda d, k: F.get("pos", _begin(k)) == 0)
        found = self._alive(lambda s: self.blocks(s).where(F.col("field").isin(*fields)).select(F.explode(begun).alias("doc_id")))
        return self._none("doc_id long") if found is None else found.distinct()

    def _whole(self) -> bool:
        """Whether each book has one row in one segment, so that blocks share no book and can be counted as they are."""
        return bool(self.segments) and not any(s.dead or s.repeated for s in self.segments)

    def word_counts(self, fields: tuple[str, ...]) -> DataFrame:
        """``token, field, tf, df``: places of a word in a field, and books."""
        if not self._whole():
            rows = self.live(test=F.col("field").isin(*fields))
            return rows.groupBy("token", "field").agg(F.sum(F.size("pos")).alias("tf"), F.count_distinct("doc_id").alias("df"))
        kept = reduce(DataFrame.unionByName, [self.blocks(s).where(F.col("field").isin(*fields)) for s in self.segments])
        return kept.groupBy("token", "field").agg(F.sum(F.size("pos")).alias("tf"), F.sum(F.size("docs")).alias("df"))

    def stem_counts(self, fields: tuple[str, ...]) -> DataFrame:
        """``stem, df``: books with a word of a stem. Books of two parts differ, so a part is counted by itself."""
        if not self._whole():
            return self.live(test=F.col("field").isin(*fields)).groupBy("stem").agg(F.count_distinct("doc_id").alias("df"))
        kept = [self.blocks(s).where(F.col("field").isin(*fields)).select(F.lit(k).alias("segment"), "part", "stem", "docs") for k, s in enumerate(self.segments)]
        each = reduce(DataFrame.unionByName, kept).groupBy("segment", "part", "stem").agg(F.collect_list("docs").alias("docs"))
        return each.groupBy("stem").agg(F.sum(F.size(F.array_distinct(F.flatten("docs")))).alias("df"))

    def candidates(self, text: str) -> DataFrame | None:
        """``doc_id`` of the books that have the grams of all terms: the only ones in which a substring search can find
        them. None if the terms' grams aren't kept or tell nothing, so that all books have to be read."""
        grams = grams_in(text) if self.grams else None
        if grams is None:
            return None
        asked = sorted(grams)
        test = self._in_buckets(asked) & F.col("gram").isin(*asked)
        hits = self.live("grams", test).groupBy("doc_id").agg(F.count("*").alias("n"))
        return hits.where(F.col("n") == len(asked)).select("doc_id")

    def _in_buckets(self, grams: list[int]) -> Column:
        return reduce(lambda a, b: a | b, (F.col("bucket") == bucket_of(F.lit(g).cast("long"), self.buckets) for g in grams))

    def _rows(self, test: Column, field: str | None, stem: str | None = None) -> DataFrame:
        if stem is not None:
            # a constant to the planner, which so reads one bucket's files
            test = (F.col("bucket") == bucket_of(F.lit(stem), self.buckets)) & (F.col("stem") == stem) & test
        return self._narrow(self.live(test=test), field)


def _folder(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
