"""Book files as a source: listings, metadata readers by format, text of MOBI and FB2, external lookups."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tomewright.functions.text import cache_key, extension, extract_year, from_filename, stem, truthy
from tomewright.operators.ordering import numbered
from tomewright.sources.shared import file_system

BOOK_FORMATS = ("epub", "pdf", "mobi", "azw3", "djvu", "cbr", "cbz", "fb2")
PRUNED = ("@eaDir", "#recycle", "$RECYCLE.BIN", ".git", "node_modules")
IMAGES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp")
#: Codes of rows that can't be used. Not raised here: CLASSIFY_FALLBACK, CLASSIFY_LOW_CONF, ENRICH_FAIL.
ERROR_CODES = ("NO_METADATA_EMPTY", "EXTRACT_FAIL", "FORMAT_UNSUPPORTED", "NO_RAR_TOOL", "DEDUP_AMBIGUOUS", "CLASSIFY_FALLBACK", "CLASSIFY_LOW_CONF", "ENRICH_FAIL")
EXTRACTED = "title string, authors string, publisher string, isbn string, language string, pages int, year int, description string, subjects array<string>, cover_data binary, title_is_stem boolean, error string, error_code string"
PDF_HEAD = 409_600


def listing(spark: SparkSession, roots: list[str], formats: tuple[str, ...] = BOOK_FORMATS, content: bool = False) -> DataFrame:
    """Book files below some roots: ``path, filename, format, length, modified, source_group[, content]``.

    Listed by Spark's file source, so any store it reads will do; content is read only if asked for.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    fmt = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    pruned = "/(" + "|".join(map(re.escape, PRUNED)) + ")/"
    group = F.coalesce(*[F.when(F.contains("path", F.lit(r.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")), F.lit(PurePosixPath(r).name)) for r in roots], F.lit(None).cast("string"))
    columns = ["path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), fmt.alias("format"), "length", F.col("modificationTime").alias("modified"), group.alias("source_group")]
    return df.where(fmt.isin(*formats) & ~F.col("path").rlike(pruned)).select(*columns, *(["content"] if content else []))


def count_files(files: DataFrame) -> DataFrame:
    return files.groupBy("source_group").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def from_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """An explicit list of files; they have no source group."""
    return listing(spark, paths, content=False).withColumn("source_group", F.lit(None).cast("string"))


def _natural(name: str) -> list:
    return [(0, int(p), "") if p.isdigit() else (1, 0, p.lower()) for p in re.split(r"(\d+)", name) if p]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def read_epub(source: BinaryIO, name: str) -> dict:
    """Dublin Core of the package document; the identifier that looks like an ISBN, else the last that isn't a URL."""
    with zipfile.ZipFile(source) as z:
        container = ElementTree.fromstring(z.read("META-INF/container.xml"))
        place = next(e.attrib["full-path"] for e in container.iter() if _local(e.tag) == "rootfile")
        package = ElementTree.fromstring(z.read(place))
        fields: dict[str, list[str]] = {}
        for e in package.iter():
            if "purl.org/dc/" in e.tag and (e.text or "").strip():
                fields.setdefault(_local(e.tag), []).append(e.text.strip())
        names = fields.get("identifier", [])
        isbn = next((i for i in names if re.search("isbn|978|979", i, re.IGNORECASE)), None) or next((i for i in reversed(names) if "://" not in i), None)
        items = [e.attrib for e in package.iter() if _local(e.tag) == "item"]
        cover_id = next((e.attrib.get("content") for e in package.iter() if _local(e.tag) == "meta" and e.attrib.get("name") == "cover"), None)
        cover = next((i["href"] for i in items if i.get("id") == cover_id or "cover-image" in i.get("properties", "")), None)
        at = str(PurePosixPath(place).parent / cover) if cover else ""
        data = z.read(at) if at in z.namelist() else None
    one = lambda k: (fields.get(k) or [None])[0]
    year = (one("date") or "")[:4]
    return {
        "title": one("title"), "authors": "; ".join(fields.get("creator", [])) or None, "publisher": one("publisher"),
        "isbn": re.sub("(?i)^urn:isbn:", "", isbn).replace("-", "") if isbn else None, "language": one("language"), "description": one("description"),
        "subjects": fields.get("subject"), "year": int(year) if year.isdigit() else None, "cover_data": data,
    }


def _pdf_text(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    text = raw.decode("utf-16") if raw[:2] in (b"\xfe\xff", b"\xff\xfe") else raw.decode("latin-1")
    return re.sub(r"[\x00-\x1f\x7f]", "", text).strip() or None


def read_pdf(source: BinaryIO, name: str) -> dict:
    """Information entries and page objects in the file's head; the subject is one of the subjects."""
    head = source.read(PDF_HEAD)
    got = {k: (m[1] if (m := re.search(rb"/" + k + rb"\s*\(((?:\\.|[^\\)])*)\)", head)) else None) for k in (b"Title", b"Author", b"Subject")}
    pages = head.count(b"/Type /Page") - head.count(b"/Type /Pages")
    subject = _pdf_text(got[b"Subject"])
    return {"title": _pdf_text(got[b"Title"]), "authors": _pdf_text(got[b"Author"]), "subjects": [subject] if subject else None, "pages": pages if pages > 0 else None}


def read_mobi(source: BinaryIO, name: str) -> dict:
    """The name whose length stands at byte 76, from byte 78 on, 256 bytes at most."""
    content = source.read(334)
    (length,) = struct.unpack(">I", content[76:80]) if len(content) >= 80 else (0,)
    title = content[78 : 78 + min(length, 256)].decode("utf-8", "replace").replace("\x00", "").strip()
    return {"title": title or None}


def read_cbz(source: BinaryIO, name: str) -> dict:
    """Number of images, and the first of them in natural order."""
    with zipfile.ZipFile(source) as z:
        images = sorted((n for n in z.namelist() if n.lower().endswith(IMAGES)), key=_natural)
        return {"pages": len(images), "cover_data": z.read(images[0]) if images else None}


class ExtractError(Exception):
    def __init__(self, code: str, text: str) -> None:
        super().__init__(text)
        self.code = code


def read_cbr(source: BinaryIO, name: str) -> dict:
    raise ExtractError("NO_RAR_TOOL", "no tool for RAR archives")


READERS: dict[str, Callable[[BinaryIO, str], dict]] = {"epub": read_epub, "pdf": read_pdf, "mobi": read_mobi, "azw3": read_mobi, "cbz": read_cbz, "cbr": read_cbr}


class Ranges(io.RawIOBase):
    """A file that is read from its place in ranges, as they are asked for; ``taken`` counts the bytes."""

    def __init__(self, path: str) -> None:
        super().__init__()
        fs, at = file_system(path)
        self._file, self.taken = fs.open_input_file(at), 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self._file.read(len(buffer))
        buffer[: len(got)] = got
        self.taken += len(got)
        return len(got)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._file.seek(offset, whence)
        return self._file.tell()

    def tell(self) -> int:
        return self._file.tell()

    def close(self) -> None:
        self._file.close()
        super().close()


#: Formats whose metadata stand in the first bytes: nothing behind these is sent to a worker.
HEADS = {"pdf": PDF_HEAD, "mobi": 4096, "azw3": 4096}


def extract(files: DataFrame, readers: dict[str, Callable[[BinaryIO, str], dict]] | None = None, most_bytes: int = 1 << 28) -> DataFrame:
    """Metadata of files: ``path``, the fields of EXTRACTED and ``bytes_read``; formats without a reader give none.

    Without a column ``content`` each file is opened by its path where the task runs, and read in ranges: the head of a
    PDF or MOBI file, the directory and two members of an archive, whatever the file's size. That asks for paths that
    Arrow's file systems can open (local and shared folders, HDFS, object stores). With ``content`` Spark has read the
    files, and those of over ``most_bytes`` are rows with the error ``EXTRACT_FAIL``. A file that can't be read is a row
    with an error, never the end of the job.
    """
    table = readers or READERS
    fields = [f.split()[0] for f in EXTRACTED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, fmt, content in zip(batch["path"], batch["format"], batch["content"], strict=True):
                row = dict.fromkeys(fields) | {"bytes_read": 0}
                name = PurePosixPath(path).stem
                try:
                    if fmt in table:
                        with Ranges(path) if content is None else io.BytesIO(content) as source:
                            try:
                                row |= table[fmt](source, name)
                            finally:
                                row["bytes_read"] = getattr(source, "taken", len(content or b""))
                        row["title_is_stem"] = not row["title"]
                        row["title"] = row["title"] or name
                except ExtractError as e:
                    row |= {"error": str(e), "error_code": e.code}
                except Exception as e:  # noqa: BLE001  any broken file
                    row |= {"error": f"{type(e).__name__}: {e}"[:300], "error_code": "EXTRACT_FAIL"}
                rows.append({"path": path} | row)
            yield pd.DataFrame(rows, columns=["path", *fields, "bytes_read"]).astype({"pages": "Int32", "year": "Int32"})

    schema = f"path string, {EXTRACTED}, bytes_read long"
    if "content" not in files.columns:
        return files.select("path", "format", F.lit(None).cast("binary").alias("content")).mapInPandas(run, schema)
    head = F.col("content")
    for fmt, size in HEADS.items():
        head = F.when(F.col("format") == fmt, F.substring("content", 1, size)).otherwise(head)
    found = files.where(F.col("length") <= most_bytes).select("path", "format", head.alias("content")).mapInPandas(run, schema)
    reason = F.concat(F.col("length").cast("string"), F.lit(f" bytes, of {most_bytes} at most"))
    large = files.where(F.col("length") > most_bytes).select("path", reason.alias("error"), F.lit("EXTRACT_FAIL").alias("error_code"))
    return found.unionByName(large, allowMissingColumns=True)


def palmdoc(data: bytes) -> bytes:
    """PalmDOC decompression: literals, runs of raw bytes, back references, and space pairs."""
    out = bytearray()
    i = 0
    while i < len(data):
        c = data[i]
        i += 1
        if 1 <= c <= 8:
            out += data[i : i + c]
            i += c
        elif c < 0x80:
            out.append(c)
        elif c >= 0xC0:
            out += bytes((0x20, c ^ 0x80))
        elif i < len(data):
            pair = c << 8 | data[i]
            i += 1
            back, size = pair >> 3 & 0x7FF, (pair & 7) + 3
            for _ in range(size if 0 < back <= len(out) else 0):
                out.append(out[-back])
    return bytes(out)


def mobi_text(content: bytes) -> str:
    """Text of an uncompressed or PalmDOC-compressed MOBI file, markup removed."""
    (count,) = struct.unpack_from(">H", content, 76)
    starts = [struct.unpack_from(">I", content, 78 + 8 * k)[0] for k in range(count)] + [len(content)]
    kind, _, _, records = struct.unpack_from(">HHIH", content, starts[0])
    if kind not in (1, 2):
        raise ExtractError("FORMAT_UNSUPPORTED", f"compression {kind}")
    parts = [content[a:b] for a, b in zip(starts[1 : records + 1], starts[2 : records + 2], strict=True)]
    raw = b"".join(palmdoc(p) if kind == 2 else p for p in parts)
    return strip_markup(raw.decode("utf-8", "replace"))


def fb2_text(content: bytes) -> str:
    """Text of the bodies of an FB2 file, a paragraph a line."""
    root = ElementTree.fromstring(content)
    paragraphs = (e for body in root.iter() if _local(body.tag) == "body" for e in body.iter() if _local(e.tag) in ("p", "v", "subtitle"))
    return "\n".join(t for e in paragraphs if (t := " ".join("".join(e.itertext()).split())))


def strip_markup(html: str) -> str:
    html = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", html)
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html)).strip()


TEXT_READERS = {"mobi": mobi_text, "azw3": mobi_text, "fb2": fb2_text}


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def full_text(content: pd.Series, fmt: pd.Series) -> pd.DataFrame:
    """Text of MOBI and FB2 content; null with an error where it can't be decoded."""
    rows = []
    for data, kind in zip(content, fmt, strict=True):
        try:
            rows.append((TEXT_READERS[kind](bytes(data)) if kind in TEXT_READERS else None, None))
        except Exception as e:  # noqa: BLE001  any broken file
            rows.append((None, f"{type(e).__name__}: {e}"[:300]))
    return pd.DataFrame(rows, columns=["text", "error"])


def catalogued(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files with what their content and their names give: embedded first, then the name, then the stem.

    A title that is only the file's stem gives way to the one parsed from the name.
    """
    joined = files.join(found, "path", "left").withColumn("named", from_filename(F.col("filename")))
    filled = lambda *cs: F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])
    embedded = F.when(~F.coalesce("title_is_stem", F.lit(True)), F.col("title"))
    rest = [c for c in files.columns if c != "content"] + ["publisher", "isbn", "language", "pages", "description", "subjects", "title_is_stem", "error", "error_code"]
    return joined.select(
        *rest, filled(embedded, F.col("named.title"), stem(F.col("filename"))).alias("title"), filled(F.col("authors"), F.col("named.author")).alias("authors"),
        F.coalesce("year", "named.year", extract_year(F.col("filename"))).alias("year"), *[F.col(f"named.{c}").alias(c) for c in ("series", "num", "volume", "issue")],
    )


def lookup(books: DataFrame, answers: DataFrame, fallback: DataFrame, columns: list[str]) -> DataFrame:
    """Answers of external services from tables keyed by md5 ``key``: the second fills what the first leaves blank.

    There is no network here; a rate-limited crawler would append to the same tables.
    """
    key = cache_key(F.col("isbn"), F.col("title"), F.col("authors"))
    first = answers.select(F.col("key").alias("_k1"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    second = fallback.select(F.col("key").alias("_k2"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    rows = books.select("id", key.alias("key")).join(first, F.col("key") == F.col("_k1"), "left").join(second, F.col("key") == F.col("_k2"), "left")
    value = lambda c: F.when(truthy(F.col(f"_a_{c}").cast("string")), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}"))
    return rows.where("_k1 is not null or _k2 is not null").select("id", "key", *[value(c).alias(c) for c in columns])


def unique_names(arrivals: DataFrame, taken: DataFrame) -> DataFrame:
    """Names for uploads: the one asked for, or with the first free of ``_1``, ``_2`` … before the extension.

    Of equal names the least id comes first. A number is free if no taken name and no other arrival's own name has it.
    """
    mark = r"^(.*)_(\d{1,9})(\.[^.]*)?$"
    own = arrivals.select("filename").unionByName(taken.select("filename"))
    base = F.concat(F.regexp_extract("filename", mark, 1), F.regexp_extract("filename", mark, 3))
    marked = own.where(F.col("filename").rlike(mark)).select(base.alias("filename"), F.regexp_extract("filename", mark, 2).cast("bigint").alias("number"))
    held = marked.groupBy("filename").agg(F.array_sort(F.collect_set("number")).alias("held"))
    used = taken.select("filename").distinct().withColumn("used", F.lit(1))
    rows = numbered(arrivals, ["filename"], [F.col("id")], "k").join(used, "filename", "left")
    rows = rows.withColumn("k", F.col("k") - 1 + F.coalesce("used", F.lit(0))).join(held, "filename", "left")
    free = F.aggregate(F.coalesce("held", F.array().cast("array<bigint>")), F.col("k"), lambda k, n: F.when((n > 0) & (n <= k), k + 1).otherwise(k))
    name: Column = F.concat(stem(F.col("filename")), F.lit("_"), free.cast("string"), extension(F.col("filename")))
    return rows.select("id", F.when(F.col("k") == 0, F.col("filename")).otherwise(name).alias("filename"))
