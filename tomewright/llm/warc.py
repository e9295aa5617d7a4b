"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames; a bundle is its frames and, as a skippable frame at its end, a seek table
of their sizes (the published seekable format). An index maps each record to its bundle, frame and the offset inside
the decompressed frame, so that one frame is read for one record. Bundles are values of a Parquet table in the shared
folder, so any store that Spark writes to can hold them; ``content`` is a complete ``.warc.zst`` file.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tomewright.llm.common import only, read_table, stage_table

#: Bytes of records in a frame and of compressed frames in a bundle, reached before the next one is begun.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 4 << 20, 3
#: Payloads of fewer bytes are never stored as revisits.
MIN_REVISIT = 100
# Fixed values of the seekable format, and of WARC 1.1.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

BUNDLE_SCHEMA = "bundle string, content binary, entries array<struct<record: string, frame: int, offset: bigint, length: bigint>>"
RECORD_SCHEMA = "record string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame with the compressed and decompressed size of each frame, and the footer."""
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(content: bytes) -> list[tuple[int, int]]:
    """Compressed and decompressed sizes of a bundle's frames, from its last bytes."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the bundle's end")
    width = 12 if flags & 0x80 else 8
    at = len(content) - 9 - width * count
    return [struct.unpack_from("<II", content, at + width * k) for k in range(count)]


def read_frame(content: bytes, frame: int, sizes: list[tuple[int, int]] | None = None) -> bytes:
    """One decompressed frame of a bundle."""
    sizes = sizes or read_seek_table(content)
    at = sum(x for x, _ in sizes[:frame])
    return zstandard.ZstdDecompressor().decompress(content[at : at + sizes[frame][0]], max_output_size=sizes[frame][1])


def make_record(record: str, url: str | None, payload: bytes, digest: str, size: int, refers_to: str | None, date: str) -> bytes:
    """A response record, or a revisit of another record if ``refers_to`` names one."""
    revisit = refers_to is not None
    block = b"" if revisit else HTTP_HEAD + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{record}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Payload-Length: {size}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[tuple, int]:
    """The record at an offset as a row of RECORD_SCHEMA, and where the next one begins."""
    stop = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:stop].decode().split("\r\n")[1:])
    block = data[stop + 4 : stop + 4 + int(head["Content-Length"])]
    name = head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    if head["WARC-Type"] == "revisit":
        refers = head["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">")
        row = (name, None, int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", refers)
    else:
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        row = (name, payload, len(payload), hashlib.sha256(payload).hexdigest(), "response", None)
    return row, stop + 8 + len(block)


def record_name(page: Column) -> Column:
    return F.coalesce(F.url_encode(page.cast("string")), F.lit("%"))


def page_of(record: Column, kind: str) -> Column:
    return F.when(record != "%", F.url_decode(record)).cast(kind)


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """``record, url, payload, digest, size, refers_to``: what ``write_bundles`` writes.

    Of records with equal payloads of at least ``min_revisit`` bytes the one with the least id is the response that
    the others revisit. Digests are grouped (partial sums first); the join with those that repeat is one Spark can
    split where a digest holds many rows. It sends the repeating digests to the pages where they are few; else the
    payloads travel once.

    A record is named by its id, URL-encoded, so that no character of an id can end a header; a null id is ``%``.
    """
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    base = only(pages, id_col, url_col, html_col).toDF("id", "url", "html").select("id", "url", payload.alias("payload"))
    base = base.select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    first = base.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = stage_table(first, "first-pages")
    other = F.when((F.col("size") >= min_revisit) & ~F.col("id").eqNullSafe(F.col("first")), F.url_encode(F.col("first").cast("string")))
    return base.join(first, "digest", "left").select(record_name(F.col("id")).alias("record"), "url", F.when(other.isNull(), F.col("payload")).alias("payload"), "digest", "size", other.alias("refers_to"))


def write_bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Bundles of the records, written to the shared folder: ``bundle, content, entries``. A task holds one bundle."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        frames, sizes, entries, held, n = [], [], [], [], 0

        def close_frame() -> None:
            nonlocal held, n
            if held:
                frames.append(squeeze.compress(b"".join(held)))
                sizes.append((len(frames[-1]), n))
            held, n = [], 0

        def close_bundle() -> pa.RecordBatch:
            nonlocal frames, sizes, entries
            close_frame()
            content = b"".join(frames) + seek_table(sizes)
            row = {"bundle": hashlib.sha256(content).hexdigest()[:32], "content": content, "entries": entries}
            frames, sizes, entries = [], [], []
            kind = pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
            return pa.RecordBatch.from_pylist([row], pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("entries", pa.list_(kind))]))

        for batch in batches:
            for name, url, payload, digest, size, refers in zip(*batch.columns, strict=True):
                raw = payload.as_buffer().to_pybytes() if payload.is_valid else b""
                data = make_record(str(name), url.as_py(), raw, digest.as_py(), size.as_py(), refers.as_py(), date)
                entries.append({"record": str(name), "frame": len(frames), "offset": n, "length": len(data)})
                held.append(data)
                n += len(data)
                if n >= frame_bytes:
                    close_frame()
                    if sum(x for x, _ in sizes) >= bundle_bytes:
                        yield close_bundle()
        if held or frames:
            yield close_bundle()

    return stage_table(records.mapInArrow(pack, BUNDLE_SCHEMA), "bundles")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("record", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(kinds)], schema=pa.schema(kinds))


def read_bundles(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the bundles, frame by frame; digest and length of a response are those of the bytes read."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                content = content.as_buffer().to_pybytes()
                sizes, unpack, start = read_seek_table(content), zstandard.ZstdDecompressor(), 0
                for packed, size in sizes:
                    data, at, rows = unpack.decompress(content[start : start + packed], max_output_size=size), 0, []
                    start += packed
                    while at < len(data):
                        row, at = parse_record(data, at)
                        rows.append(row if payloads else (row[0], None, *row[2:]))
                    yield _rows(rows)

    return bundles.select("content").mapInArrow(parse, RECORD_SCHEMA)


def lookup_records(bundles: DataFrame, names: DataFrame) -> DataFrame:
    """The records named in ``names`` (a column ``record``), by index: only the frames that hold them are decompressed."""
    index = bundles.select("bundle", F.explode("entries").alias("e")).select("bundle", "e.*")
    wanted = index.join(names.select("record").distinct(), "record").groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("at"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, at in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                content = content.as_buffer().to_pybytes()
                sizes, rows, held = read_seek_table(content), [], (-1, b"")
                for frame, offset in sorted((x["frame"], x["offset"]) for x in at):
                    held = held if held[0] == frame else (frame, read_frame(content, frame, sizes))
                    rows.append(parse_record(held[1], offset)[0])
                yield _rows(rows)

    return bundles.select("bundle", "content").join(wanted, "bundle").select("content", "at").mapInArrow(fetch, RECORD_SCHEMA)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write the pages as bundles, read the bundles back: ``id_col, payload_bytes, payload_digest, record_type, refers_to``.

    A null html is an empty payload, a null url has no URI line. Rows that repeat the least id of a payload are all
    responses; rows with a null id revisit the least id, and are responses if a payload has none but null ids. An
    empty table writes no bundle and gives an empty result; further columns are not written. Ids may be of any type
    that a string can be cast to, and hold any character.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    back = read_bundles(write_bundles(warc_records(pages, id_col, url_col, html_col)), payloads=False)
    own, other = page_of(F.col("record"), kind), page_of(F.col("refers_to"), kind)
    return back.select(own.alias(id_col), "payload_bytes", "payload_digest", "record_type", other.alias("refers_to"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(read_table(spark, sf_dir, "pages"))


OP1_SQL = f"""
with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as least from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {MIN_REVISIT} and page_id <> least then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {MIN_REVISIT} and page_id <> least then least end as refers_to
from f"""
