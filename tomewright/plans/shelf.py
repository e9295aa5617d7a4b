"""A small tree of book files, one or two a nation, for the queries over file sources."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import DataFrame, SparkSession

from tomewright.sources.shared import new_path


def _zip(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def _epub(key: int, name: str) -> bytes:
    package = f"""<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{name}</dc:title><dc:creator>Writer {key}</dc:creator><dc:creator>Other</dc:creator>
<dc:identifier>urn:isbn:978-0-{key}</dc:identifier><dc:date>{1900 + key}-02</dc:date><dc:subject>s{key}</dc:subject></metadata><manifest/></package>"""
    container = '<c xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>'
    return _zip({"META-INF/container.xml": container.encode(), "o/p.opf": package.encode()})


def _pdf(key: int, name: str) -> bytes:
    return f"%PDF /Title ({name}) /Author (Writer {key}) /Subject (s{key}) /Type /Pages".encode() + b" /Type /Page" * key


def _cbz(key: int, name: str) -> bytes:
    return _zip({f"p{k}.png": f"page {k}".encode() for k in range(key, 0, -1)})


def _mobi(key: int, name: str) -> bytes:
    text = f"<p>{name} <b>begins</b></p>".encode()
    header = struct.pack(">HHIHHI", 1, 0, len(text), 1, 4096, 0)
    out = bytearray(94)
    struct.pack_into(">H", out, 76, 2)
    struct.pack_into(">I", out, 78, 94)
    struct.pack_into(">I", out, 86, 94 + len(header))
    return bytes(out) + header + text


def _azw3(key: int, name: str) -> bytes:
    """A file with its title in the header: a length of 32, which ends in a space, and the title from the byte behind it."""
    return bytes(76) + struct.pack(">I", 32) + name.ljust(30).encode() + bytes(16)


def _fb2(key: int, name: str) -> bytes:
    return f"<FictionBook><body><p>{name}</p><p>ends  here</p></body></FictionBook>".encode()


MAKERS = {"epub": _epub, "pdf": _pdf, "cbz": _cbz, "mobi": _mobi, "fb2": _fb2}


def write_tree(spark: SparkSession, nations: DataFrame) -> str:
    """The folder: ``<region>/<key>.<format>`` by the key's remainder, broken and odd files beside them. Nations are 25."""
    path = new_path(spark, "shelf")
    made = {"0/broken.epub": b"no archive", "0/comic.cbr": b"x", "1/scan.djvu": b"x", "1/notes.txt": b"not a book", "2/.git/7.pdf": b"%PDF", "2/#recycle/8.pdf": b"%PDF"}
    for key, name, region in nations.select("n_nationkey", "n_name", "n_regionkey").collect():
        kind = list(MAKERS)[key % len(MAKERS)]
        made[f"{region}/{key}.{kind}"] = MAKERS[kind](key, name.title())
        if kind == "mobi":
            made[f"{region}/{key}.azw3"] = _azw3(key, name.title())
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, data in made.items():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"))
        out.write(bytearray(data))
        out.close()
    return path
