"""ZIP containers in a binary column: members as rows, e-books in reading order, and packing."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.extract.markup import attribute, chapters
from lexiflow.functions.encoding import decode

MEMBERS = "path string, name string, idx int, size long, method string, crc long, data binary, error string"
SCHEMA = pa.schema([("path", pa.string()), ("name", pa.string()), ("idx", pa.int32()), ("size", pa.int64()), ("method", pa.string()), ("crc", pa.int64()), ("data", pa.binary()), ("error", pa.string())])
#: Members that are sent back at once, whatever the length of an archive.
CHUNK_ROWS = 1_000


def safe(name: str) -> bool:
    """Whether a member name stays below the folder it is put into."""
    clean = posixpath.normpath(name.replace("\\", "/"))
    return bool(name) and not clean.startswith(("/", "../")) and clean != ".." and not re.match(r"^[A-Za-z]:", clean)


def members_of(path: str, content: bytes) -> Iterator[tuple]:
    """Rows of MEMBERS, one by one; one that cannot be read has an error and no data."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for i, info in enumerate(z.infolist()):
                if info.is_dir():
                    continue
                data, error = None, None
                try:
                    if not safe(info.filename):
                        raise ValueError("unsafe name")
                    data = z.read(info)
                except (ValueError, RuntimeError, zipfile.BadZipFile, NotImplementedError) as e:
                    error = str(e)
                method = {0: "store", 8: "deflate"}.get(info.compress_type, str(info.compress_type))
                yield path, info.filename, i, info.file_size, method, info.CRC, data, error
    except zipfile.BadZipFile as e:
        yield path, "", -1, 0, "", 0, None, str(e)


def members(archives: DataFrame) -> DataFrame:
    """One row for each member of each archive (path, content)."""

    def run(batches):
        for batch in batches:
            for path, content in zip(*batch.columns, strict=True):
                for rows in batched(members_of(path.as_py(), content.as_py()) if content.is_valid else (), CHUNK_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return archives.select("path", "content").mapInArrow(run, MEMBERS)


def pages(rows: DataFrame, natural: Column, extensions: tuple[str, ...], most: int | None) -> DataFrame:
    """Image members of each archive in natural order, numbered from 0, at most `most` in all; all of them without it."""
    from pyspark.sql import Window

    image = rows.where(F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).isin(*extensions))
    numbered = image.withColumn("page", F.row_number().over(Window.partitionBy("path").orderBy(natural, "name")) - 1)
    return numbered if most is None else numbered.orderBy("path", "page").limit(most)


def targets(files: DataFrame, image_pages: DataFrame, most: int | None = 40) -> DataFrame:
    """file, page and page_entry of what is to be read: images (rel, kind), then archive pages (path, name, page), at most `most`.

    Without it all of them, in no order."""
    images = files.where("kind = 'image'").select(F.col("rel").alias("file"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("page_entry"))
    both = images.union(image_pages.select("path", "page", "name"))
    return both if most is None else both.orderBy(F.col("page").isNotNull(), "file", "page").limit(most)


def pack(rows: list[tuple[str, bytes]]) -> bytes:
    """An archive in the order of names, `mimetype` first and stored as it is."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted(rows, key=lambda r: (r[0] != "mimetype", r[0])):
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    return out.getvalue()


def replaced(content: bytes, new: dict[str, bytes]) -> bytes:
    """An archive with some members replaced; order and methods stay, and so do all other members."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as z:
        for info in old.infolist():
            z.writestr(info, new.get(info.filename, old.read(info)), compress_type=info.compress_type)
    return out.getvalue()


def reading_order(parts: dict[str, bytes]) -> list[str]:
    """Names of an e-book's chapters: its spine, or else all content documents of its manifest, each once."""
    container = parts.get("META-INF/container.xml", b"").decode("utf-8", "replace")
    rootfile = re.search(r"<rootfile\b[^>]*>", container, re.I)
    opf = attribute(rootfile[0], "full-path") if rootfile else None
    if opf not in parts:
        opf = next((n for n in sorted(parts) if n.lower().endswith(".opf")), None)
    if opf is None:
        return []
    return [name for name in dict.fromkeys(chapters(parts[opf].decode("utf-8", "replace"), opf)) if name in parts]


CHAPTERS = "path string, chapter int, name string, text string"


def book_chapters(books: DataFrame) -> DataFrame:
    """CHAPTERS of e-books (path, content) in reading order; a book that cannot be opened has none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                parts = {m[1]: m[6] for m in (members_of(path, bytes(content)) if content is not None else []) if m[6] is not None}
                rows += [(path, n, name, decode(parts[name])[0]) for n, name in enumerate(reading_order(parts))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHAPTERS.split(", ")])

    return books.select("path", "content").mapInPandas(run, CHAPTERS)
