"""Bytes to text and back in legacy character sets, batch by batch."""

from __future__ import annotations

import codecs
import itertools
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tried in this order where nothing else tells; each strictly, so that the first that fits is meant.
CANDIDATES = ("utf-8", "shift_jis", "gbk", "latin-1")
MARKS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode(data: bytes, hint: str | None = None) -> tuple[str, str, bool]:
    """(text, encoding, had a byte-order mark)."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name, True
    for name in ("utf-8", *([hint] if hint else ()), *CANDIDATES[1:]):
        try:
            return data.decode(name), name, False
        except (UnicodeDecodeError, LookupError):
            continue
    return data.decode("latin-1"), "latin-1", False


def encode(text: str, encoding: str, mark: bool = False) -> bytes:
    """text in an encoding, with its own byte-order mark if asked; what it cannot hold becomes a question mark."""
    start = next((m for m, name in MARKS if name == encoding), b"") if mark else b""
    return start + text.encode(encoding, "replace")


def decoded(content: Column, hint: Column | None = None) -> Column:
    """struct(text, encoding, bom) of a binary column.

    Without a hint it takes one argument only, so that Spark runs it in the worker of the function below it.
    """

    def rows(data: pa.Array, hints: Iterable[str | None]) -> pa.Array:
        found = [decode(d.as_py(), h) if d.is_valid else (None, None, None) for d, h in zip(data, hints, strict=False)]
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_()), strict=True)], ["text", "encoding", "bom"])

    @F.arrow_udf("text string, encoding string, bom boolean")
    def plain(data: pa.Array) -> pa.Array:
        return rows(data, itertools.repeat(None))

    @F.arrow_udf("text string, encoding string, bom boolean")
    def hinted(data: pa.Array, hints: pa.Array) -> pa.Array:
        return rows(data, hints.to_pylist())

    return plain(content) if hint is None else hinted(content, hint)


def encoded(text: Column, encoding: Column, mark: Column) -> Column:
    """Bytes of a string column in the encoding that stands beside it."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array, names: pa.Array, marks: pa.Array) -> pa.Array:
        each = zip(texts, names.to_pylist(), marks.to_pylist(), strict=True)
        return pa.array([encode(t.as_py(), n or "utf-8", bool(m)) if t.is_valid else None for t, n, m in each], pa.binary())

    return run(text, encoding, mark)
