"""Helpers for code that runs on Arrow batches inside the executors."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import SparkSession

#: Bytes of text worked on at once in one Python worker.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch, where the session does not say otherwise: whole documents are large rows.
BATCH_ROWS, BATCH_CONF = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A-Z to a-z; all ASCII but letters and digits to a blank; other bytes stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: A-Z to a-z; other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it the session hands texts to Python in batches of BATCH_ROWS rows, unless it has a number set."""
    conf = spark.conf
    if conf.get(BATCH_CONF, None) is not None:
        yield
        return
    conf.set(BATCH_CONF, str(BATCH_ROWS))
    try:
        yield
    finally:
        conf.unset(BATCH_CONF)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of a string column as UTF-8."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of batch with about `limit` bytes of text; a longer text stands alone."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    ends = np.cumsum(lengths.astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(i, j - i)
        i = j
    pa.default_memory_pool().release_unused()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Odd bases of the polynomial hashes modulo 2**64, with their inverses.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls and grown by doubling."""
    have = _powers.get((base, 0))
    if have is None or len(have) <= n:
        size = 1 << max(16, int(n + 1).bit_length())
        have = np.ones(size, np.uint64)
        have[1:] = base & 0xFFFFFFFFFFFFFFFF
        np.multiply.accumulate(have, out=have)
        _powers[(base, 0)] = have
    return have[: n + 1]


class Rolling:
    """Hashes of any ranges of a sequence of uint64 symbols, from one running sum."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        n = len(symbols)
        self.inverse = pow(base, -1, 1 << 64)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(symbols.astype(np.uint64) * powers(base, n)[:n] if n else symbols.astype(np.uint64), out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash for each [start, end): equal symbols give equal hashes."""
        top = int(start.max(initial=0))
        return mixed((self.sums[end] - self.sums[start]) * powers(self.inverse, top)[start])


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` of a byte array."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
