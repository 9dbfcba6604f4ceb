"""Fixed-length windows that also start earlier: super-k-mers in, removed ranges out.

Shared by the operators on repeated passages of words and of bytes. Consecutive windows of a document with
the same minimiser travel as one packed string, the super-k-mer, to the bucket of that minimiser; equal
windows share their minimiser, so each bucket decides alone. Before they travel, equal strings of one block
of documents are reduced to the earliest; the others are known to repeat it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.arrow import Rolling, record, slices, utf8, word_spans

#: Bytes of super-k-mers that are packed together; they are cut from CHUNK_BYTES of text at a time.
BLOCK_BYTES = 24 << 20
#: Level at which the strings of a bucket are compressed for the way.
ZSTD_LEVEL = 5
#: Bits of a key that hold the place of a k-mer; the rest is its hash.
PLACE_BITS = 28
#: Bytes of text for each bucket, so that what one task sorts does not grow with the corpus.
BUCKET_BYTES = 16 << 20
#: Equal rows that are given back at once.
COPIES = 10_000
#: Stands for a null doc_id, which comes after all others.
LAST = (1 << 63) - 1


@dataclass(frozen=True)
class Unit:
    """What windows are made of."""

    words: bool
    window: int
    k: int

    def canonical(self, text: bytes | None) -> bytes:
        text = text or b""
        return b" ".join(text.split()) if self.words else text

    def minimiser(self, text: bytes, offset: int) -> bytes:
        """The k units of a string that begin at a byte."""
        return b" ".join(text[offset:].split(b" ", self.k)[: self.k]) if self.words else text[offset : offset + self.k]

    def without(self, text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]], bytes]:
        """The number of units of a text, the ranges and what is left of it; words are joined by one space."""
        units = text.split() if self.words else text
        kept, at = [], 0
        for a, b in ranges:
            kept.append(units[at:a])
            at = b
        kept.append(units[at:])
        return len(units), ranges, b" ".join([w for part in kept for w in part]) if self.words else b"".join(kept)

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the units of a byte array start and end."""
        return word_spans(data) if self.words else (np.arange(len(data)), np.arange(1, len(data) + 1))


#: What names a row: its doc_id and, where doc_ids do not tell all rows apart, two hashes of its text.
KEY = ("doc", "v", "w")


@dataclass
class Strings:
    """Super-k-mers in the order of their rows; start counts units, offset the bytes before the minimiser."""

    doc: np.ndarray
    v: np.ndarray
    w: np.ndarray
    start: np.ndarray
    minimiser: np.ndarray
    offset: np.ndarray
    text: list[bytes]

    def take(self, at: np.ndarray) -> Strings:
        return Strings(*(getattr(self, c)[at] for c in (*KEY, "start", "minimiser", "offset")), [self.text[i] for i in at.tolist()])

    def in_order(self) -> Strings:
        return self.take(np.lexsort((self.start, self.w, self.v, self.doc)))

    def row(self) -> np.ndarray:
        """A number for each string's row; the strings are in order."""
        return np.cumsum(np.concatenate(([False], np.any([(x := getattr(self, c))[1:] != x[:-1] for c in KEY], axis=0)))) if self.text else np.zeros(0, np.int64)


COLUMNS = (("doc", np.int64), ("v", np.int64), ("w", np.int64), ("start", np.int32), ("offset", np.int32), ("length", np.int32))
#: Of these, neighbours mostly differ by little.
STEADY = (*KEY, "start")
MARKS = (("doc", np.int64), ("v", np.int64), ("w", np.int64), ("a", np.int32), ("b", np.int32))


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=ZSTD_LEVEL).compress(raw, asbytes=True)


def restored(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def packed(strings: Strings, marks: list[np.ndarray]) -> bytes:
    """One compressed blob: counts, columns, marks already known, and the text."""
    arrays = [strings.doc, strings.v, strings.w, strings.start, strings.offset, np.array([len(t) for t in strings.text])]
    body = [np.array([len(strings.text), len(marks[0])], np.int64).tobytes()]
    for (name, kind), x in zip(COLUMNS, arrays, strict=True):
        x = x.astype(kind)
        body.append((np.diff(x, prepend=kind(0)) if name in STEADY else x).tobytes())
    body += [x.astype(kind).tobytes() for (_, kind), x in zip(MARKS, marks, strict=True)]
    return squeezed(b"".join([*body, *strings.text]))


def unpacked(blob: bytes, unit: Unit) -> tuple[Strings, list[np.ndarray]]:
    raw = restored(blob)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at, got, marks = 16, {}, []
    for name, kind in COLUMNS:
        x = np.frombuffer(raw, kind, n, at)
        got[name] = np.cumsum(x, dtype=kind) if name in STEADY else x
        at += x.nbytes
    for _, kind in MARKS:
        marks.append(np.frombuffer(raw, kind, m, at))
        at += marks[-1].nbytes
    ends = at + np.cumsum(got.pop("length"), dtype=np.int64)
    edges = [at, *ends.tolist()]
    text = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    # Only equality of minimisers matters from here on, and only inside this process.
    minimiser = np.array([hash(unit.minimiser(t, o)) for t, o in zip(text, got["offset"].tolist(), strict=True)], np.int64)
    return Strings(**got, minimiser=minimiser, text=text), marks


def joined(parts: list[Strings]) -> Strings:
    columns = [np.concatenate([getattr(s, c) for s in parts]) for c in (*KEY, "start", "minimiser", "offset")]
    return Strings(*columns, [t for s in parts for t in s.text])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return x if span == width else np.minimum(x[: len(x) - (width - span)], x[width - span :])


def cut(keys: list[np.ndarray], texts: list[bytes], unit: Unit) -> Strings:
    """The super-k-mers of whole rows, whose doc, v and w are in keys."""
    joined = b"\n".join(texts)
    data = np.frombuffer(joined, np.uint8)
    starts, ends = unit.spans(data)
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, edges[:-1])  # of each document's units
    last = np.searchsorted(starts, edges[:-1] + np.array([len(t) for t in texts], np.int64))
    symbols = data.astype(np.uint64) + np.uint64(1)
    if unit.words:
        symbols = Rolling(symbols).ranges(starts, ends)
    n = len(starts)
    empty = np.zeros(0, np.int64)
    if n < unit.window:
        return Strings(*[empty] * 6, [])
    at = np.arange(n - unit.k + 1)
    hashes = Rolling(symbols).ranges(at, at + unit.k)
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((hashes & ~place) | (at.astype(np.uint64) & place), unit.window - unit.k + 1)
    windows = np.arange(len(least))
    owner = np.repeat(np.arange(len(texts)), last - first) if not unit.words else np.searchsorted(first, windows, side="right") - 1
    owner = np.searchsorted(edges, starts[windows], side="right") - 1 if not unit.words else owner
    inside = windows + unit.window <= last[owner]
    windows, owner, least = windows[inside], owner[inside], least[inside]
    if not len(windows):
        return Strings(*[empty] * 6, [])
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (windows[1:] != windows[:-1] + 1)))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(windows)])) - 1
    a, b = windows[head], windows[tail] + unit.window
    who = owner[head]
    lead = (least[head] & place).astype(np.int64)
    lead += (a - lead) & ~np.int64(place) if n > place else 0
    begin, end = starts[a], ends[b - 1]
    text = [joined[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)]
    return Strings(*(k[who] for k in keys), a - first[who], (least[head] >> np.uint64(PLACE_BITS)).astype(np.int64), starts[lead] - begin, text)


def earliest(strings: Strings) -> tuple[np.ndarray, np.ndarray]:
    """Places of the strings that no earlier one equals, and of those that an earlier one equals.

    strings are in order. What stands at one place twice is of equal rows and is given once.
    """
    seen: dict[bytes, int] = {}
    row, start = strings.row().tolist(), strings.start.tolist()
    keep, again = [], []
    for i, t in enumerate(strings.text):
        k = seen.setdefault(t, i)
        if k == i:
            keep.append(i)
        elif (row[k], start[k]) != (row[i], start[i]):
            again.append(i)
    return np.array(keep, np.int64), np.array(again, np.int64)


def whole(strings: Strings, at: np.ndarray, unit: Unit) -> list[np.ndarray]:
    """Marks over all units of the strings at these places."""
    n = np.array([strings.text[i].count(b" ") + 1 if unit.words else len(strings.text[i]) for i in at.tolist()], np.int64)
    return [*(getattr(strings, c)[at] for c in KEY), strings.start[at], strings.start[at] + n]


def marked_runs(strings: Strings, owner: np.ndarray, nth: np.ndarray, unit: Unit) -> list[np.ndarray]:
    """Marks for flagged windows: the string of each and its number there, in rising order."""
    if not len(owner):
        return [np.zeros(0, np.int64)] * len(MARKS)
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (nth[1:] != nth[:-1] + 1)))
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(owner)])) - 1
    s = owner[head]
    return [*(getattr(strings, c)[s] for c in KEY), strings.start[s] + nth[head], strings.start[s] + nth[tail] + unit.window]


def repeated_minimisers(strings: Strings) -> np.ndarray:
    """Places of strings whose minimiser another one has."""
    _, inverse, n = np.unique(strings.minimiser, return_inverse=True, return_counts=True)
    return np.flatnonzero(n[inverse] > 1)


def super_kmers(docs: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """(bucket, blob): the packed super-k-mers of docs (doc, v, w, text)."""
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def blobs(parts: list[Strings]):
        strings = joined(parts).in_order()
        keep, again = earliest(strings)
        marks = whole(strings, again, unit)
        mark_bucket = strings.minimiser[again] % buckets
        strings = strings.take(keep)
        bucket = strings.minimiser % buckets
        order, mark_order = np.argsort(bucket, kind="stable"), np.argsort(mark_bucket, kind="stable")
        names = np.union1d(bucket, mark_bucket)
        edges = [np.searchsorted(bucket[order], names, side=s) for s in ("left", "right")]
        mark_edges = [np.searchsorted(mark_bucket[mark_order], names, side=s) for s in ("left", "right")]
        for i in range(0, len(names), 64):
            made = []
            for j in range(i, min(i + 64, len(names))):
                m = mark_order[mark_edges[0][j] : mark_edges[1][j]]
                made.append(packed(strings.take(order[edges[0][j] : edges[1][j]]), [x[m] for x in marks]))
            yield record(schema, names[i : i + 64].astype(np.int32), made)

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            for part in slices(batch):
                keys = [np.asarray(part.column(c)) for c in KEY]
                parts.append(cut(keys, [unit.canonical(t) for t in utf8(part.column("text"))], unit))
                size += sum(map(len, parts[-1].text))
                if size >= BLOCK_BYTES:
                    yield from blobs(parts)
                    parts, size = [], 0
        if size:
            yield from blobs(parts)

    return docs.mapInArrow(run, "bucket int, blob binary")


def measured(docs: DataFrame) -> tuple[int, bool]:
    """Bytes of all texts, and whether every row has a doc_id of its own."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("d")).agg(F.sum(F.octet_length("text").cast("long")).alias("size"), F.count(F.lit(1)).alias("n"))
    size, shared = ids.agg(F.sum("size"), F.count_if((F.col("n") > 1) | F.col("d").isNull())).first()  # one row
    return size or 0, not shared


def repeated(docs: DataFrame, unit: Unit, resolve: Callable[[Strings, Unit], list[np.ndarray]]) -> DataFrame:
    """doc_id, n, ranges and kept for each row of docs, n and ranges (of {a, b}) in units, kept as bytes.

    resolve(strings, unit) marks the windows of one bucket's distinct strings, which are in order, that repeat
    an earlier one. Every row is a document of its own. They follow each other by doc_id, those without one
    last; rows that share a doc_id, or have none, by two hashes of their text. Equal rows are worked on once;
    all but one of them repeat it from their first window to their last.
    """
    size, unique = measured(docs)
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    text = F.coalesce("text", F.lit(""))
    versions = [F.lit(0).cast("long")] * 2 if unique else [F.xxhash64(text), F.xxhash64(F.lit(unit.k), text)]
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), *(x.alias(c) for x, c in zip(versions, KEY[1:], strict=True))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key, "text")
    schema = pa.schema([("doc", pa.int64()), ("v", pa.int64()), ("w", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def run(group: pa.Table) -> pa.Table:
        got = [unpacked(b, unit) for b in group.column("blob").to_pylist()]
        strings = joined([s for s, _ in got])
        marks = [[m[i] for _, m in got] for i in range(len(MARKS))]
        del got
        strings = strings.in_order()
        keep, again = earliest(strings)
        more = [whole(strings, again, unit), resolve(strings.take(keep), unit)]
        columns = [np.concatenate([*x, *(m[i] for m in more)]) for i, x in enumerate(marks)]
        return pa.Table.from_arrays([pa.array(x, f.type, safe=False) for x, f in zip(columns, schema, strict=True)], schema=schema)

    blobs = super_kmers(rows.where(F.col("text").isNotNull()).select(*KEY, "text"), unit, buckets)
    ranges = blobs.groupBy("bucket").applyInArrow(run, "doc long, v long, w long, a int, b int")
    per_row = ranges.groupBy(*(F.col(c).alias(f"_{c}") for c in KEY)).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    # The texts meet their ranges compressed.
    packed_schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in KEY), ("blob", pa.binary())])

    def squeeze(batches):
        for batch in batches:
            for part in slices(batch):
                yield record(packed_schema, *(part.column(c) for c in ("doc_id", *KEY)), [squeezed(t or b"") for t in utf8(part.column("text"))])

    texts = rows.mapInArrow(squeeze, "doc_id long, doc long, v long, w long, blob binary")
    if not unique:  # equal rows travel as one with their number
        texts = texts.groupBy("doc_id", *KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("blob").alias("blob"))
    met = texts.join(per_row, [F.col(c) == F.col(f"_{c}") for c in KEY], "left").select("doc_id", "blob", "ranges", F.lit(1).cast("long").alias("copies") if unique else "copies")
    pair = pa.struct([("a", pa.int32()), ("b", pa.int32())])
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("ranges", pa.list_(pair)), ("kept", pa.binary()), ("copies", pa.int64())])

    def parted(batches):
        for batch in batches:
            for part in slices(batch, "blob"):
                found = [unit.without(restored(b), merged(r)) for b, r in zip(part.column("blob").to_pylist(), part.column("ranges").to_pylist(), strict=True)]
                n, gone, kept = zip(*found, strict=True)
                lists = pa.array([[{"a": a, "b": b} for a, b in r] for r in gone], pa.list_(pair))
                yield record(out, part.column("doc_id"), list(n), lists, list(kept), part.column("copies"))

    cleaned = met.mapInArrow(parted, "doc_id long, n long, ranges array<struct<a:int,b:int>>, kept binary, copies long")
    if unique:
        return cleaned.drop("copies")
    # Many equal rows come back in two steps, so that no array holds all of them.
    step = F.explode(F.sequence(F.lit(0).cast("long"), (F.col("copies") - 1).cast("long"), F.lit(COPIES).cast("long"))).alias("from")
    each = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("copies")) - 1)).alias("copy")
    gone = (F.col("copy") > 0) & (F.col("n") >= unit.window)
    everything = F.array(F.struct(F.lit(0).alias("a"), F.col("n").cast("int").alias("b")))
    return cleaned.select("*", step).select("*", each).select(
        "doc_id",
        "n",
        F.when(gone, everything).otherwise(F.col("ranges")).alias("ranges"),
        F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    """Ranges in order; those that overlap or touch as one."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed_units() -> Column:
    """How many units the ranges of a row of repeated() hold."""
    return F.aggregate("ranges", F.lit(0).cast("long"), lambda t, r: t + r.b - r.a)


def often(keys: list[bytes | None]) -> list[bool]:
    """Which keys stand there more than once; none of None."""
    n = Counter(keys)
    return [k is not None and n[k] > 1 for k in keys]
