"""Repeated passages of bytes, by a distributed difference-cover suffix array.

Super-k-mers (see repeats.py) bring all windows with the same minimiser into one bucket, so that each bucket
sorts its suffixes alone: triples at the positions 1 and 2 modulo 3 are sorted and named, the names are
sorted by recursion, the remaining suffixes are merged in, and windows are equal where neighbours in the
suffix order have the same first hundred bytes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.repeats import MARKS, Strings, Unit, marked_runs, often, removed_units, repeated
from lexiflow.session import table

BYTES = Unit(words=False, window=100, k=12)
#: Bytes whose suffixes are sorted together, if no single minimiser has more.
SORT_BYTES = 1 << 20


def names(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of rows of small non-negative integers."""
    key, room = columns[0].astype(np.uint64), 64 - int(columns[0].max(initial=0)).bit_length()
    for c in columns[1:]:
        bits = int(c.max(initial=0)).bit_length()
        if bits > room:  # too wide for one word: rank what there is first
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
            room = 64 - len(key).bit_length()
        key = key << np.uint64(bits) | c.astype(np.uint64)
        room -= bits
    order = np.argsort(key)
    ranks = np.empty(len(key), np.int64)
    ranks[order] = np.cumsum(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    return ranks


def suffix_order(s: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of s (non-negative integers) in order; an end comes before any symbol."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    p = np.concatenate((s.astype(np.int64) + 1, np.zeros(3, np.int64)))
    one, two, rest = (np.arange(k, n, 3) for k in (1, 2, 0))
    sample = np.concatenate((one, two))
    name = names(p[sample], p[sample + 1], p[sample + 2])
    if name.max() < len(sample):
        # The names of one residue after the other; the 0 between them ends the first sequence.
        below = suffix_order(np.concatenate((name[: len(one)], [0], name[len(one) :])))
        at = np.concatenate((one, [-1], two))[below]
        sample = at[at >= 0]
    else:
        sample = sample[np.argsort(name)]
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = np.arange(1, len(sample) + 1)
    rest = rest[np.argsort(p[rest] * (n + 1) + rank[rest + 1])]
    # A remaining suffix stands after all sampled ones that are smaller, counted for each residue.
    ones, twos = sample[sample % 3 == 1], sample[sample % 3 == 2]
    low = np.searchsorted(p[ones] * (n + 1) + rank[ones + 1], p[rest] * (n + 1) + rank[rest + 1])
    wide = names(np.concatenate((p[twos], p[rest])), np.concatenate((p[twos + 1], p[rest + 1])), np.concatenate((rank[twos + 2], rank[rest + 2])))
    low = low + np.searchsorted(wide[: len(twos)], wide[len(twos) :])
    out = np.empty(n, np.int64)
    out[np.arange(len(rest)) + low] = rest
    at = np.arange(len(sample))
    out[at + np.searchsorted(low, at, side="right")] = sample
    return out


def same_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether data[a:a+length] == data[b:b+length], eight bytes at a time for the pairs still equal."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    words = padded[:n].copy()
    for k in range(1, 8):
        words |= padded[k : n + k] << np.uint64(8 * k)
    left = np.arange(len(a))
    for at in (length - 8, *range(0, length - 8, 8)):
        left = left[words[a[left] + at] == words[b[left] + at]]
    equal = np.zeros(len(a), bool)
    equal[left] = True
    return equal


def likely(strings: Strings, unit: Unit) -> np.ndarray:
    """Places of the strings that can share a window with another one.

    A window reaches at least half of what it holds beside its minimiser to one side of it, so two strings
    with a common window agree on the minimiser and that half on one side.
    """
    half = (unit.window - unit.k + 1) // 2
    offset = strings.offset.tolist()
    left = [t[o - half : o + unit.k] if o >= half else None for t, o in zip(strings.text, offset, strict=True)]
    right = [t[o : o + unit.k + half] if len(t) - o >= unit.k + half else None for t, o in zip(strings.text, offset, strict=True)]
    return np.flatnonzero(np.array(often(left), bool) | np.array(often(right), bool))


def in_suffix_order(strings: Strings, unit: Unit) -> list[np.ndarray]:
    """Marks of the windows that also start earlier."""
    at = likely(strings, unit)
    at = at[np.argsort(strings.minimiser[at], kind="stable")]
    sizes = np.cumsum([len(strings.text[i]) + 1 for i in at.tolist()])
    cuts = np.flatnonzero(np.diff(strings.minimiser[at])) + 1 if len(at) else np.zeros(0, np.int64)
    marks, begin, done = [], 0, 0
    for k, end in enumerate([*cuts.tolist(), len(at)]):
        following = cuts[k + 1] if k + 1 < len(cuts) else len(at)
        if end == len(at) or sizes[following - 1] - done > SORT_BYTES:
            if end > begin:
                marks.append(equal_windows(strings.take(np.sort(at[begin:end])), unit))
                begin, done = end, sizes[end - 1]
    return [np.concatenate([m[i] for m in marks]) if marks else np.zeros(0, np.int64) for i in range(len(MARKS))]


def equal_windows(strings: Strings, unit: Unit) -> list[np.ndarray]:
    text = b"\0".join(strings.text)
    data = np.frombuffer(text, np.uint8)
    # 0 stands between strings, so that no common prefix is followed by it by chance.
    lengths = np.array([len(t) for t in strings.text], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    symbols = data.astype(np.int64) + 1
    symbols[starts[1:] - 1] = 0
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)[: len(data)]
    nth = np.arange(len(data)) - starts[owner]
    order = suffix_order(symbols)
    order = order[nth[order] + unit.window <= lengths[owner[order]]]
    equal = same_prefix(data, order[:-1], order[1:], unit.window)
    heads = np.flatnonzero(np.concatenate(([True], ~equal)))
    lead = np.repeat(np.minimum.reduceat(order, heads), np.diff(np.concatenate((heads, [len(order)]))))
    place = strings.start[owner] + nth
    doc = strings.row()[owner]
    later = np.sort(order[(doc[order] != doc[lead]) | (place[order] != place[lead])])
    return marked_runs(strings, owner[later], nth[later], unit)


def dedup_bytes(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """doc_id, n, ranges and kept for each row of docs: its UTF-8 bytes, the ranges {a, b} of removed ones, and the others.

    Each byte in a string of a hundred bytes that also starts earlier (smaller doc_id, or the same document
    further up) is removed. Null texts are empty; texts of under a hundred bytes lose nothing. A null doc_id
    comes after all others. Rows that share a doc_id, or have none, are documents of their own, which follow
    each other by hashes of their texts; of equal rows one comes before the others. Extra columns are
    ignored; an empty table gives an empty result.
    """
    return repeated(docs, unit, in_suffix_order)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        removed_units().alias("n_removed"),
        F.size("ranges").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP8_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS k
  FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM d WHERE length(h) >= 200)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w) WHERE n > 1
), s AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM r),
g AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
u AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM u),
k AS (
  SELECT doc_id, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept, max(b) AS last, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS m
  FROM e JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(m, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
