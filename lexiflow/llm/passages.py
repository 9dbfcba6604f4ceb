"""Repeated passages of words, by super-k-mer partitioning: see repeats.py.

In a bucket, windows are sorted by a hash of their words. Each is compared with the first of its equals on
the text itself, in runs of consecutive windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.arrow import Rolling, word_spans
from lexiflow.llm.repeats import Strings, Unit, marked_runs, removed_units, repeated, repeated_minimisers
from lexiflow.session import table

WORDS = Unit(words=True, window=20, k=3)


def sorted_windows(strings: Strings, unit: Unit) -> list[np.ndarray]:
    """Marks of the windows that also start earlier."""
    strings = strings.take(repeated_minimisers(strings))
    if not strings.text:
        return marked_runs(strings, np.zeros(0, np.int64), np.zeros(0, np.int64), unit)
    text = b"\n".join(strings.text)
    data = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(data)
    edges = np.cumsum([0, *(len(t) + 1 for t in strings.text)])
    first = np.searchsorted(starts, edges)
    owner = np.repeat(np.arange(len(strings.text)), np.diff(first) - unit.window + 1)
    at = np.arange(len(owner)) + owner * (unit.window - 1)  # the first word of each window
    key = Rolling(Rolling(data.astype(np.uint64) + np.uint64(1)).ranges(starts, ends)).ranges(at, at + unit.window)
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    lead = np.empty(len(order), np.int64)
    lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.flatnonzero(lead != np.arange(len(lead)))
    if not same_text(text, starts, ends, at, owner, later, lead, unit.window):
        lead = by_text(text, starts, ends, at, unit.window)
        later = np.flatnonzero(lead != np.arange(len(lead)))
    nth = at - first[owner]
    place = strings.start[owner] + nth
    doc = strings.row()[owner]
    later = later[(doc[later] != doc[lead[later]]) | (place[later] != place[lead[later]])]
    return marked_runs(strings, owner[later], nth[later], unit)


def same_text(text: bytes, starts, ends, at, owner, later, lead, window: int) -> bool:
    """Whether each window of `later` has the words of its lead; consecutive pairs are compared as one range."""
    if not len(later):
        return True
    to = lead[later]
    new = np.concatenate(
        ([True], (later[1:] != later[:-1] + 1) | (to[1:] != to[:-1] + 1) | (owner[later[1:]] != owner[later[:-1]]) | (owner[to[1:]] != owner[to[:-1]]))
    )
    head = np.flatnonzero(new)
    tail = np.concatenate((head[1:], [len(later)])) - 1
    spans = (starts[at[x[head]]].tolist() for x in (later, to)), (ends[at[x[tail]] + window - 1].tolist() for x in (later, to))
    (a, c), (b, d) = spans
    return all(text[i:j] == text[k:m] for i, j, k, m in zip(a, b, c, d, strict=True))


def by_text(text: bytes, starts, ends, at, window: int) -> np.ndarray:
    """The first equal of each window without hashes; for the case that two texts share one."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(text[starts[a] : ends[a + window - 1]], i) for i, a in enumerate(at.tolist())], np.int64)


def dedup_passages(docs: DataFrame, unit: Unit = WORDS) -> DataFrame:
    """doc_id, n, ranges and kept for each row of docs: its words, the ranges {a, b} of removed ones, and the
    others joined by one space (UTF-8).

    Each word in a window of twenty words that also starts earlier (smaller doc_id, or the same document
    further up) is removed. Null, empty and short texts lose nothing. A null doc_id comes after all others.
    Rows that share a doc_id, or have none, are documents of their own, which follow each other by hashes of
    their texts; of equal rows one comes before the others. Extra columns are ignored; an empty table gives
    an empty result.
    """
    return repeated(docs, unit, sorted_windows)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("n").alias("n_words"), removed_units().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1
), h AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS p FROM r
), p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d),
k AS (
  SELECT p.doc_id, string_agg(w[p.p], ' ' ORDER BY p.p) AS kept FROM p LEFT JOIN h ON h.doc_id = p.doc_id AND h.p = p.p WHERE h.p IS NULL GROUP BY p.doc_id
), c AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
