"""The record that all extractors give, and running them over a table of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions.text import blank

MOST_ENTRIES = 20_000
#: Rows that are sent back at once, whatever the length of a file.
CHUNK_ROWS = 2_000
COLUMNS = "suffix string, format string, source string, loc string, ref_kind string, line int, start int, stop int, prefix string, tail string, quote string, path array<string>, tokens array<string>, begin_ms double, end_ms double"


@dataclass(slots=True)
class Found:
    """One translatable string: where it is and how to write it back."""

    suffix: str
    format: str
    source: str
    loc: str = ""
    ref_kind: str = ""
    line: int | None = None
    start: int | None = None
    stop: int | None = None
    prefix: str | None = None
    tail: str | None = None
    quote: str | None = None
    path: list[str] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    begin_ms: float | None = None
    end_ms: float | None = None


def entry_id(rel: Column, suffix: Column) -> Column:
    return F.concat(rel, F.lit("#"), suffix)


def extracted(files: DataFrame, extract: Callable[[str, object], Iterable[Found]], content: str = "text") -> DataFrame:
    """ord, id, file, engine and the columns of Found for each string that extract(rel, content) finds.

    A file that cannot be read gives one row whose format is `error` and whose source says why.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    columns = f"ord int, file string, engine string, {COLUMNS}"
    types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, types[kind]) for name, kind in (c.split() for c in columns.split(", "))])
    values = attrgetter(*names)

    def record(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def entries(rel: str, data: object) -> Iterator[Found | str]:
        """What is found, or at last why the file cannot be read."""
        try:
            for f in extract(rel, data):
                if f.source and not f.source.isspace():
                    yield f
        except (ValueError, KeyError, IndexError, TypeError, RecursionError) as e:
            yield f"{type(e).__name__}: {e}"

    def run(batches):
        rows = []
        for batch in batches:
            for rel, engine, data in zip(*batch.columns, strict=True):
                rel, engine, data = rel.as_py(), engine.as_py(), data.as_py()
                if data is None:
                    continue
                # A file's entries wait in packed runs until all of it is read.
                runs, own, n = [], [], 0
                for f in entries(rel, data):
                    if isinstance(f, str):
                        runs, own, n, f = [], [], 0, Found("error", "error", f)
                    own.append((n, rel, engine, *values(f)))
                    n += 1
                    if len(own) == CHUNK_ROWS:
                        runs.append(record(own))
                        own = []
                yield from runs
                for row in own:
                    rows.append(row)
                    if len(rows) == CHUNK_ROWS:
                        yield record(rows)
                        rows = []
        if rows:
            yield record(rows)

    got = files.select("rel", "engine", content).mapInArrow(run, columns)
    return got.withColumn("id", entry_id(F.col("file"), F.col("suffix")))


def capped(entries: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """The first `most` non-blank entries in the order of file and ord."""
    return entries.where(~blank(F.col("source"))).orderBy("file", "ord").limit(most)


def per_file(entries: DataFrame) -> DataFrame:
    return entries.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def siblings(entries: DataFrame, most: int = 12) -> DataFrame:
    """id and labels: up to `most` other distinct labels of the same folder, first ones first.

    entries: (id, folder, ord, source). One aggregate a folder, not a join of the folder with itself.
    """
    named = entries.withColumn("label", F.trim("source")).where(F.col("label") != "")
    first = named.groupBy("folder", "label").agg(F.min(F.struct("ord", "id")).alias("at"))
    # One more than needed: an entry's own label is taken out below.
    w = Window.partitionBy("folder").orderBy("at")
    kept = first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most + 1)
    lists = kept.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("all"))
    own = F.filter(F.transform("all", lambda x: x.label), lambda x: x != F.trim("source"))
    return entries.join(lists, "folder", "left").select("id", F.coalesce(F.slice(own, 1, most), F.array().cast("array<string>")).alias("labels"))
