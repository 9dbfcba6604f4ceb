"""Translations back into files: patches per file, write-once backups and side files."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.extract import marshal, structured, subtitles, tabular
from lexiflow.extract import markup as html
from lexiflow.functions.encoding import decode, encode
from lexiflow.session import spread
from lexiflow.sources.archives import pack, reading_order, replaced, safe

RESULT = "file string, content binary, applied int, refused int, error string"


def patched_line(raw: Column, prefix: Column, source: Column, tail: Column, target: Column) -> Column:
    """A line with its value replaced, if the value still is what was read; else the line as it is."""
    return F.when(target.isNotNull() & (raw == F.concat(prefix, source, tail)), F.concat(prefix, target, tail)).otherwise(raw)


def patched_lines(lines: DataFrame, patches: DataFrame) -> DataFrame:
    """lines (file, line, raw) with out: patches (file, line, prefix, source, tail, target) applied where they hold."""
    p = patches.select(F.col("file").alias("_f"), F.col("line").alias("_l"), "prefix", "source", "tail", "target")
    joined = lines.join(p, (F.col("file") == F.col("_f")) & (F.col("line") == F.col("_l")), "left")
    return joined.select("file", "line", "raw", patched_line(F.col("raw"), F.col("prefix"), F.col("source"), F.col("tail"), F.col("target")).alias("out"))


def rebuilt(patched: DataFrame, eol: str = "\n") -> DataFrame:
    """file and text from (file, line, out)."""
    return patched.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "out"))), lambda x: x.out), eol).alias("text"))


def _affix(text: str, rows: list[dict]) -> tuple[str, int]:
    lines, done = text.split("\n"), 0
    for r in rows:
        raw = lines[r["line"]] if r["line"] < len(lines) else None
        cr = "\r" if raw is not None and raw.endswith("\r") else ""
        if raw is not None and raw.removesuffix("\r") == f"{r['prefix']}{r['source']}{r['tail']}":
            lines[r["line"]] = f"{r['prefix']}{r['target']}{r['tail']}{cr}"
            done += 1
    return "\n".join(lines), done


def _span(text: str, rows: list[dict]) -> tuple[str, int]:
    lines, done = text.split("\n"), 0
    for r in sorted(rows, key=lambda r: -r["start"]):
        line = lines[r["line"]] if r["line"] < len(lines) else ""
        if line[r["start"] : r["stop"]] == r["source"]:
            lines[r["line"]] = line[: r["start"]] + r["target"] + line[r["stop"] :]
            done += 1
    return "\n".join(lines), done


def _chars(text: str, rows: list[dict]) -> tuple[str, int]:
    held = [r for r in rows if 0 <= r["start"] <= r["stop"] <= len(text)]
    return subtitles.patched(text, [(r["start"], r["stop"], r["target"], list(r["tokens"] if r["tokens"] is not None else []), r["quote"]) for r in held]), len(held)


def _html(text: str, rows: list[dict]) -> tuple[str, int]:
    held = [r for r in rows if html.decoded(text[r["start"] : r["stop"]]) == r["source"]]
    return html.patched(text, [(r["start"], r["stop"], r["target"]) for r in held]), len(held)


def _json(text: str, rows: list[dict]) -> tuple[str, int]:
    data, done = json.loads(text), 0
    for r in rows:
        if structured.read(data, list(r["path"])) == r["source"]:
            structured.write(data, list(r["path"]), r["target"])
            done += 1
    return json.dumps(data, ensure_ascii=False, indent=2), done


def _cell(text: str, rows: list[dict]) -> tuple[str, int]:
    cells, by, done = tabular.table(text), tabular.delimiter(text), 0
    for r in rows:
        if r["line"] < len(cells) and r["start"] < len(cells[r["line"]]) and cells[r["line"]][r["start"]] == r["source"]:
            cells[r["line"]][r["start"]] = r["target"]
            done += 1
    return tabular.written(cells, by) + ("\n" if text.endswith("\n") else ""), done


def _block(text: str, rows: list[dict]) -> tuple[str, int]:
    import re

    pieces, done = re.split(r"(\r?\n\r?\n)", text), 0
    for r in rows:
        at = 2 * r["line"]
        if at < len(pieces) and tabular.fields(pieces[at]).get("msgid") == r["source"]:
            pieces[at] = tabular.po_patched(pieces[at], r["target"])
            done += 1
    return "".join(pieces), done


TEXT_WRITERS: dict[str, Callable[[str, list[dict]], tuple[str, int]]] = {
    "affix": _affix, "span": _span, "chars": _chars, "htmlchars": _html, "json": _json, "cell": _cell, "block": _block,
}


def patched_content(content: bytes, ref_kind: str, rows: list[dict]) -> tuple[bytes, int]:
    """(content with the rows applied, how many held). No row leaves every byte as it is."""
    if not rows:
        return content, 0
    if ref_kind.startswith("rgss"):
        new = marshal.patched(content, [(list(r["path"]), r["source"], r["target"]) for r in rows])
        return new, len(rows)
    text, encoding, mark = decode(content)
    new, done = TEXT_WRITERS[ref_kind](text, rows)
    return encode(new, encoding, mark) if new != text else content, done


def structs(lists: pa.ListArray) -> list[list[dict]]:
    """Lists of structs as Python rows, made field by field: far fewer steps than value by value."""
    flat = lists.flatten()
    each = iter([dict(zip(flat.type.names, values, strict=True)) for values in zip(*(c.to_pylist() for c in flat.flatten()), strict=True)])
    return [[next(each) for _ in range(n or 0)] for n in lists.value_lengths().to_pylist()]


def exported(files: DataFrame, patches: DataFrame) -> DataFrame:
    """RESULT for each file (rel, content) that has patches (file, ref_kind, …, source, target).

    A file's patches are one group; a file that cannot be written keeps its content and has an error.
    """
    columns = ["ref_kind", "line", "start", "stop", "prefix", "tail", "quote", "path", "tokens", "source", "target"]
    grouped = spread(patches, "file", each=8).groupBy("file").agg(F.collect_list(F.struct(*columns)).alias("rows"))
    joined = spread(files.select(F.col("rel").alias("_rel"), "content"), "_rel", each=8).join(grouped, F.col("_rel") == F.col("file"))

    schema = pa.schema([("file", pa.string()), ("content", pa.binary()), ("applied", pa.int32()), ("refused", pa.int32()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for file, content, rows in zip(batch["file"].to_pylist(), batch["content"].to_pylist(), structs(batch["rows"]), strict=True):
                try:
                    new, done = patched_content(content, rows[0]["ref_kind"], rows)
                    out.append((file, new, done, len(rows) - done, None))
                except (ValueError, KeyError, IndexError, TypeError) as e:
                    out.append((file, content, 0, len(rows), f"{type(e).__name__}: {e}"))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return joined.select("file", "content", "rows").mapInArrow(run, RESULT)


def book_exported(content: bytes, patches: dict[str, list[dict]]) -> bytes:
    """An e-book with patches by chapter; all other members stay as they are."""
    from lexiflow.sources.archives import members_of

    parts = {m[1]: m[6] for m in members_of("", content) if m[6] is not None}
    return replaced(content, {name: patched_content(parts[name], "htmlchars", patches[name])[0] for name in reading_order(parts) if name in patches})


def books_exported(books: DataFrame, patches: DataFrame) -> DataFrame:
    """path and content of e-books (path, content) with patches (path, name, start, stop, source, target) by chapter."""
    grouped = patches.groupBy(F.col("path").alias("_path")).agg(F.collect_list(F.struct("name", "start", "stop", "source", "target")).alias("rows"))

    def run(batches):
        for pdf in batches:
            done = []
            for content, rows in zip(pdf["content"], pdf["rows"], strict=True):
                by_name: dict[str, list[dict]] = {}
                for r in rows if rows is not None else ():
                    by_name.setdefault(r["name"], []).append(r)
                done.append(book_exported(bytes(content), by_name))
            yield pd.DataFrame({"path": pdf["path"], "content": done})

    joined = books.join(grouped, F.col("path") == F.col("_path"), "left").select("path", "content", "rows")
    return joined.mapInPandas(run, "path string, content binary")


def packed(rows: DataFrame) -> DataFrame:
    """archive and content from (archive, name, data).

    Archives are dealt once more when packed, so that Python that reads them does not run beside Python that packs.
    """

    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def run(members: pa.Table) -> pa.Table:
        content = pack(list(zip(members["name"].to_pylist(), members["data"].to_pylist(), strict=True)))
        return pa.table([[members["archive"][0].as_py()], [content]], schema=schema)

    made = spread(rows.select("archive", "name", "data"), "archive").groupBy("archive").applyInArrow(run, "archive string, content binary")
    return spread(made, "archive")


def sidecar(results: DataFrame) -> DataFrame:
    """file and text: source and target of each line, by page and line."""
    line = F.concat(F.lit("["), F.col("page"), F.lit(":"), F.col("line"), F.lit("] "), F.col("source"), F.lit("\n"), F.col("target"))
    return results.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", line.alias("s")))), lambda x: x.s), "\n").alias("text"))


OPERATIONS = "id string, file string, page int, step int, op string, box array<double>, text string, size int, fits boolean"


def image_operations(labels: DataFrame) -> DataFrame:
    """OPERATIONS for labels (id, file, page, box, parts array<struct<file, box>>, target): what to wipe and what to draw.

    Parts on the label's own file are wiped with it, parts on other files there; a part outside of the box
    of a label stays. The target is drawn into the box at the largest size at which it fits; an empty one
    only wipes.
    """
    from lexiflow.functions.geometry import inside
    from lexiflow.operators.layout import fit

    part = labels.select("id", "file", "page", "box", F.posexplode(F.coalesce("parts", F.array())).alias("step", "p"))
    near = (F.col("p.file") != F.col("file")) | inside(F.col("p.box"), F.col("box"))
    wiped = part.where(near).select("id", F.col("p.file").alias("file"), "page", "step", F.lit("erase").alias("op"), F.col("p.box").alias("box"), F.lit(None).cast("string").alias("text"))

    @F.pandas_udf("size int, text string, fits boolean")
    def fitted(text: pd.Series, box: pd.Series) -> pd.DataFrame:
        got = [fit(t, b[2], b[3]) for t, b in zip(text, box, strict=True)]
        return pd.DataFrame([(size, "\n".join(lines), ok) for size, lines, ok in got], columns=["size", "text", "fits"])

    drawn = labels.where(F.coalesce(F.col("target"), F.lit("")) != "").withColumn("f", fitted("target", "box"))
    drawn = drawn.select("id", "file", "page", F.coalesce(F.size("parts"), F.lit(0)).alias("step"), F.lit("draw").alias("op"), "box", "f.text", "f.size", "f.fits")
    return wiped.unionByName(drawn, allowMissingColumns=True)


def write_files(results: DataFrame, root: str, backups: str | None = None) -> DataFrame:
    """Write (file, content) below root from the executors; (file, written, saved).

    Files go to a new name of each attempt and are renamed. With backups, what stood there before is kept below
    it, once: a backup is never written again. root and backups must be folders that all executors share. A name
    that would leave root is an error.
    """

    def run(batches):
        import os
        import uuid

        for pdf in batches:
            out = []
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                if not safe(file):
                    raise ValueError(f"{file} is not below the folder")
                path, saved = os.path.join(root, file), False
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                if backups and os.path.exists(path):
                    old = os.path.join(backups, file)
                    os.makedirs(os.path.dirname(old), exist_ok=True)
                    try:
                        with open(path, "rb") as source, open(old, "xb") as kept:
                            kept.write(source.read())
                        saved = True
                    except FileExistsError:
                        pass
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as new:
                    new.write(bytes(content))
                os.replace(part, path)
                out.append((file, len(content), saved))
            yield pd.DataFrame(out, columns=["file", "written", "saved"])

    return results.select("file", "content").mapInPandas(run, "file string, written long, saved boolean")


def save_table(df: DataFrame, path: str) -> None:
    """Persist entries, translations, cache or ledger."""
    df.write.mode("overwrite").parquet(path)


def load_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A persisted table, or an empty one where there is none yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
