"""Choosing the extractor of a file, and keeping the table of entries up to date."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.extract import marshal, scripts, structured, subtitles, tabular
from lexiflow.extract.markup import text_nodes
from lexiflow.extract.plain import ini_entries, txt_entries, yaml_entries
from lexiflow.extract.rows import Found, extracted
from lexiflow.sources.files import MOST_BINARY_BYTES


def html_entries(rel: str, text: str) -> list[Found]:
    return [Found(f"t{n}", "html", x.text, x.tag, "htmlchars", start=x.start, stop=x.end) for n, x in enumerate(text_nodes(text))]


BY_EXTENSION = {
    "json": structured.json_entries,
    "csv": tabular.csv_entries,
    "tsv": tabular.csv_entries,
    "po": tabular.po_entries,
    "pot": tabular.po_entries,
    **dict.fromkeys(("html", "htm", "xhtml", "xht"), html_entries),
    **dict.fromkeys(("srt", "vtt", "ass", "ssa", "lrc", "sub", "smi"), subtitles.subtitle_entries),
}
AFFIX = {"txt": ("txt", txt_entries), "ini": ("ini", ini_entries), "yaml": ("yaml", yaml_entries), "yml": ("yaml", yaml_entries)}
SPAN = {"rpy": ("renpy", scripts.renpy_entries), "ks": ("krkr-ks", scripts.ks_entries), "scn": ("krkr-ks", scripts.ks_entries), "tjs": ("krkr-tjs", scripts.tjs_entries)}
RUBY = ("rxdata", "rvdata", "rvdata2")


def by_extension(rel: str, text: str) -> Iterable[Found]:
    return BY_EXTENSION[rel.rsplit(".", 1)[-1].lower()](rel, text)


def parse_texts(files: DataFrame) -> DataFrame:
    """Entries of decoded files (rel, ext, engine, text): line formats as columns, the others in batches of files."""
    parts = [extracted(files.where(F.col("ext").isin(*BY_EXTENSION)), by_extension)]
    common = [F.col("rel").alias("file"), "engine", "suffix", "source", "line", F.concat("rel", F.lit("#"), "suffix").alias("id")]
    for ext, (name, reader) in AFFIX.items():
        got = reader(files.where(F.col("ext") == ext), "rel", "engine")
        parts.append(got.select(*common, F.lit(name).alias("format"), F.lit("affix").alias("ref_kind"), F.col("suffix").alias("loc"), F.col("line").cast("long").alias("ord"), "prefix", "tail"))
    for ext, (name, reader) in SPAN.items():
        got = reader(files.where(F.col("ext") == ext), "rel", "engine")
        # In the order of lines, and in a line of places.
        order = F.shiftleft(F.col("line").cast("long"), 20) + F.col("start")
        loc = F.when(F.col("suffix").rlike(r"\.[0-9]+$"), F.regexp_extract("suffix", r"^line[0-9]+", 0)).otherwise(F.col("suffix"))
        parts.append(got.select(*common, F.lit(name).alias("format"), F.lit("span").alias("ref_kind"), loc.alias("loc"), order.alias("ord"), "start", "stop", "quote"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def parse_binaries(files: DataFrame, most: int = MOST_BINARY_BYTES) -> DataFrame:
    """Entries of Marshal files (rel, ext, engine, content) of at most so many bytes."""
    return extracted(files.where(F.col("ext").isin(*RUBY) & (F.octet_length("content") <= most)), marshal.marshal_entries, "content")


def replaced_by_file(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """old without the entries of `files` (file), plus new: other files keep what they had."""
    return old.join(files.select("file").distinct(), "file", "left_anti").unionByName(new, allowMissingColumns=True)


def pruned(translations: DataFrame, entries: DataFrame) -> DataFrame:
    """Translations whose entry still exists."""
    return translations.join(entries.select("id").distinct(), "id", "left_semi")
