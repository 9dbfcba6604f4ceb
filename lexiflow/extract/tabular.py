"""Delimited tables and message catalogues."""

from __future__ import annotations

import csv
import io
import re

from lexiflow.extract.rows import Found

# Header names of the column of texts and of the column of keys.
SOURCE_NAMES = frozenset({"source", "text", "原文", "english", "en", "value", "string", "msgid"})
KEY_NAMES = frozenset({"key", "id", "键"})


def delimiter(text: str) -> str:
    head = re.split(r"\r?\n", text, maxsplit=1)[0]
    return max(",;\t", key=head.count)


def table(text: str) -> list[list[str]]:
    return list(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text)))


def written(rows: list[list[str]], by: str) -> str:
    """Rows as text; a cell is quoted only if it holds the delimiter, a quote or a line end."""

    def cell(value: str) -> str:
        return '"' + value.replace('"', '""') + '"' if re.search(rf'[{re.escape(by)}"\n]', value) else value

    return "\n".join(by.join(map(cell, row)) for row in rows)


def columns(header: list[str]) -> tuple[int, int]:
    """(column of texts, column of keys): the last ones named so, else the second and the first."""
    names = [h.strip().lower() for h in header]
    source = max((i for i, h in enumerate(names) if h in SOURCE_NAMES), default=1)
    return source, max((i for i, h in enumerate(names) if h in KEY_NAMES), default=0)


def csv_entries(rel: str, text: str) -> list[Found]:
    rows = table(text)
    if not rows:
        return []
    source, key = columns(rows[0])
    out = []
    for r, row in enumerate(rows[1:], 1):
        if source < len(row) and row[source].strip():
            name = row[key] if key < len(row) and row[key] else f"row{r}"
            out.append(Found(name, "csv", row[source], f"row{r}.col{source}", "cell", r, source))
    return out


ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


def unescaped(text: str) -> str:
    return re.sub(r'\\([ntr"\\])', lambda m: ESCAPES[m[1]], text)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\r", "").replace("\n", "\\n").replace("\t", "\\t")


def blocks(text: str) -> list[str]:
    return re.split(r"\r?\n\r?\n", text)


def fields(block: str) -> dict[str, str]:
    """msgctxt, msgid and msgstr of a block; a quoted line goes on with the field above it."""
    out: dict[str, str] = {}
    name = None
    for line in re.split(r"\r?\n", block):
        match = re.match(r'(?:(msgctxt|msgid|msgstr)\s+|\s*)"(.*?)"?\s*$', line)
        if not match:
            continue
        name = match[1] or name
        if name:
            out[name] = out.get(name, "") + unescaped(match[2])
    return out


def po_entries(rel: str, text: str) -> list[Found]:
    out = []
    for n, block in enumerate(blocks(text)):
        got = fields(block)
        if got.get("msgid"):
            suffix = (got["msgctxt"] + "|" if got.get("msgctxt") else "") + got["msgid"][:40]
            out.append(Found(suffix, "po", got["msgid"], f"block{n}", "block", n, prefix=got.get("msgstr", "")))
    return out


def po_patched(block: str, target: str) -> str:
    """A block with msgstr, over all its lines, replaced."""
    new, held, skip = f'msgstr "{escaped(target)}"', [], False
    for line in block.split("\n"):
        if line.startswith("msgstr"):
            held.append(new + ("\r" if line.endswith("\r") else ""))
            skip = True
        elif not (skip and re.match(r'\s*"', line)):
            skip = False
            held.append(line)
    return "\n".join(held if any(h.startswith("msgstr") for h in held) else [*held, new])
