"""Licence scans: fixed phrases, and templates compiled into token automata.

In a template, [[...]] is optional wording and {{n}} stands for up to n words of anyone's. All other words
are mandatory and must match exactly; case and punctuation do not count. A template becomes an automaton over
words whose states are sets of positions, made when first reached. Documents are searched for the longest
mandatory run of a template first; only where it occurs does the automaton read.
"""

from __future__ import annotations

import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.arrow import PLAIN, record, slices, small_batches, utf8
from lexiflow.session import checkpoint, table

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Whole licences, headers and notices as plain text; see its README.txt.
TEXTS = Path(__file__).with_name("licence_texts")


def templates_of(folder: Path = TEXTS) -> list[tuple[str, str]]:
    """(template, label) of all files of a folder but README.txt."""
    files = sorted(f for f in folder.glob("*.txt") if f.name != "README.txt")
    return [(t, f.stem) for f in files for t in f.read_text("utf-8").split("\n%%\n")]


class Automaton:
    """A template as a deterministic automaton over words."""

    def __init__(self, template: str):
        self.edges: list[dict] = [{}]
        self.free: list[set[int]] = [set()]  # moves without a word
        self.run: list[bytes] = []
        self.anchor: list[bytes] = []
        tokens = []
        for part in re.split(r"(\[\[|\]\]|\{\{\d+\}\})", template):
            tokens += [part] if part[:2] in ("[[", "]]", "{{") else part.encode().translate(PLAIN).split()
        self.last = self._build(tokens)
        self._longest()
        self.steps: dict[tuple[frozenset, bytes | None], frozenset] = {}
        self.words = {w for e in self.edges for w in e if w is not None}
        self.first = self._close({0})

    def _state(self) -> int:
        self.edges.append({})
        self.free.append(set())
        return len(self.edges) - 1

    def _longest(self) -> None:
        if len(self.run) > len(self.anchor):
            self.anchor = self.run
        self.run = []

    def _build(self, tokens: list[str | bytes]) -> int:
        at, opened = 0, []
        for token in tokens:
            if token == "[[":
                self._longest()
                opened.append(at)
            elif token == "]]":
                start, end = opened.pop(), self._state()
                self.free[at].add(end)
                self.free[start].add(end)
                at = end
            elif isinstance(token, str):
                self._longest()
                end = self._state()
                self.free[at].add(end)
                for _ in range(int(token[2:-2])):
                    step = self._state()
                    self.edges[at].setdefault(None, set()).add(step)
                    self.free[step].add(end)
                    at = step
                at = end
            else:
                if not opened:
                    self.run = [*self.run, token]
                step = self._state()
                self.edges[at].setdefault(token, set()).add(step)
                at = step
        return at

    def _close(self, states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return frozenset(seen)

    def step(self, states: frozenset, word: bytes) -> frozenset:
        key = states, word if word in self.words else None
        if key not in self.steps:
            self.steps[key] = self._close({t for s in states for w in {key[1], None} for t in self.edges[s].get(w, ())})
        return self.steps[key]

    def longest(self, words: list[bytes], start: int) -> int:
        """Where the longest match from start ends; start itself if there is none."""
        states, end = self.first, start
        for i in range(start, len(words)):
            states = self.step(states, words[i])
            if not states:
                break
            if self.last in states:
                end = i + 1
        return end

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """All places where the template stands, each with its longest end."""
        opening = {w for s in self.first for w in self.edges[s]}
        starts = (i for i, w in enumerate(words) if w in opening or None in opening)
        return [(i, end) for i in starts if (end := self.longest(words, i)) > i]


def compiled(templates: list[tuple[str, str]]) -> list[tuple[Automaton, bytes, str]]:
    """Each template's automaton, the words to look for first, and its label."""
    return [(a := Automaton(t), b" %s " % b" ".join(a.anchor), label) for t, label in templates]


def scan_text(text: bytes | None, phrases: dict[str, str], automata: list[tuple[Automaton, bytes, str]]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of one text."""
    words = (text or b"").translate(PLAIN).split()
    joined = b" %s " % b" ".join(words)
    n, first, last, base, covered = 0, None, None, set(), bytearray(len(words))
    for phrase, label in phrases.items():
        needle, length = f" {phrase} ".encode(), phrase.count(" ") + 1
        place, seen, at = 0, 0, joined.find(needle)
        while at >= 0:
            place, seen = place + joined.count(b" ", seen, at), at
            n, first, last = n + 1, place if first is None else min(first, place), place if last is None else max(last, place)
            base.add(label)
            covered[place : place + length] = b"\1" * length
            at = joined.find(needle, at + 1)
    labels = set(base)
    for automaton, anchor, label in automata:
        if anchor in joined:
            for start, end in automaton.matches(words):
                labels.add(label)
                covered[start:end] = b"\1" * (end - start)
    score = sum(covered) / len(words) if words else 0.0
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for each row of docs.

    templates are (template, label), those of templates_of() if none are given.
    Null and wordless texts have 0 words, no places, empty labels and score 0. All places count, also
    overlapping ones. score is the share of the words that stand in a phrase or template. Repeated rows
    are scanned each; other columns are ignored; an empty table gives an empty result.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    )

    templates = templates_of() if templates is None else templates

    def run(batches):
        automata = compiled(templates)
        for batch in batches:
            for part in slices(batch):
                found = [scan_text(t, phrases, automata) for t in utf8(part.column("text"))]
                yield record(schema, part.column("doc_id"), *map(list, zip(*found, strict=True)))

    made = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    with small_batches(docs.sparkSession):
        return checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, made))


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
