"""Fitting text into boxes with a width model, and strips of fragments."""

from __future__ import annotations

import re

WIDE = re.compile("[⺀-鿿＀-￯가-힯]")


def width(text: str, size: float) -> float:
    """Estimated width: a wide character is as wide as the font size, any other 0.55 of it."""
    wide = len(WIDE.findall(text))
    return (wide + (len(text) - wide) * 0.55) * size


def tokens(text: str) -> list[str]:
    """Units between which a line may break: wide characters, words and blanks."""
    return re.findall(r"[⺀-鿿＀-￯가-힯]|[^\s⺀-鿿＀-￯가-힯]+|\s", text)


def wrapped(text: str, size: float, room: float) -> list[str]:
    lines = []
    for part in text.split("\n"):
        line = ""
        for token in tokens(part):
            if line and width((line + token).rstrip(), size) > room:
                lines.append(line.rstrip())
                line = "" if token.isspace() else token
            else:
                line += token
        lines.append(line.rstrip())
    return lines


def fit(text: str, box_width: float, box_height: float, largest: int = 64, smallest: int = 8, spacing: float = 1.2) -> tuple[int, list[str], bool]:
    """(size, lines, fits): the largest font size at which the wrapped text fits, or the smallest."""
    for size in range(largest, smallest - 1, -1):
        lines = wrapped(text, size, box_width)
        if len(lines) * size * spacing <= box_height + size * (spacing - 1) and all(width(x, size) <= box_width for x in lines):
            return size, lines, True
    return smallest, wrapped(text, smallest, box_width), False


def strip(sizes: list[tuple[float, float]], gap: float = 6, vertical: bool = False, align: str = "center") -> list[tuple[float, float]]:
    """Places of fragments (w, h) in a row or column with a gap between them."""
    across = max((w if vertical else h for w, h in sizes), default=0)
    at, out = 0.0, []
    for w, h in sizes:
        side = w if vertical else h
        off = {"top": 0.0, "center": (across - side) / 2, "baseline": across - side}[align]
        out.append((off, at) if vertical else (at, off))
        at += (h if vertical else w) + gap
    return out
