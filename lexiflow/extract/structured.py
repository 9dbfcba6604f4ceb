"""Strings of JSON documents: any of them, or those of role-playing-game data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from lexiflow.extract.rows import Found

# Keys that hold no text, text fields of records, and where commands keep their texts.
SKIPPED_KEYS = frozenset({"id", "code", "iconIndex", "priority", "note", "meta"})
RECORD_FIELDS = {
    "Actors": ("name", "nickname", "profile", "description"),
    "Classes": ("name",),
    "Skills": ("name", "description", "message1", "message2"),
    "Items": ("name", "description"),
    "Weapons": ("name", "description"),
    "Armors": ("name", "description"),
    "Enemies": ("name",),
    "States": ("name", "description", "message1", "message2", "message3", "message4"),
    "Troops": ("name",),
}
#: Command code to (parameter, mark in the place name); {} stands for a place in a list of texts.
COMMAND_TEXTS = {101: (0, "#{}"), 102: (0, ".c{}"), 401: (0, ".m"), 402: (1, ".w"), 408: (0, ".x")}


def leaves(value: object, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """All strings below value with their paths, in order, but for skipped keys."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from leaves(item, (*path, str(i)))
    elif isinstance(value, dict):
        for key, item in value.items():
            if key not in SKIPPED_KEYS:
                yield from leaves(item, (*path, key))


def found(path: tuple, source: str, loc: str | None = None, suffix: str | None = None) -> Found:
    names = [str(p) for p in path]
    return Found(suffix or ".".join(names), "json", source, loc or ".".join(names), "json", path=names)


def commands(items: object, path: tuple, place: str) -> Iterator[Found]:
    """Texts of an event's command list."""
    for n, command in enumerate(items if isinstance(items, list) else []):
        if not isinstance(command, dict) or command.get("code") not in COMMAND_TEXTS:
            continue
        at, mark = COMMAND_TEXTS[command["code"]]
        values = command.get("parameters")
        value = values[at] if isinstance(values, list) and at < len(values) else None
        here = (*path, n, "parameters", at)
        if "{}" in mark:
            for k, text in enumerate(value if isinstance(value, list) else []):
                if isinstance(text, str):
                    yield found((*here, k), text, f"{place}.l{n}{mark.format(k)}", f"{place}.{n}.{mark.format(k).lstrip('#.')}")
        elif isinstance(value, str):
            yield found(here, value, f"{place}.l{n}{mark}", f"{place}.{n}{mark}")


def map_texts(data: object) -> Iterator[Found]:
    events = data.get("events") if isinstance(data, dict) else None
    named = events.items() if isinstance(events, dict) else enumerate(events or [])
    for key, event in named:
        for n, page in enumerate(event.get("pages") or [] if isinstance(event, dict) else []):
            yield from commands(page.get("list"), ("events", key, "pages", n, "list"), f"ev{key}.p{n}")


def common_texts(data: object) -> Iterator[Found]:
    for n, event in enumerate(data if isinstance(data, list) else []):
        if isinstance(event, dict):
            yield from commands(event.get("list"), (n, "list"), f"ce{n}")


def record_texts(name: str, data: object) -> Iterator[Found]:
    for n, record in enumerate(data if isinstance(data, list) else []):
        for field in RECORD_FIELDS[name] if isinstance(record, dict) else ():
            for path, text in leaves(record.get(field), (str(n), field)):
                if len(path) <= 3:
                    yield found(path, text, f"{name}[{n}].{field}" + "".join(f"[{p}]" for p in path[2:]), f"{name}." + ".".join(path))


def system_texts(data: object) -> Iterator[Found]:
    data = data if isinstance(data, dict) else {}
    terms = data.get("terms") if isinstance(data.get("terms"), dict) else {}
    for name in ("gameTitle", "currencyUnit"):
        yield from (found((name,), data[name]) for _ in (0,) if isinstance(data.get(name), str))
    for name in ("basic", "params", "commands"):
        yield from (found(("terms", name, n), t) for n, t in enumerate(terms.get(name) or []) if isinstance(t, str))
    for key, text in (terms.get("messages") or {}).items():
        if isinstance(text, str):
            yield found(("terms", "messages", key), text)


def json_entries(rel: str, text: str) -> list[Found]:
    """Texts by the kind of file that its name tells; else all strings."""
    data, name = json.loads(text.removeprefix("\ufeff")), rel.replace("\\", "/").rsplit("/", 1)[-1].removesuffix(".json")
    if re.fullmatch(r"Map\d{3}", name, re.I):
        return list(map_texts(data))
    if name == "CommonEvents":
        return list(common_texts(data))
    if name == "System":
        return list(system_texts(data))
    if name in RECORD_FIELDS:
        return list(record_texts(name, data))
    return [found(path, t) for path, t in leaves(data)]


def read(data: object, path: list[str]) -> object:
    for step in path:
        if isinstance(data, list):
            data = data[int(step)] if step.isdigit() and int(step) < len(data) else None
        else:
            data = data.get(step) if isinstance(data, dict) else None
    return data


def write(data: object, path: list[str], value: object) -> None:
    """Set a value; missing steps become lists before numbers and objects before names."""
    for step, following in zip(path, [*path[1:], None], strict=True):
        fresh = value if following is None else [] if following.isdigit() else {}
        if isinstance(data, list):
            data.extend([None] * (int(step) + 1 - len(data)))
            step = int(step)
        if following is None or (data[step] if isinstance(step, int) else data.get(step)) is None:
            data[step] = fresh
        data = data[step]
