"""Chat services as translators: prompts, replies and requests."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

from lexiflow.config import Config


def prompt(pairs: list[tuple[str, str]], config: Config, labels: list[str] | None = None) -> str:
    """A request for the translation of (context, text) pairs; labels are others on the same screen."""
    lines = [
        f"Translate the text of each [context, text] pair into {config.target_lang} (from: {config.source_lang}).",
        "Keep names and menu items short, dialogue natural, and subtitles to the point. The context says what a text is.",
        "Leave every placeholder as it is, such as %s, {0}, \\N[1], <tag> or ⟦1⟧.",
        f"Answer with a JSON array of {len(pairs)} strings in the same order, and nothing else.",
    ]
    if labels:
        lines.insert(2, f"Labels on the same screen, for a common style: {json.dumps(labels[:10], ensure_ascii=False)}")
    return "\n".join([*lines, json.dumps([list(p) for p in pairs], ensure_ascii=False)])


def reply(text: str) -> list[str]:
    """The strings of the array from the first [ to the last ]."""
    start, end = text.find("["), text.rfind("]")
    if start < 0 or end < start:
        raise ValueError("no array in the reply")
    return [str(v) for v in json.loads(text[start : end + 1])]


def http_post(url: str, key: str, body: dict, timeout: float = 180) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
    with urllib.request.urlopen(request, timeout=timeout) as got:  # noqa: S310 - the URL is the caller's setting
        return json.loads(got.read())


def translator(config: Config, post: Callable[[str, str, dict], dict] = http_post) -> Callable[[list[tuple[str, str]]], list[str]]:
    """A function for operators.translate.served()."""

    def translate(pairs: list[tuple[str, str]]) -> list[str]:
        if not config.service_url or not config.service_key:
            raise ValueError("no service is set")
        body = {"model": config.model, "temperature": 0.1, "messages": [{"role": "user", "content": prompt(pairs, config)}]}
        return reply(post(config.service_url, config.service_key, body)["choices"][0]["message"]["content"])

    return translate


def abilities(config: Config) -> dict[str, bool]:
    """What can be done with these settings and this machine."""
    from importlib.util import find_spec

    return {
        "translation": bool(config.service_url and config.service_key),
        "vision": bool(config.service_url and config.service_key and config.vision_model),
        "drawing": find_spec("PIL") is not None,
        "video": False,
    }
