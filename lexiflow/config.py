"""Settings of a localization project."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """The defaults of a new project."""

    service_url: str = ""
    service_key: str = ""
    model: str = ""
    target_lang: str = "简体中文"
    source_lang: str = "auto"
    chunk: int = 40
    vision_model: str = ""
    vision_tokens: int = 1024
    recognition_lang: str = "auto"
    recognition_budget: int = 8
    recognition_images: int = 40
    least_area: int = 24
    most_regions: int = 60
    grouping: str = "auto"
    group_parts: int = 2
    group_gap: float = 2.5
    strip_gap: int = 6
    group_most: int = 8

    def updated(self, **changes: object) -> Config:
        """A copy with known fields changed: numbers that cannot be read or are negative are 0, chunks are 1 to 100."""
        kinds = {f.name: type(f.default) for f in fields(self)}
        held: dict[str, object] = {}
        for name, value in changes.items():
            if name not in kinds:
                raise KeyError(name)
            held[name] = str(value) if kinds[name] is str else max(kinds[name](0), _number(value, kinds[name]))
        if "chunk" in held:
            held["chunk"] = min(100, max(1, held["chunk"] or 40))
        return replace(self, **held)

    def shown(self) -> dict[str, object]:
        """All fields; of the key only the ends."""
        key = self.service_key
        hidden = f"{key[:4]}****{key[-4:]}" if len(key) > 8 else "****" if key else ""
        return {f.name: getattr(self, f.name) for f in fields(self)} | {"service_key": hidden}


def _number(value: object, kind: type) -> float:
    try:
        return kind(float(str(value)))
    except (ValueError, OverflowError):
        return kind(0)
