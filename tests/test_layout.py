"""Rules of the repository itself."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_training_data_operators_stand_apart():
    for path in (ROOT / "lexiflow").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", path.read_text(encoding="utf-8"), re.M), path


def test_no_forbidden_calls():
    for path in (ROOT / "lexiflow").rglob("*.py"):
        source = path.read_text(encoding="utf-8")
        assert "localCheckpoint" not in source and "crossJoin" not in source and "mapPartitions" not in source, path
