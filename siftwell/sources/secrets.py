"""Known secret values from JSON, KEY=VALUE or plain files (driver side, never printed)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

from siftwell.plans.fixed import SECRET_NAMES

_NAMED = re.compile(SECRET_NAMES, re.IGNORECASE)
LEAST = 8


def _leaves(root: object) -> Iterator[tuple[str, str]]:
    """Names and strings of a JSON value; items of a list have the list's name."""
    todo: list[tuple[str, object]] = [("", root)]
    while todo:
        name, node = todo.pop()
        if isinstance(node, str):
            yield name, node
        elif isinstance(node, dict):
            todo.extend(node.items())
        elif isinstance(node, list):
            todo.extend((name, item) for item in node)


def _settings(text: str) -> Iterator[tuple[str, str]]:
    """Names and values of KEY=VALUE lines; a bare line is a secret."""
    for line in text.splitlines():
        if m := re.match(r"\s*(?:export )?\s*([^#=\s][^=]*)=(.*)", line):
            yield m[1].strip(), m[2]
        elif (bare := line.strip()) and bare[0] not in "#=":
            yield "secret", bare


def read_values(path: str | Path, all_values: bool = False) -> list[str]:
    """Distinct values with secret-looking names, longest first."""
    path = Path(path)
    text = path.read_text("utf-8", "replace")
    pairs = _leaves(json.loads(text)) if path.suffix.lower() == ".json" else _settings(text)
    found = {value.strip().strip("'\"") for name, value in pairs if all_values or _NAMED.search(name)}
    return sorted((v for v in found if len(v) >= LEAST), key=lambda v: (-len(v), v))
