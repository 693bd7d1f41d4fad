"""Schemas, categories and configuration of a scan."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, replace
from pathlib import Path

CATEGORIES = ("secret", "pii", "infra", "custom")
#: A span of lower priority number wins where spans overlap; a known value beats everything.
PRIORITY = {"secret": 1, "custom": 2, "pii": 3, "infra": 4}
ALLOW_MARK = "siftwell:allow"

SPAN = "struct<start:int,end:int,value:string,from:int,to:int>"
FINDING = "path string, where string, line int, start int, end int, category string, rule string, value string, engine string"
UNSCANNED = "path string, reason string"
CONFIG_NAME = ".siftwell.toml"
SAMPLE = """# Every key is optional.
categories = ["secret", "pii", "infra", "custom"]
# Further scanners, where they are installed: gitleaks, maskingtape, ko-pii.
engines = []
# Files (json, .env or one a line) whose values are secrets; they are never printed.
known_secrets = []
# Globs of paths that are not scanned, from the scanned folder on.
exclude = []
# Regular expressions; a finding whose value has a match is dropped.
allow = []

[custom]
# Whole words, in any case.
terms = []
# Regular expressions; a group named v is what is reported.
patterns = []
# Words whose nearby number is sensitive.
metrics = []
metric_window = 40
# People, and files with one name a line.
names = []
names_files = []
"""


@dataclass(frozen=True)
class Config:
    """What to look for. All lists are driver-side parameters."""

    categories: tuple[str, ...] = ("secret", "pii", "infra", "custom")
    allow: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    metric_window: int = 40
    names: tuple[str, ...] = ()
    known_values: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    engines: tuple[str, ...] = ()
    only_rules: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if unknown := set(self.categories) - set(CATEGORIES):
            raise ValueError(f"unknown categories: {sorted(unknown)}")


def read_names(text: str) -> list[str]:
    """One name a line; what follows a # is a comment."""
    return [n for line in text.splitlines() if (n := line.split("#", 1)[0].strip())]


def load_config(start: str | Path, named: str | Path | None = None) -> Config:
    """The configuration file ``named``, else the one nearest to ``start``, upwards; defaults if there is none.

    Unknown keys are errors.
    """
    at = Path(start).resolve()
    near = (folder / CONFIG_NAME for folder in ([at, *at.parents] if at.is_dir() else at.parents))
    file = Path(named) if named else next((f for f in near if f.is_file()), None)
    if file is None:
        return Config()
    told = tomllib.loads(file.read_text("utf-8"))
    custom = told.pop("custom", {})
    if unknown := set(told) - {"categories", "engines", "known_secrets", "exclude", "allow"}:
        raise ValueError(f"{file}: unknown keys {sorted(unknown)}")
    names = list(custom.get("names", []))
    for other in custom.get("names_files", []):
        names += read_names((file.parent / other).read_text("utf-8"))
    from siftwell.sources.secrets import read_values

    values = [v for p in told.get("known_secrets", []) for v in read_values(file.parent / p)]
    config = Config(names=tuple(names), known_values=tuple(values), **{k: tuple(custom.get(k, ())) for k in ("terms", "patterns", "metrics")})
    if "metric_window" in custom:
        config = replace(config, metric_window=int(custom["metric_window"]))
    return replace(config, **{k: tuple(told[k]) for k in ("categories", "engines", "exclude", "allow") if k in told})


def glob_regex(glob: str) -> str:
    """A glob as a regular expression; ``*`` crosses folders."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"
