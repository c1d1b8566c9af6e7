"""Settings of a project: a JSON or YAML file at its root or in its config folder, else defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

NAMES = ("graphloom.json", "graphloom.yaml", "config/graphloom.json", "config/graphloom.yaml")


@dataclass(frozen=True)
class Config:
    root: str = "."
    languages: tuple[str, ...] = ("php", "javascript", "python", "typescript", "go", "csharp")
    max_file_kb: int = 500
    max_commits: int = 5000
    churn_window_days: int = 90
    extra_patterns: tuple[str, ...] = ()
    use_ignore_files: tuple[str, ...] = ("git", "hg", "own")
    export_prefix: str = "graphloom"
    more: dict = field(default_factory=dict)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'":
        return text[1:-1]
    try:
        return json.loads(text)
    except ValueError:
        return text


def flat_yaml(text: str) -> dict:
    """`key: value`, `key: [a, b]` and `- item` lists: as much of YAML as the settings need."""
    out: dict = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key:
            out[key] = [*(out[key] or []), _scalar(line.lstrip()[2:])]
            continue
        key, _, value = line.strip().partition(":")
        value = value.strip()
        out[key] = [_scalar(x) for x in value[1:-1].split(",") if x.strip()] if value.startswith("[") and value.endswith("]") else _scalar(value) if value else None
    return out


def load(root: str) -> Config:
    """The first file of NAMES that there is; unknown keys are kept in `more`."""
    found: dict = {}
    for name in NAMES:
        path = Path(root) / name
        if path.is_file():
            found = json.loads(path.read_text()) if name.endswith(".json") else flat_yaml(path.read_text())
            break
    known = {f.name for f in fields(Config)} - {"root", "more"}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in known and v is not None}
    return Config(root=str(Path(root).resolve()), more={k: v for k, v in found.items() if k not in known}, **values)
