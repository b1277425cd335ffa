"""Settings from files: every field named, none unknown."""

from __future__ import annotations

import dataclasses
import json
from pathlib import Path
from typing import TypeVar

T = TypeVar("T")


def load_settings(path: str, kind: type[T]) -> T:
    """A frozen dataclass from a JSON file, or a YAML file where a YAML library is installed.

    Fields without default must be there; a name that is no field is an error.
    """
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs a YAML library; use JSON") from e
        values = yaml.safe_load(text)
    else:
        values = json.loads(text)
    fields = {f.name: f for f in dataclasses.fields(kind)}
    unknown = sorted(set(values) - set(fields))
    free = dataclasses.MISSING
    missing = sorted(n for n, f in fields.items() if n not in values and f.default is free and f.default_factory is free)
    if unknown or missing:
        raise ValueError(f"unknown settings {unknown}, missing settings {missing}")
    return kind(**values)
