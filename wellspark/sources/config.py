"""Configuration files: dataclasses from YAML or JSON, with overrides; unknown keys are errors."""

from __future__ import annotations

import dataclasses
import json
import os
import typing
from pathlib import Path

from wellspark.functions.vector import deep_merge

try:
    import yaml
except ImportError:  # JSON only
    yaml = None


@dataclasses.dataclass
class Objects:
    """What is measured of one mask's objects; lists name channels."""

    mask: str = "cell"
    parent: str | None = None
    intensity: list[str] = dataclasses.field(default_factory=list)
    radial: list[str] = dataclasses.field(default_factory=list)
    granularity: list[str] = dataclasses.field(default_factory=list)
    texture: list[str] = dataclasses.field(default_factory=list)
    pairs: list[list[str]] = dataclasses.field(default_factory=list)
    bins: int = 4
    steps: int = 16
    distance: int = 2
    levels: int = 256


@dataclasses.dataclass
class Catalogue:
    root: str = "."
    image_pattern: str | None = None
    mask_pattern: str | None = None
    subdir: str | None = None
    filters: dict[str, str] = dataclasses.field(default_factory=dict)


@dataclasses.dataclass
class Config:
    """One run: where the files are, and what is measured."""

    catalogue: Catalogue = dataclasses.field(default_factory=Catalogue)
    objects: list[Objects] = dataclasses.field(default_factory=list)
    image_profile: bool = True
    workers: int | None = None


def built(kind: type, values: dict, where: str = "") -> object:
    """A dataclass from nested dictionaries; an unknown key is an error that names its place and the known ones."""
    if not isinstance(values, dict):
        raise ValueError(f"{where or kind.__name__}: expected keys and values")
    fields = {f.name: f for f in dataclasses.fields(kind)}
    unknown = sorted(set(values) - set(fields))
    if unknown:
        raise ValueError(f"{where or kind.__name__}: unknown keys {unknown}, known are {sorted(fields)}")
    kinds = typing.get_type_hints(kind)
    out = {}
    for name, v in values.items():
        t, at = kinds[name], f"{where}.{name}".lstrip(".")
        inner = typing.get_args(t)[0] if typing.get_origin(t) is list else None
        if dataclasses.is_dataclass(t) and v is not None:
            v = built(t, v, at)
        elif dataclasses.is_dataclass(inner) and v is not None:
            v = [built(inner, x, f"{at}[{k}]") for k, x in enumerate(v)]
        out[name] = v
    return kind(**out)


def parse_override(text: str) -> dict:
    """``a.b=value`` as a nested dictionary; the value is read as JSON where it can be."""
    path, sign, raw = text.partition("=")
    if not sign or not path:
        raise ValueError(f"no key=value: {text}")
    try:
        value = json.loads(raw)
    except json.JSONDecodeError:
        value = raw
    for key in reversed(path.split(".")):
        value = {key: value}
    return value


def read_values(path: str) -> dict:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json") or yaml is None:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def load_config(path: str | None = None, overrides: list[str] | dict | None = None, kind: type = Config) -> object:
    """The file's values under the overrides, as ``kind``."""
    values = read_values(path) if path else {}
    for over in [overrides] if isinstance(overrides, dict) else [parse_override(o) for o in overrides or []]:
        values = deep_merge(values, over)
    return built(kind, values)


def save_values(path: str, values: object) -> None:
    """Written beside and then moved into place, so that a reader never sees half a file."""
    data = dataclasses.asdict(values) if dataclasses.is_dataclass(values) else values
    text = json.dumps(data, indent=1, ensure_ascii=False) if path.endswith(".json") or yaml is None else yaml.safe_dump(data, sort_keys=False, allow_unicode=True)
    beside = f"{path}.{os.getpid()}.part"
    Path(beside).write_text(text, encoding="utf-8")
    os.replace(beside, path)
