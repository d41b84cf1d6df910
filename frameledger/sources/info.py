"""meta/info.json, the features it declares, and the format version."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyarrow import fs

from frameledger.errors import DatasetFormatError, DatasetVersionError
from frameledger.sources.files import exists, read_text

#: The supported versions, each with what its layout must have.
LAYOUT = {
    "v2.0": (("meta/episodes.jsonl", fs.FileType.File), ("meta/tasks.jsonl", fs.FileType.File)),
    "v2.1": (("meta/episodes.jsonl", fs.FileType.File), ("meta/tasks.jsonl", fs.FileType.File)),
    "v3.0": (("meta/episodes", fs.FileType.Directory),),
}


@dataclass(frozen=True)
class Feature:
    """A declared column; `shape` of an image is its size, of a scalar (1,)."""

    name: str
    dtype: str
    shape: tuple[int, ...]
    names: tuple[str, ...] | None = None

    @property
    def width(self) -> int:
        out = 1
        for n in self.shape:
            out *= n
        return out

    @property
    def is_video(self) -> bool:
        return self.dtype == "video"

    @property
    def is_numeric(self) -> bool:
        return self.dtype not in ("video", "string")


@dataclass(frozen=True)
class Info:
    codebase_version: str
    fps: int
    features: dict[str, Feature]
    total_episodes: int | None = None
    total_frames: int | None = None
    extra: dict[str, Any] = field(default_factory=dict)


def _whole(value: Any, key: str) -> int:
    """A whole number; texts and floats that stand for one, and booleans, are taken as such."""
    try:
        if isinstance(value, bool | int):
            return int(value)
        if isinstance(value, float) and value == int(value):
            return int(value)
        if isinstance(value, str):
            return int(value.strip().removesuffix(".0"))
    except (ValueError, OverflowError):
        pass
    raise DatasetFormatError(f"meta/info.json: {key} is no whole number: {value!r}")


def _names(raw: Any, feature: str) -> tuple[str, ...] | None:
    """Axis names: a list, or a mapping of lists that are strung together in its order."""
    if raw is None:
        return None
    if isinstance(raw, dict):
        parts = list(raw.values())
        if not all(isinstance(p, list) for p in parts):
            raise DatasetFormatError(f"feature {feature!r}: names must be lists")
        return tuple(str(x) for p in parts for x in p)
    if isinstance(raw, list):
        return tuple(str(x) for x in raw)
    raise DatasetFormatError(f"feature {feature!r}: names must be a list, a mapping or null")


def parse_feature(name: str, raw: Any) -> Feature:
    if not isinstance(raw, dict):
        raise DatasetFormatError(f"feature {name!r} is no object")
    if "dtype" not in raw or "shape" not in raw:
        raise DatasetFormatError(f"feature {name!r} lacks dtype or shape")
    if not isinstance(raw["dtype"], str):
        raise DatasetFormatError(f"feature {name!r}: dtype is no text")
    shape = raw["shape"]
    if not isinstance(shape, list) or not all(isinstance(n, int) and not isinstance(n, bool) for n in shape):
        raise DatasetFormatError(f"feature {name!r}: shape is no list of whole numbers")
    return Feature(name, raw["dtype"], tuple(shape), _names(raw.get("names"), name))


def parse_info(text: str) -> Info:
    """The info of a JSON text; keys beyond the known ones are kept as extra."""
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise DatasetFormatError(f"meta/info.json is not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise DatasetFormatError("meta/info.json is no object")
    known = ("codebase_version", "fps", "features", "total_episodes", "total_frames")
    if missing := [k for k in known[:3] if k not in raw]:
        raise DatasetFormatError(f"meta/info.json lacks {', '.join(missing)}")
    if not isinstance(raw["codebase_version"], str) or not isinstance(raw["features"], dict):
        raise DatasetFormatError("meta/info.json: codebase_version must be text and features an object")
    total = {k: None if raw.get(k) is None else _whole(raw[k], k) for k in known[3:]}
    features = {k: parse_feature(k, v) for k, v in raw["features"].items()}
    return Info(raw["codebase_version"], _whole(raw["fps"], "fps"), features, **total, extra={k: v for k, v in raw.items() if k not in known})


def load_info(root: str) -> Info:
    text = read_text(root, "meta/info.json")
    if text is None:
        raise DatasetFormatError("meta/info.json is missing")
    return parse_info(text)


def check_version(root: str, info: Info) -> str:
    """The declared version, if it is supported and the layout has what it asks for."""
    version = info.codebase_version
    if version not in LAYOUT:
        raise DatasetVersionError(f"unsupported version {version!r}; supported: {', '.join(LAYOUT)}")
    if absent := [p for p, kind in LAYOUT[version] if not exists(root, p, kind)]:
        raise DatasetVersionError(f"version {version} is declared, but {', '.join(absent)} is absent")
    return version
