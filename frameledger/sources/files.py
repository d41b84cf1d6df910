"""Files of a dataset: containment of paths, size bounds, listing, small reads. Driver side."""

from __future__ import annotations

import os
import posixpath

from pyarrow import fs

from frameledger.errors import DatasetFormatError, PathTraversalError, ResourceBoundError

#: The most episodes and frames that are accepted.
MAX_EPISODES, MAX_FRAMES = 1_000_000, 500_000_000


def check_bound(value: int, most: int, what: str) -> None:
    """Raises if value is beyond most (equal is fine)."""
    if value > most:
        raise ResourceBoundError(f"{what}: {value} is more than the {most} accepted")


def contained(root: str, *parts: str) -> str:
    """Path of parts under root, where a leading '/' and '.' mean nothing; parts may not hold '..' or lead out by a symbolic link."""
    steps = [s for p in parts for s in p.split("/") if s not in ("", ".")]
    if any(s == ".." or "\x00" in s or "\\" in s for s in steps):
        raise PathTraversalError(f"path leaves the dataset: {'/'.join(parts)!r}")
    path = posixpath.join(root, *steps)
    if "://" not in root:
        real, base = os.path.realpath(path), os.path.realpath(root)
        if real != base and not real.startswith(base.rstrip("/") + "/"):
            raise PathTraversalError(f"path leaves the dataset: {path!r}")
    return path


def filesystem(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of root, a local path or a URI that pyarrow knows."""
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


def listing(root: str, folder: str) -> dict[str, int]:
    """Relative path -> size of every file below a folder of the dataset; none if the folder is absent."""
    system, base = filesystem(root)
    infos = system.get_file_info(fs.FileSelector(posixpath.join(base, folder), recursive=True, allow_not_found=True))
    return {i.path[len(base) :].lstrip("/"): i.size or 0 for i in infos if i.type == fs.FileType.File}


def exists(root: str, path: str, kind: fs.FileType = fs.FileType.File) -> bool:
    system, base = filesystem(root)
    return system.get_file_info([posixpath.join(base, path)])[0].type == kind


def read_text(root: str, path: str) -> str | None:
    """Text of a small file, None if it is absent."""
    contained(root, path)
    if not exists(root, path):
        return None
    system, base = filesystem(root)
    with system.open_input_stream(posixpath.join(base, path)) as f:
        data = f.read()
    try:
        return bytes(data).decode("utf-8")
    except UnicodeDecodeError as e:
        raise DatasetFormatError(f"{path} is not UTF-8: {e}") from e
