"""Whether the video files decode."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import functions as F

from frameledger.checks.engine import CheckContext, check, found, passed
from frameledger.sources.files import filesystem
from frameledger.sources.loader import TrajectoryDataset
from frameledger.verdict import CheckResult, Severity

#: Positions that are tried, frames decoded at most, findings after which the check stops.
POSITIONS, MOST_FRAMES, _CAP = ("first", "middle", "last"), 10_000, 10


def decoder_name() -> str:
    try:
        import av  # noqa: F401
    except ImportError:
        return "container structure only"
    return "av"


def _decode(file: BinaryIO, position: str) -> str | None:
    import av

    try:
        file.seek(0)
        with av.open(file) as box:
            if not box.streams.video:
                return "no video stream"
            n = 0
            for _ in box.decode(box.streams.video[0]):
                n += 1
                if position == "first" or n >= MOST_FRAMES:
                    break
            return None if n else "no frame"
    except Exception as e:
        return f"{type(e).__name__}: {e}"


def walk_boxes(file: BinaryIO, end: int) -> str | None:
    """Error in the top-level boxes of an MP4 file of `end` bytes, None if they fill it and hold movie and media.

    Reads the boxes' headers only, and says nothing about the frames.
    """
    at, names = 0, []
    while at < end:
        file.seek(at)
        head = file.read(16)
        if len(head) < 8:
            return "the file ends inside a box header"
        size, name = int.from_bytes(head[:4], "big"), bytes(head[4:8])
        if size == 1:
            if len(head) < 16:
                return "the file ends inside a box header"
            size = int.from_bytes(head[8:16], "big")
        elif size == 0:
            size = end - at
        if size < 8 or not all(32 <= c < 127 for c in name):
            return "no MP4 box"
        if at + size > end:
            return f"box {name.decode()} is cut off"
        names.append(name)
        at += size
    if lack := [n.decode() for n in (b"ftyp", b"moov", b"mdat") if n not in names]:
        return f"no box {', '.join(lack)}"
    return None


def _try(root: str, decoder: str) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(root)
        for b in batches:
            rows = []
            for path in b.column("path").to_pylist():
                try:
                    with system.open_input_file(posixpath.join(base, path)) as f:
                        said = [_decode(f, p) for p in POSITIONS] if decoder == "av" else [walk_boxes(f, f.size())] * len(POSITIONS)
                except OSError as e:
                    said = [f"{type(e).__name__}: {e}"[:200]] * len(POSITIONS)
                rows.append((path, said))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["path", "errors"])

    return run


@check("VIDEO.DECODABLE_SPOTCHECK", Severity.FAIL, requires_video=True)
def decodable_spotcheck(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Each video file, once: its first frame, and all of it up to MOST_FRAMES for the middle and last."""
    me = "VIDEO.DECODABLE_SPOTCHECK"
    if ds.is_remote and not ctx.deep:
        return passed(me, "Skipped: too slow on remote data unless asked to go deep.")
    decoder = decoder_name()
    files = ds.segments.dropna(subset=["path"]).select("path").distinct()
    said = files.mapInArrow(_try(ds.root, decoder), "path string, errors array<string>").filter(F.exists("errors", lambda x: x.isNotNull()))
    first = ds.segments.filter("path is not null").groupBy("camera", "path").agg(F.min("ord").alias("ord"))
    lost = ds.segments.filter("path is null").select("camera", "ord", "episode_index", F.lit(None).cast("string").alias("path"), F.array("problem").alias("errors"))
    bad = said.join(first, "path").select("camera", "ord", F.lit(None).cast("bigint").alias("episode_index"), "path", "errors").unionByName(lost)
    # an unresolvable segment is a finding by itself; a file that was tried ends the list once the cap is reached
    items: list[str] = []
    for r in bad.orderBy("camera", "ord").toLocalIterator():
        if r.path is None:
            items.append(f"camera {r.camera!r} episode {r.episode_index}: {r.errors[0] or 'no file'}")
            continue
        items += [f"camera {r.camera!r} file {r.path.rsplit('/', 1)[-1]!r} {p} frame: {e}" for p, e in zip(POSITIONS, r.errors, strict=True) if e]
        if len(items) >= _CAP:
            break
    if items:
        return found(me, Severity.FAIL, "Videos do not decode", items, "failures", decoder=decoder)
    return passed(me, f"All video files of {len(ds.cameras)} camera(s) pass ({decoder}).", decoder=decoder)
