"""Writing tables out as a dataset in one of the layouts, file by file on the executors."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.operators.common import group_chunks
from frameledger.sources.files import filesystem

#: Fixed value: bytes of the smallest MP4 that has its boxes, what a camera's file holds here.
EMPTY_VIDEO = bytes.fromhex("00000010667479706973366d00000000000000086d6f6f76000000086d646174")


def _open(root: str, path: str):
    system, base = filesystem(root)
    full = posixpath.join(base, path)
    system.create_dir(posixpath.dirname(full), recursive=True)
    return system.open_output_stream(full)


def put(root: str, path: str, data: bytes) -> None:
    with _open(root, path) as f:
        f.write(data)


def _files(root: str, path: str, names: list[str]) -> Callable:
    """Each group of rows with equal `_file` becomes the file path.format(_file) with columns of those names; gives the file and its rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_chunks(batches, ["_file"]):
            ids = t.column("_file").to_numpy()
            cuts = [0, *(i + 1 for i in range(len(ids) - 1) if ids[i] != ids[i + 1]), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                with _open(root, path.format(int(ids[a]))) as f:
                    pq.write_table(t.slice(a, b - a).rename_columns(names).drop_columns(["_file"]), f)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[a])]), pa.array([b - a])], names=["file", "rows"])

    return run


def write_files(rows: DataFrame, file: str, order: list[str], root: str, path: str) -> int:
    """rows written to one Parquet file per value of the column `file`, sorted by `order`; gives the number of files. A file's rows pass through one task."""
    names = ["_file" if c == file else c for c in rows.columns]
    # plain names on the way: those of the layout may hold dots
    d = rows.toDF(*("_file" if c == "_file" else f"c{i}" for i, c in enumerate(names)))
    d = d.repartition("_file").sortWithinPartitions("_file", *(f"c{names.index(c)}" for c in order))
    return d.mapInArrow(_files(root, path, names), "file bigint, rows bigint").count()


def write_v3(root: str, info: dict, frames: DataFrame, episodes: DataFrame, tasks: DataFrame, stats: dict, cameras: dict[str, list[bytes]], order: list[str]) -> None:
    """A dataset of version v3.0: frames with file_index, sorted by episode and `order`; episodes with all their columns; tasks (task_index, task); videos by camera and file."""
    put(root, "meta/info.json", json.dumps(info).encode())
    put(root, "meta/stats.json", json.dumps(stats).encode())
    write_files(frames, "file_index", ["episode_index", *order], root, "data/chunk-000/file-{:03d}.parquet")
    write_files(episodes.withColumn("_one", F.lit(0).cast("bigint")), "_one", ["episode_index"], root, "meta/episodes/chunk-000/file-{:03d}.parquet")
    write_files(tasks.withColumn("_one", F.lit(0).cast("bigint")), "_one", ["task_index"], root, "meta/tasks-{:d}.parquet")
    system, base = filesystem(root)
    system.move(posixpath.join(base, "meta/tasks-0.parquet"), posixpath.join(base, "meta/tasks.parquet"))
    for camera, files in cameras.items():
        for i, data in enumerate(files):
            put(root, f"videos/{camera}/chunk-000/file-{i:03d}.mp4", data)


def write_v2(root: str, info: dict, frames: DataFrame, episodes: DataFrame, tasks: DataFrame, order: list[str]) -> None:
    """A dataset of version v2.0 or v2.1 without statistics: a data file per episode, episodes (episode_index, tasks, length) and tasks as JSON lines."""
    put(root, "meta/info.json", json.dumps(info).encode())
    write_files(frames.withColumn("_one", F.col("episode_index")), "_one", order, root, "data/chunk-000/episode_{:06d}.parquet")
    for name, df in (("episodes", episodes), ("tasks", tasks)):
        folder = posixpath.join(root if "://" in root else f"file://{filesystem(root)[1]}", f"_{name}")
        df.coalesce(1).write.json(folder)
        system, base = filesystem(root)
        (part,) = [i.path for i in system.get_file_info(fs.FileSelector(posixpath.join(base, f"_{name}"))) if i.base_name.startswith("part-")]
        system.move(part, posixpath.join(base, f"meta/{name}.jsonl"))
        system.delete_dir(posixpath.join(base, f"_{name}"))
