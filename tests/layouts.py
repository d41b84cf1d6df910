"""Datasets on disk in the three layouts, with named faults."""

from __future__ import annotations

import copy
import json
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

CORE = {"timestamp": "float32", "frame_index": "int64", "episode_index": "int64", "index": "int64", "task_index": "int64"}
ARROW = {"float32": pa.float32(), "float64": pa.float64(), "int64": pa.int64(), "int32": pa.int32(), "uint8": pa.uint8(), "string": pa.string()}
BOX = b"\x00\x00\x00\x10ftypisom\x00\x00\x02\x00" + b"\x00\x00\x00\x08moov" + b"\x00\x00\x00\x0cmdatxxxx"


class Layout:
    """What a dataset is made of; change parts, then write()."""

    def __init__(self, episodes: int = 3, frames: int = 4, fps: int = 30, version: str = "v3.0", camera: str | None = "top") -> None:
        self.version, self.fps, self.cameras = version, fps, [camera] if camera else []
        self.features: dict[str, Any] = {k: {"dtype": t, "shape": [1], "names": None} for k, t in CORE.items()}
        self.features |= {c: {"dtype": "video", "shape": [3, 48, 80], "names": None} for c in self.cameras}
        self.totals: dict[str, Any] = {"total_episodes": episodes, "total_frames": episodes * frames}
        self.types = {k: ARROW[t] for k, t in CORE.items()}
        self.episodes = [{"episode_index": e, "length": frames, "tasks": ["stack the crates"], "dataset_from_index": e * frames, "dataset_to_index": (e + 1) * frames} for e in range(episodes)]
        self.rows = [{"timestamp": float(np.float32(i / fps)), "frame_index": i, "episode_index": e, "index": e * frames + i, "task_index": 0} for e in range(episodes) for i in range(frames)]
        self.tasks: list[dict] = [{"task_index": 0, "task": "stack the crates"}]
        self.stats: Any = None
        self.episode_stats: dict[int, dict] = {}
        self.video = BOX
        self.task_column = "task"

    def copy(self) -> Layout:
        return copy.deepcopy(self)

    def feature(self, name: str, dtype: str, shape: list[int], arrow: pa.DataType, value: Any, names: Any = None) -> Layout:
        """Adds a column; value(row) gives its values."""
        self.features[name] = {"dtype": dtype, "shape": shape, "names": names}
        self.types[name] = arrow
        for r in self.rows:
            r[name] = value(r)
        return self

    def table(self, rows: list[dict]) -> pa.Table:
        return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in self.types.items()})

    def write(self, root: Path) -> str:
        info = {"codebase_version": self.version, "fps": self.fps, "features": self.features, **self.totals}
        put = lambda p, data: (p.parent.mkdir(parents=True, exist_ok=True), p.write_bytes(data if isinstance(data, bytes) else data.encode()))
        put(root / "meta/info.json", json.dumps(info))
        if self.stats is not None:
            put(root / "meta/stats.json", json.dumps(self.stats))
        (self._v3 if self.version.startswith("v3") else self._v2)(root, put)
        return str(root)

    def _v3(self, root: Path, put) -> None:
        for d in ("meta/episodes/chunk-000", "data/chunk-000"):
            (root / d).mkdir(parents=True, exist_ok=True)
        pq.write_table(self.table(self.rows), root / "data/chunk-000/file-000.parquet")
        e = pa.table({k: pa.array([x[k] for x in self.episodes], pa.int64()) for k in ("episode_index", "length", "dataset_from_index", "dataset_to_index")})
        e = e.append_column("tasks", pa.array([x["tasks"] for x in self.episodes], pa.list_(pa.string())))
        zero = pa.array([0] * len(self.episodes), pa.int64())
        for c in ("data/chunk_index", "data/file_index", "meta/episodes/chunk_index", "meta/episodes/file_index", *(f"videos/{c}/{k}" for c in self.cameras for k in ("chunk_index", "file_index"))):
            e = e.append_column(c, zero)
        for c in self.cameras:
            for k in ("from_timestamp", "to_timestamp"):
                e = e.append_column(f"videos/{c}/{k}", pa.array([0.0] * len(self.episodes), pa.float64()))
            put(root / f"videos/{c}/chunk-000/file-000.mp4", self.video)
        for k in sorted({k for s in self.episode_stats.values() for k in s}):
            e = e.append_column(f"stats/{k}", pa.array([self.episode_stats.get(x["episode_index"], {}).get(k) for x in self.episodes]))
        pq.write_table(e, root / "meta/episodes/chunk-000/file-000.parquet")
        t = pa.table({"task_index": pa.array([x["task_index"] for x in self.tasks], pa.int64()), self.task_column: pa.array([x["task"] for x in self.tasks], pa.string())})
        pq.write_table(t, root / "meta/tasks.parquet")

    def _v2(self, root: Path, put) -> None:
        lines = lambda rows: "\n".join(json.dumps(x) for x in rows) + "\n"
        put(root / "meta/episodes.jsonl", lines({k: x[k] for k in ("episode_index", "tasks", "length")} for x in self.episodes))
        put(root / "meta/tasks.jsonl", lines(self.tasks))
        if self.version == "v2.1":
            nested = lambda s: {f: {k.split("/")[1]: v for k, v in s.items() if k.startswith(f + "/")} for f in {k.split("/")[0] for k in s}}
            put(root / "meta/episodes_stats.jsonl", lines({"episode_index": x["episode_index"], "stats": nested(self.episode_stats.get(x["episode_index"], {}))} for x in self.episodes))
        (root / "data/chunk-000").mkdir(parents=True, exist_ok=True)
        for x in self.episodes:
            i = x["episode_index"]
            pq.write_table(self.table([r for r in self.rows if r["episode_index"] == i]), root / f"data/chunk-000/episode_{i:06d}.parquet")
            for c in self.cameras:
                put(root / f"videos/chunk-000/{c}/episode_{i:06d}.mp4", self.video)
