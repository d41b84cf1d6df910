"""Checks on a stream of frames, with state of a few numbers per episode.

An extension of the batch checks: rising and evenly spaced timestamps and the drift of each episode,
reported as soon as a frame breaks a rule. Frames of an episode must arrive in order within a
trigger's batches; resent frames (an index not above the last) are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

FOUND = "dataset_id bigint, episode_index bigint, frame_index bigint, kind string, amount double"
_STATE = "last_index bigint, last_ts double, drift double, drifted boolean"
TOLERANCE = 1e-4


def watch_frames(frames: DataFrame, fps: float, timeout: str = "1 hour", tolerance: float = TOLERANCE) -> DataFrame:
    """Streaming frames (dataset_id, episode_index, frame_index, timestamp, loaded_at) -> rows of FOUND.

    kind: 'not increasing', 'spacing', 'drift' (once per episode, when the sum passes the tolerance).
    The watermark follows loaded_at by `timeout`; frames older than it are ignored, and the state of an
    episode is dropped once it has passed the episode's last frame. Null and NaN timestamps are skipped.
    """
    step = 1.0 / fps
    keep = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_i, last_t, drift, drifted = state.get if state.exists else (-1, float("nan"), 0.0, False)
        rows: list[tuple] = []
        d = pd.concat(list(batches))
        latest = int(d["at"].max().timestamp() * 1000) if d["at"].notna().any() else 0
        d = d.dropna(subset=["frame_index", "timestamp"]).sort_values("frame_index", kind="stable")
        for i, t in zip(d["frame_index"].tolist(), d["timestamp"].astype(np.float64).tolist(), strict=True):
            if i <= last_i:
                continue
            if last_i >= 0:
                gap = t - last_t
                if gap <= 0:
                    rows.append((*key, i, "not increasing", gap))
                if abs(gap - step) > tolerance:
                    rows.append((*key, i, "spacing", gap))
            drift += abs(t - float(np.float32(i * step)))
            if drift > tolerance and not drifted:
                drifted = True
                rows.append((*key, i, "drift", drift))
            last_i, last_t = i, t
        state.update((last_i, last_t, drift, drifted))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + keep)
        if rows:
            yield pd.DataFrame(rows, columns=["dataset_id", "episode_index", "frame_index", "kind", "amount"])

    f = frames.selectExpr("cast(dataset_id as bigint) dataset_id", "cast(episode_index as bigint) episode_index", "cast(frame_index as bigint) frame_index", "cast(timestamp as float) timestamp", "cast(loaded_at as timestamp) at").withWatermark("at", timeout)
    return f.groupBy("dataset_id", "episode_index").applyInPandasWithState(run, FOUND, _STATE, "append", "EventTimeTimeout")
