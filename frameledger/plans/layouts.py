"""Queries that write the tables out as one dataset in a layout, load it, and look at it through the loader and the checks; and their SQL.

Every episode with a length and bounds is an episode of that dataset, numbered by dataset and episode;
its frames are the readings with a finite timestamp, an index and a task, tasks being numbered over all datasets. What
the checks find there is what is wrong with the tables themselves, beside a stored mean that is off by one
and two videos that are cut off.
"""

from __future__ import annotations

import atexit
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameledger.checks import CheckEngine
from frameledger.functions.columns import finite
from frameledger.operators.common import read, shared_folder
from frameledger.sources.export import EMPTY_VIDEO, write_v2, write_v3
from frameledger.sources.files import filesystem
from frameledger.sources.loader import load, stored_episode_stats

#: Frames a second, episodes of a data file and of a video, numbers kept free for the tasks of a dataset.
FPS, PER_FILE, PER_VIDEO, TASKS = 20, 100, 400, 1000
CAMERA, ORDER = "observation.images.cam", ["frame_index", "timestamp", "index", "task_index"]


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """episodes (dataset_id, old, episode_index, length, lo, hi, tasks), frames of the one dataset, tasks."""
    e = read(spark, d, "episodes").groupBy("dataset_id", F.col("episode_index").alias("old")).agg(
        F.max("length").alias("length"), F.max("dataset_from_index").alias("lo"), F.max("dataset_to_index").alias("hi"), F.max(F.coalesce(F.array_join("tasks", "|"), F.lit(""))).alias("text")
    )
    e = e.filter("dataset_id is not null and old is not null and length is not null and lo is not null and hi is not null")
    # a row per episode, whose number a dataset bounds
    e = e.withColumn("episode_index", F.row_number().over(Window.orderBy("dataset_id", "old")).cast("bigint") - 1)
    f = read(spark, d, "frames").select("dataset_id", F.col("episode_index").alias("old"), "frame_index", "index", "timestamp", "task_index", "action").filter("frame_index is not null and task_index is not null and index is not null").filter(finite(F.col("timestamp"))).distinct()
    f = f.join(e.select("dataset_id", "old", "episode_index"), ["dataset_id", "old"])
    f = f.select("timestamp", "frame_index", "episode_index", "index", (F.col("dataset_id") * TASKS + F.col("task_index")).alias("task_index"), F.coalesce("action", F.array(F.lit(None).cast("float"))).alias("action"))
    t = read(spark, d, "tasks").filter("dataset_id is not null and task_index is not null").groupBy((F.col("dataset_id") * TASKS + F.col("task_index")).alias("task_index")).agg(F.max(F.coalesce("__index_level_0__", "task", F.lit(""))).alias("task"))
    return e, f, t


def _info(version: str, episodes: int, frames: int) -> dict:
    one = lambda t: {"dtype": t, "shape": [1], "names": None}
    features = {"timestamp": one("float32"), **{k: one("int64") for k in ("frame_index", "episode_index", "index", "task_index")}, "action": {"dtype": "float32", "shape": [4], "names": None}}
    if version == "v3.0":
        features[CAMERA] = {"dtype": "video", "shape": [3, 48, 80], "names": None}
    return {"codebase_version": version, "fps": FPS, "features": features, "total_episodes": episodes, "total_frames": frames}


def _root(spark: SparkSession) -> str:
    """A new folder in the shared one, as a path where that is a folder of files; removed when the process ends."""
    shared = shared_folder(spark)
    if shared.startswith("file:"):
        shared = "/" + shared.removeprefix("file:").lstrip("/")
    root = f"{shared}/layout-{uuid.uuid4().hex}"
    system, path = filesystem(root)
    atexit.register(lambda: system.delete_dir(path) if system.get_file_info([path])[0].type == fs.FileType.Directory else None)
    return root


def _v3(spark: SparkSession, d: str) -> str:
    e, f, t = _tables(spark, d)
    root = _root(spark)
    n = e.agg(F.count(F.lit(1)), F.sum("length")).first()
    m = f.agg(*(x(c).alias(f"{k}_{c}") for c in ("timestamp", "frame_index") for k, x in (("mean", F.avg), ("std", F.stddev_pop)))).first()
    usual = F.col("length").cast("double")
    meta = e.select(
        "episode_index", "length", F.array("text").alias("tasks"), F.col("lo").alias("dataset_from_index"), F.col("hi").alias("dataset_to_index"), F.lit(0).cast("bigint").alias("data/chunk_index"), F.floor(F.col("episode_index") / PER_FILE).alias("data/file_index"),
        F.lit(0).cast("bigint").alias(f"videos/{CAMERA}/chunk_index"), F.floor(F.col("episode_index") / PER_VIDEO).alias(f"videos/{CAMERA}/file_index"), F.lit(0.0).alias(f"videos/{CAMERA}/from_timestamp"), F.lit(1.0).alias(f"videos/{CAMERA}/to_timestamp"),
        F.array((usual - 1) / 2).alias("stats/frame_index/mean"), F.array(F.sqrt((usual * usual - 1) / 12)).alias("stats/frame_index/std"),
    )
    videos = [EMPTY_VIDEO if i else EMPTY_VIDEO[:-4] for i in range(-(-n[0] // PER_VIDEO))]
    # the mean of the frame numbers is stored as it is, that of the timestamps is off by one
    stats = {"frame_index": {"mean": [m.mean_frame_index], "std": [m.std_frame_index]}, "timestamp": {"mean": [(m.mean_timestamp or 0.0) + 1.0], "std": [m.std_timestamp]}}
    write_v3(root, _info("v3.0", n[0], n[1]), f.withColumn("file_index", F.floor(F.col("episode_index") / PER_FILE)), meta, t, stats, {CAMERA: videos}, ORDER)
    return root


def _v2(spark: SparkSession, d: str) -> str:
    e, f, t = _tables(spark, d)
    root, n = _root(spark), e.agg(F.count(F.lit(1)), F.sum("length")).first()
    write_v2(root, _info("v2.0", n[0], n[1]), f, e.orderBy("episode_index").select("episode_index", F.array("text").alias("tasks"), "length"), t.select("task_index", "task"), ORDER)
    return root


def layout_checks(spark: SparkSession, d: str) -> DataFrame:
    """check_id, severity, listed: what the sixteen checks say of the written dataset, and how many findings the two that list all of them list."""
    ds = load(spark, _v3(spark, d))
    results = CheckEngine().run(ds)
    ds.close()
    listed = {"SEMANTIC.TASK_INTEGRITY": "violations", "SEMANTIC.LANGUAGE_PRESENT": "empty_episode_indices"}
    return spark.createDataFrame([(r.check_id, r.severity.value, len(r.details.get(listed.get(r.check_id), ()))) for r in results], "check_id string, severity string, listed bigint")


def layout_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The episodes as the loader of v3.0 has them."""
    e = load(spark, _v3(spark, d)).episodes
    return e.select("ord", "episode_index", "length", "dataset_from_index", "dataset_to_index", "shard", F.element_at("tasks", 1).alias("text"))


def layout_frames(spark: SparkSession, d: str) -> DataFrame:
    """Per episode of v3.0: rows, the sum of their places, and those whose frame number is not their place."""
    p = load(spark, _v3(spark, d)).placed(["frame_index"])
    return p.groupBy("ord").agg(F.count(F.lit(1)).alias("rows"), F.sum("position").alias("places"), F.count_if(F.col("frame_index") != F.col("position")).alias("off"))


def layout_tasks(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, _v3(spark, d)).tasks.select("task_index", "task")


def layout_episode_stats(spark: SparkSession, d: str) -> DataFrame:
    """The stored statistics of the episodes of v3.0, as the loader reads them."""
    s = stored_episode_stats(load(spark, _v3(spark, d)), ["frame_index", "timestamp"])
    return s.select("episode_index", "feature", F.round(F.element_at("mean", 1), 6).alias("mean"), F.round(F.element_at("std", 1), 6).alias("std"))


def layout_v2_episodes(spark: SparkSession, d: str) -> DataFrame:
    """The episodes as the loader of v2.0 has them, with bounds from the running sum of lengths."""
    return load(spark, _v2(spark, d)).episodes.select("ord", "episode_index", "length", "dataset_from_index", "dataset_to_index", "shard")


QUERIES = {f.__name__: f for f in (layout_checks, layout_episodes, layout_frames, layout_tasks, layout_episode_stats, layout_v2_episodes)}

_E = """
WITH e AS (SELECT *, row_number() OVER (ORDER BY dataset_id, old) - 1 AS ep FROM (
  SELECT dataset_id, episode_index AS old, max(length) AS length, max(dataset_from_index) AS lo, max(dataset_to_index) AS hi, max(coalesce(array_to_string(tasks, '|'), '')) AS text FROM episodes GROUP BY ALL)
  WHERE dataset_id IS NOT NULL AND old IS NOT NULL AND length IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL),
t AS (SELECT dataset_id * 1000 + task_index AS task_index, max(coalesce(__index_level_0__, task, '')) AS task FROM tasks WHERE dataset_id IS NOT NULL AND task_index IS NOT NULL GROUP BY 1),
f AS (SELECT ep, length, lo, frame_index, i, ts, task, action, row_number() OVER (PARTITION BY ep ORDER BY frame_index, ts, i, task) - 1 AS pos FROM (
  SELECT DISTINCT dataset_id, episode_index AS old, frame_index, "index" AS i, "timestamp" AS ts, dataset_id * 1000 + task_index AS task, action FROM frames WHERE frame_index IS NOT NULL AND task_index IS NOT NULL AND "index" IS NOT NULL AND isfinite("timestamp")) JOIN e USING (dataset_id, old))
"""
_BLANK = "NOT regexp_matches({}, '[^\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]')"
_IF = "(SELECT CASE WHEN {} THEN '{}' ELSE 'INFO' END{})"
_CHECKED = {
    "SEMANTIC.FEATURE_DIMENSIONALITY": _IF.format("bool_or(n <> 4)", "FAIL", " FROM (SELECT arg_min(coalesce(len(action), 1), pos) AS n FROM f GROUP BY ep)"),
    "SEMANTIC.TASK_INTEGRITY": _IF.format("(SELECT n FROM listed_tasks) > 0", "FAIL", ""),
    "SEMANTIC.CAMERA_INTRINSICS_PLAUSIBLE": "'INFO'",
    "SEMANTIC.LANGUAGE_PRESENT": _IF.format("(SELECT n FROM listed_texts) > 0", "WARN", ""),
    "STATISTICAL.STATS_MATCH_DATA": _IF.format("1 / greatest(abs(avg(CAST(ts AS DOUBLE))), 1e-6) > 1e-4", "FAIL", " FROM f"),
    "STATISTICAL.PER_EPISODE_STATS_MATCH": _IF.format(
        "bool_or(abs((length - 1) / 2 - m) / greatest(abs(m), 1e-6) > 1e-4 OR abs(sqrt((CAST(length AS DOUBLE) * length - 1) / 12) - s) / greatest(abs(s), 1e-6) > 1e-4)", "WARN", " FROM (SELECT length, avg(frame_index) AS m, stddev_pop(frame_index) AS s FROM f GROUP BY ep, length)"
    ),
    "STATISTICAL.VALUE_SANITY": "(SELECT CASE WHEN bool_or(n = bad) THEN 'FAIL' WHEN bool_or(bad > 0 OR lo = hi) THEN 'WARN' ELSE 'INFO' END FROM (SELECT ep, count(*) AS n, count(*) FILTER (v IS NULL OR isnan(v)) AS bad, min(v) FILTER (NOT isnan(v)) AS lo, max(v) FILTER (NOT isnan(v)) AS hi FROM (SELECT ep, unnest(coalesce(action, [NULL])) AS v FROM f) GROUP BY ep))",
    "STRUCTURAL.VERSION_DETECTED": "'INFO'",
    "STRUCTURAL.SCHEMA_CONSISTENCY": "'INFO'",
    "STRUCTURAL.INDEX_CONTINUITY": _IF.format("(SELECT bool_or(frame_index <> pos OR i <> lo + pos) FROM f) OR (SELECT bool_or(coalesce(n, 0) <> length) FROM e LEFT JOIN (SELECT ep, count(*) AS n FROM f GROUP BY ep) USING (ep))", "FAIL", ""),
    "STRUCTURAL.METADATA_DATA_AGREEMENT": _IF.format("bool_or(coalesce(n, 0) <> length OR hi - lo <> length)", "FAIL", " FROM e LEFT JOIN (SELECT ep, count(*) AS n FROM f GROUP BY ep) USING (ep)"),
    "STRUCTURAL.PATH_TEMPLATE_RESOLVES": "'INFO'",
    "TEMPORAL.TIMESTAMP_MONOTONIC": _IF.format("bool_or(gap <= 0)", "FAIL", " FROM g"),
    "TEMPORAL.TIMESTAMP_SPACING": "(SELECT CASE WHEN bool_or(far) THEN 'FAIL' WHEN count(far) > 0 THEN 'WARN' ELSE 'INFO' END FROM (SELECT arg_min(dev > 0.05, pos) AS far FROM (SELECT ep, pos, abs(gap - 0.05) AS dev FROM g WHERE length >= 2) WHERE dev > 1e-4 GROUP BY ep))",
    "KNOWNBUG.TIMESTAMP_DRIFT": _IF.format("sum(abs(CAST(ts AS DOUBLE) - CAST(CAST(frame_index * (1.0 / 20) AS FLOAT) AS DOUBLE))) > 1e-4", "FAIL", " FROM f"),
    "VIDEO.DECODABLE_SPOTCHECK": "'FAIL'",
}
_LISTED = {"SEMANTIC.TASK_INTEGRITY": "(SELECT n FROM listed_tasks)", "SEMANTIC.LANGUAGE_PRESENT": "(SELECT n FROM listed_texts)"}
_SHARD = "'data/chunk-000/file-' || lpad(CAST(ep // 100 AS VARCHAR), 3, '0') || '.parquet'"

SQL = {
    "layout_checks": _E
    + f""", g AS (SELECT *, CAST(ts AS DOUBLE) - lag(CAST(ts AS DOUBLE)) OVER (PARTITION BY ep ORDER BY pos) AS gap FROM f),
listed_tasks AS (SELECT (SELECT count(DISTINCT task) FROM f WHERE task NOT IN (SELECT task_index FROM t)) + (SELECT count(*) FROM t WHERE {_BLANK.format('task')}) AS n),
listed_texts AS (SELECT count(*) AS n FROM e WHERE {_BLANK.format('text')})
"""
    + " UNION ALL ".join(f"SELECT '{c}' AS check_id, {s} AS severity, CAST({_LISTED.get(c, '0')} AS BIGINT) AS listed" for c, s in _CHECKED.items()),
    "layout_episodes": _E + f"SELECT ep AS ord, ep AS episode_index, length, lo AS dataset_from_index, hi AS dataset_to_index, {_SHARD} AS shard, text FROM e",
    "layout_frames": _E + "SELECT ep AS ord, count(*) AS rows, CAST(sum(pos) AS BIGINT) AS places, count(*) FILTER (frame_index <> pos) AS off FROM f GROUP BY ep",
    "layout_tasks": _E + "SELECT * FROM t",
    "layout_episode_stats": _E + "SELECT ep AS episode_index, 'frame_index' AS feature, round((length - 1) / 2, 6) AS mean, round(sqrt((CAST(length AS DOUBLE) * length - 1) / 12), 6) AS std FROM e",
    "layout_v2_episodes": _E
    + "SELECT ep AS ord, ep AS episode_index, length, CAST(sum(length) OVER w - length AS BIGINT) AS dataset_from_index, CAST(sum(length) OVER w AS BIGINT) AS dataset_to_index, CASE WHEN ep IN (SELECT ep FROM f) THEN 'data/chunk-000/episode_' || lpad(CAST(ep AS VARCHAR), 6, '0') || '.parquet' END AS shard FROM e WINDOW w AS (ORDER BY ep ROWS UNBOUNDED PRECEDING)",
}
