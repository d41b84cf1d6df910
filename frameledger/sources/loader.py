"""From a reference to a dataset of DataFrames."""

from __future__ import annotations

import functools
import json
import os
import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameledger.errors import CheckExecutionError, DatasetFormatError, SourceResolutionError
from frameledger.operators.series import last_runs, with_position
from frameledger.sources.files import MAX_EPISODES, MAX_FRAMES, check_bound, contained, exists, listing, read_text
from frameledger.sources.footers import read_footers
from frameledger.sources.info import Feature, Info, check_version, load_info

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def once(make: Callable) -> property:
    """A property worked out once, also when checks that run side by side ask for it together."""

    def get(self):
        with self.lock:
            if make.__name__ not in self.made:
                self.made[make.__name__] = make(self)
            return self.made[make.__name__]

    return property(get, doc=make.__doc__)


@dataclass
class TrajectoryDataset:
    """A dataset's metadata on the driver, its records as DataFrames.

    episodes: ord (0, 1, ... by episode_index), episode_index, length, tasks, dataset_from_index,
    dataset_to_index, shard (relative path), problem (why there is no shard). tasks: task_index, task,
    ord. segments: ord, episode_index, camera, path, problem, from_timestamp, to_timestamp.
    """

    spark: SparkSession
    root: str
    ref: str
    version: str
    info: Info
    episodes: DataFrame
    tasks: DataFrame
    segments: DataFrame
    is_remote: bool = False
    kept: list[DataFrame] = field(default_factory=list)
    shared: dict[str, DataFrame] = field(default_factory=dict)  # what checks leave for each other
    made: dict = field(default_factory=dict)
    lock: threading.RLock = field(default_factory=threading.RLock)

    @property
    def features(self) -> list[Feature]:
        return list(self.info.features.values())

    @property
    def columns(self) -> list[Feature]:
        """Declared features that are columns of the data files."""
        return [f for f in self.features if not f.is_video]

    @property
    def cameras(self) -> list[str]:
        return sorted(f.name for f in self.features if f.is_video)

    @once
    def num_episodes(self) -> int:
        return self.episodes.count()

    def keep(self, df: DataFrame) -> DataFrame:
        """df persisted until close(); for what several checks read."""
        self.kept.append(df.persist())
        return df

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()

    @once
    def footers(self) -> DataFrame:
        paths = self.episodes.select(F.col("shard").alias("path")).dropna().distinct()
        return self.keep(read_footers(paths, self.root))

    @once
    def broken_shards(self) -> list[tuple[int, int, str]]:
        """(ord, episode_index, why) of the first episode without a readable data file, if any."""
        e = self.episodes.join(self.footers.select(F.col("path").alias("shard"), "error"), "shard", "left").filter("problem is not null or error is not null")
        return [tuple(r) for r in e.orderBy("ord").select("ord", "episode_index", F.coalesce("problem", "error")).limit(1).collect()]

    def frames(self, wanted: list[str], optional: bool = False) -> DataFrame:
        """ord, path, row (place in the file), episode_index and the wanted columns of all rows of the episodes.

        Files are read in groups of like types, so one whose column has another type than its
        neighbours does not break the scan. With optional, a file without a wanted column gives null;
        else that is an error.
        """
        if self.broken_shards:
            raise CheckExecutionError(f"episode {self.broken_shards[0][1]}: {self.broken_shards[0][2]}")
        need = list(dict.fromkeys(["episode_index", *wanted]))
        types = F.transform(F.array(*map(F.lit, need)), lambda n: F.get(F.filter("columns", lambda c: c["name"] == n), F.lit(0))["spark"])
        groups = self.footers.withColumn("types", types).groupBy("types").agg(F.collect_list("path").alias("paths")).collect()
        parts = []
        for g in groups:
            have = dict(zip(need, g.types, strict=True))
            if lack := [n for n, t in have.items() if t is None and (n == "episode_index" or not optional)]:
                raise CheckExecutionError(f"column {lack[0]!r} is absent from {min(g.paths)}")
            if odd := [n for n, t in have.items() if t == ""]:
                raise CheckExecutionError(f"column {odd[0]!r} holds neither numbers nor texts in {min(g.paths)}")
            schema = ", ".join(f"`{n}` {t}" for n, t in have.items() if t)
            uri = self.root if "://" in self.root else f"file://{os.path.abspath(self.root)}"
            d = self.spark.read.schema(schema).parquet(*(f"{uri}/{p}" for p in sorted(g.paths)))
            d = d.select(F.regexp_extract("_metadata.file_path", r"(data/[^/]+/[^/]+)$", 1).alias("path"), F.col("_metadata.row_index").alias("row"), *(_as(n, t).alias(n) for n, t in have.items()))
            parts.append(d)
        if not parts:
            raw = ", ".join(f"`{n}` double" for n in need if n != "episode_index")
            return self.spark.createDataFrame([], f"ord bigint, path string, row bigint, episode_index bigint{', ' + raw if raw else ''}")
        out = functools.reduce(lambda a, b: a.unionByName(b), _aligned(parts))
        who = self.episodes.select("ord", "episode_index", F.col("shard").alias("path"))
        return out.withColumn("episode_index", F.col("episode_index").cast("bigint")).join(who, ["path", "episode_index"])

    @once
    def extents(self) -> DataFrame:
        """ord, first, last, n: places of an episode's rows in its file; a row per episode, kept."""
        return self.keep(self.frames([]).groupBy("ord").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count(F.lit(1)).alias("n")))

    @once
    def scattered(self) -> bool:
        """Whether some episode's rows do not stand together in its file."""
        return not self.extents.filter("last - first + 1 <> n").isEmpty()

    def core(self, wanted: list[str]) -> DataFrame:
        """frames of an episode whose rows are scattered over its file only in their last stretch."""
        d = self.frames(wanted)
        return last_runs(d, ["path", "ord"], "row", "episode_index") if self.scattered else d

    def placed(self, wanted: list[str]) -> DataFrame:
        """core with `position` (0, 1, ... in file order) and `rows`, their number."""
        if self.scattered:
            return with_position(self.core(wanted), ["ord"], "row")
        return self.frames(wanted).join(self.extents.select("ord", "first", F.col("n").alias("rows")), "ord").withColumn("position", F.col("row") - F.col("first")).drop("first")

    def row_counts(self) -> DataFrame:
        """ord, rows of core."""
        if self.scattered:
            return self.core([]).groupBy("ord").agg(F.count(F.lit(1)).alias("rows"))
        return self.extents.select("ord", F.col("n").alias("rows"))


def _as(name: str, spark: str | None):
    """The column widened: whole numbers to bigint, others to double, arrays to array<double>; null where the file lacks it."""
    c = F.col(f"`{name}`")
    if spark is None:
        return F.lit(None)
    if spark.startswith("array<"):
        if spark.startswith("array<array<"):
            raise CheckExecutionError(f"column {name!r} holds nested lists")
        return c.cast("array<string>") if "string" in spark else c.cast("array<double>")
    if spark == "boolean":
        return c.cast("int").cast("double")
    return c.cast({"float": "double", "double": "double", "string": "string"}.get(spark, "bigint"))


def _aligned(parts: list[DataFrame]) -> list[DataFrame]:
    """The groups with one type per column: double or array<double> where they differ."""
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for n, t in p.dtypes:
            if t != "void":
                kinds.setdefault(n, set()).add(t)
    out = []
    for p in parts:
        cols = []
        for n, t in p.dtypes:
            of = kinds.get(n, {"double"})
            to = next(iter(of)) if len(of) == 1 else "array<double>" if any(x.startswith("array") for x in of) else "double"
            c = F.col(f"`{n}`")
            cols.append((c if t == to else F.array(c.cast("double")) if to == "array<double>" and not t.startswith("array") and t != "void" else c.cast(to)).alias(n))
        out.append(p.select(*cols))
    return out


def resolve(ref: str) -> str:
    """The folder of a reference: a local directory or a URI; names of a remote hub need a copy staged first."""
    if "://" in ref:
        return ref.rstrip("/")
    if os.path.isdir(ref):
        return os.path.abspath(ref)
    raise SourceResolutionError(f"{ref!r} is no directory; datasets of a remote hub must be staged as a directory or an object-store URI")


def remote(root: str) -> bool:
    """Whether a root lies in an object store or behind a network protocol, where what reads all data waits for `deep`; files and the cluster's own HDFS do not count."""
    return root.partition("://")[0] not in ("file", "hdfs", "viewfs") if "://" in root else False


def load(spark: SparkSession, ref: str, max_episodes: int = MAX_EPISODES, max_frames: int = MAX_FRAMES) -> TrajectoryDataset:
    """The dataset of a reference; one that declares or holds more than the given numbers is an error."""
    root = resolve(ref)
    info = load_info(root)
    version = check_version(root, info)
    check_bound(info.total_episodes or 0, max_episodes, "declared episodes")
    check_bound(info.total_frames or 0, max_frames, "declared frames")
    cameras = sorted(f.name for f in info.features.values() if f.is_video)
    for c in cameras:
        contained(root, "videos", c)
    build = _v3 if version == "v3.0" else _v2
    episodes, tasks, segments = build(spark, root, cameras, max_episodes)
    return TrajectoryDataset(spark, root, ref, version, info, episodes, tasks, segments, remote(root))


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    """`ord` by order: one sorted scan of the episode records, whose number is bounded."""
    return df.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1)


def _stored(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Small metadata tables are read by every check: kept."""
    return df.persist()


def _v3(spark: SparkSession, root: str, cameras: list[str], most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    uri = root if "://" in root else f"file://{root}"
    paths = sorted(p for p in listing(root, "meta/episodes") if p.rsplit("/", 1)[-1].startswith("file-") and p.endswith(".parquet") and p.split("/")[-2].startswith("chunk-"))
    if not paths:
        raise DatasetFormatError("meta/episodes holds no chunk-*/file-*.parquet")
    raw = spark.read.option("mergeSchema", "true").parquet(*(f"{uri}/{p}" for p in paths))
    whole = ["episode_index", "length", "dataset_from_index", "dataset_to_index", "data/chunk_index", "data/file_index"]
    video = [f"videos/{c}/{k}" for c in cameras for k in ("chunk_index", "file_index", "from_timestamp", "to_timestamp")]
    if lack := [c for c in [*whole, "tasks", *video] if c not in raw.columns]:
        raise DatasetFormatError(f"meta/episodes lacks column {lack[0]!r}")
    raw = raw.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    check_bound(raw.limit(most + 1).count(), most, "episodes")
    if not raw.filter(" or ".join(f"`{c}` is null" for c in whole)).isEmpty():
        raise DatasetFormatError("meta/episodes has a null in a required column")
    d = _numbered(raw, "episode_index", "_file", "_row")
    last = Window.partitionBy("episode_index").orderBy("_file", "_row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # of several records of one episode the last one says where its data are
    at = lambda c: F.last(F.col(f"`{c}`")).over(last).cast("bigint")
    d = d.withColumn("shard", F.format_string("data/chunk-%03d/file-%03d.parquet", at("data/chunk_index"), at("data/file_index")))
    for i, c in enumerate(cameras):
        d = d.withColumn(f"_v{i}", F.concat(F.lit(f"videos/{c}/"), F.format_string("chunk-%03d/file-%03d.mp4", at(f"videos/{c}/chunk_index"), at(f"videos/{c}/file_index"))))
    d = _stored(spark, d)
    none = F.lit(None).cast("string")
    episodes = d.select("ord", *(F.col(c).cast("bigint").alias(c) for c in whole[:4]), F.col("tasks").cast("array<string>").alias("tasks"), "shard", none.alias("problem"))
    each = [
        F.struct(F.lit(c).alias("camera"), F.col(f"_v{i}").alias("path"), F.col(f"`videos/{c}/from_timestamp`").cast("double").alias("from_timestamp"), F.col(f"`videos/{c}/to_timestamp`").cast("double").alias("to_timestamp"))
        for i, c in enumerate(cameras)
    ]
    none_yet = "array<struct<camera:string,path:string,from_timestamp:double,to_timestamp:double>>"
    segments = d.select("ord", "episode_index", F.explode(F.array(*each) if each else F.array().cast(none_yet)).alias("s")).select("ord", F.col("episode_index").cast("bigint").alias("episode_index"), "s.*", none.alias("problem"))
    if not exists(root, "meta/tasks.parquet"):
        raise DatasetFormatError("meta/tasks.parquet is missing")
    t = spark.read.parquet(f"{uri}/meta/tasks.parquet")
    text = next((c for c in ("__index_level_0__", "task") if c in t.columns), None)
    if text is None or "task_index" not in t.columns:
        raise DatasetFormatError("meta/tasks.parquet has no task_index or no task text")
    t = t.select(F.col("task_index").cast("bigint").alias("task_index"), F.col(text).cast("string").alias("task"), F.col("_metadata.row_index").alias("row"))
    return episodes, _last_tasks(t), segments


def _last_tasks(t: DataFrame) -> DataFrame:
    """Of several rows of a task the text of the last holds, in the place of the first."""
    return t.groupBy("task_index").agg(F.max_by("task", "row").alias("task"), F.min("row").alias("ord"))


def json_lines(spark: SparkSession, root: str, path: str, schema: str, required: list[str], most: int = MAX_EPISODES) -> DataFrame:
    """Records of a JSON-lines file with `row`; blank lines are skipped, a line that is no object or lacks a required key is an error."""
    if not exists(root, path):
        raise DatasetFormatError(f"{path} is missing")
    uri = root if "://" in root else f"file://{root}"
    lines = spark.read.text(f"{uri}/{path}").select("value", F.monotonically_increasing_id().alias("row")).filter(F.trim("value") != "")
    check_bound(lines.limit(most + 1).count(), most, path)
    d = lines.withColumn("r", F.from_json("value", schema)).withColumn("_keys", F.json_object_keys("value"))
    gone = [~F.array_contains("_keys", k) | F.col(f"r.{k}").isNull() for k in required]
    # from_json gives a row of nulls for other values, json_object_keys null
    bad = d.filter(F.col("_keys").isNull() | F.try_parse_json("value").isNull() | functools.reduce(lambda a, b: a | b, gone)).select("value").limit(1).collect()
    if bad:
        raise DatasetFormatError(f"{path}: not an object with {', '.join(required)}: {bad[0].value[:120]!r}")
    return d.select("row", "r.*")


def _v2(spark: SparkSession, root: str, cameras: list[str], most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    tasks = json_lines(spark, root, "meta/tasks.jsonl", "task_index bigint, task string", ["task_index", "task"], most)
    e = json_lines(spark, root, "meta/episodes.jsonl", "episode_index bigint, tasks array<string>, length bigint", ["episode_index", "tasks", "length"], most)
    upto = Window.orderBy("episode_index", "row").rowsBetween(Window.unboundedPreceding, 0)
    e = _numbered(e, "episode_index", "row").withColumn("dataset_to_index", F.sum("length").over(upto)).withColumn("dataset_from_index", F.col("dataset_to_index") - F.col("length"))

    def located(folder: str, pattern: str) -> DataFrame:
        files = [(p,) for p in listing(root, folder)]
        d = spark.createDataFrame(files, "path string").select("path", F.regexp_extract("path", pattern, 1).alias("n")).filter("n <> ''")
        return d.groupBy(F.col("n").cast("bigint").alias("episode_index")).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))

    problem = F.when(F.col("copies").isNull(), F.lit("no file")).when(F.col("copies") > 1, F.lit("several files"))
    d = located("data", r"^data/chunk-[^/]*/episode_(\d{6,})\.parquet$")
    e = e.join(d, "episode_index", "left").withColumns({"problem": problem, "shard": F.when(F.col("copies") == 1, F.col("path"))}).drop("path", "copies")
    e = _stored(spark, e.select("ord", "episode_index", "length", "tasks", "dataset_from_index", "dataset_to_index", "shard", "problem"))
    parts = [
        e.select("ord", "episode_index").join(located("videos", rf"^videos/chunk-[^/]*/\Q{c}\E/episode_(\d{{6,}})\.mp4$"), "episode_index", "left")
        .select("ord", "episode_index", F.lit(c).alias("camera"), F.when(F.col("copies") == 1, F.col("path")).alias("path"), F.lit(None).cast("double").alias("from_timestamp"), F.lit(None).cast("double").alias("to_timestamp"), problem.alias("problem"))
        for c in cameras
    ]
    none = spark.createDataFrame([], "ord bigint, episode_index bigint, camera string, path string, from_timestamp double, to_timestamp double, problem string")
    return e, _last_tasks(tasks), functools.reduce(lambda a, b: a.unionByName(b), parts, none)


def stored_stats(ds: TrajectoryDataset) -> dict[str, dict] | None:
    """meta/stats.json, None if it is absent."""
    text = read_text(ds.root, "meta/stats.json")
    if text is None:
        return None
    try:
        raw = json.loads(text)
    except ValueError as e:
        raise DatasetFormatError(f"meta/stats.json is not JSON: {e}") from e
    if not isinstance(raw, dict):
        raise DatasetFormatError("meta/stats.json is no object")
    return raw


def stored_episode_stats(ds: TrajectoryDataset, features: list[str]) -> DataFrame:
    """episode_index, feature, mean, std (array<double>, null if absent or not numeric): the first record of each episode."""
    if ds.version == "v2.1":
        if not exists(ds.root, "meta/episodes_stats.jsonl"):
            return ds.spark.createDataFrame([], "episode_index bigint, feature string, mean array<double>, std array<double>")
        uri = ds.root if "://" in ds.root else f"file://{ds.root}"
        lines = ds.spark.read.text(f"{uri}/meta/episodes_stats.jsonl").select(F.from_json("value", "episode_index bigint, stats map<string,map<string,variant>>").alias("r"), F.monotonically_increasing_id().alias("row"))
        d = lines.filter("r.episode_index is not null and r.stats is not null").groupBy("r.episode_index").agg(F.min_by("r.stats", "row").alias("stats"))
        d = d.select("episode_index", F.explode("stats").alias("feature", "s")).filter(F.col("feature").isin(features))
        return d.select("episode_index", "feature", *(_numbers(F.to_json(F.element_at("s", F.lit(k)))).alias(k) for k in ("mean", "std")))
    uri = ds.root if "://" in ds.root else f"file://{ds.root}"
    paths = sorted(p for p in listing(ds.root, "meta/episodes") if p.endswith(".parquet"))
    # a file that cannot be read has no statistics, and does not stop the others
    raw = ds.spark.read.option("mergeSchema", "true").option("ignoreCorruptFiles", "true").parquet(*(f"{uri}/{p}" for p in paths))
    have = dict(raw.dtypes)
    rows = []
    for f in features:
        pair = [f"stats/{f}/{k}" for k in ("mean", "std")]
        if any(p in have for p in pair):
            rows.append(F.struct(F.lit(f).alias("feature"), *(_flat(F.col(f"`{p}`"), have[p]).alias(k) if p in have else F.lit(None).cast("array<double>").alias(k) for k, p in zip(("mean", "std"), pair, strict=True))))
    if not rows:
        return ds.spark.createDataFrame([], "episode_index bigint, feature string, mean array<double>, std array<double>")
    first = F.struct("_metadata.file_path", "_metadata.row_index")
    d = raw.select(F.col("episode_index").cast("bigint").alias("episode_index"), first.alias("at"), F.array(*rows).alias("s")).groupBy("episode_index").agg(F.min_by("s", "at").alias("s"))
    return d.select("episode_index", F.inline("s"))


def _flat(c, kind: str):
    """Numbers of a scalar, list or nested list column in order, nulls left out; null if there are none."""
    depth = kind.count("array<")
    if depth == 0:
        return F.when(c.isNotNull(), F.array(c.cast("double")))
    for _ in range(depth - 1):
        c = F.flatten(F.filter(c, lambda x: x.isNotNull()))
    return _some(c.cast("array<double>"))


def _some(values):
    """The numbers among values, null if there are none."""
    found = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(found) > 0, found)


def _numbers(text):
    """Numbers of a JSON number or (nested) list given as JSON text; texts (also such of digits), nulls and objects in it are left out; null if there are none."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\\\]|\\\\.)*"', "t"), r"\{[^{}]*\}", "t")
    items = F.split(F.regexp_replace(bare, r"[\[\]\s]", ""), ",")
    return _some(F.transform(items, lambda x: F.when(x == "true", 1.0).when(x == "false", 0.0).otherwise(x.try_cast("double"))))
