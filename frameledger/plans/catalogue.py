"""The integrity checks and their operators over tables that hold many datasets, and their SQL.

A series is an episode of a dataset, ordered by frame_index; rows sent again count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger import audit
from frameledger.checks import registry
from frameledger.functions.columns import finite, is_blank, plain_source, py_gt
from frameledger.operators import series
from frameledger.operators.common import read
from frameledger.verdict import scored

EP = ["dataset_id", "episode_index"]
_FEATURE = "map<string,struct<dtype:string,shape:array<bigint>>>"
#: The types of columns that a declared type asks for.
_TYPES = {"float32": "float", "float64": "double", "int64": "bigint", "int32": "int", "string": "string"}


def _frames(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return read(spark, d, "frames").select(*EP, "frame_index", *cols).distinct()


def _fps(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "datasets").groupBy("dataset_id").agg(F.max("fps").cast("double").alias("fps"))


def _episodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per episode: the greatest of its lengths and bounds."""
    e = read(spark, d, "episodes")
    return e.groupBy(*EP).agg(*(F.max(c).alias(c) for c in ("length", "dataset_from_index", "dataset_to_index")))


def _components(spark: SparkSession, d: str) -> DataFrame:
    """*EP, item, value: finite components of actions."""
    v = series.values_of(_frames(spark, d, "action"), EP, {"action": F.col("action").cast("array<double>")})
    return v.withColumn("value", F.when(finite(F.col("value")), F.col("value")).otherwise(float("nan")))


def _features(spark: SparkSession, d: str) -> DataFrame:
    f = read(spark, d, "datasets").select("dataset_id", F.explode(F.from_json("features", _FEATURE)).alias("feature", "f"))
    return f.select("dataset_id", "feature", "f.dtype", "f.shape").distinct()


def check_feature_dimensionality(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset: episodes whose first action has the declared width, and others."""
    want = _features(spark, d).filter("feature = 'action'").select("dataset_id", F.aggregate("shape", F.lit(1).cast("bigint"), lambda a, b: a * b).alias("declared"))
    first = _frames(spark, d, "action").filter("action is not null").groupBy(*EP).agg(F.min(F.struct("frame_index", F.size("action").cast("bigint").alias("n"))).alias("x"))
    j = first.join(want, "dataset_id")
    return j.groupBy("dataset_id", "declared").agg(F.count(F.lit(1)).alias("episodes"), F.count_if(F.col("x.n") != F.col("declared")).alias("off"))


def check_intrinsics(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the first row of each label read as camera matrices: the rule on focal lengths and principal points."""
    e = read(spark, d, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("k"))
    f = series.intrinsics(F.col("k").cast("array<double>"))
    return e.select("label", F.explode(F.filter(F.array(F.when(f["short"], "short"), F.when(f["focal"], "focal length"), F.when(f["centre"], "principal point")), lambda x: x.isNotNull())).alias("finding"))


def check_task_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Task numbers of frames that no task has, and tasks without a text."""
    t = read(spark, d, "tasks")
    lost = series.undefined(read(spark, d, "frames"), t, ["dataset_id", "task_index"]).withColumn("problem", F.lit("undefined"))
    blank = t.filter(is_blank(F.coalesce("__index_level_0__", "task"))).select("dataset_id", "task_index").distinct().withColumn("problem", F.lit("blank"))
    return lost.unionByName(blank)


def check_language_present(spark: SparkSession, d: str) -> DataFrame:
    return series.without_text(read(spark, d, "episodes"), "tasks").select(*EP).distinct()


def check_stats(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset: pooled moments of all components of its actions, from those of its episodes."""
    m = series.pooled(series.moments(_components(spark, d), EP), ["dataset_id"])
    return m.select("dataset_id", "n", "n_nan", *(F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")), "n_nonzero")


def check_per_episode_stats(spark: SparkSession, d: str) -> DataFrame:
    """Episodes whose mean action is off their dataset's by more than half of it."""
    m = series.moments(_components(spark, d), EP)
    j = m.join(series.pooled(m, ["dataset_id"]).select("dataset_id", F.col("mean").alias("stored")), "dataset_id")
    return j.filter(series.off_tolerance(F.col("stored"), F.col("mean"), 0.5)).select(*EP)


#: Fixed value: statistics count as stored when only the frames before this one were there.
STORED_UP_TO = 40


def _match(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    """keys, mean_off, std_off: statistics of the first frames of each episode, as stored, against those of all, by the check's own tolerance."""
    v = series.values_of(_frames(spark, d, "action"), [*EP, "frame_index"], {"action": F.col("action").cast("array<double>")})
    v = v.withColumn("value", F.when(finite(F.col("value")), F.col("value")).otherwise(float("nan")))
    stored = series.moments(v.filter(F.col("frame_index") < STORED_UP_TO), keys).select(*keys, F.col("mean").alias("mean0"), F.col("std").alias("std0"))
    j = series.moments(v, keys).join(stored, keys)
    return j.select(*keys, series.off_tolerance(F.col("mean0"), F.col("mean")).alias("mean_off"), series.off_tolerance(F.col("std0"), F.col("std")).alias("std_off"))


def check_stats_match(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, ["dataset_id"])


def check_episode_stats_match(spark: SparkSession, d: str) -> DataFrame:
    return _match(spark, d, EP).filter("mean_off or std_off")


def check_value_sanity(spark: SparkSession, d: str) -> DataFrame:
    s = series.sanity(series.moments(_components(spark, d), [*EP, "item"]))
    return s.select(*EP, F.col("item").cast("bigint").alias("item"), F.explode("findings").alias("finding"))


def check_version(spark: SparkSession, d: str) -> DataFrame:
    v = read(spark, d, "datasets").select("dataset_id", "codebase_version").distinct()
    return v.select("dataset_id", "codebase_version", F.col("codebase_version").isin("v2.0", "v2.1", "v3.0").alias("supported"))


def check_schema_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Declared columns of each dataset and whether the frames have them in that type."""
    have = dict(read(spark, d, "frames").dtypes)
    f = _features(spark, d).filter("dtype <> 'video'")
    held = F.create_map(*(F.lit(x) for n, t in have.items() for x in (n, t.removeprefix("array<").removesuffix(">"))))
    want = F.create_map(*(F.lit(x) for p in _TYPES.items() for x in p))
    found = F.element_at(held, F.col("feature"))
    return f.select("dataset_id", "feature", "dtype", F.when(found.isNull(), "absent").when(found == F.element_at(want, F.col("dtype")), "same").otherwise("other").alias("held"))


def check_index_continuity(spark: SparkSession, d: str) -> DataFrame:
    """Per episode: rows, and readings whose global index does not run on from the first."""
    f = _frames(spark, d, "index").filter("frame_index is not null")
    e = _episodes(spark, d).select(*EP, "dataset_from_index")
    return series.sequence_breaks(f.join(e, EP), EP, "frame_index", "index", F.col("dataset_from_index")).filter("breaks > 0")


def check_metadata_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Episodes whose number of frames or whose bounds are not their length."""
    e = _episodes(spark, d).filter("length is not null")
    return series.count_agreement(e, _frames(spark, d), EP, "length", F.col("dataset_to_index") - F.col("dataset_from_index"))


def check_paths(spark: SparkSession, d: str) -> DataFrame:
    """Data files that episodes name and no shard lists ('absent'), and those listed that no episode names ('unnamed')."""
    keys = ["dataset_id", "data/chunk_index", "data/file_index"]
    e, s = read(spark, d, "episodes").select(*keys), read(spark, d, "data_shards").select(*keys)
    both = series.undefined(e, s, keys).withColumn("side", F.lit("absent")).unionByName(series.undefined(s, e, keys).withColumn("side", F.lit("unnamed")))
    return both.withColumnsRenamed({"data/chunk_index": "chunk_index", "data/file_index": "file_index"})


def check_monotonic(spark: SparkSession, d: str) -> DataFrame:
    bad = series.first_not_increasing(_frames(spark, d, "timestamp").filter("timestamp is not null"), EP, "frame_index", "timestamp")
    return bad.select(*EP, "frame_index")


def _spaced(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d, "timestamp").filter("timestamp is not null").join(_fps(spark, d), "dataset_id")
    return series.first_off_spacing(f, [*EP, "fps"], "frame_index", "timestamp", F.lit(1.0) / F.col("fps"))


def check_spacing(spark: SparkSession, d: str) -> DataFrame:
    return _spaced(spark, d).select(*EP, "frame_index", "level")


def _drift(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d, "timestamp").filter(finite(F.col("timestamp"))).join(_fps(spark, d), "dataset_id")
    return series.drift_totals(f, EP, series.drift(F.col("frame_index"), F.col("timestamp"), F.col("fps"), F.lit(False)))


def check_drift(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset: total drift, and the first episode by which it has passed what decoders tolerate."""
    r = series.running_totals(_drift(spark, d), ["dataset_id"], "episode_index")
    return r.groupBy("dataset_id").agg(F.round(F.sum("total"), 4).alias("total"), F.min(F.when(py_gt(F.col("running"), F.lit(1e-4)), F.col("episode_index"))).alias("first_breach"))


def check_video_files(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset and camera: video files and segments in them, each counted once."""
    v = read(spark, d, "video_segments").select("dataset_id", "camera", "chunk_index", "file_index", "episode_index").distinct()
    return v.groupBy("dataset_id", "camera").agg(F.countDistinct("chunk_index", "file_index").alias("files"), F.count(F.lit(1)).alias("segments"))


CHECKS = [c.id for c in registry.all_checks()]


def _results(spark: SparkSession, d: str) -> DataFrame:
    """dataset_id, check_id, severity: the outcome of the sixteen checks on each dataset; those that these tables have nothing for (stored statistics, intrinsics, video files) are skipped, which is INFO."""
    every = read(spark, d, "datasets").select("dataset_id").distinct()
    sane = check_value_sanity(spark, d)
    bad: list[tuple[str, DataFrame, Column]] = [
        ("SEMANTIC.FEATURE_DIMENSIONALITY", check_feature_dimensionality(spark, d).filter("off > 0"), F.lit("FAIL")),
        ("STATISTICAL.VALUE_SANITY", sane, F.when(F.col("finding") == "all NaN", "FAIL").otherwise("WARN")),
        ("STRUCTURAL.SCHEMA_CONSISTENCY", check_schema_consistency(spark, d).filter("held <> 'same'"), F.lit("FAIL")),
        ("STRUCTURAL.INDEX_CONTINUITY", check_index_continuity(spark, d), F.lit("FAIL")),
        ("STRUCTURAL.PATH_TEMPLATE_RESOLVES", check_paths(spark, d).filter("side = 'absent'"), F.lit("FAIL")),
        ("KNOWNBUG.TIMESTAMP_DRIFT", check_drift(spark, d).filter("first_breach is not null"), F.lit("FAIL")),
        ("SEMANTIC.TASK_INTEGRITY", check_task_integrity(spark, d), F.lit("FAIL")),
        ("SEMANTIC.LANGUAGE_PRESENT", check_language_present(spark, d), F.lit("WARN")),
        ("STRUCTURAL.METADATA_DATA_AGREEMENT", check_metadata_agreement(spark, d), F.lit("FAIL")),
        ("TEMPORAL.TIMESTAMP_MONOTONIC", check_monotonic(spark, d), F.lit("FAIL")),
        ("TEMPORAL.TIMESTAMP_SPACING", _spaced(spark, d), F.upper("level")),
    ]
    found = None
    for name, df, s in bad:
        one = df.select("dataset_id", F.lit(name).alias("check_id"), s.alias("severity"))
        found = one if found is None else found.unionByName(one)
    worst = found.groupBy("dataset_id", "check_id").agg(F.min("severity").alias("severity"))  # FAIL sorts before WARN
    ids = every.select("dataset_id", F.explode(F.array(*map(F.lit, CHECKS))).alias("check_id"))
    return ids.join(worst, ["dataset_id", "check_id"], "left").withColumn("severity", F.coalesce("severity", F.lit("INFO")))


def dataset_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(_results(spark, d), ["dataset_id"])


def _runs(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    g = r.groupBy("dataset_id").agg(F.sort_array(F.collect_list(F.struct("check_id", "severity"))).alias("results"))  # one per check
    s = scored(r, ["dataset_id"])
    return g.join(s, "dataset_id").select(F.lpad(F.col("dataset_id").cast("string"), 8, "0").alias("repo_id"), F.col("grade").alias("status"), "trust_score", "results", F.lit(None).cast("string").alias("error_message"), F.col("dataset_id").cast("double").alias("duration_s"))


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.status_summary(_runs(spark, d))


def audit_top_checks(spark: SparkSession, d: str) -> DataFrame:
    """The checks that fire most often (a top-k report)."""
    return audit.top_checks(_runs(spark, d))


def audit_known_defects(spark: SparkSession, d: str) -> DataFrame:
    return audit.known_defects(_runs(spark, d), audit.KNOWN)


def series_last_runs(spark: SparkSession, d: str) -> DataFrame:
    """Per hundred events and type: events of the last stretch of that type."""
    e = read(spark, d, "events").select(F.floor(F.col("event_id") / 100).alias("part"), "event_id", "event_type")
    r = series.last_runs(e, ["part"], "event_id", "event_type")
    return r.groupBy("part", "event_type").agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


def orders_lines_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Orders by number of lines other than three."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit(3).cast("bigint").alias("length"))
    return series.count_agreement(o, read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"], "length").select("k", "declared", "actual")


def undefined_references(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines and lines without orders."""
    o, c = read(spark, d, "orders").select(F.col("o_orderkey").alias("k")), read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"))
    return series.undefined(o, c, ["k"]).withColumn("side", F.lit("orders")).unionByName(series.undefined(c, o, ["k"]).withColumn("side", F.lit("lineitem")))


def embedding_moments(spark: SparkSession, d: str) -> DataFrame:
    """Per label: width and pooled moments of the vectors."""
    e = read(spark, d, "embeddings")
    v = series.values_of(e, ["label"], {"embedding": F.col("embedding").cast("array<double>")})
    m = series.moments(v, ["label"]).select("label", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")))
    return m.join(e.groupBy("label").agg(F.min(F.size("embedding")).cast("bigint").alias("width"), F.max(F.size("embedding")).cast("bigint").alias("width_max")), "label")


def event_spacing(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the first gap between events that is off an hour by more than a minute or an hour."""
    e = read(spark, d, "events").select("user_id", "event_id", (F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts"))).cast("double").alias("s"))
    return series.first_off_spacing(e, ["user_id"], "event_id", "s", F.lit(3600.0), 60.0).select("user_id", "event_id", "level")


def source_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Documents, declared and actual characters by plain source."""
    t = read(spark, d, "documents").select(plain_source(F.col("source")).alias("source"), "n_chars", F.char_length("text").cast("bigint").alias("chars"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("declared"), F.sum("chars").alias("actual"))


def event_properties(spark: SparkSession, d: str) -> DataFrame:
    """JSON properties of events: values of k by type."""
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.countDistinct(k).alias("kinds"))


_NAMES = [
    check_feature_dimensionality, check_intrinsics, check_task_integrity, check_language_present, check_stats, check_per_episode_stats, check_stats_match, check_episode_stats_match, check_value_sanity, check_version, check_schema_consistency,
    check_index_continuity, check_metadata_agreement, check_paths, check_monotonic, check_spacing, check_drift, check_video_files, dataset_scores, audit_summary, audit_top_checks,
    audit_known_defects, series_last_runs, orders_lines_agreement, undefined_references, embedding_moments, event_spacing, source_spellings, event_properties,
]
QUERIES = {f.__name__: f for f in _NAMES}

_F = "f AS (SELECT DISTINCT dataset_id, episode_index, frame_index, \"index\", \"timestamp\" AS ts, action FROM frames), fps AS (SELECT dataset_id, CAST(max(fps) AS DOUBLE) AS fps FROM datasets GROUP BY ALL)"
_E = "e AS (SELECT dataset_id, episode_index, max(length) AS length, max(dataset_from_index) AS lo, max(dataset_to_index) AS hi FROM episodes GROUP BY ALL)"
_FEAT = "feat AS (SELECT DISTINCT dataset_id, k AS feature, json_extract_string(features, '$.\"' || k || '\".dtype') AS dtype, CAST(json_extract(features, '$.\"' || k || '\".shape') AS BIGINT[]) AS shape FROM (SELECT dataset_id, features, unnest(json_keys(features)) AS k FROM datasets))"
_V = "v AS (SELECT dataset_id, episode_index, i - 1 AS item, CASE WHEN isfinite(action[i]) THEN CAST(action[i] AS DOUBLE) END AS value FROM (SELECT DISTINCT dataset_id, episode_index, frame_index, coalesce(action, [NULL]) AS action FROM frames), range(1, 65) AS t(i) WHERE i <= len(action))"
_BLANK = "NOT regexp_matches({}, '[^\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]')"
_TASK = f"""task AS (SELECT DISTINCT dataset_id, task_index, 'undefined' AS problem FROM frames f WHERE dataset_id IS NOT NULL AND task_index IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tasks t WHERE t.dataset_id = f.dataset_id AND t.task_index = f.task_index)
  UNION ALL SELECT DISTINCT dataset_id, task_index, 'blank' FROM tasks WHERE coalesce(__index_level_0__, task) IS NULL OR {_BLANK.format("coalesce(__index_level_0__, task)")})"""
_LANG = f"lang AS (SELECT DISTINCT dataset_id, episode_index FROM episodes WHERE len(list_filter(coalesce(tasks, []), lambda t: t IS NOT NULL AND NOT ({_BLANK.format('t')}))) = 0)"
_AGREE = """agree AS (SELECT dataset_id, episode_index, length AS declared, coalesce(n, 0) AS actual, coalesce(hi - lo <> length, false) AS span_off
  FROM e LEFT JOIN (SELECT dataset_id, episode_index, count(*) AS n FROM (SELECT DISTINCT dataset_id, episode_index, frame_index FROM frames) GROUP BY ALL) USING (dataset_id, episode_index)
  WHERE length IS NOT NULL AND (coalesce(n, 0) <> length OR coalesce(hi - lo <> length, false)))"""
_STEP = """s AS (SELECT dataset_id, episode_index, frame_index, CAST(ts AS DOUBLE) AS t, lag(CAST(ts AS DOUBLE)) OVER (PARTITION BY dataset_id, episode_index ORDER BY frame_index) AS b FROM (SELECT DISTINCT dataset_id, episode_index, frame_index, ts FROM f WHERE ts IS NOT NULL)),
mono AS (SELECT dataset_id, episode_index, min(frame_index) AS frame_index FROM s WHERE t <= b AND NOT isnan(t) AND NOT isnan(b) GROUP BY ALL),
off AS (SELECT s.*, abs(t - b - 1.0 / fps) AS dev, 1.0 / fps AS ideal FROM s JOIN fps USING (dataset_id) WHERE b IS NOT NULL),
space AS (SELECT dataset_id, episode_index, min(frame_index) AS frame_index, CASE WHEN arg_min(dev > ideal, frame_index) THEN 'fail' ELSE 'warn' END AS level FROM off WHERE NOT isnan(dev) AND (dev > ideal OR dev > 1e-4) GROUP BY ALL)"""
_SANE = "m AS (SELECT dataset_id, episode_index, item, count(*) AS n, count(value) AS k, count(*) FILTER (value <> 0) AS nz, min(value) AS lo, max(value) AS hi FROM v GROUP BY ALL)"
_HELD = "held AS (SELECT * FROM (VALUES ('dataset_id', 'int64'), ('episode_index', 'int64'), ('frame_index', 'int64'), ('index', 'int64'), ('timestamp', 'float32'), ('task_index', 'int64'), ('action', 'float32')) AS t(feature, kind))"
_POS = "g AS (SELECT DISTINCT dataset_id, episode_index, frame_index, \"index\" AS i FROM frames WHERE frame_index IS NOT NULL), p AS (SELECT *, frame_index - min(frame_index) OVER (PARTITION BY dataset_id, episode_index) AS pos FROM g)"
_DRIFT = "dt AS (SELECT dataset_id, episode_index, sum(abs(CAST(ts AS DOUBLE) - CAST(CAST(CAST(frame_index AS DOUBLE) * (1.0 / fps) AS FLOAT) AS DOUBLE))) AS total FROM (SELECT DISTINCT dataset_id, episode_index, frame_index, ts FROM f WHERE isfinite(ts)) JOIN fps USING (dataset_id) GROUP BY ALL), dr AS (SELECT *, sum(total) OVER (PARTITION BY dataset_id ORDER BY episode_index ROWS UNBOUNDED PRECEDING) AS running FROM dt)"
_KEYS = '"data/chunk_index" IS NOT NULL AND "data/file_index" IS NOT NULL'
_ABSENT = f"""SELECT DISTINCT dataset_id, "data/chunk_index" AS chunk_index, "data/file_index" AS file_index, 'absent' AS side FROM episodes ANTI JOIN data_shards USING (dataset_id, "data/chunk_index", "data/file_index") WHERE {_KEYS}"""
_UNNAMED = f"""SELECT DISTINCT dataset_id, "data/chunk_index", "data/file_index", 'unnamed' FROM data_shards ANTI JOIN episodes USING (dataset_id, "data/chunk_index", "data/file_index") WHERE {_KEYS}"""
_WIDTH = "x AS (SELECT dataset_id, episode_index, arg_min(len(action), frame_index) AS n FROM f WHERE action IS NOT NULL GROUP BY ALL)"
_VM = "v AS (SELECT dataset_id, episode_index, frame_index, CASE WHEN isfinite(action[i]) THEN CAST(action[i] AS DOUBLE) END AS value FROM (SELECT DISTINCT dataset_id, episode_index, frame_index, coalesce(action, [NULL]) AS action FROM frames), range(1, 65) AS t(i) WHERE i <= len(action))"
_IDS = ", ".join(f"'{c}'" for c in CHECKS)


def _match_sql(keys: str) -> str:
    off = "coalesce(abs({0}0 - {0}) / greatest(abs({0}), 1e-6) > 1e-4, false) AS {0}_off"
    part = f"SELECT {keys}, avg(value) AS {{0}}, stddev_pop(value) AS {{1}} FROM v"
    return f"WITH {_VM}, a AS ({part.format('mean', 'std')} GROUP BY ALL), b AS ({part.format('mean0', 'std0')} WHERE frame_index < {STORED_UP_TO} GROUP BY ALL) SELECT * FROM (SELECT {keys}, {off.format('mean')}, {off.format('std')} FROM a JOIN b USING ({keys}))"


_RES = f"""WITH {_F}, {_E}, {_TASK}, {_LANG}, {_AGREE}, {_STEP}, {_FEAT}, {_V}, {_SANE}, {_HELD}, {_POS}, {_DRIFT}, {_WIDTH},
hit AS (SELECT dataset_id, 'SEMANTIC.FEATURE_DIMENSIONALITY' AS check_id, 'FAIL' AS severity FROM x JOIN feat USING (dataset_id) WHERE feature = 'action' AND n <> list_product(shape)
  UNION ALL SELECT dataset_id, 'STATISTICAL.VALUE_SANITY', CASE WHEN k = 0 THEN 'FAIL' ELSE 'WARN' END FROM m WHERE k < n OR lo = hi
  UNION ALL SELECT dataset_id, 'STRUCTURAL.SCHEMA_CONSISTENCY', 'FAIL' FROM feat LEFT JOIN held USING (feature) WHERE dtype <> 'video' AND kind IS DISTINCT FROM dtype
  UNION ALL SELECT dataset_id, 'STRUCTURAL.INDEX_CONTINUITY', 'FAIL' FROM p JOIN e USING (dataset_id, episode_index) WHERE i IS DISTINCT FROM lo + pos
  UNION ALL SELECT dataset_id, 'STRUCTURAL.PATH_TEMPLATE_RESOLVES', 'FAIL' FROM ({_ABSENT})
  UNION ALL SELECT dataset_id, 'KNOWNBUG.TIMESTAMP_DRIFT', 'FAIL' FROM dr WHERE running > 1e-4
  UNION ALL SELECT dataset_id, 'SEMANTIC.TASK_INTEGRITY', 'FAIL' FROM task UNION ALL SELECT dataset_id, 'SEMANTIC.LANGUAGE_PRESENT', 'WARN' FROM lang
  UNION ALL SELECT dataset_id, 'STRUCTURAL.METADATA_DATA_AGREEMENT', 'FAIL' FROM agree UNION ALL SELECT dataset_id, 'TEMPORAL.TIMESTAMP_MONOTONIC', 'FAIL' FROM mono UNION ALL SELECT dataset_id, 'TEMPORAL.TIMESTAMP_SPACING', upper(level) FROM space),
ids AS (SELECT DISTINCT dataset_id, unnest([{_IDS}]) AS check_id FROM datasets),
res AS (SELECT dataset_id, check_id, coalesce(min(severity), 'INFO') AS severity FROM ids LEFT JOIN hit USING (dataset_id, check_id) GROUP BY ALL),
n AS (SELECT dataset_id, count(*) FILTER (severity = 'INFO') AS n_info, count(*) FILTER (severity = 'WARN') AS n_warn, count(*) FILTER (severity = 'FAIL') AS n_fail, count(*) FILTER (severity = 'ERROR') AS n_error FROM res GROUP BY ALL),
score AS (SELECT *, greatest(0, 100 - least(30 * n_fail, 60) - least(5 * n_warn, 20) - 10 * n_error) AS trust_score, CASE WHEN n_error > 0 THEN 'ERROR' WHEN n_fail > 0 THEN 'FAIL' WHEN n_warn > 0 THEN 'WARN' ELSE 'PASS' END AS grade,
  CAST(CASE WHEN n_error + n_fail > 0 THEN 2 WHEN n_warn > 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code FROM n)
"""

SQL = {
    "check_paths": f"{_ABSENT} UNION ALL {_UNNAMED}",
    "undefined_references": "SELECT DISTINCT o_orderkey AS k, 'orders' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'lineitem' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)",
    "check_intrinsics": "WITH e AS (SELECT label, arg_min(embedding, vec_id) AS k FROM embeddings GROUP BY label), m AS (SELECT label, len(k) AS n, k[1] AS fx, CASE WHEN len(k) >= 9 THEN k[5] ELSE k[2] END AS fy, k[3] AS cx, CASE WHEN len(k) >= 9 THEN k[6] ELSE k[4] END AS cy FROM e) SELECT label, 'short' AS finding FROM m WHERE n < 4 UNION ALL SELECT label, 'focal length' FROM m WHERE n >= 4 AND (fx <= 0 OR fy <= 0) UNION ALL SELECT label, 'principal point' FROM m WHERE n >= 4 AND (cx <= 0 OR cy <= 0)",
    "check_stats_match": _match_sql("dataset_id"),
    "check_episode_stats_match": _match_sql("dataset_id, episode_index") + " WHERE mean_off OR std_off",
    "check_feature_dimensionality": f"WITH {_F}, {_FEAT}, x AS (SELECT dataset_id, episode_index, arg_min(len(action), frame_index) AS n FROM f WHERE action IS NOT NULL GROUP BY ALL) SELECT dataset_id, list_product(shape)::BIGINT AS declared, count(*) AS episodes, count(*) FILTER (n <> list_product(shape)) AS off FROM x JOIN feat USING (dataset_id) WHERE feature = 'action' GROUP BY ALL",
    "check_task_integrity": f"WITH {_TASK} SELECT * FROM task",
    "check_language_present": f"WITH {_LANG} SELECT * FROM lang",
    "check_stats": f"WITH {_V} SELECT dataset_id, count(*) AS n, count(*) - count(value) AS n_nan, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high, count(*) FILTER (value <> 0) AS n_nonzero FROM v GROUP BY ALL",
    "check_per_episode_stats": f"WITH {_V}, m AS (SELECT dataset_id, episode_index, avg(value) AS mean FROM v GROUP BY ALL), p AS (SELECT dataset_id, avg(value) AS stored FROM v GROUP BY ALL) SELECT dataset_id, episode_index FROM m JOIN p USING (dataset_id) WHERE abs(stored - mean) / greatest(abs(mean), 1e-6) > 0.5",
    "check_value_sanity": f"WITH {_V}, m AS (SELECT dataset_id, episode_index, item, count(*) AS n, count(value) AS k, count(*) FILTER (value <> 0) AS nz, min(value) AS lo, max(value) AS hi FROM v GROUP BY ALL) SELECT dataset_id, episode_index, item, 'all NaN' AS finding FROM m WHERE k = 0 UNION ALL SELECT dataset_id, episode_index, item, 'some NaN' FROM m WHERE k > 0 AND k < n UNION ALL SELECT dataset_id, episode_index, item, CASE WHEN nz = 0 THEN 'zero' ELSE 'constant' END FROM m WHERE k > 0 AND lo = hi",
    "check_version": "SELECT DISTINCT dataset_id, codebase_version, codebase_version IN ('v2.0', 'v2.1', 'v3.0') AS supported FROM datasets",
    "check_schema_consistency": f"WITH {_FEAT}, held AS (SELECT * FROM (VALUES ('dataset_id', 'int64'), ('episode_index', 'int64'), ('frame_index', 'int64'), ('index', 'int64'), ('timestamp', 'float32'), ('task_index', 'int64'), ('action', 'float32')) AS t(feature, kind)) SELECT dataset_id, feature, dtype, CASE WHEN kind IS NULL THEN 'absent' WHEN kind = dtype THEN 'same' ELSE 'other' END AS held FROM feat LEFT JOIN held USING (feature) WHERE dtype <> 'video'",
    "check_index_continuity": f"WITH {_E}, g AS (SELECT DISTINCT dataset_id, episode_index, frame_index, \"index\" AS i FROM frames WHERE frame_index IS NOT NULL), p AS (SELECT *, frame_index - min(frame_index) OVER (PARTITION BY dataset_id, episode_index) AS pos FROM g) SELECT dataset_id, episode_index, count(*) AS rows, count(*) FILTER (i IS DISTINCT FROM lo + pos) AS breaks FROM p JOIN e USING (dataset_id, episode_index) GROUP BY ALL HAVING count(*) FILTER (i IS DISTINCT FROM lo + pos) > 0",
    "check_metadata_agreement": f"WITH {_E}, {_AGREE} SELECT * FROM agree",
    "check_monotonic": f"WITH {_F}, {_STEP} SELECT * FROM mono",
    "check_spacing": f"WITH {_F}, {_STEP} SELECT * FROM space",
    "check_drift": f"WITH {_F}, t AS (SELECT dataset_id, episode_index, sum(abs(CAST(ts AS DOUBLE) - CAST(CAST(CAST(frame_index AS DOUBLE) * (1.0 / fps) AS FLOAT) AS DOUBLE))) AS total FROM (SELECT DISTINCT dataset_id, episode_index, frame_index, ts FROM f WHERE isfinite(ts)) JOIN fps USING (dataset_id) GROUP BY ALL), r AS (SELECT *, sum(total) OVER (PARTITION BY dataset_id ORDER BY episode_index ROWS UNBOUNDED PRECEDING) AS running FROM t) SELECT dataset_id, round(sum(total), 4) AS total, min(episode_index) FILTER (running > 1e-4) AS first_breach FROM r GROUP BY ALL",
    "check_video_files": "SELECT dataset_id, camera, count(DISTINCT (chunk_index, file_index)) AS files, count(*) AS segments FROM (SELECT DISTINCT dataset_id, camera, chunk_index, file_index, episode_index FROM video_segments) GROUP BY ALL",
    "dataset_scores": _RES + "SELECT * FROM score",
    "audit_summary": _RES + "SELECT count(*) AS datasets, count(*) FILTER (grade = 'PASS') AS n_pass, count(*) FILTER (grade = 'WARN') AS n_warn, count(*) FILTER (grade = 'FAIL') AS n_fail, count(*) FILTER (grade = 'ERROR') AS n_error, CAST(0 AS BIGINT) AS n_timeout, round(100.0 * count(*) FILTER (grade IN ('FAIL', 'ERROR')) / count(*), 1) AS pct_fail_or_worse, round(100.0 * count(*) FILTER (grade <> 'PASS') / count(*), 1) AS pct_any_issue, round(avg(CAST(dataset_id AS DOUBLE)), 2) AS mean_duration_s FROM score",
    "audit_top_checks": _RES + "SELECT check_id, count(*) AS fired FROM res WHERE severity <> 'INFO' GROUP BY check_id ORDER BY fired DESC, min(lpad(CAST(dataset_id AS VARCHAR), 8, '0') || check_id) LIMIT 10",
    "audit_known_defects": _RES + ", k AS (SELECT * FROM (VALUES ('timestamp_drift', 'KNOWNBUG.TIMESTAMP_DRIFT'), ('metadata_data_agreement', 'STRUCTURAL.METADATA_DATA_AGREEMENT')) AS t(defect, check_id)) SELECT defect, count(*) FILTER (severity = 'FAIL') AS n, round(100.0 * count(*) FILTER (severity = 'FAIL') / (SELECT count(*) FROM score WHERE grade <> 'ERROR'), 1) AS pct FROM k JOIN res USING (check_id) GROUP BY defect",
    "series_last_runs": "WITH x AS (SELECT event_id // 100 AS part, event_id, event_type, event_id - row_number() OVER (PARTITION BY event_id // 100, event_type ORDER BY event_id) AS run FROM events), y AS (SELECT part, event_type, run, min(event_id) AS first_id, count(*) AS n FROM x GROUP BY ALL) SELECT part, event_type, max(first_id) AS first_id, arg_max(n, first_id) AS n FROM y GROUP BY ALL",
    "orders_lines_agreement": "SELECT o_orderkey AS k, CAST(3 AS BIGINT) AS declared, count(l_orderkey) AS actual FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) <> 3",
    "embedding_moments": "SELECT label, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS low, round(max(v), 6) AS high, CAST(min(w) AS BIGINT) AS width, CAST(max(w) AS BIGINT) AS width_max FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v, len(embedding) AS w FROM embeddings) GROUP BY label",
    "event_spacing": "WITH s AS (SELECT user_id, event_id, floor(epoch(ts)) - lag(floor(epoch(ts))) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events) SELECT user_id, min(event_id) AS event_id, CASE WHEN arg_min(abs(gap - 3600) > 3600, event_id) THEN 'fail' ELSE 'warn' END AS level FROM s WHERE abs(gap - 3600) > 60 GROUP BY user_id",
    "source_spellings": "SELECT lower(trim(source)) AS source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS declared, CAST(sum(length(text)) AS BIGINT) AS actual FROM documents GROUP BY 1",
    "event_properties": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, count(DISTINCT k) AS kinds FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
}
