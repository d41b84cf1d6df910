"""Queries of the training-data operators in the core, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.operators import compaction, intervals, orphans, regrid, schema_drift, spikes
from frameledger.operators.common import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*(read(spark, d, t) for t in ("frames", "video_segments", "episodes", "tasks")))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*(read(spark, d, t) for t in ("frames", "video_segments", "episodes", "tasks")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return regrid.missing_periods(*(read(spark, d, t) for t in ("frames", "episodes", "datasets")))


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    """Each period of each episode with its state and the task carried on."""
    g = regrid.frame_grid(*(read(spark, d, t) for t in ("frames", "episodes", "datasets")), value=F.col("task_index"))
    return g.withColumnRenamed("value", "task_index")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(read(spark, d, "info_files"), read(spark, d, "task_records"))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.consistent_table(read(spark, d, "info_files"), read(spark, d, "task_records"), all_revisions=True)


def p3_tasks(spark: SparkSession, d: str) -> DataFrame:
    """The task records of the revisions in p3_table."""
    return schema_drift.task_table(read(spark, d, "task_records"))


def p3_versions(spark: SparkSession, d: str) -> DataFrame:
    """The versions of the schema and the steps that lead from each to the table."""
    return schema_drift.schema_versions(p3_table(spark, d))


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of p3_table that every revision has."""
    return p3_table(spark, d).select("repo_id", "revision", *schema_drift.TARGET, "n_features", "n_task_keys")


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    """The columns of p3_tasks that every record has."""
    return p3_tasks(spark, d).select("repo_id", "revision", "line_no", "task_index", "task")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.superfluous_pieces(read(spark, d, "data_shards"))


def p4_plan(spark: SparkSession, d: str) -> DataFrame:
    return compaction.compaction_plan(read(spark, d, "data_shards"))


#: Fixed value: bytes of a bin in the queries that look at many bins of these small tables.
SMALL_BIN = 64 << 10


def p4_held(spark: SparkSession, d: str) -> DataFrame:
    """Per episode, packed into small bins: frames held, frames held twice, and whether it stays together unless larger than a bin."""
    plan = compaction.compaction_plan(read(spark, d, "data_shards"), SMALL_BIN)
    bytes_ = plan.groupBy(*compaction.EPISODE).agg(F.sum("est_bytes").alias("bytes"))
    h = compaction.held_frames(plan).join(bytes_, list(compaction.EPISODE))
    return h.select(*compaction.EPISODE, "frames", "doubled", ((F.col("bins") == 1) | (F.col("bytes") > SMALL_BIN)).alias("together"))


def p4_bins(spark: SparkSession, d: str) -> DataFrame:
    """Per dataset, packed into small bins: pieces, bytes, bins beyond the size that hold more than a piece, and whether all bins but one are more than half full, as first fit has it."""
    b = compaction.bin_sizes(compaction.compaction_plan(read(spark, d, "data_shards"), SMALL_BIN))
    low = F.count_if(2 * F.col("bytes") <= SMALL_BIN)
    return b.groupBy("dataset_id").agg(F.sum("pieces").alias("pieces"), F.sum("bytes").alias("bytes"), F.count_if((F.col("bytes") > SMALL_BIN) & (F.col("pieces") > 1)).alias("over"), (low <= 1).alias("full"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(read(spark, d, "frames"), read(spark, d, "datasets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.overlaps_and_gaps(read(spark, d, "episodes"), read(spark, d, "video_segments"))


def p6_periods(spark: SparkSession, d: str) -> DataFrame:
    i = intervals.dataset_intervals(read(spark, d, "episodes"), read(spark, d, "video_segments"))
    return intervals.periods(i, intervals.KEYS).withColumnsRenamed({"lo": "a", "hi": "b"})


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_grid, p3_found, p3_table, p3_tasks, p3_versions, p3_columns, p3_texts, p4_found, p4_plan, p4_held, p4_bins, p5_found, p6_found, p6_periods)}

_P1 = """
WITH refs AS (
  SELECT DISTINCT 'frames' AS src_table, 'episodes' AS ref_table, dataset_id, episode_index, episode_index AS ref_key, loaded_at FROM frames WHERE episode_index IS NOT NULL AND dataset_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'frames', 'tasks', dataset_id, episode_index, task_index, loaded_at FROM frames WHERE task_index IS NOT NULL AND dataset_id IS NOT NULL
  UNION ALL SELECT DISTINCT 'video_segments', 'episodes', dataset_id, episode_index, episode_index, loaded_at FROM video_segments WHERE episode_index IS NOT NULL AND dataset_id IS NOT NULL),
targets AS (
  SELECT DISTINCT 'episodes' AS ref_table, dataset_id, episode_index AS ref_key, loaded_at AS since, deleted_at AS until FROM episodes
  UNION ALL SELECT DISTINCT 'tasks', dataset_id, task_index, loaded_at, deleted_at FROM tasks),
j AS (
  SELECT r.*, count(t.ref_key) AS n, coalesce(bool_or(t.since <= r.loaded_at AND (t.until IS NULL OR t.until > r.loaded_at)), false) AS good, coalesce(bool_and(t.since > r.loaded_at), false) AS late
  FROM refs r LEFT JOIN targets t ON r.ref_table = t.ref_table AND r.dataset_id = t.dataset_id AND r.ref_key = t.ref_key GROUP BY ALL),
found AS (
  SELECT DISTINCT src_table, ref_table, strftime(loaded_at, '%Y-%m') AS period, dataset_id, episode_index, ref_key, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS kind
  FROM j WHERE NOT good)
"""

_P2 = """
WITH e AS (SELECT dataset_id, episode_index, max(length) AS length FROM episodes WHERE length IS NOT NULL GROUP BY ALL),
g AS (SELECT dataset_id, episode_index, unnest(range(length)) AS grid_index FROM e),
d AS (SELECT dataset_id, max(fps) AS fps FROM datasets GROUP BY ALL),
r AS (SELECT dataset_id, episode_index, CAST(floor(CAST("timestamp" AS DOUBLE) * fps + 0.5) AS BIGINT) AS grid_index, min(task_index) AS task_index
  FROM frames JOIN d USING (dataset_id) WHERE isfinite("timestamp") AND abs("timestamp") < 1e12 GROUP BY ALL)
"""

_P4 = """
WITH p AS (SELECT DISTINCT dataset_id, "data/chunk_index" AS chunk_index, "data/file_index" AS file_index, episode_index, from_frame, to_frame, greatest(to_frame - from_frame, 0) AS n, written_at FROM data_shards)
SELECT DISTINCT a.dataset_id, a.chunk_index, a.file_index, a.episode_index FROM p a WHERE EXISTS (
  SELECT 1 FROM p b WHERE b.dataset_id = a.dataset_id AND b.episode_index = a.episode_index AND (b.chunk_index, b.file_index) <> (a.chunk_index, a.file_index) AND b.n > 0
  AND (a.n = 0 OR (b.from_frame <= a.from_frame AND b.to_frame >= a.to_frame))
  AND (b.n > a.n OR b.written_at > a.written_at OR (b.written_at = a.written_at AND (b.chunk_index, b.file_index) < (a.chunk_index, a.file_index))))
"""

_P4K = """
WITH r AS (SELECT DISTINCT dataset_id, episode_index, "data/chunk_index" AS chunk_index, "data/file_index" AS file_index, from_frame AS lo, to_frame AS hi, size_bytes, written_at FROM data_shards WHERE from_frame < to_frame),
k AS (SELECT * FROM r a WHERE NOT EXISTS (
  SELECT 1 FROM r b WHERE b.dataset_id = a.dataset_id AND b.episode_index = a.episode_index AND (b.chunk_index, b.file_index) <> (a.chunk_index, a.file_index) AND b.lo <= a.lo AND b.hi >= a.hi
  AND (b.hi - b.lo > a.hi - a.lo OR b.written_at > a.written_at OR (b.written_at = a.written_at AND (b.chunk_index, b.file_index) < (a.chunk_index, a.file_index))))),
m AS (SELECT *, greatest(lo, coalesce(max(hi) OVER (PARTITION BY dataset_id, episode_index ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS from_frame FROM k),
plan AS (SELECT dataset_id, episode_index, chunk_index, file_index, from_frame, hi AS to_frame, CAST(ceil(coalesce(size_bytes, 0) * ((hi - from_frame) / (hi - lo))) AS BIGINT) AS est_bytes FROM m WHERE from_frame < hi)
"""

#: Frames of an episode by walking through all pieces in order of their starts; nothing of the plan is used.
_P4H = """
WITH r AS (SELECT DISTINCT dataset_id, episode_index, from_frame AS lo, to_frame AS hi FROM data_shards WHERE from_frame < to_frame),
w AS (SELECT *, greatest(lo, coalesce(max(hi) OVER (PARTITION BY dataset_id, episode_index ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS since FROM r)
SELECT dataset_id, episode_index, CAST(sum(greatest(hi - since, 0)) AS BIGINT) AS frames, CAST(0 AS BIGINT) AS doubled, true AS together FROM w GROUP BY ALL
"""

_P5 = """
WITH one AS (SELECT DISTINCT dataset_id, episode_index, frame_index, "timestamp" AS ts, action FROM frames),
long AS (
  SELECT dataset_id, episode_index, frame_index, -1 AS component, CAST(ts AS DOUBLE) AS v FROM one
  UNION ALL SELECT dataset_id, episode_index, frame_index, i - 1, CAST(action[i] AS DOUBLE) FROM one, range(1, 65) AS t(i) WHERE i <= len(action)),
bad AS (SELECT * FROM long WHERE NOT isfinite(v) OR (component = -1 AND v < 0)),
ok AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, episode_index, component ORDER BY frame_index) AS n FROM long WHERE v IS NOT NULL AND isfinite(v)),
nb AS (SELECT *, lag(v) OVER w AS l1, lag(v, 2) OVER w AS l2, lag(v, 3) OVER w AS l3, lead(v) OVER w AS r1, lead(v, 2) OVER w AS r2, lead(v, 3) OVER w AS r3
  FROM ok WINDOW w AS (PARTITION BY dataset_id, episode_index, component ORDER BY n)),
fps AS (SELECT dataset_id, max(fps) AS fps FROM datasets GROUP BY ALL),
step AS (SELECT dataset_id, component, CASE WHEN component = -1 THEN 1.0 / max(fps) ELSE quantile_cont(abs(v - l1), 0.75) FILTER (v <> l1) END AS s, avg(CASE WHEN v = l1 THEN 1.0 ELSE 0.0 END) AS same
  FROM nb JOIN fps USING (dataset_id) WHERE l1 IS NOT NULL GROUP BY dataset_id, component),
hit AS (
  SELECT nb.*, list_filter([0, 1, 2, -1, -2, -3], lambda k: CASE k
    WHEN 0 THEN least(abs(v - l1), abs(v - r1)) > 20 * s AND l1 IS NOT NULL AND r1 IS NOT NULL
    WHEN 1 THEN least(abs(v - l1), abs(v - r2), abs(r1 - l1), abs(r1 - r2)) > 20 * s AND l1 IS NOT NULL AND r2 IS NOT NULL
    WHEN 2 THEN least(abs(v - l1), abs(v - r3), abs(r1 - l1), abs(r1 - r3), abs(r2 - l1), abs(r2 - r3)) > 20 * s AND l1 IS NOT NULL AND r3 IS NOT NULL
    WHEN -1 THEN least(abs(v - l2), abs(v - r1), abs(l1 - l2), abs(l1 - r1)) > 20 * s AND l2 IS NOT NULL AND r1 IS NOT NULL
    WHEN -2 THEN least(abs(v - l3), abs(v - r1), abs(l1 - l3), abs(l1 - r1), abs(l2 - l3), abs(l2 - r1)) > 20 * s AND l3 IS NOT NULL AND r1 IS NOT NULL
    ELSE least(abs(v - l2), abs(v - r2), abs(l1 - l2), abs(l1 - r2), abs(r1 - l2), abs(r1 - r2)) > 20 * s AND l2 IS NOT NULL AND r2 IS NOT NULL END) AS ks
  FROM nb JOIN step USING (dataset_id, component)),
runs AS (SELECT *, sum(CASE WHEN v = l1 THEN 0 ELSE 1 END) OVER (PARTITION BY dataset_id, episode_index, component ORDER BY n) AS run FROM nb),
stuck AS (SELECT *, count(*) OVER (PARTITION BY dataset_id, episode_index, component, run) AS c FROM runs)
SELECT DISTINCT dataset_id, episode_index, frame_index, CAST(component AS BIGINT) AS component FROM (
  SELECT dataset_id, episode_index, frame_index, component FROM bad
  UNION ALL SELECT dataset_id, episode_index, frame_index, component FROM hit WHERE len(ks) > 0
  UNION ALL SELECT dataset_id, episode_index, frame_index, component FROM stuck JOIN step USING (dataset_id, component) WHERE c >= 8 AND same <= 0.5)
"""

_P6 = """
WITH i AS (
  SELECT DISTINCT 'episodes' AS src_table, dataset_id, '' AS camera, "meta/episodes/chunk_index" AS chunk_index, CAST(-1 AS BIGINT) AS file_index, episode_index AS m, dataset_from_index AS lo, dataset_to_index AS hi
  FROM episodes WHERE dataset_from_index < dataset_to_index
  UNION ALL SELECT DISTINCT 'video_segments', dataset_id, camera, chunk_index, file_index, episode_index, CAST(round(from_timestamp * 1000) AS BIGINT), CAST(round(to_timestamp * 1000) AS BIGINT)
  FROM video_segments WHERE round(from_timestamp * 1000) < round(to_timestamp * 1000)),
o AS (
  SELECT DISTINCT 'overlap' AS kind, x.src_table, x.dataset_id, x.camera, x.chunk_index, x.file_index, x.m AS a, y.m AS b
  FROM i x JOIN i y ON x.src_table = y.src_table AND x.dataset_id = y.dataset_id AND x.camera = y.camera AND x.chunk_index = y.chunk_index AND x.file_index = y.file_index AND x.m < y.m AND x.lo < y.hi AND y.lo < x.hi),
r AS (SELECT *, max(hi) OVER (PARTITION BY src_table, dataset_id, camera, chunk_index, file_index ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT DISTINCT 'gap' AS kind, src_table, dataset_id, camera, chunk_index, file_index, reach AS a, lo AS b FROM r WHERE reach < lo),
n AS (SELECT *, sum(CASE WHEN reach >= lo THEN 0 ELSE 1 END) OVER (PARTITION BY src_table, dataset_id, camera, chunk_index, file_index ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM r)
"""

_KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'NULL' THEN NULL ELSE 'number' END"
_P3 = f"""
WITH b AS (SELECT repo_id, revision, CAST(body AS JSON) AS j FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, revision ORDER BY written_at DESC, file_id DESC) AS k FROM info_files WHERE CASE WHEN json_valid(body) THEN json_type(body) = 'OBJECT' ELSE false END) WHERE k = 1),
ik AS (SELECT repo_id, revision, k AS field, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM b)),
fk AS (SELECT repo_id, revision, k AS field, json_extract(v, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(v)) AS k FROM ik WHERE field = 'features' AND json_type(v) = 'OBJECT')),
t AS (SELECT repo_id, revision, CAST(record AS JSON) AS j FROM task_records WHERE CASE WHEN json_valid(record) THEN json_type(record) = 'OBJECT' ELSE false END),
tk AS (SELECT repo_id, revision, k AS field, {_KIND.format("json_extract(j, '$." + '"' + "' || k || '" + '"' + "')")} AS kind FROM (SELECT *, unnest(json_keys(j)) AS k FROM t)),
tn AS (SELECT repo_id, revision, field, kind, count(*) AS n FROM tk WHERE kind IS NOT NULL GROUP BY ALL),
flat AS (
  SELECT repo_id, revision, 'info' AS scope, field, {_KIND.format("v")} AS kind, CAST(NULL AS VARCHAR) AS shape, CASE WHEN {_KIND.format("v")} = 'number' THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS same, ltrim(json_extract_string(v, '$'), 'v') AS bare
  FROM ik WHERE json_type(v) <> 'NULL'
  UNION ALL SELECT repo_id, revision, 'feature', field, json_extract_string(v, '$.dtype'), CAST(CAST(json_extract(v, '$.shape') AS BIGINT[]) AS VARCHAR), json_extract_string(v, '$.dtype') || CAST(CAST(json_extract(v, '$.shape') AS BIGINT[]) AS VARCHAR), NULL FROM fk WHERE json_type(v) <> 'NULL'
  UNION ALL SELECT repo_id, revision, 'task', field, kind, NULL, kind, NULL FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, revision, field ORDER BY n DESC, kind) AS k FROM tn) WHERE k = 1),
revs AS (SELECT s.scope, repo_id, revision, lag(revision) OVER (PARTITION BY s.scope, repo_id ORDER BY revision) AS before FROM (
  SELECT 'info' AS scope, repo_id, revision FROM b UNION ALL SELECT 'feature', repo_id, revision FROM b UNION ALL SELECT DISTINCT 'task', repo_id, revision FROM t) s),
o AS (SELECT r.scope, r.repo_id, r.revision, f.field, f.kind, f.shape, f.same, f.bare FROM revs r JOIN flat f ON f.scope = r.scope AND f.repo_id = r.repo_id AND f.revision = r.before),
n AS (SELECT f.* FROM revs r JOIN flat f ON f.scope = r.scope AND f.repo_id = r.repo_id AND f.revision = r.revision WHERE r.before IS NOT NULL),
gone AS (SELECT *, row_number() OVER (PARTITION BY scope, repo_id, revision, same ORDER BY field) AS k FROM o ANTI JOIN n USING (scope, repo_id, revision, field)),
came AS (SELECT *, row_number() OVER (PARTITION BY scope, repo_id, revision, same ORDER BY field) AS k FROM n ANTI JOIN o USING (scope, repo_id, revision, field)),
stay AS (SELECT o.scope, o.repo_id, o.revision, o.field, o.kind AS k0, n.kind AS k1, o.shape AS s0, n.shape AS s1, o.bare AS b0, n.bare AS b1 FROM o JOIN n USING (scope, repo_id, revision, field))
SELECT repo_id, revision, scope, coalesce(g.field, c.field) AS field, CASE WHEN c.field IS NULL THEN 'removed' WHEN g.field IS NULL THEN 'added' ELSE 'renamed' END AS change FROM gone g FULL JOIN came c USING (scope, repo_id, revision, same, k)
UNION ALL SELECT repo_id, revision, scope, field, 'retyped' FROM stay WHERE k0 <> k1
UNION ALL SELECT repo_id, revision, scope, field, 'reshaped' FROM stay WHERE scope = 'feature' AND s0 IS DISTINCT FROM s1
UNION ALL SELECT repo_id, revision, scope, field, 'version' FROM stay WHERE scope = 'info' AND field = 'codebase_version' AND b0 <> b1
"""

#: A value as text, as the table has it before its casts.
_TEXT = "json_extract_string(j, '$.{0}')"
_P3C = (
    "WITH changes AS (" + _P3 + "), "
    + _P3[_P3.index("b AS (") : _P3.index("ik AS (")]
    + _P3[_P3.index("t AS (SELECT repo_id") : _P3.index("tn AS (")].rstrip().rstrip(",")
    + """,
v AS (SELECT repo_id, revision, j, json_type(json_extract(j, '$.codebase_version')) AS kind, EXISTS (SELECT 1 FROM changes WHERE scope = 'info' AND change = 'renamed' AND field IN ('robot', 'robot_type')) AS alike FROM b),
c AS (SELECT repo_id, revision, 'v' || ltrim(CASE WHEN kind = 'VARCHAR' THEN """ + _TEXT.format("codebase_version") + """ ELSE CAST(CAST(""" + _TEXT.format("codebase_version") + """ AS DOUBLE) AS VARCHAR) END, 'v') AS codebase_version,
  TRY_CAST(""" + _TEXT.format("fps") + """ AS DOUBLE) AS fps, TRY_CAST(TRY_CAST(""" + _TEXT.format("total_episodes") + """ AS DOUBLE) AS BIGINT) AS total_episodes, TRY_CAST(TRY_CAST(""" + _TEXT.format("total_frames") + """ AS DOUBLE) AS BIGINT) AS total_frames,
  coalesce(""" + _TEXT.format("robot_type") + """, CASE WHEN alike THEN """ + _TEXT.format("robot") + """ END, 'unknown') AS robot_type,
  CAST(coalesce(len(list_filter(json_keys(j, '$.features'), lambda k: json_type(json_extract(j, '$.features."' || k || '"')) <> 'NULL')), 0) AS BIGINT) AS n_features FROM v),
k AS (SELECT t.repo_id, t.revision, count(DISTINCT field) FILTER (kind IS NOT NULL) AS n_task_keys FROM (SELECT DISTINCT repo_id, revision FROM t) t LEFT JOIN tk USING (repo_id, revision) GROUP BY ALL)
SELECT repo_id, revision, codebase_version, fps, total_episodes, total_frames, coalesce(robot_type, 'unknown') AS robot_type, n_features, n_task_keys FROM c FULL JOIN k USING (repo_id, revision)"""
)

SQL = {
    "p3_columns": _P3C,
    "p3_texts": "SELECT repo_id, revision, line_no, TRY_CAST(TRY_CAST(json_extract_string(j, '$.task_index') AS DOUBLE) AS BIGINT) AS task_index, coalesce(json_extract_string(j, '$.__index_level_0__'), json_extract_string(j, '$.task')) AS task FROM (SELECT DISTINCT repo_id, revision, line_no, list_sort(list_transform(json_keys(CAST(record AS JSON)), lambda k: k || CAST(json_extract(CAST(record AS JSON), '$.\"' || k || '\"') AS VARCHAR))) AS content, any_value(CAST(record AS JSON)) AS j FROM task_records WHERE CASE WHEN json_valid(record) THEN json_type(record) = 'OBJECT' ELSE false END GROUP BY repo_id, revision, line_no, content)",
    "p3_found": _P3,
    "p1_found": _P1 + "SELECT * FROM found",
    "p1_report": _P1 + "SELECT src_table, ref_table, period, kind, count(*) AS refs, count(DISTINCT (dataset_id, ref_key)) AS keys FROM found GROUP BY ALL",
    "p2_found": _P2 + "SELECT dataset_id, episode_index, grid_index FROM g ANTI JOIN r USING (dataset_id, episode_index, grid_index)",
    "p2_grid": _P2
    + """, j AS (SELECT g.*, r.grid_index AS own, r.task_index FROM g LEFT JOIN r USING (dataset_id, episode_index, grid_index)),
k AS (SELECT *, max(own) OVER (PARTITION BY dataset_id, episode_index ORDER BY grid_index ROWS UNBOUNDED PRECEDING) AS filled_from FROM j)
SELECT k.dataset_id, k.episode_index, k.grid_index, r.task_index, CASE WHEN own IS NOT NULL THEN 'reading' WHEN filled_from IS NOT NULL THEN 'filled' ELSE 'missing' END AS state, filled_from
FROM k LEFT JOIN r ON r.dataset_id = k.dataset_id AND r.episode_index = k.episode_index AND r.grid_index = k.filled_from""",
    "p4_found": _P4,
    # one bin of 128 MB holds each of these datasets
    "p4_plan": _P4K + "SELECT *, CAST(0 AS BIGINT) AS bin_group, CAST(0 AS BIGINT) AS bin_no FROM plan",
    "p4_held": _P4H,
    "p4_bins": _P4K + "SELECT dataset_id, count(*) AS pieces, CAST(sum(est_bytes) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS over, true AS full FROM plan GROUP BY dataset_id",
    "p5_found": _P5,
    "p6_found": _P6 + "SELECT * FROM o UNION ALL BY NAME SELECT * FROM g",
    "p6_periods": _P6 + "SELECT src_table, dataset_id, camera, chunk_index, file_index, min(lo) AS a, max(hi) AS b FROM n GROUP BY src_table, dataset_id, camera, chunk_index, file_index, run",
}
