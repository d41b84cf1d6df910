"""Feature widths, tasks, camera intrinsics, language."""

from __future__ import annotations


from pyspark.sql import functions as F

from frameledger.checks.engine import CheckContext, check, found, passed, require_shards
from frameledger.errors import CheckExecutionError
from frameledger.functions.columns import is_blank
from frameledger.operators.series import intrinsics, undefined, without_text
from frameledger.sources.info import Feature
from frameledger.sources.loader import TrajectoryDataset
from frameledger.verdict import CheckResult, Severity

_SAMPLE = 5


@check("SEMANTIC.FEATURE_DIMENSIONALITY", Severity.FAIL)
def feature_dimensionality(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Stored width and number of axis names against the declared shape; the first episode that is off.

    A fixed-size list has its width in the footer; of another list the first value of the episode counts.
    """
    me = "SEMANTIC.FEATURE_DIMENSIONALITY"
    want = ds.spark.createDataFrame([(i, f.name, f.width, None if f.names is None else len(f.names)) for i, f in enumerate(ds.columns)], "place int, name string, declared int, n_names int")
    cols = ds.footers.filter("error is null").select("path", F.explode("columns").alias("c")).select("path", "c.name", "c.width")
    open_ = [r.name for r in cols.filter("width is null").join(want, "name").select("name").distinct().collect()]
    counted = ds.core(open_) if ds.broken_shards == [] else None
    require_shards(ds)
    first = counted.groupBy("ord").agg(F.min_by(F.array(*(F.coalesce(F.size(F.col(f"`{n}`")), F.lit(1)) if n in open_ else F.lit(1) for n in open_), F.lit(0)), "row").alias("sizes"))
    width = F.coalesce("width", *(F.when(F.col("name") == n, F.element_at("sizes", i + 1)) for i, n in enumerate(open_)), F.lit(1))
    # episodes without rows are skipped: they have no first row
    rows = ds.episodes.join(first, "ord").join(cols.withColumnRenamed("path", "shard"), "shard").join(F.broadcast(want), "name").withColumn("actual", width)
    bad = rows.filter("actual <> declared or n_names <> declared")
    at = bad.agg(F.min("ord")).first()[0]
    if at is None:
        return passed(me, "Widths and axis names fit the declared shapes.")
    items = []
    for r in bad.filter(F.col("ord") == at).orderBy("place").collect():
        shape = ds.info.features[r.name].shape
        if r.actual != r.declared:
            items.append(f"episode {r.episode_index}: feature {r.name!r} has {r.actual} values, shape {shape} asks for {r.declared}")
        if r.n_names is not None and r.n_names != r.declared:
            items.append(f"episode {r.episode_index}: feature {r.name!r} has {r.n_names} axis names, shape {shape} asks for {r.declared}")
    return found(me, Severity.FAIL, "Features do not have their declared width", items, "mismatches")


@check("SEMANTIC.TASK_INTEGRITY", Severity.FAIL)
def task_integrity(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Task numbers of frames that the task table lacks, and tasks without a text."""
    me = "SEMANTIC.TASK_INTEGRITY"
    used = ds.core(["task_index"])
    if not used.filter("task_index is null").isEmpty():
        raise CheckExecutionError("a null task_index")
    lost = undefined(used, ds.tasks, ["task_index"]).orderBy("task_index").toLocalIterator()
    blank = ds.tasks.filter(is_blank(F.col("task"))).orderBy("ord").toLocalIterator()
    items = [f"task_index {r.task_index} of frames is not in the task table" for r in lost] + [f"task_index {r.task_index} has no text" for r in blank]
    return found(me, Severity.FAIL, "Tasks are undefined or without text", items, "violations") if items else passed(me, "All tasks of frames are defined and have a text.")


def is_intrinsics(f: Feature) -> bool:
    """Names and shapes by which a camera matrix is known."""
    name = f.name.lower()
    return "intrinsic" in name or "camera_matrix" in name or (f.name == "K" and f.shape in ((3, 3), (9,)))


@check("SEMANTIC.CAMERA_INTRINSICS_PLAUSIBLE", Severity.INFO)
def camera_intrinsics(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Focal lengths and principal point of the first frame must be positive; never more than INFO."""
    me = "SEMANTIC.CAMERA_INTRINSICS_PLAUSIBLE"
    features = [f for f in ds.columns if is_intrinsics(f)]
    if not features:
        return passed(me, "Skipped: no camera intrinsics are declared.")
    names = [f.name for f in features]
    first = ds.frames(names, optional=True).filter("ord = 0").orderBy("row").limit(1)
    arrays = [F.col(f"`{n}`").cast("array<double>") if dict(first.dtypes)[n].startswith("array") else F.when(F.col(f"`{n}`").isNotNull(), F.array(F.col(f"`{n}`").cast("double"))) for n in names]
    row = first.select(*(F.struct(F.size(v).alias("size"), *(x.alias(k) for k, x in intrinsics(v).items())).alias(f"c{i}") for i, v in enumerate(arrays))).collect()
    items = []
    for n, k in zip(names, row[0] if row else (), strict=False):
        if k.short:
            items.append(f"feature {n!r}: {k.size} values, at least 4 are needed")
        if k.focal:
            items.append(f"feature {n!r}: focal lengths {k.fx:.4f}, {k.fy:.4f} are not positive")
        if k.centre:
            items.append(f"feature {n!r}: principal point {k.cx:.4f}, {k.cy:.4f} is not positive")
    if items:
        return found(me, Severity.INFO, "Camera intrinsics are implausible", items, "violations", intrinsics_features=names)
    return passed(me, f"Camera intrinsics look plausible: {', '.join(names)}.", intrinsics_features=names)


@check("SEMANTIC.LANGUAGE_PRESENT", Severity.WARN)
def language_present(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    me = "SEMANTIC.LANGUAGE_PRESENT"
    bad = [r.episode_index for r in without_text(ds.episodes, "tasks").orderBy("ord").select("episode_index").toLocalIterator()]
    if not bad:
        return passed(me, "Every episode has a task text.")
    return CheckResult(me, Severity.WARN, f"{len(bad)} episode(s) have no task text, such as {bad[:_SAMPLE]}.", {"empty_episode_indices": bad})


