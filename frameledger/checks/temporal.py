"""Timestamps: order, spacing, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameledger.checks.engine import CheckContext, check, found, passed, require_shards
from frameledger.errors import CheckExecutionError
from frameledger.functions.columns import py_gt
from frameledger.operators.series import BLOCK, drift, first_not_increasing, first_off_spacing
from frameledger.sources.loader import TrajectoryDataset
from frameledger.verdict import CheckResult, Severity

#: Fixed value: seconds a decoder tolerates.
TOLERANCE = 1e-4


def _frames(ds: TrajectoryDataset, *cols: str) -> DataFrame:
    d = ds.placed(list(cols))
    if not d.filter(" or ".join(f"{c} is null" for c in cols)).isEmpty():
        raise CheckExecutionError(f"a null in {' or '.join(cols)}")
    return d.select("ord", "position", *cols)


def _name(ds: TrajectoryDataset, rows: DataFrame) -> DataFrame:
    return rows.join(ds.episodes.select("ord", "episode_index"), "ord")


@check("TEMPORAL.TIMESTAMP_MONOTONIC", Severity.FAIL)
def timestamp_monotonic(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Strictly rising timestamps; the first offence of the first episode that has one."""
    me = "TEMPORAL.TIMESTAMP_MONOTONIC"
    bad = first_not_increasing(_frames(ds, "timestamp"), ["ord"], "position", "timestamp")
    row = _name(ds, bad).orderBy("ord").limit(1).collect()
    require_shards(ds)
    if not row:
        return passed(me, "Timestamps rise strictly in every episode.")
    r = row[0]
    item = f"episode {r.episode_index}: timestamp {r.ts:.6f} of frame {r.position} is not later than {r.before:.6f} of the frame before"
    return found(me, Severity.FAIL, "Timestamps do not rise", [item], "violations")


@check("TEMPORAL.TIMESTAMP_SPACING", Severity.FAIL)
def timestamp_spacing(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Gaps of 1/fps. The first gap of an episode that is off decides on it; the first failing episode ends the check."""
    me = "TEMPORAL.TIMESTAMP_SPACING"
    if ds.info.fps == 0:
        raise CheckExecutionError("fps is 0")
    ideal = 1.0 / ds.info.fps
    d = _frames(ds, "timestamp").join(ds.episodes.filter("length >= 2").select("ord"), "ord", "left_semi")
    off = ds.keep(_name(ds, first_off_spacing(d, ["ord"], "position", "timestamp", F.lit(ideal), TOLERANCE)))
    stop = off.filter("level = 'fail'").agg(F.min("ord")).first()[0]
    require_shards(ds, stop)
    seen = off if stop is None else off.filter(F.col("ord") <= stop)
    text = lambda r: f"episode {r.episode_index} frame {r.position}: gap of {r.gap:.6f}s is off {ideal:.6f}s by {r.deviation:.6f}s"
    warns = [text(r) for r in seen.filter("level = 'warn'").orderBy("ord").toLocalIterator()]
    if stop is not None:
        fails = [text(r) for r in off.filter(F.col("ord") == stop).collect()]
        return found(me, Severity.FAIL, "Frames are missing or out of place", fails, "fails", warns=warns, ideal_spacing_s=ideal)
    if warns:
        return found(me, Severity.WARN, "Spacing is off by more than decoders tolerate", warns, "warns", ideal_spacing_s=ideal)
    return passed(me, f"Spacing fits {ds.info.fps} frames a second.", ideal_spacing_s=ideal)


@check("KNOWNBUG.TIMESTAMP_DRIFT", Severity.FAIL)
def timestamp_drift(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Sum over all frames, episode by episode, of |timestamp - frame_index / fps|, beyond the tolerance.

    Sums per episode, then a scan over episodes, then one over the blocks of the episode where it is
    passed. A NaN ends the part in which it could be passed, and makes the total NaN.
    """
    me = "KNOWNBUG.TIMESTAMP_DRIFT"
    if "frame_index" not in ds.info.features:
        return passed(me, "Skipped: no feature frame_index is declared.")
    if ds.info.fps == 0:
        raise CheckExecutionError("fps is 0")
    exact = ds.info.features["timestamp"].dtype == "float64" if "timestamp" in ds.info.features else False
    d = _frames(ds, "frame_index", "timestamp").withColumn("amount", drift(F.col("frame_index"), F.col("timestamp"), F.lit(float(ds.info.fps)), F.lit(exact)))
    require_shards(ds)
    nan = d.filter(F.isnan("amount")).agg(F.min(F.struct("ord", "position"))).first()[0]
    good = d if nan is None else d.filter((F.col("ord") < nan[0]) | ((F.col("ord") == nan[0]) & (F.col("position") < nan[1])))
    block = F.floor(F.col("position") / BLOCK)
    sums = ds.keep(good.groupBy("ord", block.alias("block")).agg(F.sum("amount").alias("total")))
    per = sums.groupBy("ord").agg(F.sum("total").alias("total"))
    upto = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)  # a row per episode
    hit = per.withColumn("upto", F.sum("total").over(upto)).filter(py_gt(F.col("upto"), F.lit(TOLERANCE))).orderBy("ord").limit(1).collect()
    total = float("nan") if nan is not None else (sums.agg(F.sum("total")).first()[0] or 0.0)
    if not hit:
        return passed(me, f"No drift: {total:.6f}s in all.", cumulative_drift_s=total)
    o, before = hit[0].ord, hit[0].upto - hit[0].total
    at = sums.filter(F.col("ord") == o).withColumn("upto", F.lit(before) + F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)))
    b = at.filter(F.col("upto") > TOLERANCE).orderBy("block").first()
    first = hit[0].upto
    if b is not None:
        rows = good.filter((F.col("ord") == o) & (block == b.block)).withColumn("upto", F.lit(b.upto - b.total) + F.sum("amount").over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))
        r = rows.filter(F.col("upto") > TOLERANCE).orderBy("position").first()
        first = r.upto if r is not None else first
    episode = ds.episodes.filter(F.col("ord") == o).first().episode_index
    return CheckResult(me, Severity.FAIL, f"Timestamps drift from frame_index / fps: {first:.6f}s have gathered in episode {episode}, more than {TOLERANCE}s.", {"cumulative_drift_s": total, "episode_index": episode})
