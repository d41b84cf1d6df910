"""Stored statistics against recomputed ones; degenerate values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.checks.engine import CheckContext, check, found, passed, require_shards
from frameledger.errors import CheckExecutionError
from frameledger.operators.series import BLOCK, moments, off_tolerance, ordered_moments, pooled, sanity, values_of
from frameledger.sources.info import Feature
from frameledger.sources.loader import TrajectoryDataset, stored_episode_stats, stored_stats
from frameledger.verdict import CheckResult, Severity

#: Relative tolerance, floor of the denominator, episodes' findings after which a check stops.
RTOL, ATOL = 1e-4, 1e-6
_STATS_CAP, _SANITY_CAP = 10, 20
_REMOTE = "Skipped: too slow on remote data unless asked to go deep."


def _features(ds: TrajectoryDataset, features: list[Feature]) -> list[str]:
    """Those that some data file has."""
    have = {r.name for r in ds.footers.select(F.explode("columns.name").alias("name")).distinct().collect()}
    return [f.name for f in features if f.name in have]


def _values(ds: TrajectoryDataset, names: list[str]) -> DataFrame:
    """ord, row, feature, item, value of the numeric features, null as NaN; a file without the feature has no values of it."""
    d = ds.frames(names, optional=True)
    kinds = dict(d.dtypes)
    files = ds.footers.select("path", F.col("columns.name").alias("_has"))
    d = d.join(files, "path")
    if texts := [n for n in names if "string" in kinds[n]]:
        raise CheckExecutionError(f"feature {texts[0]!r} holds texts")
    one = {n: (F.col(f"`{n}`") if kinds[n].startswith("array") else F.array(F.col(f"`{n}`").cast("double"))) for n in names}
    v = values_of(d, ["ord", "row", "_has"], one)
    return v.filter(F.array_contains("_has", F.col("feature"))).drop("_has")


def _moments(ds: TrajectoryDataset, names: list[str]) -> DataFrame:
    """Moments of every numeric feature by episode, computed once for all checks of this module."""
    with ds.lock:
        if "moments" not in ds.shared:
            ds.shared["moments"] = ds.keep(moments(_values(ds, _features(ds, [f for f in ds.features if f.is_numeric])), ["ord", "feature"]))
    return ds.shared["moments"].filter(F.col("feature").isin(names))


def _with_order(ds: TrajectoryDataset, m: DataFrame, keys: list[str], names: list[str], whole: bool) -> DataFrame:
    """keys, mean, std from moments; groups with NaN are folded again in the order of the rows."""
    dirty = m.filter("n_nan > 0").select(*keys)
    clean = m.filter("n_nan = 0").select(*keys, "mean", "std")
    if dirty.isEmpty():
        return clean
    v = _values(ds, names).join(dirty, keys, "left_semi")
    row = F.floor(F.col("row") / BLOCK)
    block = F.col("ord") * F.lit(1 << 20) + row if whole else row
    return clean.unionByName(ordered_moments(v, keys, ["ord", "row", "item"], block).select(*keys, "mean", "std"))


def _numbers(value: Any) -> list[float] | None:
    """Numbers of a (nested) list or a number, nulls and whatever else is in it left out; None if there are none."""
    if isinstance(value, int | float):
        return [float(value)]
    out = [x for item in value for x in _numbers(item) or ()] if isinstance(value, list) else []
    return out or None


@check("STATISTICAL.STATS_MATCH_DATA", Severity.FAIL)
def stats_match_data(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Mean and std in meta/stats.json against those of the data; each stored component is held against the feature's pooled value."""
    me = "STATISTICAL.STATS_MATCH_DATA"
    if ds.is_remote and not ctx.deep:
        return passed(me, _REMOTE)
    stored = stored_stats(ds)
    if stored is None:
        return passed(me, "Skipped: there is no meta/stats.json.")
    require_shards(ds)
    names = _features(ds, [f for f in ds.features if f.is_numeric])
    rows = []
    for place, n in enumerate(names):
        s = stored.get(n)
        if not isinstance(s, dict) or s.get("mean") is None or s.get("std") is None:
            continue
        mean, std = _numbers(s["mean"]), _numbers(s["std"])
        if mean is not None and std is not None:
            rows += [(place, n, i, len(mean), len(std), a, b) for i, (a, b) in enumerate(zip(mean, std, strict=False))]
    d = ds.spark.createDataFrame(rows, "place int, feature string, item int, n_mean int, n_std int, mean0 double, std0 double")
    stated = list(dict.fromkeys(r[1] for r in rows))
    m = pooled(_moments(ds, stated), ["feature"])
    got = _with_order(ds, m, ["feature"], stated, True)
    zero = F.lit(0.0)
    j = d.join(got, "feature", "left").withColumns({"mean": F.coalesce("mean", zero), "std": F.coalesce("std", zero)})
    j = j.withColumns({"off_mean": off_tolerance(F.col("mean0"), F.col("mean"), RTOL), "off_std": off_tolerance(F.col("std0"), F.col("std"), RTOL)})
    items = []
    for r in j.filter("off_mean or off_std").orderBy("place", "item").collect():  # as many as stats.json has
        if r.off_mean:
            items.append(f"feature {r.feature!r}{f'[{r.item}]' if r.n_mean > 1 else ''}: stored mean {r.mean0:.8g}, recomputed {r.mean:.8g}")
        if r.off_std:
            items.append(f"feature {r.feature!r}{f'[{r.item}]' if r.n_std > 1 else ''}: stored std {r.std0:.8g}, recomputed {r.std:.8g}")
    if items:
        return found(me, Severity.FAIL, "Stored statistics are not those of the data", items, "violations", rtol=RTOL, atol=ATOL)
    return passed(me, "Stored statistics fit the data.")


@check("STATISTICAL.PER_EPISODE_STATS_MATCH", Severity.WARN)
def per_episode_stats_match(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    me = "STATISTICAL.PER_EPISODE_STATS_MATCH"
    if ds.is_remote and not ctx.deep:
        return passed(me, _REMOTE)
    if ds.version == "v2.0":
        return passed(me, "Skipped: v2.0 stores no statistics of episodes.")
    require_shards(ds)
    names = _features(ds, [f for f in ds.features if f.is_numeric])
    stored = stored_episode_stats(ds, names).filter("mean is not null and std is not null").withColumnsRenamed({"mean": "mean0", "std": "std0"})
    kept = {r.feature for r in stored.select("feature").distinct().collect()}
    stated = [n for n in names if n in kept]
    got = _with_order(ds, _moments(ds, stated), ["ord", "feature"], stated, False)
    j = ds.episodes.select("ord", "episode_index").join(stored, "episode_index").join(got, ["ord", "feature"])
    j = j.select("ord", "episode_index", "feature", "mean", "std", F.posexplode(F.filter(F.arrays_zip("mean0", "std0"), lambda x: x["mean0"].isNotNull() & x["std0"].isNotNull())).alias("item", "s"))
    j = j.withColumns({"off_mean": off_tolerance(F.col("s.mean0"), F.col("mean"), RTOL), "off_std": off_tolerance(F.col("s.std0"), F.col("std"), RTOL)}).filter("off_mean or off_std")
    worst = j.select("ord").distinct().orderBy("ord").limit(_STATS_CAP)
    items: list[str] = []
    at = None
    for r in j.join(F.broadcast(worst), "ord").withColumn("place", F.array_position(F.array(*map(F.lit, names)), F.col("feature"))).orderBy("ord", "place", "item").collect():
        if r.ord != at and len(items) >= _STATS_CAP:
            break
        at = r.ord
        if r.off_mean:
            items.append(f"episode {r.episode_index} feature {r.feature!r}: stored mean {r.s.mean0:.8g}, recomputed {r.mean:.8g}")
        if r.off_std:
            items.append(f"episode {r.episode_index} feature {r.feature!r}: stored std {r.s.std0:.8g}, recomputed {r.std:.8g}")
    return found(me, Severity.WARN, "Stored statistics of episodes are not those of the data", items, "violations", rtol=RTOL) if items else passed(me, "Stored statistics of episodes fit the data.")


def is_sanity_column(name: str) -> bool:
    """The columns of states and actions that are looked at."""
    if name in ("action", "observation.state", "observation.velocity", "observation.effort"):
        return True
    low = name.lower()
    return low.startswith(("observation.", "action")) and "image" not in low and "video" not in low


@check("STATISTICAL.VALUE_SANITY", Severity.WARN)
def value_sanity(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """States and actions of an episode that are all NaN (FAIL), partly NaN, all zero or constant (WARN)."""
    me = "STATISTICAL.VALUE_SANITY"
    if ds.is_remote and not ctx.deep:
        return passed(me, _REMOTE)
    names = [f.name for f in ds.features if f.is_numeric and is_sanity_column(f.name)]
    if not names:
        return passed(me, "Skipped: no states or actions are declared.")
    require_shards(ds)
    s = sanity(_moments(ds, names)).withColumn("place", F.array_position(F.array(*map(F.lit, names)), F.col("feature")))
    worst = s.select("ord").distinct().orderBy("ord").limit(_SANITY_CAP)
    fails: list[str] = []
    warns: list[str] = []
    at = None
    for r in s.join(F.broadcast(worst), "ord").join(ds.episodes.select("ord", "episode_index"), "ord").orderBy("ord", "place").collect():
        if r.ord != at and len(fails) + len(warns) >= _SANITY_CAP:
            break
        at = r.ord
        for f in r.findings:
            who = f"episode {r.episode_index} feature {r.feature!r}: "
            if f == "all NaN":
                fails.append(who + f"all {r.n} values are NaN")
            else:
                warns.append(who + {"some NaN": f"{r.n_nan} of {r.n} values are NaN", "zero": "all values are zero", "constant": f"all values are {r.low:.6g}"}[f])
    if fails:
        return found(me, Severity.FAIL, "States or actions are all NaN", fails, "fail_items", warn_items=warns)
    return found(me, Severity.WARN, "States or actions are degenerate", warns, "warn_items") if warns else passed(me, "States and actions vary in every episode.")
