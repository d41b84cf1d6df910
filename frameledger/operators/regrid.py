"""Irregular readings onto a regular grid.

Every source's grid is cut into shards of `shard` periods. Readings are reduced to one per period
(partially before the shuffle) and collected per shard as a sorted array. The first and last
reading of each shard are its summary; a scan over the summaries of a source carries the last
reading over shard borders, past empty shards too; then every shard fills its own periods.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameledger.functions.columns import finite

#: What a period of the grid holds: a reading, one carried on from an earlier period, or nothing.
STATES = ("reading", "filled", "missing")


def regular_grid(readings: DataFrame, sources: DataFrame, keys: Sequence[str], cell: str, value: Column | None = None, shard: int = 1024, fill: bool = True) -> DataFrame:
    """One row per source and period: keys, grid_index, value, state, filled_from.

    readings: keys, `cell` (bigint number of the period) and what `value` needs; sources: keys and
    `length` (periods 0 .. length-1), one row per keys. Of several readings in a period the least
    value is kept; readings outside the grid or with null keys or cell are ignored; a source of
    length null or below 1 has no grid. With fill, a period without a reading takes the last
    earlier one's value (state 'filled', filled_from its period); before the first it is 'missing'.
    """
    keys = list(keys)
    of = F.lit(None).cast("bigint") if value is None else value
    r = readings.select(*keys, F.col(cell).cast("bigint").alias("cell"), of.alias("value")).filter("cell >= 0")
    one = r.distinct() if value is None else r.groupBy(*keys, "cell").agg(F.min("value").alias("value"))
    per = one.groupBy(*keys, F.floor(F.col("cell") / shard).cast("bigint").alias("shard")).agg(F.sort_array(F.collect_list(F.struct("cell", "value"))).alias("have"))
    grid = sources.filter("length >= 1").select(*keys, F.col("length").cast("bigint").alias("length"))
    shards = grid.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / shard).cast("bigint"))).alias("shard"))
    lo = F.col("shard") * shard
    hi = F.least(F.col("length"), lo + shard)
    s = shards.join(per, [*keys, "shard"], "left").withColumn("have", F.filter(F.coalesce("have", F.array().cast("array<struct<cell:bigint,value:" + dict(r.dtypes)["value"] + ">>")), lambda x: x["cell"] < F.col("length")))
    last = F.when(F.size("have") > 0, F.element_at("have", -1))
    before = Window.partitionBy(*keys).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # only sources of several shards carry anything over a border
    carry = s.filter(F.col("length") > shard).select(*keys, "shard", last.alias("_last")).select(*keys, "shard", F.last("_last", ignorenulls=True).over(before).alias("carry"))
    s = s.join(carry, [*keys, "shard"], "left")
    stop = F.transform("have", lambda x, i: F.coalesce(F.get("have", i + 1)["cell"], hi))
    spans = F.concat(
        F.array(F.struct(lo.alias("start"), F.coalesce(F.get("have", F.lit(0))["cell"], hi).alias("stop"), F.col("carry.cell").alias("at"), F.col("carry.value").alias("value"))),
        F.zip_with("have", stop, lambda x, e: F.struct(x["cell"].alias("start"), e.alias("stop"), x["cell"].alias("at"), x["value"].alias("value"))),
    )
    runs = s.select(*keys, F.explode(F.filter(spans, lambda x: x["start"] < x["stop"])).alias("x"))
    out = runs.select(*keys, "x.at", "x.value", F.explode(F.sequence(F.col("x.start"), F.col("x.stop") - 1)).alias("grid_index"))
    kept = F.col("at") == F.col("grid_index")
    known = (kept | F.lit(fill)) & F.col("at").isNotNull()
    state = F.when(kept, "reading").when(known, "filled").otherwise("missing")
    return out.select(*keys, "grid_index", F.when(known, F.col("value")).alias("value"), state.alias("state"), F.when(known, F.col("at")).alias("filled_from"))


def episode_sources(episodes: DataFrame) -> DataFrame:
    """dataset_id, episode_index, length: one row per episode with a length, deleted ones too; the greatest of several."""
    return episodes.filter("length is not null and dataset_id is not null and episode_index is not null").groupBy("dataset_id", "episode_index").agg(F.max("length").alias("length"))


def frame_cells(frames: DataFrame, datasets: DataFrame) -> DataFrame:
    """Frames with a finite timestamp and their period floor(timestamp * fps + 0.5), in double; fps null: no period."""
    fps = datasets.filter("dataset_id is not null").groupBy("dataset_id").agg(F.max("fps").cast("double").alias("_fps"))
    at = F.floor(F.col("timestamp").cast("double") * F.col("_fps") + F.lit(0.5))
    f = frames.filter(finite(F.col("timestamp"))).join(fps, "dataset_id")
    # a float's period may pass the range of bigint
    return f.filter(F.abs(F.col("timestamp").cast("double") * F.col("_fps")) < 4e18).withColumn("_cell", at.cast("bigint"))


def frame_grid(frames: DataFrame, episodes: DataFrame, datasets: DataFrame, value: Column | None = None, fill: bool = True) -> DataFrame:
    """regular_grid of the frames of each episode, periods of 1/fps; a NaN or infinite timestamp is no reading."""
    return regular_grid(frame_cells(frames, datasets), episode_sources(episodes), ["dataset_id", "episode_index"], "_cell", value, fill=fill)


def missing_periods(frames: DataFrame, episodes: DataFrame, datasets: DataFrame) -> DataFrame:
    """dataset_id, episode_index, grid_index of every period without a reading."""
    return frame_grid(frames, episodes, datasets, fill=False).filter("state = 'missing'").select("dataset_id", "episode_index", "grid_index")
