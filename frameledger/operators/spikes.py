"""Implausible readings: spikes, stuck stretches, impossible values, per component of each dataset.

The readings of an episode are cut into shards of frames that tasks judge on their own, each with
the few readings before and after it; an episode with a third of all rows is many shards. The shards
of a dataset that a task holds are laid out as profiles, rows of PROFILE consecutive readings of one
component, and robust principal components split that matrix into a low-rank part, the normal course
of the source, and a sparse one, what stands out from it. Where the sparse part is large, or the
low-rank part itself leaps, readings are candidates, and the rule on neighbours is applied to them
alone; constant runs and impossible values are tested apart. A value further than t from another has
a residual of more than t/4 there or at the other, or the low-rank part leaps by more than t/2
between them. So no spike escapes the candidates, however well or badly the profiles fit.

The ordinary step is an exact quantile: a histogram over the leading bits of the changes finds the
bins in which it lies, and only the changes in these are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameledger.operators.common import cut, group_chunks, small_enough

SHARD = 4096
#: Equal values in a row that make a stuck stretch; neighbours of up to SPAN - 1 values stand off together.
STUCK, SPAN = 8, 3
_HALO = STUCK - 1
#: Readings of a profile, principal components kept, rounds of the splitting, low bits of a double that a bin of changes leaves out.
PROFILE, RANK, ROUNDS, BITS = 16, 4, 6, 40
_SHARD_KEYS = ("dataset_id", "episode_index", "shard")


def standoff(v: np.ndarray, group: np.ndarray, at: np.ndarray | None = None, span: int = SPAN) -> np.ndarray:
    """For each value (of the places `at`) the greatest t such that, alone or with up to span - 1 neighbours, it and they differ from the values just before and after by t or more; 0 at the ends of a group."""
    at = np.arange(len(v)) if at is None else at
    best = np.zeros(len(at))
    for m in range(1, span + 1):
        for place in range(m):
            before, after = at - place - 1, at - place + m
            ok = np.flatnonzero((before >= 0) & (after < len(v)))
            ok = ok[group[before[ok]] == group[after[ok]]]
            low, high = v[before[ok]], v[after[ok]]
            t = np.full(len(ok), np.inf)
            for j in range(m):
                x = v[before[ok] + 1 + j]
                np.minimum(t, np.minimum(np.abs(x - low), np.abs(x - high)), out=t)
            best[ok] = np.maximum(best[ok], t)
    return best


def low_rank(m: np.ndarray, t: float, rank: int = RANK, rounds: int = ROUNDS) -> np.ndarray:
    """The low-rank part of a matrix of profiles about their medians, by alternating projections; what is left is sparse.

    Cells further than a threshold from the low-rank part are sparse and do not count for the principal
    components; it falls from t to t / 4. The components come from the small square of the profile's
    length, so a round is linear in the number of profiles.
    """
    base = np.median(m, axis=1, keepdims=True)
    d = m - base
    low = np.zeros_like(d)
    for at in np.geomspace(t, t / 4, rounds):
        x = np.where(np.abs(d - low) > at, low, d)
        u = np.linalg.eigh(x.T @ x)[1][:, -rank:]
        low = (x @ u) @ u.T
    return base + low


def candidates(v: np.ndarray, group: np.ndarray, t: float, profile: int = PROFILE) -> np.ndarray:
    """Places of v (finite, sorted groups, one source) that may stand off by more than t; none that do is left out."""
    n = len(v)
    if not n or not t < np.inf:
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, n))
    rows = -(-size // profile)
    first = np.repeat(np.concatenate(([0], np.cumsum(rows)[:-1])) * profile, size)
    cell = first + np.arange(n) - np.repeat(start, size)
    # a profile that the group does not fill goes on with its last value
    fill = np.zeros(int(rows.sum()) * profile, np.int64)
    fill[cell] = np.arange(n)
    with np.errstate(over="ignore", invalid="ignore"):
        low = low_rank(v[np.maximum.accumulate(fill)].reshape(-1, profile), t).ravel()[cell]
    low[~np.isfinite(low)] = 0.0
    out = np.abs(v - low) > t / 4
    for _ in range(SPAN):
        out[1:] |= out[:-1].copy()
        out[:-1] |= out[1:].copy()
    for d in range(1, SPAN + 1):
        leap = np.abs(low[d:] - low[:-d]) > t / 2
        out[d:] |= leap
        out[:-d] |= leap
    return np.flatnonzero(out)


def run_lengths(v: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the run of equal values that each value belongs to."""
    if not len(v):
        return np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (group[1:] != group[:-1]))))
    size = np.diff(np.append(start, len(v)))
    return np.repeat(size, size)


def _components(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """component, rows with a value, the values: from a table sorted by shard and frame_index, resent rows left out."""
    n = t.num_rows
    frame, halo = t.column("frame_index").to_numpy(), _halo(t)
    again = np.zeros(n, bool)
    again[1:] = (frame[1:] == frame[:-1]) & (halo[1:] == 0) & (halo[:-1] == 0) & (_groups(t)[1:] == _groups(t)[:-1])
    ts = t.column("timestamp").combine_chunks()
    ok = ~again & ts.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    yield -1, rows, ts.to_numpy(zero_copy_only=False)[rows].astype(np.float64)
    action = t.column("action").combine_chunks()
    size = np.where(action.is_valid().to_numpy(zero_copy_only=False), np.diff(action.offsets.to_numpy()), 0)
    flat = action.values
    there, value, first = flat.is_valid().to_numpy(zero_copy_only=False), flat.to_numpy(zero_copy_only=False), action.offsets.to_numpy()[:-1]
    for c in range(int(size.max(initial=0))):
        rows = np.flatnonzero(~again & (size > c))
        rows = rows[there[first[rows] + c]]
        yield c, rows, value[first[rows] + c].astype(np.float64)


def _halo(t: pa.Table) -> np.ndarray:
    """Whether a row stands in for a reading of a neighbouring shard; without such rows there is no column."""
    return t.column("halo").to_numpy() if "halo" in t.column_names else np.zeros(t.num_rows, np.int32)


def _groups(t: pa.Table) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    for k in _SHARD_KEYS:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.cumsum(new)


def _changes_of(rows: np.ndarray, v: np.ndarray, group: np.ndarray, halo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and sizes of the changes from one finite value of a shard to the next; those that lead into the halo belong to another shard."""
    use = (group[rows[1:]] == group[rows[:-1]]) & (halo[rows[1:]] == 0)
    return rows[1:][use], np.abs(np.diff(v))[use]


def _histogram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dataset_id, component, bin (leading bits of the change, -1 if it is zero), n."""
    for t in group_chunks(batches, _SHARD_KEYS):
        group, dataset, halo = _groups(t), t.column("dataset_id").to_numpy(), _halo(t)
        for c, rows, v in _components(t):
            fine = np.isfinite(v)
            at, d = _changes_of(rows[fine], v[fine], group, halo)
            bins = np.where(d > 0, d.view(np.int64) >> BITS, -1)
            if c == -1:
                bins = np.minimum(bins, 0)  # its step is known; only whether it repeats counts
            ids = dataset[at]
            cuts = np.concatenate(([0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    value, n = np.unique(bins[a:b], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), ids[a])), pa.array(np.full(len(value), c, np.int64)), pa.array(value), pa.array(n)], names=["dataset_id", "component", "bin", "n"])


_FOUND = "dataset_id bigint, component bigint, episode_index bigint, frame_index bigint, standoff double, stuck boolean, change double, n bigint"


def _row_batch(dataset: np.ndarray, c: int, **cols: np.ndarray) -> pa.RecordBatch:
    n, kinds = len(dataset), {"episode_index": pa.int64(), "frame_index": pa.int64(), "standoff": pa.float64(), "stuck": pa.bool_(), "change": pa.float64(), "n": pa.int64()}
    arrays = [pa.array(dataset), pa.array(np.full(n, c, np.int64))] + [pa.array(cols[k]) if k in cols else pa.nulls(n, t) for k, t in kinds.items()]
    return pa.RecordBatch.from_arrays(arrays, names=["dataset_id", "component", *kinds])


def _judge(factor: float) -> Callable:
    """Candidates with their standoff and stuck values (episode_index not null), and the changes in the bins of the quantile (change not null).

    The bins and the step's lower bound of a source stand in the column edges, four numbers a component.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in group_chunks(batches, _SHARD_KEYS):
            group, core, halo = _groups(t), _halo(t) == 0, _halo(t)
            dataset, episode, frame = (t.column(k).to_numpy() for k in ("dataset_id", "episode_index", "frame_index"))
            cuts = np.concatenate(([0], np.flatnonzero(dataset[1:] != dataset[:-1]) + 1, [t.num_rows]))
            here = {}
            for a in cuts[:-1]:
                for c, low, high, floor in np.array(t.column("edges")[int(a)].as_py() or (), float).reshape(-1, 4):
                    here[int(dataset[a]), int(c)] = (low, high, floor)
            for c, rows, v in _components(t):
                fine = np.isfinite(v)
                off = np.where(fine, 0.0, np.inf)
                if c == -1:
                    off[fine & (v < 0)] = np.inf
                run_ = np.zeros(len(v), np.int64)
                run_[fine] = run_lengths(v[fine], group[rows[fine]])
                at, d = _changes_of(rows[fine], v[fine], group, halo)
                places = np.flatnonzero(fine)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    low, high, floor = here.get((int(dataset[a]), c), (np.nan, np.nan, np.nan))
                    mine = places[slice(*np.searchsorted(rows[places], (a, b)))]
                    if not np.isnan(floor) and len(mine):
                        x, g = v[mine], group[rows[mine]]
                        one = candidates(x, g, factor * floor)
                        got = standoff(x, g, one)
                        off[mine[one]] = np.maximum(off[mine[one]], np.where(got > factor * floor, got, 0.0))
                    if c >= 0 and not np.isnan(low):
                        near = d[slice(*np.searchsorted(at, (a, b)))]
                        near = near[(near > 0) & (near.view(np.int64) >> BITS >= low) & (near.view(np.int64) >> BITS <= high)]
                        value, n = np.unique(near, return_counts=True)
                        if len(value):
                            yield _row_batch(np.full(len(value), dataset[a]), c, change=value, n=n)
                use = ((off > 0) | (run_ >= STUCK)) & core[rows]
                if use.any():
                    r = rows[use]
                    yield _row_batch(dataset[r], c, episode_index=episode[r], frame_index=frame[r], standoff=off[use], stuck=run_[use] >= STUCK)

    return run


def _neighbours(one: DataFrame, wide: DataFrame) -> DataFrame:
    """Rows that give every shard of the episodes in `wide` the readings, up to STUCK - 1 each way, of the shards beside it; a row holds one component."""
    keys = ["dataset_id", "episode_index", "component"]
    long = one.join(wide, ["dataset_id", "episode_index"], "left_semi").select(
        "dataset_id", "episode_index", "shard", "frame_index", F.posexplode(F.concat(F.array("timestamp"), F.coalesce("action", F.array().cast("array<float>")))).alias("_p", "v")
    )
    long = long.filter("v is not null and not isnan(v) and abs(v) <> float('inf')").withColumn("component", F.col("_p") - 1)
    item = F.sort_array(F.collect_list(F.struct("frame_index", "v")))  # at most SHARD frames
    ends = long.groupBy(*keys, "shard").agg(item.alias("have")).select(*keys, "shard", F.slice("have", 1, _HALO).alias("head"), F.expr(f"slice(have, greatest(1, size(have) - {_HALO - 1}), {_HALO})").alias("tail"))
    w = Window.partitionBy(*keys).orderBy("shard")
    near = ends.select(*keys, "shard", F.flatten(F.collect_list("tail").over(w.rowsBetween(-_HALO, -1))).alias("b"), F.flatten(F.collect_list("head").over(w.rowsBetween(1, _HALO))).alias("a"))
    near = near.select(*keys, "shard", F.explode(F.concat(F.expr(f"slice(b, greatest(1, size(b) - {_HALO - 1}), {_HALO})"), F.slice("a", 1, _HALO))).alias("x"))
    place = F.when(F.col("component") >= 0, F.transform(F.sequence(F.lit(0), F.greatest("component", F.lit(0))), lambda i: F.when(i == F.col("component"), F.col("x.v"))))
    return near.select("dataset_id", "episode_index", "shard", "x.frame_index", F.when(F.col("component") == -1, F.col("x.v")).alias("timestamp"), place.alias("action"), F.lit(1).alias("halo"))


#: Datasets up to whose number the sources' bins are broadcast, some 200 bytes each; with more it is an ordinary join.
MOST_DATASETS = 50_000


def _edges(rows: DataFrame, datasets: DataFrame, quantile: float) -> DataFrame:
    """dataset_id, component, low, high (bins of the two values between which the quantile lies), skip (changes below low), pos (rank, from 0, with a fraction), floor (at most the step), known (the step where it is no quantile), same (share of zero changes).

    A source has a row per bin that occurs, whatever the number of its readings.
    """
    source = ["dataset_id", "component"]
    h = rows.mapInArrow(_histogram, "dataset_id bigint, component bigint, bin bigint, n bigint")
    # said here, as a join would say it, so that both uses of the histogram are one
    h = h.filter("dataset_id is not null").groupBy(*source, "bin").agg(F.sum("n").alias("n"))
    total = Window.partitionBy(*source)
    h = h.withColumns({"before": F.sum("n").over(total.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), "all": F.sum("n").over(total), "zero": F.sum(F.when(F.col("bin") < 0, F.col("n")).otherwise(0)).over(total)})
    h = h.withColumn("before", F.coalesce("before", F.lit(0)) - F.col("zero")).withColumn("pos", F.lit(quantile) * (F.col("all") - F.col("zero") - 1))
    holds = lambda k: (F.col("bin") >= 0) & (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
    first, second = holds(F.floor("pos")), holds(F.ceil("pos"))
    e = h.groupBy(*source).agg(
        F.max(F.when(first, F.col("bin"))).alias("low"), F.max(F.when(second, F.col("bin"))).alias("high"), F.max(F.when(first, F.col("before"))).alias("skip"), F.max("pos").alias("pos"), (F.max("zero") / F.max("all")).alias("same")
    )
    fps = datasets.groupBy("dataset_id").agg(F.max("fps").cast("double").alias("fps"))
    known = F.when((F.col("component") == -1) & (F.col("fps") > 0), 1 / F.col("fps"))
    return e.join(fps, "dataset_id", "left").select(*source, "low", "high", "skip", "pos", "same", known.alias("known"), F.when(F.col("component") == -1, known).otherwise(_edge_value("low")).alias("floor"))


def _edge_value(bin_: str):
    """The least double of a bin: sign, exponent and leading bits of the mantissa from the bin's number."""
    exponent, mantissa = F.shiftright(bin_, 52 - BITS), F.col(bin_).bitwiseAND(F.lit((1 << (52 - BITS)) - 1).cast("bigint"))
    size = F.lit(float(1 << (52 - BITS)))
    return F.when(exponent == 0, mantissa / size * F.lit(2.0**-1022)).otherwise((1 + mantissa / size) * F.pow(F.lit(2.0), exponent - 1023))


def _exact_steps(edges: DataFrame, got: DataFrame) -> DataFrame:
    """dataset_id, component, step, same: the quantile of the non-zero changes, from those of its bins."""
    source = ["dataset_id", "component"]
    c = got.filter("change is not null").groupBy(*source, "change").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*source).orderBy("change").rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("upto", upto).join(edges.select(*source, "skip", "pos"), source).withColumn("before", F.col("upto") - F.col("n"))
    at = lambda k: F.max(F.when((F.col("skip") + F.col("before") <= k) & (k < F.col("skip") + F.col("upto")), F.col("change")))
    c = c.groupBy(*source).agg(at(F.floor("pos")).alias("a"), at(F.ceil("pos")).alias("b"))
    e = edges.join(c, source, "left")
    exact = F.col("a") + (F.col("pos") - F.floor("pos")) * (F.col("b") - F.col("a"))
    return e.select(*source, F.when(F.col("component") == -1, F.col("known")).otherwise(exact).alias("step"), "same")


def implausible_readings(frames: DataFrame, datasets: DataFrame, factor: float = 20.0, quantile: float = 0.75) -> DataFrame:
    """dataset_id, episode_index, frame_index, component (-1: timestamp) of each implausible value.

    Values are ordered by frame_index; null values and rows with a null in dataset, episode or
    frame_index are skipped, rows sent again count once (of unequal rows of one frame, the one that
    sorts first). A case: not finite or a negative timestamp; or a standoff of more than `factor`
    ordinary steps, the exact `quantile` of the non-zero changes (between two ranks in proportion) (1/fps for timestamp; none where fps is
    null or 0), non-finite values being no neighbours; or one of STUCK or more equal values in a row, unless most
    changes of that component in the dataset are zero.
    """
    shard = F.floor(F.col("frame_index") / SHARD).cast("bigint")
    keyed = frames.filter("dataset_id is not null and episode_index is not null and frame_index is not null")
    one = keyed.select("dataset_id", "episode_index", "frame_index", F.col("timestamp").cast("float").alias("timestamp"), F.col("action").cast("array<float>").alias("action")).distinct()
    one = one.withColumn("shard", shard)
    rows = one.select(*_SHARD_KEYS, "frame_index", "timestamp", "action")
    # only where some reading lies beyond the first shard can an episode have several; the files' statistics answer that
    if not keyed.filter((F.col("frame_index") >= SHARD) | (F.col("frame_index") < 0)).isEmpty():
        wide = keyed.groupBy("dataset_id", "episode_index").agg(F.min(shard).alias("_a"), F.max(shard).alias("_b")).filter("_a < _b").drop("_a", "_b")
        rows = rows.withColumn("halo", F.lit(0)).unionByName(_neighbours(one, wide))
    # sorted last: a sort below a join would be dropped
    placed, ordered = lambda d: d.repartition(*_SHARD_KEYS), lambda d: d.sortWithinPartitions(*_SHARD_KEYS, "frame_index", "timestamp", "action")
    rows = placed(rows)
    edges = _edges(ordered(rows), datasets, quantile)
    source = ["dataset_id", "component"]
    per = edges.groupBy("dataset_id").agg(F.flatten(F.collect_list(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in ("component", "low", "high", "floor"))))).alias("edges"))
    small = small_enough(datasets, MOST_DATASETS)
    rows = ordered(rows.join(F.broadcast(per), "dataset_id", "left") if small else placed(rows.join(per, "dataset_id", "left")))
    # candidates, stuck values, a few changes, and the bins themselves: written once
    got = cut(rows.mapInArrow(_judge(factor), _FOUND).unionByName(edges, allowMissingColumns=True))
    steps = _exact_steps(got.filter("same is not null").select(edges.columns), got)
    found = got.filter("episode_index is not null").select(*source, "episode_index", "frame_index", "standoff", "stuck").join(F.broadcast(steps) if small else steps, source, "left")
    spike = (F.col("standoff") == float("inf")) | (F.col("standoff") > factor * F.col("step"))
    stuck = F.col("stuck") & (F.coalesce("same", F.lit(0.0)) <= 0.5)
    return found.filter(F.coalesce(spike, F.lit(False)) | stuck).select("dataset_id", "episode_index", "frame_index", "component")
