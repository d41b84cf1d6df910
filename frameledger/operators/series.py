"""Operators over ordered series: the relational core of the integrity checks.

All take column names, so the same operator serves the frames of one dataset read from its files
and tables that hold many datasets. `keys` name a series; rows of a series are ordered by `row`,
unique within the series. A series that holds a third of all rows is scanned in blocks of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameledger.functions.columns import is_blank, no_nan, py_gt, py_le, relative_error
from frameledger.operators.common import group_chunks, previous_row

BLOCK = 1 << 16


def _block(row: str) -> Column:
    return F.floor(F.col(row) / BLOCK)


def last_runs(df: DataFrame, part: Sequence[str], row: str, value: str) -> DataFrame:
    """The rows of the last stretch of consecutive rows with equal `value` in each part, for each value.

    `row` counts 0, 1, 2, ... over a part's rows. Values whose rows stand together, the usual case,
    only take part in an aggregate.
    """
    part = list(part)
    span = df.groupBy(*part, value).agg(F.min(row).alias("_a"), F.max(row).alias("_b"), F.count(F.lit(1)).alias("_n"))
    broken = span.filter("_b - _a + 1 <> _n").select(*part, value)
    rows = df.join(broken, [*part, value], "left_semi").select(*part, value, row)
    prev = previous_row(rows, [*part, value], row, _block(row), [])
    start = prev.filter(f"prev is null or prev.{row} <> {row} - 1").groupBy(*part, value).agg(F.max(row).alias("_from"))
    return df.join(start, [*part, value], "left").filter(f"_from is null or {row} >= _from").drop("_from").select(*df.columns)


def with_position(df: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """df with `position` (0, 1, ...) in a series whose rows are numbered without gaps, and `rows`, its length."""
    keys = list(keys)
    first = df.groupBy(*keys).agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("rows"))
    return df.join(first, keys).withColumn("position", F.col(row) - F.col("_first")).drop("_first")


def steps(df: DataFrame, keys: Sequence[str], row: str, ts: str) -> DataFrame:
    """keys, row, ts, before: each reading but the first with the timestamp (double) before it."""
    d = df.select(*keys, row, F.col(ts).cast("double").alias("ts"))
    d = previous_row(d, keys, row, _block(row), ["ts"])
    return d.filter("prev is not null").select(*keys, row, "ts", F.col("prev.ts").alias("before"))


def first_not_increasing(df: DataFrame, keys: Sequence[str], row: str, ts: str) -> DataFrame:
    """keys, row, ts, before: the first reading of each series that is not later than the one before; NaN and null never violate."""
    bad = steps(df, keys, row, ts).filter(py_le(F.col("ts"), F.col("before")))
    return _first(bad, keys, row, "ts", "before")


def first_off_spacing(df: DataFrame, keys: Sequence[str], row: str, ts: str, ideal: Column, tolerance: float = 1e-4) -> DataFrame:
    """keys, row, gap, deviation, level: the first reading of each series whose gap is off the ideal spacing by more than the tolerance or the spacing.

    That reading alone decides: 'fail' if it is off by more than the spacing, else 'warn'. `ideal` is an
    expression of the keys. NaN and null never violate.
    """
    d = steps(df, keys, row, ts).withColumns({"gap": F.col("ts") - F.col("before"), "_ideal": ideal})
    d = d.withColumn("deviation", F.abs(F.col("gap") - F.col("_ideal")))
    far = py_gt(F.col("deviation"), F.col("_ideal"))
    bad = d.filter(far | py_gt(F.col("deviation"), F.lit(tolerance))).withColumn("level", F.when(far, "fail").otherwise("warn"))
    return _first(bad, keys, row, "gap", "deviation", "level")


def _first(bad: DataFrame, keys: Sequence[str], row: str, *cols: str) -> DataFrame:
    return bad.groupBy(*keys).agg(F.min(F.struct(row, *cols)).alias("_x")).select(*keys, "_x.*")


def sequence_breaks(df: DataFrame, keys: Sequence[str], row: str, value: str, start: Column | None = None) -> DataFrame:
    """keys, rows, breaks: readings of a gaplessly numbered series whose `value` is not start + position (null is a break)."""
    d = with_position(df, keys, row)
    want = F.col("position") + (F.lit(0) if start is None else start)
    return d.groupBy(*keys).agg(F.max("rows").alias("rows"), F.count_if(~F.col(value).eqNullSafe(want)).alias("breaks"))


def drift(index: Column, ts: Column, fps: Column, exact: Column) -> Column:
    """|timestamp - index / fps| of a reading; the ideal is rounded to float unless `exact` (a double column)."""
    ideal = index.cast("double") * (F.lit(1.0) / fps)
    return F.abs(ts.cast("double") - F.when(exact, ideal).otherwise(ideal.cast("float").cast("double")))


def drift_totals(df: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """keys, total: sum of the drift of each series; NaN as soon as one reading is."""
    return df.groupBy(*keys).agg(F.sum(amount).alias("total"))


def running_totals(totals: DataFrame, part: Sequence[str], order: str) -> DataFrame:
    """totals with `running`: the sum up to and with each series, in the order of series; a row per series only."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return totals.withColumn("running", F.sum("total").over(w))


def count_agreement(declared: DataFrame, actual: DataFrame, keys: Sequence[str], length: str, span: Column | None = None) -> DataFrame:
    """keys, declared, actual, span_off: series whose number of rows (0 if none) or whose span is not the declared length; a null length agrees with nothing known and is left out."""
    n = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    d = declared.join(n, list(keys), "left").withColumns({"actual": F.coalesce("actual", F.lit(0)), "declared": F.col(length)})
    off = F.lit(False) if span is None else F.coalesce(span != F.col(length), F.lit(False))
    return d.withColumn("span_off", off).filter("actual <> declared or span_off").select(*keys, "declared", "actual", "span_off")


def undefined(refs: DataFrame, defined: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct non-null keys of refs that are not defined."""
    keys = list(keys)
    return refs.select(*keys).dropna().distinct().join(defined.select(*keys).distinct(), keys, "left_anti")


def values_of(df: DataFrame, carry: Sequence[str], features: dict[str, Column]) -> DataFrame:
    """carry, feature, item, value: every component (array<double> per feature) as a row; a null component is NaN, a null feature one NaN."""
    if not features:
        return df.select(*carry, F.lit("").alias("feature"), F.lit(0).alias("item"), F.lit(0.0).alias("value")).limit(0)
    one = [F.struct(F.lit(f).alias("feature"), F.coalesce(c, F.array(F.lit(None).cast("double"))).alias("v")) for f, c in features.items()]
    d = df.select(*carry, F.explode(F.array(*one)).alias("_f"))
    return d.select(*carry, "_f.feature", F.posexplode("_f.v").alias("item", "value")).withColumn("value", F.coalesce("value", F.lit(float("nan"))))


def moments(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, n_nan, mean, std, low, high, n_nonzero: population moments and extremes of `value` without NaN."""
    v = F.when(no_nan(F.col("value")), F.col("value"))
    return values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.isnan("value")).alias("n_nan"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(v != 0).alias("n_nonzero"),
    )


def pooled(m: DataFrame, keys: Sequence[str]) -> DataFrame:
    """moments of the groups `keys` from those of finer groups, without another look at the values."""
    k = F.col("n") - F.col("n_nan")
    t = m.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("n_nan").alias("n_nan"), F.sum(k).alias("_k"), F.sum(k * F.col("mean")).alias("_s"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n_nonzero").alias("n_nonzero"),
    )
    t = t.withColumn("mean", F.try_divide(F.col("_s"), F.col("_k")))
    about = m.join(t.select(*keys, F.col("mean").alias("_mean")), list(keys)).groupBy(*keys).agg(F.sum(k * (F.pow("std", F.lit(2)) + F.pow(F.col("mean") - F.col("_mean"), 2))).alias("_m2"))
    return t.join(about, list(keys)).withColumn("std", F.sqrt(F.try_divide(F.col("_m2"), F.col("_k")))).select(*keys, "n", "n_nan", "mean", "std", "low", "high", "n_nonzero")


def off_tolerance(stored: Column, recomputed: Column, tolerance: float = 1e-4) -> Column:
    """True where the relative error is beyond the tolerance; never for NaN or null."""
    e = relative_error(stored, recomputed)
    return F.coalesce(e > tolerance, F.lit(False)) & F.coalesce(no_nan(e), F.lit(False))


def sanity(m: DataFrame) -> DataFrame:
    """Rows of moments with `findings`: 'all NaN', or 'some NaN' and 'zero' or else 'constant'; rows without any left out."""
    all_nan = F.col("n_nan") == F.col("n")
    found = F.when(all_nan, F.array(F.lit("all NaN"))).otherwise(
        F.filter(
            F.array(F.when(F.col("n_nan") > 0, "some NaN"), F.when(F.col("n_nonzero") == 0, "zero").when(F.col("low") == F.col("high"), "constant")),
            lambda x: x.isNotNull(),
        )
    )
    return m.filter("n > 0").withColumn("findings", found).filter(F.size("findings") > 0)


def intrinsics(v: Column) -> dict[str, Column]:
    """What is wrong with an array<double> read as a camera matrix (row by row, or fx, fy, cx, cy): short, or focal lengths or principal point not positive; NaN and null are never wrong."""
    # fixed values: places of fx, fy, cx, cy in a 3 x 3 matrix and in a flat list
    wide, enough = F.size(v) >= 9, F.size(v) >= 4
    at = lambda matrix, flat: F.when(wide, F.get(v, F.lit(matrix))).otherwise(F.get(v, F.lit(flat)))
    fx, fy, cx, cy = at(0, 0), at(4, 1), at(2, 2), at(5, 3)
    low = lambda a, b: F.coalesce(enough & (py_le(a, F.lit(0.0)) | py_le(b, F.lit(0.0))), F.lit(False))
    return {"short": v.isNotNull() & ~enough, "focal": low(fx, fy), "centre": low(cx, cy), "fx": fx, "fy": fy, "cx": cx, "cy": cy}


def without_text(df: DataFrame, texts: str) -> DataFrame:
    """Rows whose array of texts has none that is more than white space (null and empty arrays too)."""
    return df.filter(~F.coalesce(F.exists(texts, lambda t: ~is_blank(t)), F.lit(False)))


# Welford's mean and variance where NaN raises the count and nothing else depend on the order of the
# values, so slices are folded on their own, as maps of the mean before them, and merged in order.


def _slice(values: np.ndarray, before: int) -> tuple[float, float, float, float, float]:
    """The slice's mean as a + b * mean0 and its sum of squares as q0 + q1 * mean0 + q2 * mean0**2; `before` values precede it."""
    a, b, q0, q1, q2 = 0.0, 1.0, 0.0, 0.0, 0.0
    at = np.flatnonzero(~np.isnan(values))
    for k, x in zip((before + 1 + at).tolist(), values[at].tolist(), strict=True):
        w, d = 1.0 - 1.0 / k, x - a
        q0, q1, q2 = q0 + w * d * d, q1 - 2.0 * w * b * d, q2 + w * b * b
        a, b = w * a + x / k, w * b
    return a, b, q0, q1, q2


def ordered_moments(values: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column) -> DataFrame:
    """keys, n, mean, std in which NaN raises the count only, folded in the order of `order`.

    `block` (bigint, not falling along the order) cuts a group into slices of bounded size. For groups
    with NaN; without any, moments gives the same from built-in aggregates.
    """
    keys, order = list(keys), list(order)
    v = values.withColumn("_block", block)
    sizes = v.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    v = v.join(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0))), [*keys, "_block"])
    names = ", ".join(f"{n} {t}" for n, t in values.select(*keys).dtypes)
    part = [*keys, "_block"]
    v = v.repartition(*part).sortWithinPartitions(*part, *order).select(*part, "value", "_before")
    slices = v.mapInArrow(_folded(part), f"{names}, _block bigint, size bigint, a double, b double, c double, d double, e double")
    slices = slices.repartition(*keys).sortWithinPartitions(*part)
    return slices.mapInArrow(_merged(keys), f"{names}, n bigint, mean double, std double")


def _each(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Chunks of sorted batches with the places where groups of equal keys begin, and the end."""
    for t in group_chunks(batches, keys):
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        yield t, np.concatenate(([0], np.flatnonzero(new), [t.num_rows]))


def _with(t: pa.Table, keys: Sequence[str], at: np.ndarray, names: Sequence[str], rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    out = t.select(list(keys)).take(pa.array(at))
    for n, c in zip(names, zip(*rows, strict=True), strict=True):
        out = out.append_column(n, pa.array(c))
    yield from out.combine_chunks().to_batches()


def _folded(part: Sequence[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _each(batches, part):
            value, before = t.column("value").to_numpy(), t.column("_before").to_numpy()
            rows = [(int(b - a), *_slice(value[a:b], int(before[a]))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield from _with(t, part, cuts[:-1], ("size", *"abcde"), rows)

    return run


def _merged(keys: Sequence[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cuts in _each(batches, keys):
            size, *parts = (t.column(c).to_numpy() for c in ("size", *"abcde"))
            rows = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                mean = m2 = 0.0
                for a, b, c, d, e in zip(*(x[i:j].tolist() for x in parts), strict=True):
                    m2 += c + d * mean + e * mean * mean
                    mean = a + b * mean
                n = int(size[i:j].sum())
                rows.append((n, mean, (m2 / n) ** 0.5 if n > 1 else 0.0))
            yield from _with(t, keys, cuts[:-1], ("n", "mean", "std"), rows)

    return run
