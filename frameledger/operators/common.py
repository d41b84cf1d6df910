"""Building blocks of the operators: skew-proof neighbours, chunks of sorted groups, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table `name` of a folder with one Parquet file (or folder) per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether df has at most max_rows rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks df for broadcasting once its size is checked; a larger one stays a plain join side."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where none is set, one process on one machine (tests) makes a temporary one and removes it at its
    end; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
            folder = tempfile.mkdtemp(prefix="frameledger-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there, so that later steps do not repeat its plan.

    What is written goes with the session's own cleaning (spark.cleaner.referenceTracking.cleanCheckpoints).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def previous_row(df: DataFrame, keys: Sequence[str], order: str, block: Column, payload: Sequence[str], out: str = "prev") -> DataFrame:
    """Adds struct `out` (order, *payload) of the row before this one among the rows of the same keys.

    (keys, order) must be unique and not null, and `block` must not fall as `order` rises. The rows
    of one key are cut into blocks that are sorted on their own; only the last row of every block
    takes part in the scan over blocks, so a key that holds a third of all rows is no single task.
    """
    keys = list(keys)
    d = df.withColumn("_block", block)
    item = F.struct(order, *payload)
    # apart, not as a struct: so numbers are aggregated by hashing, without a sort
    last = d.groupBy(*keys, "_block").agg(F.max(order).alias(order), *(F.max_by(c, order).alias(c) for c in payload)).select(*keys, "_block", item.alias("_last"))
    carry = last.select(*keys, "_block", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry"))
    inside = F.lag(item).over(Window.partitionBy(*keys, "_block").orderBy(order))
    return d.withColumn("_in", inside).join(carry, [*keys, "_block"], "left").withColumn(out, F.coalesce("_in", "_carry")).drop("_in", "_carry", "_block")


def group_chunks(batches: Iterable[pa.RecordBatch], keys: Sequence[str], rows: int = 200_000) -> Iterator[pa.Table]:
    """Cuts sorted batches into tables of about `rows` rows that never divide a group of equal keys.

    For groups of bounded size; the chunk grows until the group ends.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        last = [t.column(k)[n - 1].as_py() for k in keys]
        same = None
        for k, v in zip(keys, last, strict=True):
            col = t.column(k).to_numpy(zero_copy_only=False)
            eq = col == v
            same = eq if same is None else same & eq
        cut = n - int(same[::-1].argmin()) if not same.all() else 0
        if cut == 0:
            continue
        yield t.slice(0, cut)
        rest = t.slice(cut)
        held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)
