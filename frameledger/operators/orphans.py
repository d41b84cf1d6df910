"""References to records that do not exist, or did not exist at the time.

Keys are cut into ranges of fixed width. The parents of a range travel as sorted arrays to the
tasks that probe the references of that range by vectorised binary search. References are made
distinct before they are shuffled, and a range with many of them is divided over several tasks,
each of which gets the range's parents (at most `width` keys).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameledger.functions.columns import micros

KINDS = ("missing", "late", "deleted")
_NEVER = np.iinfo(np.int64).max
_UNKNOWN = np.iinfo(np.int64).min
_GROUP = ("link", "scope", "_range", "_salt")
_COLUMNS = ("is_ref", "key", "at", "until", "carry", "period")


def judge(keys: np.ndarray, loaded: np.ndarray, deleted: np.ndarray, ref_key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every reference 0 (good) or 1 + the index in KINDS; the parents are sorted by key."""
    lo, hi = np.searchsorted(keys, ref_key, "left"), np.searchsorted(keys, ref_key, "right")
    n = hi - lo
    out = np.where(n == 0, 1, 0).astype(np.int8)
    known = np.flatnonzero((n > 0) & (at != _UNKNOWN))
    if known.size:
        size = n[known]
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        of = np.repeat(np.arange(known.size), size)
        row = lo[known][of] + np.arange(of.size) - first[of]
        t = at[known][of]
        there = (loaded[row] <= t) & (t < deleted[row])
        good = np.logical_or.reduceat(there, first)
        late = np.logical_and.reduceat(loaded[row] > t, first)
        out[known] = np.where(good, 0, np.where(late, 2, 3))
    return out


def _probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group: tuple | None = None
    parts: list[tuple[np.ndarray, ...]] = []
    ready: tuple[np.ndarray, ...] | None = None
    empty = (np.empty(0, np.int64),) * 3
    for b in batches:
        cols = {k: b.column(k).to_numpy(zero_copy_only=False) for k in (*_GROUP, *_COLUMNS)}
        n = b.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for k in (*_GROUP, "is_ref"):
            new[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(new)
        bad: list[np.ndarray] = []
        kinds: list[np.ndarray] = []
        for s, e in zip(starts, [*starts[1:], n], strict=True):
            now = tuple(int(cols[k][s]) for k in _GROUP)
            if now != group:
                group, parts, ready = now, [], None
            if cols["is_ref"][s] == 0:
                parts.append(tuple(cols[k][s:e] for k in ("key", "at", "until")))
                continue
            if ready is None:
                ready = tuple(np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else empty
            kind = judge(*ready, cols["key"][s:e], cols["at"][s:e])
            hit = np.flatnonzero(kind)
            bad.append(hit + s)
            kinds.append(kind[hit])
        if bad and sum(map(len, bad)):
            at = np.concatenate(bad)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(cols[k][at]) for k in ("link", "scope", "key", "carry", "period")), pa.array(np.concatenate(kinds).astype(np.int32))], names=["link", "scope", "key", "carry", "period", "kind"]
            )


def probe(refs: DataFrame, parents: DataFrame, width: int = 4096, rows_per_task: int = 1_000_000) -> DataFrame:
    """The bad ones among refs (link, scope, key, carry, period, at) against parents (link, scope, key, at, until).

    All columns are bigint; refs must be distinct, link numbers the pair of tables, scope is the
    part of the key compared by equality. at null: the reference can only be 'missing'. Result:
    link, scope, key, carry, period, kind (1 + index in KINDS). No parents at all: all refs are missing.
    """
    where = ["link", "scope", "_range"]
    ranged = lambda df: df.withColumn("_range", F.floor(F.col("key") / F.lit(width)).cast("bigint"))
    r = ranged(refs)
    salts = r.groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_task)).cast("bigint").alias("_salts"))
    r = r.join(salts, where).select(
        *where, F.pmod(F.xxhash64("key", "carry", "at"), F.col("_salts")).alias("_salt"), F.lit(1).cast("bigint").alias("is_ref"),
        "key", F.coalesce("at", F.lit(int(_UNKNOWN))).alias("at"), F.lit(0).cast("bigint").alias("until"), "carry", "period",
    )
    p = ranged(parents.distinct()).join(salts, where).select(
        *where, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1)).alias("_salt"), F.lit(0).cast("bigint").alias("is_ref"),
        "key", F.coalesce("at", F.lit(int(_NEVER))).alias("at"), F.coalesce("until", F.lit(int(_NEVER))).alias("until"), F.lit(0).cast("bigint").alias("carry"), F.lit(0).cast("bigint").alias("period"),
    )
    both = p.unionByName(r).repartition(*_GROUP).sortWithinPartitions(*_GROUP, "is_ref", "key")
    return both.mapInArrow(_probe, "link bigint, scope bigint, key bigint, carry bigint, period bigint, kind int")


#: (src_table, ref_table) by link number.
LINKS = (("frames", "episodes"), ("frames", "tasks"), ("video_segments", "episodes"))


def orphan_references(frames: DataFrame, video_segments: DataFrame, episodes: DataFrame, tasks: DataFrame, **how: int) -> DataFrame:
    """One row per bad reference: src_table, ref_table, period, dataset_id, episode_index, ref_key, kind.

    A null dataset or key is no reference. A referring row without loaded_at has period null and can
    only be 'missing'. A parent without loaded_at counts as not loaded yet. Repeated rows count once.
    """
    long = lambda c: F.col(c).cast("bigint")
    when = [F.col("loaded_at")]
    f = frames.select(long("dataset_id").alias("scope"), long("episode_index").alias("episode"), long("task_index").alias("task"), *when).distinct()
    v = video_segments.select(long("dataset_id").alias("scope"), long("episode_index").alias("episode"), *when).distinct()
    stamp = lambda df: df.withColumns({"at": micros(F.col("loaded_at")), "period": (F.year("loaded_at") * 100 + F.month("loaded_at")).cast("bigint")})
    link = lambda n: F.lit(n).cast("bigint").alias("link")
    out = ["link", "scope", "key", "carry", "period", "at"]
    f_refs = stamp(f).select("scope", "period", "at", "episode", F.explode(F.array(F.struct(link(0), F.col("episode").alias("key")), F.struct(link(1), F.col("task").alias("key")))).alias("r"))
    f_refs = f_refs.select("r.link", "scope", "r.key", F.coalesce("episode", F.lit(-1)).alias("carry"), "period", "at", F.col("episode").isNull().alias("_none"))
    v_refs = stamp(v).select(link(2), "scope", F.col("episode").alias("key"), F.col("episode").alias("carry"), "period", "at", F.lit(False).alias("_none"))
    refs = f_refs.unionByName(v_refs).filter("scope is not null and key is not null")
    # a missing episode number beside a good task reference is given back as null
    refs = refs.withColumn("period", F.coalesce("period", F.lit(0)) * 2 + F.col("_none").cast("bigint")).select(*out).distinct()
    span = lambda df, key, *links: df.select(
        F.explode(F.array(*(F.lit(n).cast("bigint") for n in links))).alias("link"), long("dataset_id").alias("scope"), long(key).alias("key"), micros(F.col("loaded_at")).alias("at"), micros(F.col("deleted_at")).alias("until")
    ).filter("scope is not null and key is not null")
    bad = probe(refs, span(episodes, "episode_index", 0, 2).unionByName(span(tasks, "task_index", 1)), **how)
    name = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in LINKS)), F.col("link").cast("int") + 1)
    ym = F.floor(F.col("period") / 2)
    return bad.select(
        name(0).alias("src_table"), name(1).alias("ref_table"),
        F.when(ym > 0, F.format_string("%04d-%02d", F.floor(ym / 100), ym % 100)).alias("period"),
        F.col("scope").alias("dataset_id"), F.when(F.col("period") % 2 == 0, F.col("carry")).alias("episode_index"), F.col("key").alias("ref_key"),
        F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind"),
    ).distinct()


def orphan_report(frames: DataFrame, video_segments: DataFrame, episodes: DataFrame, tasks: DataFrame) -> DataFrame:
    """Per table, month and kind: the different bad references and the different keys they name."""
    bad = orphan_references(frames, video_segments, episodes, tasks)
    return bad.groupBy("src_table", "ref_table", "period", "kind").agg(F.count(F.lit(1)).alias("refs"), F.countDistinct("dataset_id", "ref_key").alias("keys"))
