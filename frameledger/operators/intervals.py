"""Overlaps, gaps and continuous periods of integer intervals.

Intervals are half-open. The line is cut into cells of 2**CELL units; what an interval covers of a
cell is decomposed into canonical dyadic blocks, and the whole cells between its ends are an interval
of the next tier, whose unit is a cell. In each cell blocks that an ancestor covers go, sibling pairs
become their parent level by level, and neighbouring blocks are coalesced. Every task does so with
the intervals it has before anything is shuffled, so a cell receives its disjoint stretches from each
task, however many intervals lie in it. A scan over the stretches joins cells and tiers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameledger.operators.common import group_chunks, previous_row

#: Levels within a cell, tiers that a bigint needs.
CELL, TIERS = 16, 4


def decompose(lo: np.ndarray, hi: np.ndarray, top: int = CELL) -> list[np.ndarray]:
    """For each level up to `top` the numbers of the canonical dyadic blocks of all [lo, hi), each once; number n of level l stands for [n << l, (n + 1) << l)."""
    out = []
    for level in range(top + 1):
        a, b = -(-lo >> level), hi >> level
        there = a < b
        lo, hi, a, b = lo[there], hi[there], a[there], b[there]
        if level == top:
            # what is left fills whole blocks of the top level; a cell has one
            n = b - a
            first = np.repeat(a, n)
            out.append(np.unique(first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)))
        else:
            out.append(np.unique(np.concatenate((a[a & 1 == 1], b[b & 1 == 1] - 1))))
    return out


def uncovered(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """The blocks of which no ancestor is among them.

    Blocks are nested or apart: sorted by start, larger ones first, a block has an ancestor just if
    some block before it reaches its end.
    """
    level = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    block = np.concatenate(blocks)
    start, end = block << level, (block + 1) << level
    order = np.lexsort((-level, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    keep = np.ones(len(block), bool)
    keep[order[1:]] = reach[:-1] < end[order[1:]]
    return [b[k] for b, k in zip(blocks, np.split(keep, np.cumsum([len(b) for b in blocks])[:-1]), strict=True)]


def merge_siblings(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Disjoint blocks in which sibling pairs have become their parent, from the lowest level up."""
    out, carried = [], np.zeros(0, np.int64)
    for level, b in enumerate(blocks):
        b = np.union1d(b, carried)
        pair = np.zeros(len(b), bool)
        if level + 1 < len(blocks):
            pair[:-1] = (b[:-1] & 1 == 0) & (b[1:] == b[:-1] + 1)
        carried = b[pair] >> 1
        pair[1:] |= pair[:-1].copy()
        out.append(b[~pair])
    return out


def stretches(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, none of which leaves its cell, as sorted stretches; neighbours of one cell are coalesced."""
    blocks = merge_siblings(uncovered(decompose(lo, hi)))
    level = np.repeat(np.arange(len(blocks)), [len(b) for b in blocks])
    block = np.concatenate(blocks)
    order = np.argsort(block << level)
    start, end = (block << level)[order], ((block + 1) << level)[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != end[:-1]) | (start[1:] % (1 << CELL) == 0)
    last = np.append(first[1:], True)[: len(first)]
    return start[first], end[last]


def _pieces(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, tier, cell, from, to: what intervals cover of the cells in which they begin or end, of every tier they reach; from and to within the cell."""
    row, out = np.arange(len(lo)), []
    for tier in range(TIERS):
        a, b = lo >> CELL, (hi - 1) >> CELL
        one = a == b if tier < TIERS - 1 else np.ones(len(lo), bool)
        if tier == TIERS - 1:  # the last tier has the cells -1 and 0
            for cell in (-1, 0):
                x, y = np.maximum(lo, cell << CELL), np.minimum(hi, (cell + 1) << CELL)
                k = x < y
                out.append((row[k], np.full(k.sum(), tier), np.full(k.sum(), cell), x[k] - (cell << CELL), y[k] - (cell << CELL)))
            break
        out.append((row[one], np.full(one.sum(), tier), a[one], lo[one] - (a[one] << CELL), hi[one] - (a[one] << CELL)))
        row, lo, hi, a, b = (x[~one] for x in (row, lo, hi, a, b))
        left, right = lo > a << CELL, hi < (b + 1) << CELL
        full = np.int64(1 << CELL)
        out.append((row[left], np.full(left.sum(), tier), a[left], lo[left] - (a[left] << CELL), np.full(left.sum(), full)))
        out.append((row[right], np.full(right.sum(), tier), b[right], np.zeros(right.sum(), np.int64), hi[right] - (b[right] << CELL)))
        a, b = a + left, b + 1 - right
        more = a < b
        row, lo, hi = row[more], a[more], b[more]
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True))


def _groups(t: pa.Table, keys: Sequence[str], *numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the group of equal keys and numbers of each row, and a row of each group."""
    code = np.zeros(t.num_rows, np.int64)
    parts = [t.column(k).combine_chunks().dictionary_encode(null_encoding="encode") for k in keys]
    for x in [*(p.indices.to_numpy() for p in parts), *numbers]:
        value, x = np.unique(x, return_inverse=True)
        code = np.unique(code * len(value) + x, return_inverse=True)[1]
    first = np.zeros(code.max(initial=-1) + 1, np.int64)
    first[code] = np.arange(len(code))
    return code, first


_CELLS = ("_tier", "_cell", "_from", "_to")


def _united(keys: Sequence[str], split: bool) -> Callable:
    """Stretches per cell: of intervals (lo, hi) that are split into cells first, or of stretches that several tasks found, whose cells are complete and come out in units."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = (pa.Table.from_batches([b]) for b in batches if b.num_rows) if split else group_chunks(batches, ["_hash"])
        for t in tables:
            if split:
                row, tier, cell, a, b = _pieces(t.column("lo").to_numpy(), t.column("hi").to_numpy())
                t = t.select(list(keys)).take(pa.array(row))
            else:
                tier, cell, a, b = (t.column(c).to_numpy() for c in _CELLS)
            group, first = _groups(t, keys, tier, cell)
            lo, hi = stretches((group << CELL) + a, (group << CELL) + b)
            at = first[lo >> CELL]
            base = (lo >> CELL) << CELL
            if split:
                cols = [tier[at], cell[at], lo - base, hi - base]
            else:
                unit = CELL * tier[at]
                cols = [((cell[at] << CELL) + lo - base) << unit, ((cell[at] << CELL) + hi - base) << unit]
            out = t.select(list(keys)).take(pa.array(at))
            for name, c in zip(_CELLS if split else ("lo", "hi"), cols, strict=True):
                out = out.append_column(name, pa.array(c))
            yield from out.combine_chunks().to_batches()

    return run


def covered_stretches(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, lo, hi: stretches whose union is that of the intervals, disjoint within a cell; those of other cells may touch, and one of a higher tier may cover others."""
    keys = list(keys)
    d = intervals.select(*keys, F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi")).filter("lo < hi")
    names = ", ".join(f"`{n}` {t}" for n, t in d.select(*keys).dtypes)
    part = d.mapInArrow(_united(keys, True), f"{names}, _tier bigint, _cell bigint, _from bigint, _to bigint")
    part = part.withColumn("_hash", F.xxhash64(*keys, "_tier", "_cell")).repartition("_hash").sortWithinPartitions("_hash")
    return part.mapInArrow(_united(keys, False), f"{names}, lo bigint, hi bigint")


def _between(stretches: DataFrame, keys: Sequence[str], block: int) -> DataFrame:
    """keys, a, b: what lies between the furthest end so far and the next stretch; the ends come from a scan over blocks of starts, so that no group is one task."""
    keys = list(keys)
    d = stretches.withColumn("_blk", F.floor(F.col("lo") / block))
    ends = d.groupBy(*keys, "_blk").agg(F.max("hi").alias("_end"))
    carry = ends.select(*keys, "_blk", F.max("_end").over(Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = F.max("hi").over(Window.partitionBy(*keys, "_blk").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_in", inside).join(carry, [*keys, "_blk"]).withColumn("a", F.greatest("_in", "_carry"))
    return d.filter("a < lo").select(*keys, "a", F.col("lo").alias("b"))


def gaps(intervals: DataFrame, keys: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """keys, a, b: the longest stretches between a group's first and last interval that none covers."""
    return _between(covered_stretches(intervals, keys), keys, block)


def periods(intervals: DataFrame, keys: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """keys, lo, hi: the continuous periods, touching and overlapping intervals merged."""
    keys = list(keys)
    s = covered_stretches(intervals, keys)
    ends = s.groupBy(*keys).agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    g = _between(s, keys, block)
    # a period runs from the end of one gap to the start of the next; the last one closes with the group
    marks = g.select(*keys, F.col("b").alias("at"), F.col("a").alias("closes"))
    marks = marks.unionByName(ends.select(*keys, F.inline(F.array(F.struct(F.col("first").alias("at"), F.lit(None).cast("bigint").alias("closes")), F.struct((F.col("last") + 1).alias("at"), F.col("last").alias("closes"))))))
    d = previous_row(marks, keys, "at", F.floor(F.col("at") / block), ["closes"])
    return d.filter("prev is not null").select(*keys, F.col("prev.at").alias("lo"), F.col("closes").alias("hi"))


def _level(length: Column) -> Column:
    """A level whose blocks are as long as `length` or longer, the least or (where a double rounds up) the next."""
    level = F.ceil(F.log2(length.cast("double"))).cast("int")
    return level + (F.call_function("shiftleft", F.lit(1).cast("bigint"), level) < length).cast("int")


def _block(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level)


def overlaps(intervals: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """keys, a, b (members, a < b): pairs of different members of which some intervals share more than an end point.

    An interval lies in one or two dyadic blocks of the level of its length. Another that starts later
    (or with it) has its start in one of them, and is looked up there on the levels that its group has:
    each pair of intervals meets once, on the block of that start.
    """
    keys = list(keys)
    i = intervals.select(*keys, F.col(member).alias("_m"), "lo", "hi").filter("lo < hi").distinct().withColumn("_l", _level(F.col("hi") - F.col("lo")))
    first, last = _block(F.col("lo"), F.col("_l")), _block(F.col("hi") - 1, F.col("_l"))
    holders = i.select(*keys, F.col("_m").alias("_p"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "_l", F.explode(F.array_distinct(F.array(first, last))).alias("_b"))
    levels = i.groupBy(*keys).agg(F.collect_set("_l").alias("_levels"))  # at most 64
    starts = i.join(levels, keys).select(*keys, "_m", "lo", F.explode("_levels").alias("_l"))
    starts = starts.withColumn("_b", _block(F.col("lo"), F.col("_l"))).distinct()
    pairs = holders.join(starts, [*keys, "_l", "_b"]).filter("_p <> _m and _lo <= lo and lo < _hi")
    return pairs.select(*keys, F.least("_p", "_m").alias("a"), F.greatest("_p", "_m").alias("b")).distinct()


KEYS = ("src_table", "dataset_id", "camera", "chunk_index", "file_index")


def dataset_intervals(episodes: DataFrame, video_segments: DataFrame) -> DataFrame:
    """KEYS, member (episode_index), lo, hi: frame ranges by dataset and metadata chunk, segments by video file in milliseconds.

    Rows with a null in keys, member or bounds, with NaN or infinite bounds or with from >= to are left out; repeated rows are not.
    """
    long = lambda c: F.col(c).cast("bigint")
    e = episodes.select(
        F.lit("episodes").alias("src_table"), long("dataset_id").alias("dataset_id"), F.lit("").alias("camera"), long("`meta/episodes/chunk_index`").alias("chunk_index"), F.lit(-1).cast("bigint").alias("file_index"),
        long("episode_index").alias("member"), long("dataset_from_index").alias("lo"), long("dataset_to_index").alias("hi"),
    )
    ms = lambda c: F.when(F.abs(F.col(c)) < 9e15, F.round(F.col(c).cast("double") * 1000)).cast("bigint")
    v = video_segments.select(
        F.lit("video_segments").alias("src_table"), long("dataset_id").alias("dataset_id"), F.col("camera"), long("chunk_index").alias("chunk_index"), long("file_index").alias("file_index"),
        long("episode_index").alias("member"), ms("from_timestamp").alias("lo"), ms("to_timestamp").alias("hi"),
    )
    return e.unionByName(v).dropna().filter("lo < hi")


def overlaps_and_gaps(episodes: DataFrame, video_segments: DataFrame) -> DataFrame:
    """src_table, kind ('overlap' or 'gap'), dataset_id, camera, chunk_index, file_index, a, b."""
    i = dataset_intervals(episodes, video_segments)
    out = overlaps(i, KEYS, "member").withColumn("kind", F.lit("overlap")).unionByName(gaps(i, KEYS).withColumn("kind", F.lit("gap")))
    return out.select("src_table", "kind", "dataset_id", "camera", "chunk_index", "file_index", "a", "b")
