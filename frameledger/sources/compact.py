"""Carrying out a compaction plan: freeze what is to be copied, rewrite each bin, verify, commit together."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.errors import RepairError
from frameledger.operators.common import cut
from frameledger.sources.files import filesystem

#: The file that says which folder beside it holds the bins; without it there are none.
_COMMITTED = "_COMMITTED"
_PIECE = ["dataset_id", "chunk_index", "file_index", "episode_index"]
_BIN = ["dataset_id", "bin_group", "bin_no"]


def fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rows, checksum: the checksum is the sum of the rows' hashes, so it does not depend on their order."""
    cols = sorted(c for c in df.columns if c not in keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*map(F.col, cols)).cast("decimal(38,0)")).alias("checksum"))


def planned_rows(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """frames (dataset_id, chunk_index, file_index, episode_index, position, ...) that the plan keeps, with bin_group and bin_no.

    A frame counts once: it is taken from the one piece of the plan that holds its position.
    """
    p = plan.select(*_PIECE, "from_frame", "to_frame", "bin_group", "bin_no")
    return frames.join(p, _PIECE).filter("position >= from_frame and position < to_frame").drop("from_frame", "to_frame")


def freeze(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with `rows` and `checksum` of what each piece holds now, written down: what rewrite is held to.

    A piece that does not hold each of its planned frames once is an error: its file is lost or cut
    off, or frames stand in it twice.
    """
    rows = planned_rows(frames, plan)
    have = fingerprint(rows.drop("bin_group", "bin_no"), _PIECE)
    once = rows.groupBy(*_PIECE).agg(F.countDistinct("position").alias("_once"))
    listed = cut(plan.join(have, _PIECE, "left").join(once, _PIECE, "left"))
    want = F.col("to_frame") - F.col("from_frame")
    _refuse(listed.filter(~(F.col("rows").eqNullSafe(want) & F.col("_once").eqNullSafe(want))), _PIECE, "pieces do not hold their planned frames once")
    return listed.drop("_once")


def _refuse(bad: DataFrame, keys: list[str], what: str) -> None:
    if got := bad.select(*keys).limit(5).collect():
        raise RepairError(f"{what}: {[tuple(r) for r in got]}")


def rewrite(frames: DataFrame, frozen: DataFrame, out: str) -> DataFrame:
    """Writes the frames of a frozen plan, one file per bin, to a new folder in `out` and commits it; gives rows and checksum per bin.

    The bins are read back: of every piece their rows and checksum must be those frozen, and every bin
    must hold the frames planned for it, none twice. So a lost or doubled frame, a source changed since
    it was frozen, a lost executor or a wrong copy is an error, and nothing is committed. The commit is
    one small file that names the folder, written last; no data are moved or copied, whatever the store.
    Folders that no commit names are no data.
    """
    system, path = filesystem(out)
    if system.get_file_info([posixpath.join(path, _COMMITTED)])[0].type != fs.FileType.NotFound:
        raise RepairError(f"{out} is committed already")
    rows = planned_rows(frames, frozen)
    spark, folder = rows.sparkSession, f"bins-{uuid.uuid4().hex}"
    target = _uri(out, path, folder)
    try:
        rows.repartition(*_BIN).sortWithinPartitions(*_BIN, "episode_index", "position").write.partitionBy(*_BIN).parquet(target)
        back = _read(spark, target, dict(rows.dtypes))
        got = fingerprint(back.drop("bin_group", "bin_no"), _PIECE).alias("g")
        same = F.col("w.rows").eqNullSafe(F.col("g.rows")) & F.col("w.checksum").eqNullSafe(F.col("g.checksum"))
        _refuse(frozen.alias("w").join(got, _PIECE, "full").filter(~same), _PIECE, "pieces differ from their source")
        want = frozen.groupBy(*_BIN).agg(F.sum(F.col("to_frame") - F.col("from_frame")).alias("want"))
        held = back.groupBy(*_BIN, "episode_index", "position").agg(F.count(F.lit(1)).alias("n")).groupBy(*_BIN).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
        _refuse(want.join(held, _BIN, "full").filter(~(F.col("want").eqNullSafe(F.col("n")) & (F.col("most") == 1))), _BIN, "bins do not hold their planned frames once")
        _commit(system, path, {"folder": folder, "bins": want.count()})
    except BaseException:
        left = posixpath.join(path, folder)
        if system.get_file_info([left])[0].type == fs.FileType.Directory:
            system.delete_dir(left)
        raise
    return fingerprint(read_bins(spark, out, dict(rows.dtypes)), _BIN)


def _uri(out: str, path: str, folder: str) -> str:
    return posixpath.join(out if "://" in out else f"file://{path}", folder)


def _commit(system: fs.FileSystem, path: str, said: dict) -> None:
    """One file appears whole: by a rename where the store has one, else as the one object that it is."""
    final = posixpath.join(path, _COMMITTED)
    name = f"{final}.{uuid.uuid4().hex}" if system.type_name in ("local", "hdfs") else final
    with system.open_output_stream(name) as f:
        f.write(json.dumps(said).encode())
    if name != final:
        system.move(name, final)


def _read(spark: SparkSession, uri: str, kinds: dict[str, str]) -> DataFrame:
    back = spark.read.parquet(uri)
    return back.select(*(F.col(c).cast(kinds.get(c, t)).alias(c) for c, t in back.dtypes)) if kinds else back


def read_bins(spark: SparkSession, out: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """The committed bins of `out`; an error if nothing is committed there."""
    system, path = filesystem(out)
    final = posixpath.join(path, _COMMITTED)
    if system.get_file_info([final])[0].type != fs.FileType.File:
        raise RepairError(f"nothing is committed in {out}")
    with system.open_input_stream(final) as f:
        folder = json.loads(f.read())["folder"]
    return _read(spark, _uri(out, path, folder), kinds or {})
