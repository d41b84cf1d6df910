"""Version, schema, indices, counts and paths."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import functions as F

from frameledger.checks.engine import CheckContext, check, found, passed, require_shards
from frameledger.sources.files import exists, listing
from frameledger.sources.loader import TrajectoryDataset
from frameledger.verdict import CheckResult, Severity

#: Declared types of columns and the Arrow types they must have.
ARROW = {
    "float32": "float", "float64": "double", "int64": "int64", "int32": "int32", "int16": "int16", "int8": "int8", "uint8": "uint8", "bool": "bool", "string": "string",
}
_AGREEMENT_CAP, _PATHS_CAP = 5, 10


@check("STRUCTURAL.VERSION_DETECTED", Severity.INFO)
def version_detected(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    return passed("STRUCTURAL.VERSION_DETECTED", f"Format version {ds.version}.", version=ds.version)


@check("STRUCTURAL.SCHEMA_CONSISTENCY", Severity.FAIL)
def schema_consistency(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Declared columns against the footers; the first episode with a mismatch is reported."""
    me = "STRUCTURAL.SCHEMA_CONSISTENCY"
    if not ds.columns:
        require_shards(ds)
        return passed(me, "No columns are declared.")
    text = lambda x: F.lit(x).cast("string")
    declared = F.array(*(F.struct(F.lit(i).alias("place"), text(f.name).alias("name"), text(ARROW.get(f.dtype)).alias("want"), F.lit(f.shape == (1,)).alias("scalar")) for i, f in enumerate(ds.columns)))
    files = ds.footers.filter("error is null").select("path", F.explode_outer("columns").alias("c")).select("path", F.col("c.name").alias("name"), F.col("c.type").alias("type"), F.when(F.col("c.is_list"), F.col("c.element")).alias("element"))
    per_file = ds.footers.filter("error is null").select("path", F.inline(declared)).join(files, ["path", "name"], "left")
    held = F.when(F.col("scalar"), F.col("type")).otherwise(F.coalesce("element", "type"))
    bad = per_file.filter(F.col("type").isNull() | (F.col("want").isNotNull() & (held != F.col("want")))).select(F.col("path").alias("shard"), "place", "name", "type", "want", held.alias("held"))
    hits = ds.episodes.join(bad, "shard")
    first = hits.agg(F.min("ord")).first()[0]
    require_shards(ds, first)
    if first is None:
        return passed(me, "All data files have the declared columns and types.")
    rows = hits.filter(F.col("ord") == first).orderBy("place").collect()
    items = [f"episode {r.episode_index}: column {r.name!r} " + ("is absent from its file" if r.type is None else f"holds {r.held}, declared is {r.want}") for r in rows]
    return found(me, Severity.FAIL, "Files differ from the declared schema", items, "mismatches")


@check("STRUCTURAL.INDEX_CONTINUITY", Severity.FAIL)
def index_continuity(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Episode numbers 0..N-1; frame_index 0..length-1 and index from..from+length-1 in file order.

    Episodes without rows are listed; the first other one that comes after any finding ends the list.
    """
    me = "STRUCTURAL.INDEX_CONTINUITY"
    if "frame_index" not in ds.info.features:
        return passed(me, "Skipped: no feature frame_index is declared.")
    items = []
    gap = ds.episodes.filter("episode_index <> ord").orderBy("ord").select("ord", "episode_index").limit(1).collect()
    if gap:
        items.append(f"episode numbers are not 0..{ds.num_episodes - 1}: place {gap[0].ord} has episode {gap[0].episode_index}")
    require_shards(ds)
    rows = ds.placed(["frame_index", "index"])
    e = ds.episodes.select("ord", "episode_index", "length", "dataset_from_index")
    j = rows.select("ord", "position", "rows", "frame_index", "index").join(e, "ord")
    per = j.groupBy("ord").agg(
        F.max("rows").alias("rows"), F.count_if(~F.col("frame_index").eqNullSafe(F.col("position"))).alias("off"), F.count_if(~F.col("index").eqNullSafe(F.col("dataset_from_index") + F.col("position"))).alias("off_global")
    )
    bad = (F.col("off") > 0) | (F.col("off_global") > 0) | (F.col("rows") != F.col("length"))
    per = ds.keep(e.join(per, "ord", "left").withColumn("bad", bad))
    empty = per.filter("rows is null")
    after = 0 if gap else empty.agg(F.min("ord")).first()[0]
    stop = per.filter("rows is not null").agg(F.min(F.when(F.col("bad") | (F.col("ord") >= F.lit(after) if after is not None else F.lit(False)), F.col("ord")))).first()[0]
    none = empty if stop is None else empty.filter(F.col("ord") < stop)
    items += [f"episode {r.episode_index}: its file has no rows of it" for r in none.orderBy("ord").select("episode_index").toLocalIterator()]
    if stop is not None:
        r = per.filter(F.col("ord") == stop).first()
        head = j.filter((F.col("ord") == stop) & (F.col("position") < 5)).orderBy("position").select("frame_index", "index").collect()
        if r.off or r.rows != r.length:
            items.append(f"episode {r.episode_index}: frame_index is not 0..{r.length - 1}: {r.rows} rows from {[x[0] for x in head]}")
        if r.off_global or r.rows != r.length:
            items.append(f"episode {r.episode_index}: index does not run on from {r.dataset_from_index}: {r.rows} rows from {[x[1] for x in head[:3]]}")
    return found(me, Severity.FAIL, "Indices do not run on", items, "violations") if items else passed(me, "Episode, frame and global indices run on without gaps.")


@check("STRUCTURAL.METADATA_DATA_AGREEMENT", Severity.FAIL)
def metadata_data_agreement(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Declared lengths and bounds against each other, the declared total and the rows there are."""
    me = "STRUCTURAL.METADATA_DATA_AGREEMENT"
    items = []
    total = ds.episodes.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if ds.info.total_frames is not None and total != ds.info.total_frames:
        items.append(f"lengths add up to {total}, total_frames is {ds.info.total_frames}")
    e = ds.episodes.join(ds.row_counts(), "ord", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    span = F.col("dataset_to_index") - F.col("dataset_from_index")
    bad = e.filter((F.col("rows") != F.col("length")) | (span != F.col("length"))).orderBy("ord").limit(_AGREEMENT_CAP).collect()
    require_shards(ds)
    for r in bad:
        if len(items) >= _AGREEMENT_CAP:
            break
        if r.rows != r.length:
            items.append(f"episode {r.episode_index}: length is {r.length}, its file has {r.rows} rows of it")
        if r.dataset_to_index - r.dataset_from_index != r.length:
            items.append(f"episode {r.episode_index}: bounds {r.dataset_from_index}..{r.dataset_to_index} do not span its length {r.length}")
    return found(me, Severity.FAIL, "Metadata and data disagree", items, "violations") if items else passed(me, "Declared lengths and bounds agree with the rows.")


@check("STRUCTURAL.PATH_TEMPLATE_RESOLVES", Severity.FAIL)
def path_template_resolves(ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
    """Every data and video file the metadata names is there; a data file without row groups counts as absent."""
    me = "STRUCTURAL.PATH_TEMPLATE_RESOLVES"
    f = ds.footers.select(F.col("path").alias("shard"), "error", "row_groups")
    why = F.coalesce("problem", "error", F.when(F.col("row_groups") == 0, F.lit("no row group")))
    data = ds.episodes.join(f, "shard", "left").select("ord", "episode_index", F.lit("").alias("camera"), F.col("shard").alias("path"), why.alias("why")).filter("why is not null")
    bad = data
    if ds.cameras:
        there = ds.spark.createDataFrame([(p, True) for p in listing(ds.root, "videos")], "path string, there boolean")
        v = ds.segments.join(there, "path", "left").filter("there is null")
        bad = data.unionByName(v.select("ord", "episode_index", "camera", "path", F.coalesce("problem", F.lit("no file")).alias("why")))
    worst = bad.groupBy("ord").agg(F.min("ord").alias("_o")).orderBy("ord").limit(_PATHS_CAP).select("ord")
    items: list[str] = []
    at = None
    for r in bad.join(F.broadcast(worst), "ord").orderBy("ord", "camera").collect():  # _PATHS_CAP episodes
        if r.ord != at and len(items) >= _PATHS_CAP:
            break
        at = r.ord
        items.append(f"episode {r.episode_index} {'video of ' + repr(r.camera) if r.camera else 'data'}: {r.path or ''} {r.why}".replace("  ", " "))
    if exists(ds.root, "meta/stats.json", fs.FileType.Directory):
        items.append("meta/stats.json is no file")
    return found(me, Severity.FAIL, "Files are missing", items, "missing") if items else passed(me, "All data and video files are there.")
