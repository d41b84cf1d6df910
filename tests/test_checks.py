"""Each check on clean and faulty datasets."""

import io
import json
import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from layouts import Layout

from frameledger.checks import CheckContext, CheckEngine, CheckRegistry, registry
from frameledger.checks.engine import Check
from frameledger.checks.video import walk_boxes
from frameledger.errors import CheckExecutionError
from frameledger.sources.loader import load, remote
from frameledger.verdict import CheckResult, Severity

F32 = pa.list_(pa.float32())


def run(spark, layout, path, check):
    ds = load(spark, layout.write(path))
    try:
        return CheckEngine._one(registry.get(check), ds, CheckContext())
    finally:
        ds.close()


def moving(layout):
    return layout.feature("action", "float32", [2], F32, lambda r: [r["index"] * 0.5, 1.0 - r["frame_index"]])


@pytest.mark.parametrize(("version", "episodes"), [("v3.0", 3), ("v2.1", 2), ("v2.0", 1), ("v3.0", 0)])
def test_clean(spark, tmp_path, version, episodes):
    ds = load(spark, moving(Layout(episodes, version=version)).write(tmp_path))
    results = CheckEngine().run(ds)
    ds.close()
    assert [(r.check_id, r.message) for r in results if r.severity is not Severity.INFO] == []
    assert [r.check_id for r in results] == [c.id for c in registry.all_checks()]
    assert len(registry) == 16


def shift(column, by, only=None):
    def change(x):
        for r in x.rows:
            if only is None or only(r):
                r[column] = by(r[column], r)
        return x

    return change


def retype(column, arrow):
    def change(x):
        x.types[column] = arrow
        if pa.types.is_integer(arrow):
            for r in x.rows:
                r[column] = int(r[column])
        return x

    return change


def episode(i, **what):
    def change(x):
        x.episodes[i] |= {k: x.episodes[i][k] + v if isinstance(v, int) else v for k, v in what.items()}
        return x

    return change


def task(text):
    def change(x):
        x.tasks[0]["task"] = text
        return x

    return change


def stats(feature="action", **what):
    def change(x):
        moving(x)
        v = np.array([r["action"] for r in x.rows], np.float32).astype(float)
        x.stats = {feature: {"mean": float(v.mean()), "std": float(v.std()), "min": 0} | what}
        return x

    return change


def episode_stats(factor):
    def change(x):
        moving(x)
        for e in x.episodes:
            v = np.array([r["action"] for r in x.rows if r["episode_index"] == e["episode_index"]], float)
            x.episode_stats[e["episode_index"]] = {"action/mean": float(v.mean()) * factor, "action/std": float(v.std())}
        return x

    return change


def action(value, **more):
    return lambda x: x.feature("action", "float32", [1], pa.float32(), value, **more)


def drop_episode(i):
    def change(x):
        x.rows = [r for r in x.rows if r["episode_index"] != i]
        return x

    return change


def video(data):
    def change(x):
        x.video = data
        return x

    return change


SWAP = {0: 1, 1: 0}
CASES = [
    ("STRUCTURAL.SCHEMA_CONSISTENCY", "FAIL", retype("timestamp", pa.int64())),
    ("STRUCTURAL.SCHEMA_CONSISTENCY", "FAIL", retype("task_index", pa.int32())),
    ("STRUCTURAL.SCHEMA_CONSISTENCY", "FAIL", retype("frame_index", pa.float32())),
    ("STRUCTURAL.SCHEMA_CONSISTENCY", "INFO", lambda x: x.feature("flag", "uint8", [1], pa.uint8(), lambda r: 1)),
    ("STRUCTURAL.SCHEMA_CONSISTENCY", "INFO", lambda x: x.feature("v", "float32", [2], pa.list_(pa.float32(), 2), lambda r: [0.0, 1.0])),
    ("STRUCTURAL.SCHEMA_CONSISTENCY", "FAIL", lambda x: x.feature("v", "float64", [2], F32, lambda r: [0.0, 1.0])),
    ("STRUCTURAL.INDEX_CONTINUITY", "FAIL", shift("frame_index", lambda v, r: v + 1)),
    ("STRUCTURAL.INDEX_CONTINUITY", "FAIL", shift("index", lambda v, r: v + 1, lambda r: r["episode_index"] == 2)),
    ("STRUCTURAL.INDEX_CONTINUITY", "FAIL", drop_episode(1)),
    ("STRUCTURAL.METADATA_DATA_AGREEMENT", "FAIL", episode(-1, dataset_to_index=1)),
    ("STRUCTURAL.METADATA_DATA_AGREEMENT", "FAIL", episode(0, dataset_from_index=-1)),
    ("STRUCTURAL.METADATA_DATA_AGREEMENT", "FAIL", episode(1, length=1)),
    ("STRUCTURAL.METADATA_DATA_AGREEMENT", "FAIL", drop_episode(0)),
    ("TEMPORAL.TIMESTAMP_MONOTONIC", "FAIL", shift("timestamp", lambda v, r: SWAP.get(r["frame_index"], r["frame_index"]) / 30, lambda r: r["episode_index"] == 0)),
    ("TEMPORAL.TIMESTAMP_MONOTONIC", "INFO", shift("timestamp", lambda v, r: math.nan, lambda r: r["frame_index"] == 1)),
    ("TEMPORAL.TIMESTAMP_MONOTONIC", "ERROR", shift("timestamp", lambda v, r: None, lambda r: r["frame_index"] == 1)),
    ("TEMPORAL.TIMESTAMP_SPACING", "FAIL", shift("timestamp", lambda v, r: v + 3 / 30, lambda r: r["episode_index"] == 0 and r["frame_index"] > 1)),
    ("TEMPORAL.TIMESTAMP_SPACING", "WARN", shift("timestamp", lambda v, r: v + 0.001, lambda r: r["frame_index"] == 2)),
    # a repeated timestamp is off by the spacing itself, which is not more than it
    ("TEMPORAL.TIMESTAMP_SPACING", "WARN", lambda x: shift("timestamp", lambda v, r: 0.5 * (r["frame_index"] // 2))(Layout(fps=2))),
    ("KNOWNBUG.TIMESTAMP_DRIFT", "FAIL", shift("timestamp", lambda v, r: v + 5e-5 * r["frame_index"])),
    ("KNOWNBUG.TIMESTAMP_DRIFT", "FAIL", shift("timestamp", lambda v, r: v + 1.0, lambda r: r["episode_index"] == 2)),
    ("KNOWNBUG.TIMESTAMP_DRIFT", "INFO", shift("timestamp", lambda v, r: v + 1e-7)),
    ("KNOWNBUG.TIMESTAMP_DRIFT", "INFO", shift("timestamp", lambda v, r: math.nan)),
    ("SEMANTIC.TASK_INTEGRITY", "FAIL", shift("task_index", lambda v, r: 99, lambda r: r["index"] == 11)),
    ("SEMANTIC.TASK_INTEGRITY", "FAIL", task("")),
    ("SEMANTIC.TASK_INTEGRITY", "FAIL", task("　 ")),
    ("SEMANTIC.TASK_INTEGRITY", "ERROR", shift("task_index", lambda v, r: None)),
    ("SEMANTIC.LANGUAGE_PRESENT", "WARN", episode(1, tasks=["", " "])),
    ("SEMANTIC.LANGUAGE_PRESENT", "WARN", episode(1, tasks=[])),
    ("SEMANTIC.FEATURE_DIMENSIONALITY", "FAIL", lambda x: x.feature("action", "float32", [7], F32, lambda r: [0.0] * 3, list("abcdefg"))),
    ("SEMANTIC.FEATURE_DIMENSIONALITY", "FAIL", lambda x: x.feature("action", "float32", [3], F32, lambda r: [0.0] * 3, ["a"])),
    ("SEMANTIC.FEATURE_DIMENSIONALITY", "INFO", lambda x: x.feature("action", "float32", [3], F32, lambda r: [0.0] * 3, {"motors": ["a", "b", "c"]})),
    ("SEMANTIC.FEATURE_DIMENSIONALITY", "FAIL", lambda x: x.feature("action", "float32", [3], pa.list_(pa.float32(), 2), lambda r: [0.0] * 2)),
    ("STATISTICAL.STATS_MATCH_DATA", "INFO", stats()),
    ("STATISTICAL.STATS_MATCH_DATA", "FAIL", stats(mean=0.9)),
    ("STATISTICAL.STATS_MATCH_DATA", "FAIL", stats(std=300.0)),
    ("STATISTICAL.STATS_MATCH_DATA", "INFO", stats(min=-99)),
    ("STATISTICAL.STATS_MATCH_DATA", "FAIL", stats(mean=[2.75, -0.5], std=[1.0, 1.0])),
    ("STATISTICAL.PER_EPISODE_STATS_MATCH", "INFO", episode_stats(1.0)),
    ("STATISTICAL.PER_EPISODE_STATS_MATCH", "WARN", episode_stats(3.0)),
    ("STATISTICAL.VALUE_SANITY", "FAIL", action(lambda r: math.nan)),
    ("STATISTICAL.VALUE_SANITY", "WARN", action(lambda r: 0.5)),
    ("STATISTICAL.VALUE_SANITY", "WARN", action(lambda r: 0.0)),
    ("STATISTICAL.VALUE_SANITY", "WARN", action(lambda r: None if r["index"] == 5 else float(r["frame_index"]))),
    ("STATISTICAL.VALUE_SANITY", "INFO", action(lambda r: float(r["frame_index"]))),
    ("VIDEO.DECODABLE_SPOTCHECK", "FAIL", video(b"")),
    ("VIDEO.DECODABLE_SPOTCHECK", "FAIL", video(b"garbage, not a movie")),
]


@pytest.mark.parametrize(("check", "severity", "change"), CASES, ids=[f"{c.split('.')[1]}-{i}" for i, (c, _, _) in enumerate(CASES)])
def test_case(spark, tmp_path, check, severity, change):
    r = run(spark, change(Layout()), tmp_path, check)
    assert r.severity.value == severity, r.message


def test_first_deviation_decides(spark, tmp_path):
    x = Layout(1, 6)
    for r in x.rows:
        r["timestamp"] += (0.001 if r["frame_index"] >= 2 else 0) + (1.0 if r["frame_index"] >= 4 else 0)
    assert run(spark, x, tmp_path, "TEMPORAL.TIMESTAMP_SPACING").severity is Severity.WARN


def test_drift_details(spark, tmp_path):
    x = shift("timestamp", lambda v, r: v + 0.01 * (r["episode_index"] == 1))(Layout())
    r = run(spark, x, tmp_path, "KNOWNBUG.TIMESTAMP_DRIFT")
    assert r.details["episode_index"] == 1
    assert r.details["cumulative_drift_s"] == pytest.approx(0.04, abs=1e-5)
    assert "0.010000s" in r.message


def test_scattered_rows(spark, tmp_path):
    """Of an episode whose rows are divided only the last stretch counts for the order checks."""
    x = Layout(2, 4)
    x.rows = [x.rows[0], x.rows[4], *x.rows[1:4], *x.rows[5:]]
    r = run(spark, x, tmp_path, "STRUCTURAL.METADATA_DATA_AGREEMENT")
    assert r.severity is Severity.FAIL
    assert len(r.details["violations"]) == 2


def test_empty_episode_is_listed_and_next_one_ends_it(spark, tmp_path):
    x = drop_episode(0)(Layout(4))
    x = shift("frame_index", lambda v, r: 7, lambda r: r["episode_index"] == 3)(x)
    r = run(spark, x, tmp_path, "STRUCTURAL.INDEX_CONTINUITY")
    assert len(r.details["violations"]) == 1  # episode 1 is sound and ends the check


def test_caps(spark, tmp_path):
    x = Layout(30)
    for e in x.episodes:
        e["dataset_to_index"] += 1
        e["length"] += 1
    x.totals = {}
    r = run(spark, x, tmp_path, "STRUCTURAL.METADATA_DATA_AGREEMENT")
    assert len(r.details["violations"]) == 5


def test_nan_in_stats_follows_the_order(spark, tmp_path):
    """NaN raises the count only: [1, NaN, 3] has mean 5/3."""
    x = Layout(1, 3).feature("action", "float32", [1], pa.float32(), lambda r: [1.0, math.nan, 3.0][r["frame_index"]])
    x.stats = {"action": {"mean": 5 / 3, "std": ((4 * (1 - 1 / 3)) / 3) ** 0.5}}
    assert run(spark, x, tmp_path, "STATISTICAL.STATS_MATCH_DATA").severity is Severity.INFO


def test_v21_stats(spark, tmp_path):
    x = episode_stats(2.0)(Layout(version="v2.1"))
    assert run(spark, x, tmp_path, "STATISTICAL.PER_EPISODE_STATS_MATCH").severity is Severity.WARN


def test_nulls_and_texts_in_stored_stats_leave_the_numbers(spark, tmp_path):
    """Beside a null the other numbers are still compared; numbers given as texts are none."""
    x = moving(Layout(2, version="v2.1"))
    x.stats = {"action": {"mean": [None, 99.0], "std": [None, 99.0, "7"]}, "index": {"mean": "99", "std": [[None], "99"]}}
    x.episode_stats = {0: {"action/mean": [None, 99.0], "action/std": [99.0, None], "index/mean": "99", "index/std": ["99"]}}
    ds = load(spark, x.write(tmp_path))
    got = {r.check_id: r.details.get("violations", []) for r in CheckEngine().run(ds)}
    ds.close()
    assert [v.split(":")[0] for v in got["STATISTICAL.STATS_MATCH_DATA"]] == ["feature 'action'", "feature 'action'"]
    assert [v.split(":")[0] for v in got["STATISTICAL.PER_EPISODE_STATS_MATCH"]] == ["episode 0 feature 'action'"] * 2


def test_remote_data_wait_for_deep(spark, tmp_path):
    assert [remote(x) for x in ("/a", "file:///a", "hdfs://n/a", "s3://b/a", "https://h/a")] == [False, False, False, True, True]
    slow = ("STATISTICAL.STATS_MATCH_DATA", "STATISTICAL.PER_EPISODE_STATS_MATCH", "STATISTICAL.VALUE_SANITY", "VIDEO.DECODABLE_SPOTCHECK")
    x = moving(Layout(2))
    x.stats = {"action": {"mean": [9.0], "std": [9.0]}}
    ds = load(spark, x.write(tmp_path))
    assert not ds.is_remote
    ds.is_remote = True
    for deep in (False, True):
        got = {r.check_id: r for r in CheckEngine().run(ds, CheckContext(deep=deep))}
        assert [got[c].message.startswith("Skipped: too slow") for c in slow] == [not deep] * 4
        assert (got[slow[0]].severity is Severity.FAIL) == deep
    ds.close()


def test_side_by_side_as_one_by_one(spark, tmp_path):
    ds = load(spark, shift("timestamp", lambda t, r: t + 0.5 * (r["frame_index"] == 2))(moving(Layout(3))).write(tmp_path))
    assert CheckEngine(at_once=6).run(ds) == CheckEngine(at_once=1).run(ds)
    ds.close()


def test_intrinsics(spark, tmp_path):
    name = "observation.camera_intrinsics"
    for sign, n in ((1.0, 0), (-1.0, 1)):
        x = Layout().feature(name, "float32", [9], F32, lambda r, s=sign: [s * 500.0, 0, 320, 0, 500, 240, 0, 0, 1])
        r = run(spark, x, tmp_path / str(sign), "SEMANTIC.CAMERA_INTRINSICS_PLAUSIBLE")
        assert r.severity is Severity.INFO
        assert len(r.details.get("violations", [])) == n


def test_skips(spark, tmp_path):
    x = Layout(camera=None)
    x.features["frame_index.top"] = x.features.pop("frame_index")
    x.types["frame_index.top"] = x.types.pop("frame_index")
    for r in x.rows:
        r["frame_index.top"] = r.pop("frame_index")
    ds = load(spark, x.write(tmp_path))
    got = {r.check_id: r for r in CheckEngine().run(ds)}
    ds.close()
    assert "VIDEO.DECODABLE_SPOTCHECK" not in got
    for c in ("STRUCTURAL.INDEX_CONTINUITY", "KNOWNBUG.TIMESTAMP_DRIFT"):
        assert got[c].severity is Severity.INFO
        assert "Skipped" in got[c].message


def test_missing_shard_cascades(spark, tmp_path):
    root = Layout().write(tmp_path)
    (tmp_path / "data/chunk-000/file-000.parquet").unlink()
    ds = load(spark, root)
    got = {r.check_id: r.severity.value for r in CheckEngine().run(ds)}
    ds.close()
    assert got["STRUCTURAL.PATH_TEMPLATE_RESOLVES"] == "FAIL"
    errors = {c for c, s in got.items() if s == "ERROR"}
    assert {"STRUCTURAL.SCHEMA_CONSISTENCY", "STRUCTURAL.INDEX_CONTINUITY", "TEMPORAL.TIMESTAMP_MONOTONIC", "SEMANTIC.TASK_INTEGRITY", "STATISTICAL.PER_EPISODE_STATS_MATCH"} <= errors
    assert got["STRUCTURAL.VERSION_DETECTED"] == "INFO"


def test_shards_of_different_types(spark, tmp_path):
    """A file whose timestamps are whole numbers breaks the schema check, not the scan."""
    root = Layout(2, version="v2.0").write(tmp_path)
    p = tmp_path / "data/chunk-000/episode_000001.parquet"
    t = pq.read_table(p)
    pq.write_table(t.set_column(0, "timestamp", pa.array([0, 1, 2, 3], pa.int64())), p)
    ds = load(spark, root)
    got = {r.check_id: r for r in CheckEngine().run(ds)}
    ds.close()
    assert got["STRUCTURAL.SCHEMA_CONSISTENCY"].severity is Severity.FAIL
    assert got["TEMPORAL.TIMESTAMP_MONOTONIC"].severity is Severity.INFO
    assert got["TEMPORAL.TIMESTAMP_SPACING"].severity is Severity.FAIL


def test_engine_and_registry():
    reg = CheckRegistry()

    def broken(ds, ctx):
        raise CheckExecutionError("no")

    reg.register(Check("A.B", Severity.FAIL, broken))
    reg.register(Check("V.X", Severity.FAIL, broken, requires_video=True))
    with pytest.raises(ValueError, match="registered"):
        reg.register(Check("A.B", Severity.FAIL, broken))

    class Bare:
        cameras = ()

    (r,) = CheckEngine(reg).run(Bare())
    assert r.severity is Severity.ERROR
    assert r.details["exc_type"] == "CheckExecutionError"
    assert "A.B" in reg
    assert reg.get("nope") is None
    assert isinstance(r, CheckResult)


def test_findings_are_all_listed(spark, tmp_path):
    n = 10_005
    x = Layout(1, n, camera=None)
    x.tasks += [{"task_index": i, "task": " "} for i in range(1, n + 1)]
    shift("task_index", lambda v, r: n + 1 + r["frame_index"])(x)
    r = run(spark, x, tmp_path / "tasks", "SEMANTIC.TASK_INTEGRITY")
    assert len(r.details["violations"]) == 2 * n
    assert f"({2 * n})" in r.message
    x = shift("timestamp", lambda v, r: v + 0.001 * r["frame_index"])(Layout(n, 2, camera=None))
    r = run(spark, x, tmp_path / "spacing", "TEMPORAL.TIMESTAMP_SPACING")
    assert (r.severity, len(r.details["warns"])) == (Severity.WARN, n)
    (tmp_path / "bad.mp4").write_bytes(b"garbage, not a movie")
    rows = [(i, i, "a", None, "no file") for i in range(n)] + [(0, 0, "b", "bad.mp4", None)]
    segments = spark.createDataFrame(rows, "ord bigint, episode_index bigint, camera string, path string, problem string")
    r = registry.get("VIDEO.DECODABLE_SPOTCHECK").run(SimpleNamespace(is_remote=False, root=str(tmp_path), segments=segments, cameras=["a", "b"]), CheckContext())
    assert len([v for v in r.details["failures"] if v.startswith("camera 'a' episode")]) == n
    assert any("'bad.mp4'" in v for v in r.details["failures"])


def test_boxes():
    walk = lambda b: walk_boxes(io.BytesIO(b), len(b))
    ok = b"\x00\x00\x00\x08ftyp\x00\x00\x00\x08moov\x00\x00\x00\x00mdat1234"
    assert walk(ok) is None
    assert "cut off" in walk(ok[:8] + b"\x00\x00\x00\x20moov")
    assert "no box" in walk(ok[:16])


def test_details_are_json(spark, tmp_path):
    r = run(spark, Layout(), tmp_path, "TEMPORAL.TIMESTAMP_SPACING")
    assert json.loads(json.dumps(r.details))["ideal_spacing_s"] == pytest.approx(1 / 30)
