"""Loading, reports, command line, audit, logs, streaming."""

import datetime as dt
import json
import logging
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from layouts import Layout
from pyspark.sql import functions as F

from frameledger import audit, cli, logs
from frameledger.checks import CheckContext, registry
from frameledger.errors import DatasetError, DatasetFormatError, DatasetVersionError, PathTraversalError, ResourceBoundError, SourceResolutionError
from frameledger.functions.columns import is_blank, month
from frameledger.report import Report, as_html, as_json, as_sarif, load_error_json, terminal
from frameledger.sources.files import check_bound, contained
from frameledger.sources.info import parse_info
from frameledger.sources.loader import load
from frameledger.streaming.live import watch_frames
from frameledger.verdict import CheckResult, Severity, exit_code, grade, scored, trust_score, worst

GOOD = {"codebase_version": "v3.0", "fps": 30, "features": {}}


@pytest.mark.parametrize(("change", "why"), [({"fps": 30.5}, "fps"), ({"fps": "x"}, "fps"), ({"features": {"a": {"shape": [1]}}}, "dtype"), ({"features": {"a": {"dtype": 3, "shape": [1]}}}, "dtype"), ({"features": {"a": 1}}, "object"), ({"features": []}, "features"), ({"codebase_version": 3}, "codebase_version"), ({"features": {"a": {"dtype": "x", "shape": [1], "names": {"m": "x"}}}}, "names")])
def test_bad_info(change, why):
    with pytest.raises(DatasetFormatError, match=why):
        parse_info(json.dumps(GOOD | change))


def test_info():
    for text in ("[]", "{", '{"fps": 1}'):
        with pytest.raises(DatasetFormatError):
            parse_info(text)
    for fps, want in ((30.0, 30), ("30", 30), (True, 1), (0, 0)):
        assert parse_info(json.dumps(GOOD | {"fps": fps})).fps == want
    i = parse_info(json.dumps(GOOD | {"robot_type": "x", "features": {"a": {"dtype": "float32", "shape": [2, 3], "names": {"m": ["p"], "n": ["q", "r"]}}}}))
    assert i.extra == {"robot_type": "x"}
    assert i.features["a"].names == ("p", "q", "r")
    assert i.features["a"].width == 6


def test_paths(tmp_path):
    assert contained(str(tmp_path), "a", "b/c").endswith("a/b/c")
    os.symlink("/", tmp_path / "out")
    assert contained(str(tmp_path), "/etc", "./a") == str(tmp_path / "etc/a")
    for bad in ("..", "a/../../b", "out/etc", "a\x00", "..\\a"):
        with pytest.raises(PathTraversalError):
            contained(str(tmp_path), bad)
    check_bound(5, 5, "x")
    with pytest.raises(ResourceBoundError):
        check_bound(6, 5, "x")


def broken(spark, tmp_path, edit, version="v3.0"):
    x = Layout(version=version)
    root = x.write(tmp_path)
    edit(tmp_path, x)
    return lambda: load(spark, root)


def rewrite_info(**change):
    def edit(root, x):
        p = root / "meta/info.json"
        p.write_text(json.dumps(json.loads(p.read_text()) | change))

    return edit


def drop_column(name):
    def edit(root, x):
        p = root / "meta/episodes/chunk-000/file-000.parquet"
        t = pq.read_table(p)
        pq.write_table(t.drop_columns([name]), p)

    return edit


def tasks_columns(*names):
    return lambda root, x: pq.write_table(pa.table({n: pa.array([0]) if n == "task_index" else pa.array(["t"]) for n in names}), root / "meta/tasks.parquet")


LOADS = [
    (DatasetFormatError, lambda r, x: (r / "meta/info.json").unlink(), "v3.0"),
    (DatasetFormatError, lambda r, x: (r / "meta/info.json").write_bytes(b"\xff\xfe"), "v3.0"),
    (DatasetVersionError, rewrite_info(codebase_version="v9"), "v3.0"),
    (DatasetVersionError, rewrite_info(codebase_version="v2.1"), "v3.0"),
    (ResourceBoundError, rewrite_info(total_frames=500_000_001), "v3.0"),
    (ResourceBoundError, rewrite_info(total_episodes=1_000_001), "v3.0"),
    (DatasetFormatError, lambda r, x: (r / "meta/tasks.parquet").unlink(), "v3.0"),
    (DatasetFormatError, tasks_columns("task_index", "name"), "v3.0"),
    (DatasetFormatError, drop_column("length"), "v3.0"),
    (DatasetFormatError, drop_column("videos/top/chunk_index"), "v3.0"),
    (DatasetFormatError, lambda r, x: (r / "meta/episodes/chunk-000/file-000.parquet").unlink(), "v3.0"),
    (PathTraversalError, rewrite_info(features={"../x": {"dtype": "video", "shape": [1]}}), "v3.0"),
    (DatasetVersionError, lambda r, x: (r / "meta/tasks.jsonl").unlink(), "v2.0"),
    (DatasetFormatError, lambda r, x: (r / "meta/episodes.jsonl").write_text('{"episode_index": 0, "tasks": [], "length": 1}\n{oops\n'), "v2.0"),
    (DatasetFormatError, lambda r, x: (r / "meta/episodes.jsonl").write_text("[1, 2]\n"), "v2.1"),
    (DatasetFormatError, lambda r, x: (r / "meta/tasks.jsonl").write_text('{"task_index": 0}\n'), "v2.1"),
]


@pytest.mark.parametrize(("error", "edit", "version"), LOADS)
def test_load_errors(spark, tmp_path, error, edit, version):
    with pytest.raises(error):
        broken(spark, tmp_path, edit, version)()


def test_no_dataset(spark):
    with pytest.raises(SourceResolutionError):
        load(spark, "org/name")


def test_task_columns_and_doubles(spark, tmp_path):
    x = Layout()
    x.task_column = "__index_level_0__"
    x.tasks = [{"task_index": 0, "task": "old"}, {"task_index": 1, "task": "b"}, {"task_index": 0, "task": "new"}]
    ds = load(spark, x.write(tmp_path))
    assert [tuple(r) for r in ds.tasks.orderBy("ord").select("task_index", "task").collect()] == [(0, "new"), (1, "b")]


def test_v2_offsets_and_shards(spark, tmp_path):
    x = Layout(3, version="v2.1")
    x.episodes = x.episodes[::-1]
    root = x.write(tmp_path)
    (tmp_path / "data/chunk-001").mkdir()
    os.link(tmp_path / "data/chunk-000/episode_000001.parquet", tmp_path / "data/chunk-001/episode_000001.parquet")
    (tmp_path / "data/chunk-000/episode_000002.parquet").unlink()
    ds = load(spark, root)
    got = [tuple(r) for r in ds.episodes.orderBy("ord").select("episode_index", "dataset_from_index", "dataset_to_index", "problem").collect()]
    assert got == [(0, 0, 4, None), (1, 4, 8, "several files"), (2, 8, 12, "no file")]
    r = registry.get("STRUCTURAL.PATH_TEMPLATE_RESOLVES").run(ds, CheckContext())
    assert len(r.details["missing"]) == 2


def test_scan_reads_wanted_columns_only(spark, tmp_path):
    ds = load(spark, Layout().write(tmp_path))
    plan = ds.frames(["timestamp"])._jdf.queryExecution().executedPlan().toString()
    scan = next(s for s in plan.split("ReadSchema") if "timestamp" in s.split("\n")[0])
    assert "task_index" not in scan.split("\n")[0]
    assert "Python" not in plan.split("Scan parquet")[0]


RESULTS = [CheckResult("A.X", Severity.INFO, "fine"), CheckResult("B.Y", Severity.FAIL, "<b>&bad"), CheckResult("B.Z", Severity.WARN, "hm")]


def test_score():
    many = lambda **n: [CheckResult("x", Severity[k], "") for k, c in n.items() for _ in range(c)]
    assert trust_score(many(FAIL=3, WARN=5)) == 20
    assert trust_score(many(FAIL=1)) == 70
    assert trust_score(many(ERROR=11)) == 0
    assert trust_score([]) == 100
    assert [grade(worst(many(**{s: 1}))) for s in ("INFO", "WARN", "FAIL", "ERROR")] == ["PASS", "WARN", "FAIL", "ERROR"]
    assert [exit_code(Severity[s]) for s in ("INFO", "WARN", "FAIL", "ERROR")] == [0, 1, 2, 2]
    assert Severity.INFO < Severity.WARN < Severity.FAIL < Severity.ERROR


def test_score_of_rows(spark):
    data = [("a", "FAIL")] * 3 + [("a", "WARN")] * 5 + [("b", "INFO"), ("c", "ERROR"), ("d", "WARN")]
    got = {r.ref: r for r in scored(spark.createDataFrame(data, "ref string, severity string"), ["ref"]).collect()}
    assert {k: (r.trust_score, r.grade, r.exit_code) for k, r in got.items()} == {"a": (20, "FAIL", 2), "b": (100, "PASS", 0), "c": (90, "ERROR", 2), "d": (95, "WARN", 1)}


def test_reports():
    r = Report('x"<y', "v3.0", 3, None, RESULTS)
    j = json.loads(as_json(r))
    assert list(j) == ["ref", "version", "trust_score", "score_formula_version", "grade", "num_episodes", "num_frames", "results"]
    assert j["results"][1] == {"check_id": "B.Y", "severity": "FAIL", "category": "B", "message": "<b>&bad"}
    e = json.loads(load_error_json("x", DatasetFormatError("no")))
    assert (e["grade"], e["error_category"], e["results"]) == ("ERROR", "DatasetFormatError", [])
    assert set(j) <= set(e)
    h = as_html(r)
    assert "&lt;b&gt;&amp;bad" in h
    assert "<b>&bad" not in h
    s = json.loads(as_sarif(r))["runs"][0]
    assert [x["level"] for x in s["results"]] == ["note", "error", "warning"]
    assert [x["id"] for x in s["tool"]["driver"]["rules"]] == ["A.X", "B.Y", "B.Z"]
    assert s["properties"]["trust_score"] == 65
    t = terminal(r)
    assert "unknown" in t
    counts = t[t.index("by severity") :]
    assert counts.index("FAIL") < counts.index("WARN") < counts.index("ERROR") < counts.index("INFO")
    assert "score 65 of 100" in t


def test_command_line(spark, tmp_path, capsys):
    good = Layout().write(tmp_path / "good")
    assert cli.main(["lint", good, "--json", "--report", str(tmp_path / "r.html"), "--sarif", str(tmp_path / "r.sarif")]) == 0
    assert json.loads(capsys.readouterr().out)["grade"] == "PASS"
    assert (tmp_path / "r.html").read_text().startswith("<!DOCTYPE")
    assert json.loads((tmp_path / "r.sarif").read_text())["version"] == "2.1.0"
    assert cli.main(["lint", str(tmp_path / "none"), "--json"]) == 2
    assert json.loads(capsys.readouterr().out)["error_category"] == "SourceResolutionError"
    assert cli.main(["fix", good]) == 2


def test_audit(spark, tmp_path):
    bad = Layout()
    bad.episodes[0]["dataset_to_index"] += 1
    refs = [Layout(1).write(tmp_path / "a"), bad.write(tmp_path / "b"), str(tmp_path / "c")]
    runs = audit.audit(spark, refs, timeout=120).cache()
    assert [r.status for r in runs.collect()] == ["PASS", "FAIL", "ERROR"]
    s = audit.status_summary(runs).first()
    assert (s.datasets, s.n_pass, s.n_timeout, s.pct_fail_or_worse) == (3, 1, 0, 66.7)
    assert audit.top_checks(runs).first().check_id == "STRUCTURAL.METADATA_DATA_AGREEMENT"
    assert {r.defect: (r.n, r.pct) for r in audit.known_defects(runs).collect()} == {"timestamp_drift": (0, 0.0), "metadata_data_agreement": (1, 50.0)}
    assert "66.7 %" in audit.summary_text(runs)
    assert audit.audit_one(spark, refs[0], timeout=0.01)[1] == "TIMEOUT"
    none = spark.createDataFrame([], audit.SCHEMA)
    assert audit.status_summary(none).first().pct_any_issue == 0.0
    names = spark.createDataFrame([(f"d{i:03d}",) for i in range(50)], "repo_id string")
    assert audit.choose(names, 5).count() == 5


def test_secrets(spark, caplog):
    assert logs.redacted({"my_TOKEN": "x", "n": {"password": "y", "z": 1}}) == {"my_TOKEN": logs.REDACTED, "n": {"password": logs.REDACTED, "z": 1}}
    rec = logging.LogRecord("frameledger", 20, "", 0, "api_key=%s other=%s", ("abc", "def"), None)
    logs.SecretFilter().filter(rec)
    assert "abc" not in rec.getMessage()
    assert "def" in rec.getMessage()
    df = spark.createDataFrame([("Authorization", "b"), ("x", "c")], "k string, v string")
    assert [r[0] for r in df.select(logs.redacted_value(F.col("k"), F.col("v"))).collect()] == [logs.REDACTED, "c"]


def test_text_rules(spark):
    texts = ["", " \t\n", "　 ", "\x1c\x85", "a", " .", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.b for r in df.select("i", is_blank(F.col("t")).alias("b")).collect()}
    assert got == {i: t is None or not t.strip() for i, t in enumerate(texts)}
    assert spark.range(1).select(month(F.lit("2023-04-30 23:59:59").cast("timestamp_ntz"))).first()[0] == "2023-04"


def test_live_frames(spark, tmp_path):
    rows = [(1, e, i, i / 10 + (5.0 if (e, i) == (1, 3) else 0.0), dt.datetime(2023, 1, 1)) for e in (0, 1) for i in range(6)]
    src = tmp_path / "in"
    spark.createDataFrame(rows, "dataset_id bigint, episode_index bigint, frame_index bigint, timestamp float, loaded_at timestamp").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("dataset_id bigint, episode_index bigint, frame_index bigint, timestamp float, loaded_at timestamp").parquet(str(src))
    q = watch_frames(stream, 10).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    got = {(r.episode_index, r.frame_index, r.kind) for r in spark.table("live").collect()}
    assert got == {(1, 3, "spacing"), (1, 3, "drift"), (1, 4, "spacing"), (1, 4, "not increasing")}


def test_errors_are_one_family():
    assert issubclass(PathTraversalError, DatasetError)
