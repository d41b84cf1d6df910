"""The operators on training data against brute force, and on odd input."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameledger.operators import common, compaction, intervals, orphans, regrid, schema_drift, series, spikes
from frameledger.plans import problems
from frameledger.sources.compact import fingerprint, freeze, planned_rows, read_bins, rewrite
from frameledger.errors import RepairError

DAY = dt.datetime(2023, 1, 1)
FRAMES = "dataset_id bigint, episode_index bigint, frame_index bigint, index bigint, timestamp float, task_index bigint, action array<float>, loaded_at timestamp_ntz"
EPISODES = "dataset_id bigint, episode_index bigint, length bigint, dataset_from_index bigint, dataset_to_index bigint, `meta/episodes/chunk_index` bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
SEGMENTS = "dataset_id bigint, episode_index bigint, camera string, chunk_index bigint, file_index bigint, from_timestamp double, to_timestamp double, loaded_at timestamp_ntz"
TASKS = "dataset_id bigint, task_index bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
SHARDS = "dataset_id bigint, `data/chunk_index` bigint, `data/file_index` bigint, episode_index bigint, from_frame bigint, to_frame bigint, size_bytes bigint, checksum bigint, written_at timestamp_ntz"


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def extra(df, *names):
    """df with columns of names that the operators use inside."""
    for n in names:
        df = df.withColumn(n, F.lit("x"))
    return df


def test_orphans(spark):
    rng = random.Random(1)
    eps = [(1, e, None, None, None, 0, day(rng.randint(0, 60)), day(rng.choice([None, 70, 80]))) for e in range(-3, 12) for _ in range(rng.randint(0, 2))]
    tasks = [(1, t, day(5), day(t + 5)) for t in range(3)] + [(1, 1, day(50), None)]
    frames = [(rng.choice([1, 1, None]), rng.choice([*range(-4, 14), None]), i, i, 0.0, rng.choice([0, 1, 2, 7, None]), None, day(rng.randint(0, 90))) for i in range(300)]
    frames += frames[:20] + [(1, 50, 0, 0, 0.0, None, None, None)]
    segs = [(1, rng.randint(0, 13), "top", 0, 0, 0.0, 1.0, day(rng.randint(0, 90))) for _ in range(40)]
    got = orphans.orphan_references(
        extra(spark.createDataFrame(frames, FRAMES), "key", "link", "_range"), spark.createDataFrame(segs, SEGMENTS), extra(spark.createDataFrame(eps, EPISODES), "at", "until"), spark.createDataFrame(tasks, TASKS), width=4, rows_per_task=7
    )
    refs = [("frames", "episodes", f[0], f[1], f[1], f[7]) for f in frames] + [("frames", "tasks", f[0], f[1], f[5], f[7]) for f in frames] + [("video_segments", "episodes", s[0], s[1], s[1], s[7]) for s in segs]
    want = set()
    for src, ref, d, e, k, at in refs:
        if d is None or k is None:
            continue
        have = [(x[6], x[7]) for x in eps if x[:2] == (d, k)] if ref == "episodes" else [(x[2], x[3]) for x in tasks if x[:2] == (d, k)]
        if any(at is None or (a <= at and (b is None or b > at)) for a, b in have):
            continue
        kind = "missing" if not have else "late" if all(a > at for a, _ in have) else "deleted"
        want.add((src, ref, at and f"{at:%Y-%m}", d, e, k, kind))
    assert set(rows(got)) == want
    assert len(rows(got)) == len(want)


def test_orphans_of_empty_tables(spark):
    e = lambda s: spark.createDataFrame([], s)
    assert rows(orphans.orphan_references(e(FRAMES), e(SEGMENTS), e(EPISODES), e(TASKS))) == []
    one = spark.createDataFrame([(1, 2, 0, 0, 0.0, 3, None, day(1))], FRAMES)
    got = rows(orphans.orphan_references(one, e(SEGMENTS), e(EPISODES), e(TASKS)))
    assert [(r[1], r[6]) for r in got] == [("episodes", "missing"), ("tasks", "missing")]


def brute_grid(readings, lengths):
    out = []
    for k, n in lengths.items():
        have = {}
        for kk, c, v in readings:
            if kk == k and c is not None and 0 <= c < n:
                have[c] = v if c not in have or have[c] is None or (v is not None and v < have[c]) else have[c]
        last = None
        for i in range(n):
            last = i if i in have else last
            out.append((k, i, have.get(last), "reading" if i in have else "missing" if last is None else "filled", last))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [1, 3, 1000])
def test_grid(spark, shard):
    rng = random.Random(shard)
    lengths = {1: 40, 2: 1, 3: 17, 4: 9}
    readings = [(rng.randint(1, 3), rng.choice([None, rng.randint(-3, 45)]), rng.choice([None, rng.randint(0, 9)])) for _ in range(60)]
    r = spark.createDataFrame(readings, "k bigint, c bigint, v bigint")
    s = spark.createDataFrame([*lengths.items(), (5, 0), (6, None)], "k bigint, length bigint")
    got = regrid.regular_grid(extra(r, "shard", "have"), extra(s, "cell", "carry"), ["k"], "c", F.col("v"), shard=shard)
    assert rows(got) == brute_grid(readings, lengths)
    unfilled = {(k, i) for k, i, _, s, _ in brute_grid(readings, lengths) if s != "reading"}
    bare = regrid.regular_grid(r, s, ["k"], "c", shard=shard, fill=False).filter("state = 'missing'")
    assert {(x[0], x[1]) for x in rows(bare)} == unfilled


def test_missing_periods(spark):
    f = [(1, 0, i, i, t, 0, None, DAY) for i, t in enumerate([0.0, 0.1, 0.26, 0.4, float("nan"), float("inf"), -5.0, 9.9, None, 3e38])]
    eps = [(1, 0, 6, None, None, 0, DAY, DAY), (1, 0, 6, None, None, 0, DAY, DAY), (1, 1, None, None, None, 0, DAY, None), (2, 0, 3, None, None, 0, DAY, None)]
    fps = spark.createDataFrame([(1, 10), (1, 10), (2, None)], "dataset_id bigint, fps int")
    got = regrid.missing_periods(spark.createDataFrame(f, FRAMES), spark.createDataFrame(eps, EPISODES), fps)
    assert rows(got) == [(1, 0, 2), (1, 0, 5), (2, 0, 0), (2, 0, 1), (2, 0, 2)]  # 0.26 lies in period 3


INFO = "file_id bigint, repo_id bigint, ref string, revision bigint, written_at timestamp_ntz, body string"
TASK = "repo_id bigint, revision bigint, line_no bigint, written_at timestamp_ntz, record string"


def test_schema_changes(spark):
    feat = lambda **k: '{"features": {' + ", ".join(f'"{n}": {v}' for n, v in k.items()) + "}}"
    a, b = '{"dtype": "float32", "shape": [2]}', '{"shape": [3.0], "dtype": "float32", "names": null}'
    bodies = [
        (1, 1, '{"codebase_version": "v2.0", "fps": 30, "robot_type": "arm", "x": null}'),
        (1, 2, "not json"),
        (1, 3, '{"fps": 30.0, "robot": "arm", "codebase_version": "2.1", "x": 1}'),
        (1, 5, '{"fps": "30", "codebase_version": 2.1}'),
        (1, 6, "[1]"),
        (2, 1, feat(p=a, q=a)),
        (2, 2, feat(p=b, q2=a, r="null")),
        (3, 1, None),
        (3, 2, '{"fps": 5}'),
        (3, 3, '{"fps": 5e0}'),
    ]
    info = spark.createDataFrame([(i, r, "x", v, day(i), t) for i, (r, v, t) in enumerate(bodies)], INFO)
    recs = [(1, 1, 0, DAY, '{"task_index": 0, "task": "a"}'), (1, 1, 1, DAY, '{"task_index": 1, "task": null}'), (1, 1, 2, DAY, ""), (1, 4, 0, DAY, '{"task_index": "0", "__index_level_0__": "a"}'), (1, 4, 1, DAY, "{broken"), (1, 9, 0, DAY, None)]
    got = rows(schema_drift.schema_changes(extra(info, "fields", "prev"), extra(spark.createDataFrame(recs, TASK), "n", "type")))
    want = [
        (1, 3, "info", "codebase_version", "version"), (1, 3, "info", "robot_type", "renamed"), (1, 3, "info", "x", "added"),
        (1, 5, "info", "codebase_version", "retyped"), (1, 5, "info", "fps", "retyped"), (1, 5, "info", "robot", "removed"), (1, 5, "info", "x", "removed"),
        (2, 2, "feature", "p", "reshaped"), (2, 2, "feature", "q", "renamed"),
        (1, 4, "task", "task", "renamed"), (1, 4, "task", "task_index", "retyped"),
    ]
    assert got == sorted(want, key=repr)
    table = {(r.repo_id, r.revision): r for r in schema_drift.consistent_table(info, spark.createDataFrame(recs, TASK)).collect()}
    assert set(table) == {(1, 1), (1, 3), (1, 5), (2, 1), (2, 2), (3, 2), (3, 3)}
    assert table[1, 3].robot_type == "arm"
    assert "rename robot -> robot_type" in table[1, 3].applied
    assert table[1, 5].fps == 30.0
    assert table[1, 5].robot_type == "unknown"
    assert table[1, 5].codebase_version == table[1, 3].codebase_version == "v2.1"
    assert table[2, 2].n_features == 2


def test_rename_of_equal_values_is_no_rule(spark):
    bodies = ['{"fps": 30, "robot_type": "a"}', '{"total_episodes": 30, "robot": "a"}', '{"total_episodes": 31, "bot": "a"}']
    info = spark.createDataFrame([(i, 1, "x", i, day(i), t) for i, t in enumerate(bodies)], INFO)
    assert schema_drift.rename_rules(schema_drift.info_schemas(info)) == {"robot": "robot_type", "bot": "robot_type"}
    got = {r.revision: r for r in schema_drift.consistent_table(info, spark.createDataFrame([], TASK)).collect()}
    assert [got[i].robot_type for i in range(3)] == ["a", "a", "a"]
    assert [got[i].fps for i in range(3)] == [30.0, None, None]


def test_table_keeps_features_other_keys_and_tasks(spark):
    bodies = [
        '{"fps": 30, "robot": 5, "total_frames": "many", "license": "mit", "splits": {"train": "0:9"}, "features": {"t": {"dtype": "float32", "shape": [1.0], "names": ["s"]}, "a": {"dtype": "float32", "shape": [2]}, "b": {"dtype": "float32", "shape": [2]}}}',
        '{"features": {"time": {"dtype": "float32", "shape": [1]}, "b": {"dtype": "float32", "shape": [2]}, "c": {"dtype": "float32", "shape": [2]}}}',
        '{"features": {"a": {"dtype": "float32", "shape": [2]}, "c": {"dtype": "float32", "shape": [2]}, "time": {"dtype": "float32", "shape": [1]}}}',
        '{"features": {"a": {"dtype": "float32", "shape": [2]}, "c": {"dtype": "float32", "shape": [2]}, "time": {"dtype": "float32", "shape": [1]}}}',
    ]
    info = spark.createDataFrame([(i, 1, "x", i, day(i), t) for i, t in enumerate(bodies)], INFO)
    got = {r.revision: r for r in schema_drift.consistent_table(info, spark.createDataFrame([], TASK)).collect()}
    assert [tuple(x) for x in got[0].other] == [("license", "string", "mit"), ("robot", "number", "5"), ("splits", "object", '{"train": "0:9"}'), ("total_frames", "string", "many")]
    assert [tuple(x) for x in got[0].features] == [("a", "float32", "[2]", None), ("b", "float32", "[2]", None), ("time", "float32", "[1]", '{"names": ["s"]}')]
    assert got[0].applied.endswith("; rename feature t -> time")
    assert {r: [x.name for x in got[r].features] for r in (1, 2, 3)} == {1: ["b", "c", "time"], 2: ["a", "c", "time"], 3: ["a", "c", "time"]}  # a and c stand side by side
    recs = ['{"task_index": 0, "task": "x"}', '{"task_index": "1", "__index_level_0__": "y", "priority": 2}', '{"__index_level_0__": "y", "task": "z", "task_index": 1.5}', "{broken", "[]", '{"task": null}']
    tasks = spark.createDataFrame([(1, 1, i, DAY, t) for i, t in enumerate(recs)] + [(1, 1, 0, day(1), '{"task": "x", "task_index": 0.0}'), (None, 1, 0, DAY, "{}")], TASK)
    assert [(*r[:5], [tuple(x) for x in r.other], r.applied) for r in sorted(schema_drift.task_table(tasks).collect(), key=lambda r: r.line_no)] == [
        (1, 1, 0, 0, "x", [], ""),
        (1, 1, 1, 1, "y", [("priority", "number", "2")], "cast task_index; rename __index_level_0__ -> task"),
        (1, 1, 2, 1, "y", [("task", "string", "z"), ("task_index", "number", "1.5")], "rename __index_level_0__ -> task"),
        (1, 1, 5, None, None, [], "default task_index; default task"),
    ]


def test_table_of_revisions_without_a_body(spark, tmp_path):
    spark.createDataFrame([(0, 1, "x", 1, DAY, '{"fps": 30, "robot_type": "a"}'), (1, 1, "x", 2, DAY, "not json")], INFO).write.parquet(f"{tmp_path}/info_files.parquet")
    spark.createDataFrame([(1, 2, 0, DAY, '{"task_index": 0, "task": "x"}'), (2, 1, 0, DAY, "{}"), (2, 2, 0, DAY, "{broken")], TASK).write.parquet(f"{tmp_path}/task_records.parquet")
    got = {(r.repo_id, r.revision): r for r in problems.p3_table(spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    r = got[1, 2]
    assert (r.file_id, r.fps, r.robot_type, r.other, r.features, r.n_features, r.n_task_keys) == (None, None, "unknown", None, None, None, 2)
    assert r.applied == "no body; default codebase_version; default fps; default total_episodes; default total_frames; default robot_type"
    assert got[2, 1].n_task_keys == 0
    assert "no body" not in got[1, 1].applied


def test_deep_and_long_bodies():
    assert schema_drift._described("[" * 100_000) is None
    assert [f[2] for f in schema_drift._described('{"a": 1' + "0" * 3000 + ', "b": "' + "x" * 100_000 + '", "c": 1e999}')] == ["number", "string", "number"]


def test_schema_of_nothing(spark):
    e = spark.createDataFrame([], INFO), spark.createDataFrame([], TASK)
    assert rows(schema_drift.schema_changes(*e)) == []
    assert rows(schema_drift.consistent_table(*e)) == []


def random_shards(seed, n=120):
    rng = random.Random(seed)
    out = []
    for f in range(n):
        a = rng.choice([0, 0, rng.randint(0, 5000)])
        b = rng.choice([a, a + rng.randint(0, 3000), None, a - 1])
        out.append((1, f // 50, f % 50, rng.randint(0, 6), a, b, rng.choice([None, 4000 + f]), f, day(rng.randint(0, 5))))
    return out + out[:10] + [(None, 0, 0, 0, 0, 9, 1, 1, DAY), (1, 90, 0, 0, 0, 9, 1, 1, None)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_superfluous_pieces(spark, seed):
    shards = random_shards(seed)
    got = compaction.superfluous_pieces(extra(spark.createDataFrame(shards, SHARDS), "lo", "hi", "best"))
    p = {s for s in shards if None not in s[:4]}
    n = lambda s: max(0, s[5] - s[4]) if s[5] is not None else 0
    want = set()
    for a in p:
        for b in p:
            if a[3] != b[3] or a[1:3] == b[1:3] or n(b) == 0 or (n(a) and not (b[4] <= a[4] and b[5] >= a[5])):
                continue
            wa, wb = a[8] or dt.datetime(1, 1, 1), b[8] or dt.datetime(1, 1, 1)
            if n(b) > n(a) or wb > wa or (wb == wa and b[1:3] < a[1:3]):
                want.add((a[0], a[1], a[2], a[3]))
    assert set(rows(got)) == want
    plan = compaction.compaction_plan(spark.createDataFrame(shards, SHARDS), target_bytes=9000, group_units=10).collect()
    held = {}
    for r in plan:
        for i in range(r.from_frame, r.to_frame):
            held[r.episode_index, i] = held.get((r.episode_index, i), 0) + 1
    assert set(held) == {(s[3], i) for s in p for i in range(s[4], s[4] + n(s))}
    assert set(held.values()) == {1}
    size = {}
    for r in plan:
        size.setdefault((r.bin_group, r.bin_no), []).append(r.est_bytes)
    assert all(sum(x) <= 9000 or len(x) == 1 for x in size.values())
    every = compaction.compaction(spark.createDataFrame(shards, SHARDS), target_bytes=9000, group_units=10)
    assert len(rows(every)) == len({s[:9] for s in shards if None not in s[:4]})
    assert rows(every.filter("bin_no is not null").drop("superfluous")) == sorted(map(tuple, plan), key=repr)
    assert every.filter("superfluous and bin_no is not null").isEmpty()


def test_manifest_is_frozen_before_anything_is_decided(spark):
    """The listing is read once: what a table says when it is read again has no part in the plan."""
    shards = [(1, 0, i, i % 5, 10 * i, 10 * i + 10, 100, i, DAY) for i in range(100)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    plan = compaction.compaction_plan(spark.createDataFrame(shards, SHARDS).mapInPandas(counted, SHARDS))
    assert plan.count() == 100
    assert read.value == 100


def test_piece_listed_twice_is_copied_once(spark):
    """With two checksums, two sizes, or with and without a time; of an episode that fits a bin and of a larger one."""
    one = [(1, 0, 0, 0, 0, 10, 100, 1, DAY), (1, 0, 0, 0, 0, 10, 100, 2, DAY), (1, 0, 0, 0, 0, 10, None, 3, DAY), (1, 0, 1, 0, 10, 20, 70, None, None), (1, 0, 1, 0, 10, 20, 70, 1, dt.datetime(1, 1, 1))]
    for target in (300, 120):
        plan = compaction.compaction_plan(spark.createDataFrame(one, SHARDS), target)
        assert [tuple(r)[:4] for r in rows(compaction.held_frames(plan))] == [(1, 0, 20, 0)]
        assert sorted((r.file_index, r.from_frame, r.to_frame, r.est_bytes) for r in plan.collect()) == [(0, 0, 10, 100), (1, 10, 20, 70)]


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_is_held_to_the_manifest(spark, monkeypatch, seed):
    shards = random_shards(seed, 60)
    listed = compaction.manifest(spark.createDataFrame(shards, SHARDS))
    plan = compaction.compaction_plan(spark.createDataFrame(shards, SHARDS)).select(*compaction.EPISODE, "from_frame", "to_frame").collect()
    df = lambda p: spark.createDataFrame(p, "dataset_id bigint, episode_index bigint, from_frame bigint, to_frame bigint")
    assert rows(compaction.wrongly_held(listed, df(plan))) == []
    d, e, a, b = plan[-1]
    part = lambda p: {r[:3]: r[3:] for r in rows(compaction.wrongly_held(listed, df(p)))}
    assert part(plan[:-1])[d, e, a][1] == 0
    assert part([*plan, (d, e, b - 1, b)])[d, e, b - 1][1] == 2
    assert part([*plan[:-1], (d, e, a, b - 1)])[d, e, b - 1][1] == 0
    assert part([*plan, (d, 99, 0, 1)]) == {(d, 99, 0): (0, 1)}
    whole = compaction.judged
    monkeypatch.setattr(compaction, "judged", lambda p: whole(p).withColumn("superfluous", F.lit(True)))
    with pytest.raises(RepairError, match="lost or doubled"):
        compaction.compaction(spark.createDataFrame(shards, SHARDS))


def test_episodes_stay_together(spark):
    shards = [(1, 0, i, i // 4, 10 * (i % 4), 10 * (i % 4) + 10, 1000, i, DAY) for i in range(200)] + [(1, 1, i, 999, 10 * i, 10 * i + 10, 3000, i, DAY) for i in range(9)]
    plan = compaction.compaction_plan(spark.createDataFrame(shards, SHARDS), target_bytes=10_000)
    held = {r.episode_index: r for r in compaction.held_frames(plan).collect()}
    assert {(e, r.frames, r.doubled) for e, r in held.items()} == {(e, 40, 0) for e in range(50)} | {(999, 90, 0)}
    assert {r.bins for e, r in held.items() if e != 999} == {1}
    assert held[999].bins == 3
    assert all(r.bytes <= 10_000 for r in compaction.bin_sizes(plan).collect())


def test_bins_of_many_groups_are_full(spark):
    shards = [(1, 0, i, i, 0, 10, 4000, i, DAY) for i in range(3000)]
    plan = compaction.compaction_plan(spark.createDataFrame(shards, SHARDS), target_bytes=1_280_000, group_units=200).collect()
    assert {r.episode_index for r in plan} == set(range(3000))
    assert len(plan) == 3000
    size = {}
    for r in plan:
        size[r.bin_group, r.bin_no] = size.get((r.bin_group, r.bin_no), 0) + r.est_bytes
    assert max(size.values()) <= 1_280_000
    assert len(size) <= 11  # ten would hold them


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    sizes = rng.integers(0, 70, 200)
    got = compaction.first_fit_decreasing(sizes, 100)
    room, want = [], np.zeros(200, int)
    for i in np.argsort(-sizes, kind="stable"):
        b = next((j for j, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(100)
        room[b] -= sizes[i]
        want[i] = b
    assert (got == want).all()
    assert list(compaction.first_fit_decreasing(np.array([500, 1]), 100)) == [0, 1]


@pytest.fixture
def packing(spark):
    shards = [(1, 0, i, i // 2, 5 * (i % 2), 5 * (i % 2) + 5, 100, i, DAY) for i in range(8)] + [(1, 7, 7, 0, 0, 5, 90, 1, day(-1))]
    frames = spark.createDataFrame([(s[0], s[1], s[2], s[3], p, float(p)) for s in shards for p in range(s[4], s[5])], "dataset_id bigint, chunk_index bigint, file_index bigint, episode_index bigint, position bigint, v double")
    return frames, compaction.compaction_plan(spark.createDataFrame(shards, SHARDS), target_bytes=300)


def test_rewrite(spark, tmp_path, packing):
    frames, plan = packing
    kept = planned_rows(frames, plan)
    assert kept.count() == 40
    out = str(tmp_path / "packed")
    frozen = freeze(frames, plan)
    made = rewrite(frames, frozen, out)
    assert made.agg(F.sum("rows")).first()[0] == 40
    assert rows(made) == rows(fingerprint(kept, ["dataset_id", "bin_group", "bin_no"]))
    assert rows(read_bins(spark, out).select(*kept.columns)) == rows(kept)
    with pytest.raises(RepairError, match="already"):
        rewrite(frames, frozen, out)


BROKEN_SOURCES = {
    "a lost file": lambda f: f.filter("file_index <> 3"),
    "a lost frame": lambda f: f.filter("not (file_index = 3 and position = 7)"),
    "doubled frames": lambda f: f.unionByName(f.filter("file_index = 2")),
    "a frame for another": lambda f: f.withColumn("position", F.when(F.col("file_index") == 3, F.least("position", F.lit(8))).otherwise(F.col("position"))),
}


@pytest.mark.parametrize("name", BROKEN_SOURCES)
def test_rewrite_refuses_lost_and_doubled_frames(spark, tmp_path, packing, name):
    """Whether the source was broken when it was frozen or breaks later, nothing is committed."""
    frames, plan = packing
    with pytest.raises(RepairError, match="planned frames once"):
        freeze(BROKEN_SOURCES[name](frames), plan)
    out = tmp_path / "packed"
    with pytest.raises(RepairError, match="pieces differ"):
        rewrite(BROKEN_SOURCES[name](frames), freeze(frames, plan), str(out))
    with pytest.raises(RepairError, match="nothing is committed"):
        read_bins(spark, str(out))
    assert [p for p in out.rglob("*.parquet")] == []


def test_rewrite_refuses_changed_values_and_leaves_nothing_after_a_failure(spark, tmp_path, packing):
    frames, plan = packing
    frozen = freeze(frames, plan)
    with pytest.raises(RepairError, match="pieces differ"):
        rewrite(frames.withColumn("v", F.when(F.col("position") == 4, -1.0).otherwise(F.col("v"))), frozen, str(tmp_path / "a"))
    with pytest.raises(Exception, match="boom"):
        rewrite(frames.withColumn("v", F.raise_error(F.lit("boom")).cast("double")), frozen, str(tmp_path / "b"))
    assert [p for p in tmp_path.rglob("*.parquet")] == []


def brute_spikes(frames, fps):
    """Straight from the statement, one component of one dataset at a time."""
    out = set()
    comps = {}
    for d, e, f, ts, action in sorted({(x[0], x[1], x[2], x[4], x[6] and tuple(x[6])) for x in frames}, key=lambda x: (x[0], x[1], x[2])):
        for c, v in [(-1, ts), *enumerate(action or ())]:
            if v is None:
                continue
            v = float(np.float32(v))
            if not np.isfinite(v) or (c == -1 and v < 0):
                out.add((d, e, f, c))
            if np.isfinite(v):
                comps.setdefault((d, c), {}).setdefault(e, []).append((f, v))
    for (d, c), eps in comps.items():
        changes = [abs(b[1] - a[1]) for s in eps.values() for a, b in zip(s, s[1:], strict=False)]
        step = 1 / fps if c == -1 else np.quantile([x for x in changes if x > 0] or [0.0], 0.75)
        same = np.mean([x == 0 for x in changes]) if changes else 0
        for e, s in eps.items():
            for m in (1, 2, 3):
                for i in range(1, len(s) - m):
                    if all(min(abs(s[j][1] - s[i - 1][1]), abs(s[j][1] - s[i + m][1])) > 20 * step for j in range(i, i + m)):
                        out |= {(d, e, s[j][0], c) for j in range(i, i + m)}
            i = 0
            while i < len(s):
                j = i
                while j < len(s) and s[j][1] == s[i][1]:
                    j += 1
                if j - i >= 8 and same <= 0.5:
                    out |= {(d, e, s[k][0], c) for k in range(i, j)}
                i = j
    return out


def spiky(seed, episodes=4, n=60):
    rng = random.Random(seed)
    out = []
    for e in range(episodes):
        x = 0.0
        stuck = rng.randint(10, 40)
        for f in range(n):
            x += rng.choice([-1, 1]) * rng.uniform(0.5, 1.0)
            a = [x if not stuck <= f < stuck + 9 else 3.25, 1.0 if f % 20 else 2.0, rng.choice([None, float("nan"), x]) if rng.random() < 0.1 else x * 2]
            if rng.random() < 0.06:
                a[0] += rng.choice([-500, 500, 30])
            ts = f / 10 if rng.random() > 0.05 else rng.choice([None, -1.0, float("inf"), 1e6])
            row = (1, e, f, f, ts, 0, None if rng.random() < 0.03 else a, DAY)
            if rng.random() > 0.1:
                out += [row] * rng.choice([1, 1, 2])
    return out


@pytest.mark.parametrize("shard", [4096, 16])
def test_implausible_readings(spark, monkeypatch, shard):
    monkeypatch.setattr(spikes, "SHARD", shard)  # small shards make episodes of several
    frames = spiky(shard)
    fps = spark.createDataFrame([(1, 10)], "dataset_id bigint, fps int")
    df = spark.createDataFrame(frames, FRAMES).withColumn("loaded_at", F.expr("loaded_at + make_interval(0, 0, 0, cast(rand(1) * 9 as int))"))
    got = spikes.implausible_readings(extra(df, "shard", "halo", "component", "step"), fps)
    want = brute_spikes(frames, 10)
    assert set(rows(got)) == want
    assert len(rows(got)) == len(want)
    assert {c for *_, c in want} == {-1, 0, 2}


@pytest.mark.parametrize("seed", range(30))
def test_no_spike_escapes_the_candidates(seed):
    """Whatever the course of the source, what stands off by more than t is a candidate, and its standoff is the one of the whole series."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 700))
    group = np.sort(rng.integers(0, rng.integers(1, 9), n))
    v = rng.choice([np.cumsum(rng.normal(size=n)), np.sin(np.arange(n) / 7) * 30, np.zeros(n), rng.normal(size=n) * 1e6])
    at = rng.random(n) < 0.1
    v = np.where(at, v + rng.choice([-40.0, 25.0, 1e9, 21.0], n), v)
    t = float(rng.choice([0.5, 20.0, 1e3]))
    whole, one = spikes.standoff(v, group), spikes.candidates(v, group, t)
    assert set(np.flatnonzero(whole > t)) <= set(one)
    assert list(spikes.standoff(v, group, one)) == list(whole[one])


def test_the_normal_course_is_no_candidate():
    rng = np.random.default_rng(3)
    v = np.sin(np.arange(20_000) / 9) * 8 + rng.normal(size=20_000) * 0.1
    v[5_000] += 60
    one = spikes.candidates(v, np.zeros(20_000, int), 20 * np.quantile(np.abs(np.diff(v)), 0.75))
    assert 5_000 in one
    assert len(one) < 20


@pytest.mark.parametrize("most", [0, 10**6])
def test_steps_are_exact_quantiles(spark, monkeypatch, most):
    """Values just below and above 20 times the exact quantile are told apart, in one bin of changes and in many, sent or joined."""
    monkeypatch.setattr(spikes, "MOST_DATASETS", most)
    rng = np.random.default_rng(most)
    frames, want = [], set()
    for d, scale in enumerate([1.0, 1e-3, 1e6]):
        v = np.float32(np.cumsum(rng.uniform(0.9, 1.1, 400)) * scale)
        v[200:] = v[199] + np.float32(np.cumsum(np.full(200, 1.0)) * scale)
        for e, far in enumerate([19.0, 20.5, 21.0, 24.0]):
            x = v.copy()
            x[100] += np.float32(far * scale)
            frames += [(d, e, i, i, i / 10, 0, [float(a)], day(0)) for i, a in enumerate(x)]
    df = spark.createDataFrame(frames, FRAMES)
    steps = {}
    for d in range(3):
        each = [np.abs(np.diff(np.array([f[6][0] for f in frames if f[0] == d and f[1] == e], float))) for e in range(4)]
        c = np.concatenate(each)
        steps[d] = np.quantile(c[c > 0], 0.75)
        for e in range(4):
            x = np.array([f[6][0] for f in frames if f[0] == d and f[1] == e], float)
            want |= {(d, e, int(i), 0) for i in np.flatnonzero(spikes.standoff(x, np.zeros(len(x), int)) > 20 * steps[d])}
    fps = spark.createDataFrame([(d, 10) for d in range(3)], "dataset_id bigint, fps int")
    assert {r for r in rows(spikes.implausible_readings(df, fps)) if r[3] == 0} == want
    assert want


def test_spikes_of_little(spark):
    fps = spark.createDataFrame([(1, 0)], "dataset_id bigint, fps int")
    assert rows(spikes.implausible_readings(spark.createDataFrame([], FRAMES), fps)) == []
    few = [(1, 0, 0, 0, float("nan"), 0, [1.0], DAY), (None, 0, 1, 0, -1.0, 0, [float("inf")], DAY), (1, 0, None, 0, -1.0, 0, [float("inf")], DAY), (7, 0, 0, 0, -1.0, 0, [], DAY)]
    assert rows(spikes.implausible_readings(spark.createDataFrame(few, FRAMES), fps)) == [(1, 0, 0, -1), (7, 0, 0, -1)]


def brute_intervals(iv):
    pairs, gap, merged = set(), set(), set()
    for g in {x[0] for x in iv}:
        s = sorted({(lo, hi) for k, _, lo, hi in iv if k == g and lo < hi})
        for _, m, lo, hi in (x for x in iv if x[0] == g and x[2] < x[3]):
            for _, m2, lo2, hi2 in (x for x in iv if x[0] == g and x[2] < x[3]):
                if m < m2 and lo < hi2 and lo2 < hi:
                    pairs.add((g, m, m2))
        if not s:
            continue
        a, b = s[0]
        for lo, hi in s[1:]:
            if lo > b:
                gap.add((g, b, lo))
                merged.add((g, a, b))
                a, b = lo, hi
            b = max(b, hi)
        merged.add((g, a, b))
    return pairs, gap, merged


@pytest.mark.parametrize(("seed", "span", "long"), [(1, 60, 9), (2, 3000, 700), (3, 10**9, 10**7), (4, 200, 300)])
def test_intervals(spark, seed, span, long):
    rng = random.Random(seed)
    iv = []
    for m in range(70):
        lo = rng.randint(-span, span)
        iv.append((rng.randint(1, 3), m, lo, lo + rng.randint(-2, long)))
    iv += [(1, 100, 0, 64), (1, 101, 64, 128), (1, 102, 0, 64), (9, 5, 3, 3)] + iv[:5]
    df = extra(spark.createDataFrame(iv, "g bigint, m bigint, lo bigint, hi bigint"), "level", "block", "prev")
    pairs, gap, merged = brute_intervals(iv)
    assert set(rows(intervals.overlaps(df, ["g"], "m"))) == pairs
    assert rows(intervals.gaps(df, ["g"], 64)) == sorted(gap, key=repr)
    assert rows(intervals.periods(df, ["g"], 64)) == sorted(merged, key=repr)


def test_decomposition_is_canonical():
    for a, b in [(0, 8), (1, 8), (5, 700), (7, 8), (3, 3), (65_535, 65_536), (0, 65_536), (65_536, 131_072), (1, 65_535)]:
        blocks = intervals.decompose(np.array([a]), np.array([b]))
        spans = sorted((int(n) << level, int(n) + 1 << level) for level, x in enumerate(blocks) for n in x)
        assert a == b and not spans or (spans[0][0], spans[-1][1]) == (a, b)
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        # canonical: no two of them are siblings
        assert all(np.intersect1d(x[x & 1 == 0] + 1, x).size == 0 for x in blocks[:-1])


@pytest.mark.parametrize("seed", range(20))
def test_blocks_become_the_union(seed):
    rng = np.random.default_rng(seed)
    n, size = int(rng.integers(1, 60)), int(rng.integers(1, 400))
    lo = rng.integers(0, 2000, n) + (rng.integers(0, 3, n) << 16)
    hi = lo + rng.integers(1, size + 1, n)
    here = intervals.uncovered(intervals.decompose(lo, hi))
    for level, x in enumerate(here):
        assert all(not np.isin(x >> up, here[level + up]).any() for up in range(1, len(here) - level))
    want = np.zeros(3 << 16, bool)
    for a, b in zip(lo, hi, strict=True):
        want[a:b] = True
    got = np.zeros(3 << 16, bool)
    a, b = intervals.stretches(lo, hi)
    for x, y in zip(a, b, strict=True):
        assert not got[x:y].any()
        got[x:y] = True
    assert (got == want).all()
    assert (a[1:] > b[:-1]).all()


def test_intervals_of_all_sizes(spark):
    """Intervals over many cells and tiers, up to nearly all of a bigint, beside short ones that they cover or touch."""
    iv = [(1, 0, -(2**62), -(2**60)), (1, 1, -(2**60), 2**40), (1, 2, 2**40 + 5, 2**40 + 7), (1, 3, 2**40 + 6, 2**60), (1, 4, 2**62, 2**62 + 1), (2, 5, 65_535, 65_537), (2, 6, 65_537, 3 * 65_536), (2, 7, 65_536, 2 * 65_536), (2, 8, 5 * 65_536, 6 * 65_536), (2, 9, 0, 65_536), (3, 10, -1, 0), (3, 11, 0, 1)]
    df = spark.createDataFrame(iv, "g bigint, m bigint, lo bigint, hi bigint")
    pairs, gap, merged = brute_intervals(iv)
    assert set(rows(intervals.overlaps(df, ["g"], "m"))) == pairs
    assert rows(intervals.gaps(df, ["g"])) == sorted(gap, key=repr)
    assert rows(intervals.periods(df, ["g"])) == sorted(merged, key=repr)


def test_overlaps_and_gaps_of_odd_rows(spark):
    eps = [(1, 0, 5, 0, 5, 0, DAY, None), (1, 1, 5, 3, 9, 0, DAY, DAY), (1, 2, 5, None, 9, 0, DAY, None), (1, 3, 5, 20, 12, 0, DAY, None), (1, 4, 5, 12, 20, 0, DAY, None), (1, 4, 5, 12, 20, 0, DAY, None)]
    seg = [(1, 0, "top", 0, 0, 0.0, 1.0000001, DAY), (1, 1, "top", 0, 0, 0.9999999, 2.0, DAY), (1, 2, "top", 0, 0, float("nan"), 2.0, DAY), (1, 3, None, 0, 0, 0.0, 2.0, DAY), (1, 4, "top", 0, 0, 1.0, float("inf"), DAY)]
    got = intervals.overlaps_and_gaps(spark.createDataFrame(eps, EPISODES), spark.createDataFrame(seg, SEGMENTS))
    assert rows(got) == [("episodes", "gap", 1, "", 0, -1, 9, 12), ("episodes", "overlap", 1, "", 0, -1, 0, 1)]
    e = spark.createDataFrame([], EPISODES), spark.createDataFrame([], SEGMENTS)
    assert rows(intervals.overlaps_and_gaps(*e)) == []


def test_previous_row_and_chunks(spark):
    data = [(k, i, i * i) for k in (1, 2) for i in range(0, 50, 3)]
    df = spark.createDataFrame(data, "k bigint, i bigint, v bigint")
    got = {(r.k, r.i): r.prev and tuple(r.prev) for r in common.previous_row(df, ["k"], "i", F.floor(F.col("i") / 10), ["v"]).collect()}
    assert got == {(k, i): (i - 3, (i - 3) ** 2) if i else None for k, i, _ in data}
    import pyarrow as pa

    key = np.repeat(np.arange(7), [5, 1, 9, 2, 2, 30, 4])
    t = pa.table({"k": key, "x": np.arange(len(key))})
    parts = list(common.group_chunks(iter(t.to_batches(max_chunksize=4)), ["k"], rows=6))
    assert pa.concat_tables(parts).equals(t.combine_chunks()) or pa.concat_tables(parts).to_pylist() == t.to_pylist()
    seen = [set(p.column("k").to_pylist()) for p in parts]
    assert len(parts) > 2
    assert all(not (a & b) for i, a in enumerate(seen) for b in seen[i + 1 :])


def test_ordered_moments(spark):
    rng = random.Random(5)
    vals = [rng.choice([float("nan"), rng.uniform(-5, 5)]) for _ in range(300)]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "k bigint, i bigint, value double")
    n, mean, m2 = 0, 0.0, 0.0
    for x in vals:
        n += 1
        if x == x:
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
    r = series.ordered_moments(df, ["k"], ["i"], F.floor(F.col("i") / 37)).first()
    assert (r.n, r.mean, r.std) == (300, pytest.approx(mean), pytest.approx((m2 / n) ** 0.5))
