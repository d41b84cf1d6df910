"""Schemas that drift between revisions: every change, and one consistent table.

Each revision gets a schema: fields of scope 'info' (keys of the JSON body), 'feature' (keys under
features) and 'task' (keys of the task records), each with a type and a description that a rename
keeps. A fingerprint stands for the schema; only revisions whose fingerprint differs from the one
before are compared field by field, and the differences are the migration steps. Files with the same
names and types share a version: what has to be renamed, defaulted or cast is worked out once per
version, and each file is routed through the steps of its own. Bodies and records are parsed once and
their schemas written down; all later steps read those.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from frameledger.operators.common import cut, previous_row

_FIELDS = "array<struct<scope:string,field:string,type:string,shape:string,same:string,value:string>>"
_FIELD_NAMES = ("scope", "field", "type", "shape", "same", "value")
_BLOCK = 256


def json_type(v: object) -> str:
    """Name of a JSON value's type; all numbers are one."""
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int | float):
        return "number"
    return {str: "string", list: "array", dict: "object"}.get(type(v), "null")


def canonical(v: object) -> str:
    """JSON text that is equal for equal values, whatever the order of keys or style of numbers."""

    def plain(x: object) -> object:
        if isinstance(x, float) and math.isfinite(x) and x == int(x):
            return int(x)
        if isinstance(x, dict):
            return {k: plain(y) for k, y in x.items()}
        return [plain(y) for y in x] if isinstance(x, list) else x

    return json.dumps(plain(v), sort_keys=True, ensure_ascii=False)


def _object(text: str | None) -> dict | None:
    try:
        v = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def _plain(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "replace").decode()


def _short(text: str) -> str:
    """A text to tell values apart by: long ones by their digest."""
    return text if len(text) <= 64 else hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


@functools.lru_cache(1 << 16)
def _feature(key: str, text: str) -> tuple[str, str, str, str | None, str]:
    """type, shape, same, rest and canonical text of a feature given as JSON; `key` is what the cache goes by."""
    v = json.loads(text)
    dtype, shape = (v.get("dtype"), v.get("shape")) if isinstance(v, dict) else (json_type(v), None)
    dtype, shape = dtype if isinstance(dtype, str) else canonical(dtype), canonical(shape)
    rest = {a: x for a, x in v.items() if a not in ("dtype", "shape")} if isinstance(v, dict) else v
    return _plain(dtype), _plain(shape), _plain(f"{dtype} {shape}"), None if rest == {} else _plain(canonical(rest)), canonical(v)


def describe(body: dict) -> list[tuple[str, str, str, str | None, str, str | None]]:
    """Fields of an info body as (scope, field, type, shape, same, value), in order; a key with value null is absent, and so is a feature.

    A feature's value is what it has besides dtype and shape; the features as a whole have none.
    """
    out = []
    features = body.get("features")
    texts = []
    for k in sorted(features) if isinstance(features, dict) else ():
        v = features[k]
        name = _plain(k)
        if v is None:
            texts.append(f"{json.dumps(k, ensure_ascii=False)}: null")
            continue
        dtype, shape, same, rest, whole = _feature(repr(v), json.dumps(v))
        texts.append(f"{json.dumps(k, ensure_ascii=False)}: {whole}")
        out.append(("feature", name, dtype, shape, same, rest))
    for k, v in body.items():
        if v is None:
            continue
        if k == "features" and isinstance(v, dict):
            out.append(("info", k, "object", None, _short("{" + ", ".join(texts) + "}"), None))
            continue
        kind, text = json_type(v), canonical(v)
        # a version given as a number reads as text: 3 and 3.0 both as 3.0
        value = v if isinstance(v, str) else repr(float(v)) if k == "codebase_version" and kind == "number" and abs(v) < 1e15 else text
        out.append(("info", _plain(k), kind, None, _short(text), _plain(value)))
    return sorted(out, key=lambda x: x[:2])


def _described(text: str | None) -> list[tuple] | None:
    """Fields of a body; None for one that is no JSON object or nested too deep to be read."""
    try:
        return None if (body := _object(text)) is None else describe(body)
    except RecursionError:
        return None


def _lists(rows: list[list[tuple]], names: Sequence[str]) -> pa.Array:
    """Lists of structs of texts, built by columns."""
    offsets = pa.array([0, *itertools.accumulate(map(len, rows))], pa.int32())
    flat = list(itertools.chain.from_iterable(rows))
    cols = zip(*flat, strict=True) if flat else [()] * len(names)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in cols], list(names)))


def _describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [_described(x) for x in b.column("body").to_pylist()]
        keep = pa.array([x is not None for x in got], pa.bool_())
        fields = _lists([x for x in got if x is not None], _FIELD_NAMES)
        yield pa.RecordBatch.from_arrays([*(b.column(c).filter(keep) for c in ("repo_id", "revision", "written", "file_id")), fields], names=["repo_id", "revision", "written", "file_id", "fields"])


def _keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = zip(b.column("repo_id").to_pylist(), b.column("revision").to_pylist(), b.column("record").to_pylist(), strict=True)
        n: Counter = Counter()
        for repo, revision, text in ids:
            if (x := _object(text)) is None:
                continue
            n[repo, revision, "", ""] += 1  # a readable record, perhaps without any value
            for k, v in x.items():
                if v is not None:
                    n[repo, revision, k.encode("utf-8", "replace").decode(), json_type(v)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in n], (pa.int64(), pa.int64(), pa.string(), pa.string())[i]) for i in range(4)] + [pa.array(list(n.values()), pa.int64())], names=["repo_id", "revision", "field", "type", "n"])


def info_schemas(info_files: DataFrame) -> DataFrame:
    """repo_id, revision, file_id, written, fields, version: one row per revision with a body that is a JSON object; of several the latest written, then the greatest file_id. version is the fingerprint of names and types."""
    rows = info_files.select(F.col("repo_id").cast("bigint").alias("repo_id"), F.col("revision").cast("bigint").alias("revision"), F.col("written_at").cast("timestamp_ntz").cast("string").alias("written"), F.col("file_id").cast("bigint").alias("file_id"), "body")
    d = rows.filter("repo_id is not null and revision is not null and body is not null").mapInArrow(_describe, f"repo_id bigint, revision bigint, written string, file_id bigint, fields {_FIELDS}")
    version = F.xxhash64(F.transform("fields", lambda x: F.struct(x["scope"], x["field"], x["type"])))
    d = cut(d.withColumns({"_id": F.monotonically_increasing_id(), "version": version}))
    # the files to keep are chosen by narrow rows
    best = d.groupBy("repo_id", "revision").agg(F.max(F.struct(F.coalesce("written", F.lit("")), F.coalesce("file_id", F.lit(-1)), "_id")).alias("x"))
    return d.join(best.select("repo_id", "revision", "x._id"), ["repo_id", "revision", "_id"], "left_semi").drop("_id")


def task_schemas(task_records: DataFrame) -> DataFrame:
    """repo_id, revision, fields: keys with a value in any readable record; of several types of a key the most frequent, then the first by name."""
    rows = task_records.select(F.col("repo_id").cast("bigint").alias("repo_id"), F.col("revision").cast("bigint").alias("revision"), "record").filter("repo_id is not null and revision is not null and record is not null")
    k = rows.mapInArrow(_keys, "repo_id bigint, revision bigint, field string, type string, n bigint").groupBy("repo_id", "revision", "field", "type").agg(F.sum("n").alias("n"))
    one = k.groupBy("repo_id", "revision", "field").agg(F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("x"))
    none = F.lit(None).cast("string")
    item = F.struct(F.lit("task").alias("scope"), "field", F.col("x.type").alias("type"), none.alias("shape"), F.col("x.type").alias("same"), none.alias("value"))
    return cut(one.groupBy("repo_id", "revision").agg(F.sort_array(F.collect_list(F.when(F.col("x.type") != "", item))).alias("fields")))


def _transitions(s: DataFrame) -> DataFrame:
    """repo_id, kind, revision, before: revisions whose schema's fingerprint differs from that of the nearest earlier one of the kind."""
    prints = s.select("repo_id", "kind", "revision", F.xxhash64("fields").alias("print"))
    p = previous_row(prints, ["repo_id", "kind"], "revision", F.floor(F.col("revision") / _BLOCK), ["print"])
    return p.filter("prev is not null and prev.print <> print").select("repo_id", "kind", "revision", F.col("prev.revision").alias("before"))


def _differences(s: DataFrame) -> DataFrame:
    """repo_id, revision, scope, field, o, n: fields (type, shape, same, bare) of the earlier and later schema, one of them null if it went or came; unchanged ones left out. `kind` tells schemas of bodies and of records apart."""
    t = _transitions(s)
    bare = F.when(F.col("f.field") == "codebase_version", F.regexp_replace(F.col("f.value"), "^v", ""))
    fields = s.select("repo_id", "kind", "revision", F.explode("fields").alias("f")).select("repo_id", "kind", "revision", "f.scope", "f.field", F.struct("f.type", "f.shape", "f.same", bare.alias("bare")).alias("x"))
    key = ["repo_id", "revision", "scope", "field"]
    new = t.select("repo_id", "kind", "revision").join(fields, ["repo_id", "kind", "revision"]).select(*key, F.col("x").alias("n"))
    old = t.join(fields.withColumnRenamed("revision", "before"), ["repo_id", "kind", "before"]).select(*key, F.col("x").alias("o"))
    both = old.join(new, key, "full")
    return both.filter("o is null or n is null or o.same <> n.same or o.type <> n.type")


def _of(kind: int, schemas: DataFrame) -> DataFrame:
    return schemas.select("repo_id", F.lit(kind).alias("kind"), "revision", "fields")


def schema_changes(info_files: DataFrame, task_records: DataFrame) -> DataFrame:
    """repo_id, revision, scope, field, change (renamed, removed, added, retyped, reshaped, version).

    Each revision is compared with the nearest earlier one of its repository that has a schema (info
    and feature: a body that is a JSON object; task: a readable record). A field that went and one that
    came with the same description (info: equal value; feature: dtype and shape; task: type) are a
    rename; were several alike, they pair by name. Unreadable and null bodies and records are no schema.
    """
    s = _of(0, info_schemas(info_files)).unionByName(_of(1, task_schemas(task_records)))
    return _labelled(_differences(s)).select("repo_id", "revision", "scope", "field", "change").distinct()


def _labelled(d: DataFrame) -> DataFrame:
    """Differences as changes, with `new_field` for renames."""
    group = ["repo_id", "revision", "scope"]
    rank = F.row_number().over(Window.partitionBy(*group, "same", "gone").orderBy("field"))
    moved = d.filter("o is null or n is null").select(*group, "field", F.coalesce("o.same", "n.same").alias("same"), F.col("n").isNull().alias("gone")).withColumn("k", rank)
    # what went and what came with equal descriptions meet by rank
    pair = moved.groupBy(*group, "same", "k").agg(F.max(F.when(F.col("gone"), F.col("field"))).alias("field"), F.max(F.when(~F.col("gone"), F.col("field"))).alias("new_field"))
    change = F.when(F.col("field").isNull(), "added").when(F.col("new_field").isNull(), "removed").otherwise("renamed")
    moves = pair.select(*group, F.coalesce("field", "new_field").alias("field"), change.alias("change"), F.when(change == "renamed", F.col("new_field")).alias("new_field"))
    found = F.array(
        F.when(F.col("o.type") != F.col("n.type"), "retyped"),
        F.when((F.col("scope") == "feature") & ~F.col("o.shape").eqNullSafe(F.col("n.shape")), "reshaped"),
        F.when((F.col("scope") == "info") & (F.col("o.bare") != F.col("n.bare")), "version"),
    )
    kept = d.filter("o is not null and n is not null")
    stays = kept.select(*group, "field", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("change"), F.lit(None).cast("string").alias("new_field"))
    return moves.unionByName(stays)


#: Columns of the consistent table and their types; defaults where a revision lacks the field.
TARGET = {"codebase_version": "string", "fps": "double", "total_episodes": "bigint", "total_frames": "bigint", "robot_type": "string"}
DEFAULTS: dict[str, str] = {"robot_type": "unknown"}
#: The same for task records, and the name that layouts give the text, which goes before `task` where a record has both.
TASK_TARGET = {"task_index": "bigint", "task": "string"}
TASK_TEXT = "__index_level_0__"
_OTHER = "array<struct<name:string,type:string,value:string>>"
_FEATURES = "array<struct<name:string,dtype:string,shape:string,rest:string>>"


def _renames(schemas: DataFrame, scopes: Sequence[str], max_rules: int) -> list[Row]:
    """scope, field, new_field, n: the different renames of all repositories, the most frequent first; more than max_rules of a scope are an error."""
    d = _labelled(_differences(_of(0, schemas))).filter(F.col("scope").isin(*scopes) & (F.col("change") == "renamed"))
    got = d.groupBy("scope", "field", "new_field").agg(F.count(F.lit(1)).alias("n")).limit(len(scopes) * max_rules + 1).collect()
    if got and Counter(r.scope for r in got).most_common(1)[0][1] > max_rules:
        raise ValueError(f"more than {max_rules} different renames")
    return sorted(got, key=lambda r: (-r.n, r.field, r.new_field))


def _rules(renames: Iterable[tuple[str, str]], target: dict[str, str]) -> dict[str, str]:
    """name -> column of target; a rename that would make two columns one is no rule."""
    field: dict[str, set[str]] = {}
    for old, new in renames:
        both = field.get(old, {old}) | field.get(new, {new})
        if len(both & target.keys()) < 2:
            field |= dict.fromkeys(both, both)
    return {old: new for old, names in field.items() for new in names & target.keys() if old != new}


def rename_rules(schemas: DataFrame, max_rules: int = 10_000) -> dict[str, str]:
    """name -> TARGET column, from the renames of info keys found in all repositories, followed to their end.

    Names renamed into each other, in either direction, are one field, the most frequent renames first;
    a rename that would make two TARGET columns one is a coincidence of values and no rule. The number
    of different renames is a property of the format, not of the data's size; more than max_rules of
    them are an error, not cut off. schemas as from info_schemas.
    """
    return _rules([(r.field, r.new_field) for r in _renames(schemas, ("info",), max_rules)], TARGET)


def feature_rules(schemas: DataFrame, renames: Sequence[Row], max_pairs: int = 1_000_000) -> dict[str, str]:
    """name -> the name of the same feature that most revisions have (of equals the first), from renames (field, new_field, n) found in all repositories.

    Names renamed into each other are one feature, the most frequent renames first, if they were
    renamed more often than they stand side by side in a revision; others, alike in dtype and shape
    only, stay apart. More than max_pairs pairs side by side are an error. schemas as from info_schemas.
    """
    names = {x for r in renames for x in (r.field, r.new_field)}
    if not names:
        return {}
    mine = F.transform(F.filter("fields", lambda x: x["scope"] == "feature"), lambda x: x["field"])
    here = F.array_intersect(mine, F.from_json(F.lit(json.dumps(sorted(names))), "array<string>"))
    pairs = schemas.select(here.alias("h")).select("h", F.explode("h").alias("a")).select("a", F.explode("h").alias("b")).filter("a <= b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    got = pairs.limit(max_pairs + 1).collect()
    if len(got) > max_pairs:
        raise ValueError(f"more than {max_pairs} pairs of renamed features")
    beside = Counter({(r.a, r.b): r.n for r in got})
    moved: Counter = Counter()
    for r in renames:
        moved[min(r.field, r.new_field), max(r.field, r.new_field)] += r.n
    one = {x: {x} for x in names}
    for (a, b), _ in sorted(moved.items(), key=lambda x: (-x[1], x[0])):
        x, y = one[a], one[b]
        cross = [(min(p, q), max(p, q)) for p in x for q in y] if x is not y else []
        if sum(moved[c] for c in cross) > sum(beside[c] for c in cross):
            x |= y
            one |= dict.fromkeys(y, x)
    ends = {x: min(c, key=lambda p: (-beside[p, p], p)) for x, c in one.items()}
    return {x: end for x, end in ends.items() if x != end}


def _renamed(features: list[str], rules: dict[str, str]) -> dict[str, str]:
    """Features that get another name by the rules; where two would get one name, the one that has it, else the first, and the others keep theirs."""
    taken, out = set(features), {}
    for name in features:
        if (to := rules.get(name, name)) not in taken:
            taken.add(to)
            out[name] = to
    return out


def _routes(rules: dict[str, str]) -> Callable:
    """Versions with their features' new names, and the notes on them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_renamed(names, rules) for names in b.column("names").to_pylist()]
            notes = [[f"rename feature {old} -> {new}" for old, new in x.items()] for x in got]
            yield pa.RecordBatch.from_arrays([b.column("version"), pa.array([list(x.items()) for x in got], pa.map_(pa.string(), pa.string())), pa.array(notes, pa.list_(pa.string()))], names=["version", "renames", "moved"])

    return run


def _routed(s: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Schemas with `info` (keys; features aside, if they are an object), `features` under the names of their version's steps, and `moved`, those steps."""
    of = lambda scope: F.filter("fields", lambda x: x["scope"] == scope)
    names = F.transform(of("feature"), lambda x: x["field"])
    routes = s.groupBy("version").agg(F.any_value(names).alias("names")).mapInArrow(_routes(rules), "version bigint, renames map<string,string>, moved array<string>")
    info = F.transform(F.filter(of("info"), lambda x: (x["field"] != "features") | (x["type"] != "object")), lambda x: F.struct(x["field"].alias("name"), x["type"].alias("type"), x["value"].alias("value")))
    to = lambda x: F.coalesce(F.try_element_at("renames", x["field"]), x["field"])
    features = F.array_sort(F.transform(of("feature"), lambda x: F.struct(to(x).alias("name"), x["type"].alias("dtype"), x["shape"].alias("shape"), x["value"].alias("rest"))))
    return s.join(routes, "version").select("repo_id", "revision", "file_id", "version", info.alias("info"), features.alias("features"), "moved")


def _chained(target: dict[str, str], defaults: dict[str, str], renames: dict[str, str], first: Sequence[str] = ()) -> tuple[list[Column], Column, list[Column]]:
    """The columns of target from `info` (fields by name, type and value) and its maps v and k, the fields they do not hold as they are, and notes.

    Of several names the target's goes first, or those in `first`.
    """
    out, held, notes = [], [], []
    for name, to in target.items():
        old = sorted(o for o, n in renames.items() if n == name)
        order = [*(o for o in old if o in first), name, *(o for o in old if o not in first)]
        used = F.coalesce(*(F.when(F.element_at("v", F.lit(o)).isNotNull(), F.lit(o)) for o in order))
        raw = F.element_at("v", used)
        if name == "codebase_version":  # 'v3.0', '3.0' and 3.0 are one version
            raw = F.concat(F.lit("v"), F.regexp_replace(raw, "^v", ""))
        cast = raw if to == "string" else raw.try_cast("double").try_cast(to) if to == "bigint" else raw.try_cast(to)
        out.append(F.coalesce(cast, F.lit(defaults[name])) if name in defaults else cast)
        out[-1] = out[-1].alias(name)
        whole = cast == raw.try_cast("double") if to == "bigint" else cast.isNotNull()
        held.append(F.when(whole, used))
        number = F.element_at("k", used) == "number"
        notes += [F.when(used != name, F.concat(F.lit("rename "), used, F.lit(f" -> {name}"))), F.when(used.isNull(), f"default {name}"), F.when(number == F.lit(to == "string"), f"cast {name}")]
    other = F.filter("info", lambda x: ~F.coalesce(F.array_contains(F.array(*held), x["name"]), F.lit(False)))
    return out, other.alias("other"), notes


def _mapped(d: DataFrame) -> DataFrame:
    names = F.transform("info", lambda x: x["name"])
    return d.withColumns({"v": F.map_from_arrays(names, F.transform("info", lambda x: x["value"])), "k": F.map_from_arrays(names, F.transform("info", lambda x: x["type"]))})


def _listed(*notes: Column) -> Column:
    return F.filter(F.array(*notes), lambda x: x.isNotNull())


def consistent_table(info_files: DataFrame, task_records: DataFrame, all_revisions: bool = False) -> DataFrame:
    """One row per revision with a readable body, or with all_revisions also per one with readable task records only: repo_id, revision, file_id, version, the TARGET columns, other, features, n_features, n_task_keys (of its task records, null without a readable one) and `applied`, the rules used.

    Every field passes the chain rename, default, cast; applied lists them as 'rename a -> b',
    'rename feature a -> b', 'default b' and 'cast b'. A value that cannot be cast is null. `other`
    holds every info key that no column holds whole (name, type, value; JSON text unless a string),
    `features` each feature (name, dtype, shape, rest: JSON text of what else it declares). The task
    records stand in task_table. Without a body, applied begins with 'no body', the columns have their
    defaults and the rest is null.
    """
    s = info_schemas(info_files)
    renames = _renames(s, ("info", "feature"), 10_000)
    s = _routed(s, feature_rules(s, [r for r in renames if r.scope == "feature"]))
    out, other, notes = _chained(TARGET, DEFAULTS, _rules([(r.field, r.new_field) for r in renames if r.scope == "info"], TARGET))
    tasks = task_schemas(task_records).select("repo_id", "revision", F.size("fields").cast("bigint").alias("n_task_keys"))
    s = _mapped(s).join(tasks, ["repo_id", "revision"], "full" if all_revisions else "left")
    applied = F.concat_ws("; ", F.when(F.col("info").isNull(), "no body"), _listed(*notes), "moved").alias("applied")
    return s.select("repo_id", "revision", "file_id", "version", *out, other, "features", F.size("features").cast("bigint").alias("n_features"), "n_task_keys", applied)


def schema_versions(table: DataFrame) -> DataFrame:
    """version, steps, revisions, repos: the versions of a consistent table with the migration steps of each."""
    return table.filter("version is not null").groupBy("version", F.col("applied").alias("steps")).agg(F.count(F.lit(1)).alias("revisions"), F.countDistinct("repo_id").alias("repos"))


def _record(text: str | None) -> list[tuple[str, str, str]] | None:
    """Fields of a task record as (name, type, value); None for one that is no JSON object or nested too deep to be read."""
    try:
        if (x := _object(text)) is None:
            return None
        return sorted((_plain(k), json_type(v), _plain(v if isinstance(v, str) else canonical(v))) for k, v in x.items() if v is not None)
    except RecursionError:
        return None


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [_record(x) for x in b.column("record").to_pylist()]
        keep = pa.array([x is not None for x in got], pa.bool_())
        info = _lists([x for x in got if x is not None], ("name", "type", "value"))
        yield pa.RecordBatch.from_arrays([*(b.column(c).filter(keep) for c in ("repo_id", "revision", "line_no")), info], names=["repo_id", "revision", "line_no", "info"])


def task_table(task_records: DataFrame) -> DataFrame:
    """One row per readable task record: repo_id, revision, line_no, the TASK_TARGET columns, other and `applied`, as in consistent_table.

    The renames are those found between the revisions of all repositories, and TASK_TEXT -> task.
    Lines repeated with equal content count once.
    """
    long = [F.col(c).cast("bigint").alias(c) for c in ("repo_id", "revision", "line_no")]
    rows = task_records.select(*long, "record").filter("repo_id is not null and revision is not null and record is not null")
    d = rows.mapInArrow(_records, f"repo_id bigint, revision bigint, line_no bigint, info {_OTHER}").distinct()
    found = _renames(task_schemas(task_records), ("task",), 10_000)
    rules = _rules([(TASK_TEXT, "task"), *((r.field, r.new_field) for r in found)], TASK_TARGET)
    out, other, notes = _chained(TASK_TARGET, {}, rules, (TASK_TEXT,))
    return _mapped(d).select("repo_id", "revision", "line_no", *out, other, F.concat_ws("; ", _listed(*notes)).alias("applied"))
