"""Many datasets: a run of the checks on each, and what the runs have in common."""

from __future__ import annotations

import concurrent.futures
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameledger.checks import CheckContext, CheckEngine
from frameledger.errors import DatasetError
from frameledger.sources.loader import load
from frameledger.verdict import exit_code, trust_score, worst

#: What becomes of a dataset; the checks of known defects; how many of a catalogue are looked at.
STATUSES = ("PASS", "WARN", "FAIL", "ERROR", "TIMEOUT")
KNOWN = {"timestamp_drift": "KNOWNBUG.TIMESTAMP_DRIFT", "metadata_data_agreement": "STRUCTURAL.METADATA_DATA_AGREEMENT"}
POOL, POOL_MOST, TOP = 10, 2000, 10
SCHEMA = "repo_id string, status string, trust_score bigint, results array<struct<check_id:string,severity:string,message:string>>, error_message string, duration_s double"


def choose(catalogue: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """Random datasets of a catalogue (repo_id, ...): `limit` of the first min(POOL * limit, POOL_MOST) by name."""
    pool = catalogue.orderBy("repo_id").limit(min(POOL * limit, POOL_MOST))
    return pool.orderBy(F.xxhash64(F.lit(seed), "repo_id"), "repo_id").limit(limit)


def audit_one(spark: SparkSession, ref: str, timeout: float = 60.0, deep: bool = False) -> tuple:
    """A row of SCHEMA: the status is the exit code's, ERROR if it could not be loaded, TIMEOUT (its jobs cancelled) if it took too long."""
    began, tag = time.time(), f"audit-{abs(hash((ref, time.time())))}"

    def run() -> tuple:
        spark.addTag(tag)
        try:
            ds = load(spark, ref)
            results = CheckEngine().run(ds, CheckContext(deep=deep))
            ds.close()
        finally:
            spark.removeTag(tag)
        rows = [(r.check_id, r.severity.value, r.message) for r in results]
        return STATUSES[exit_code(worst(results))], trust_score(results), rows, None

    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        got = pool.submit(run).result(timeout)
    except concurrent.futures.TimeoutError:
        spark.interruptTag(tag)
        got = ("TIMEOUT", None, [], f"more than {timeout:g} s")
    except DatasetError as e:
        got = ("ERROR", None, [], f"{type(e).__name__}: {e}")
    except Exception as e:
        got = ("ERROR", None, [], f"{type(e).__name__}: {str(e)[:500]}")
    pool.shutdown(wait=False)
    return (ref, *got, time.time() - began)


def audit(spark: SparkSession, refs: Iterable[str], timeout: float = 60.0, deep: bool = False) -> DataFrame:
    return spark.createDataFrame([audit_one(spark, r, timeout, deep) for r in refs], SCHEMA)


def _rounded(c, places: int):
    return F.round(c, places)


def status_summary(runs: DataFrame) -> DataFrame:
    """One row: datasets, a count per status, pct_fail_or_worse, pct_any_issue, mean_duration_s; percentages of all datasets, 0 if there are none."""
    n = F.count(F.lit(1))
    counts = {s: F.count_if(F.col("status") == s) for s in STATUSES}
    pct = lambda *ss: F.coalesce(_rounded(F.try_divide(100.0 * sum((counts[s] for s in ss), F.lit(0)), n), 1), F.lit(0.0))
    return runs.agg(
        n.alias("datasets"), *(c.alias(f"n_{s.lower()}") for s, c in counts.items()),
        pct("FAIL", "ERROR", "TIMEOUT").alias("pct_fail_or_worse"), pct("WARN", "FAIL", "ERROR", "TIMEOUT").alias("pct_any_issue"),
        F.coalesce(_rounded(F.avg(F.coalesce("duration_s", F.lit(0.0))), 2), F.lit(0.0)).alias("mean_duration_s"),
    )


def top_checks(runs: DataFrame, top: int = TOP) -> DataFrame:
    """check_id, fired: the checks with the most FAIL, WARN or ERROR results; among equals the one seen first (by repo_id, place)."""
    r = runs.select("repo_id", F.posexplode("results").alias("place", "r")).filter(F.col("r.severity") != "INFO")
    g = r.groupBy("r.check_id").agg(F.count(F.lit(1)).alias("fired"), F.min(F.struct("repo_id", "place")).alias("first"))
    return g.orderBy(F.desc("fired"), "first").limit(top).select("check_id", "fired")


def known_defects(runs: DataFrame, checks: dict[str, str] = KNOWN) -> DataFrame:
    """defect, n, pct: datasets in which a check of a known defect FAILs, of those that got a grade; 0 if none did."""
    graded = F.count_if(F.col("status").isin("PASS", "WARN", "FAIL"))
    failed = F.transform(F.filter("results", lambda r: r["severity"] == "FAIL"), lambda r: r["check_id"])
    fails = {k: F.count_if(F.array_contains(failed, c)) for k, c in checks.items()}
    rows = [F.struct(F.lit(k).alias("defect"), n.alias("n"), F.coalesce(_rounded(F.try_divide(100.0 * n, graded), 1), F.lit(0.0)).alias("pct")) for k, n in fails.items()]
    return runs.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def summary_text(runs: DataFrame) -> str:
    """The summary for reading."""
    s = status_summary(runs).first().asDict()
    lines = [f"{s['datasets']} datasets: " + ", ".join(f"{s[f'n_{x.lower()}']} {x}" for x in STATUSES), f"fail or worse {s['pct_fail_or_worse']} %, any issue {s['pct_any_issue']} %, mean {s['mean_duration_s']} s"]
    lines += [f"  {r.fired:>5}  {r.check_id}" for r in top_checks(runs).collect()]
    return "\n".join([*lines, *(f"{r.defect}: {r.n} ({r.pct} %)" for r in known_defects(runs).collect())])
