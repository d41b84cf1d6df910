"""Severities, results, grade, trust score, exit code."""

from __future__ import annotations

import enum
import functools
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The severities in rising order, and what a result of each costs: points apiece, points at most.
ORDER = ("INFO", "WARN", "FAIL", "ERROR")
COST = {"FAIL": (30, 60), "WARN": (5, 20), "ERROR": (10, None)}
SCORE_FORMULA_VERSION = "1.0"


@functools.total_ordering
class Severity(enum.Enum):
    INFO = "INFO"
    WARN = "WARN"
    FAIL = "FAIL"
    ERROR = "ERROR"

    @property
    def rank(self) -> int:
        return ORDER.index(self.value)

    def __lt__(self, other: object) -> bool:
        return self.rank < other.rank if isinstance(other, Severity) else NotImplemented


@dataclass(frozen=True)
class CheckResult:
    check_id: str
    severity: Severity
    message: str
    details: dict[str, Any] = field(default_factory=dict)


def worst(results: Iterable[CheckResult]) -> Severity:
    return max((r.severity for r in results), default=Severity.INFO)


def grade(severity: Severity) -> str:
    return "PASS" if severity is Severity.INFO else severity.value


def exit_code(severity: Severity) -> int:
    return min(severity.rank, 2)


def trust_score(results: Iterable[CheckResult]) -> int:
    names = [r.severity.value for r in results]
    lost = 0
    for name, (each, most) in COST.items():
        n = each * names.count(name)
        lost += n if most is None else min(n, most)
    return max(0, 100 - lost)


def _points(severity: Column, name: str) -> Column:
    each, most = COST[name]
    n = F.count_if(severity == name) * each
    return n if most is None else F.least(n, F.lit(most))


def scored(results: DataFrame, keys: list[str], severity: str = "severity") -> DataFrame:
    """keys, trust_score, grade, exit_code, one column per severity with its count: the verdict per dataset on rows of results."""
    s = F.col(severity)
    rank = F.max(sum(((s == n).cast("int") * i for i, n in enumerate(ORDER)), F.lit(0)))
    counts = [F.count_if(s == n).alias(f"n_{n.lower()}") for n in ORDER]
    lost = sum((_points(s, n) for n in COST), F.lit(0))
    names = F.array(F.lit("PASS"), *map(F.lit, ORDER[1:]))
    g = results.groupBy(*keys).agg(*counts, rank.alias("_rank"), F.greatest(F.lit(0), 100 - lost).cast("bigint").alias("trust_score"))
    return g.select(*keys, *(f"n_{n.lower()}" for n in ORDER), "trust_score", F.element_at(names, F.col("_rank") + 1).alias("grade"), F.least("_rank", F.lit(2)).cast("bigint").alias("exit_code"))
