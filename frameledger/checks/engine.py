"""Checks, their registry, and the engine that runs them over a dataset."""

from __future__ import annotations

import concurrent.futures
import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from frameledger.errors import CheckExecutionError
from frameledger.sources.loader import TrajectoryDataset
from frameledger.verdict import CheckResult, Severity

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class CheckContext:
    """deep: also run what is too slow on remote data."""

    deep: bool = False


@dataclass(frozen=True)
class Check:
    """A check: its id ('CATEGORY.NAME'), the severity it usually reports, and how to run it."""

    id: str
    severity: Severity
    run: Callable[[TrajectoryDataset, CheckContext], CheckResult]
    requires_video: bool = False

    @property
    def category(self) -> str:
        return self.id.split(".")[0]


class CheckRegistry:
    """Checks in the order of registration; an id is taken once."""

    def __init__(self) -> None:
        self._checks: dict[str, Any] = {}

    def register(self, check: Any) -> Any:
        if check.id in self._checks:
            raise ValueError(f"check {check.id!r} is registered already")
        self._checks[check.id] = check
        return check

    def all_checks(self) -> list[Any]:
        return list(self._checks.values())

    def get(self, check_id: str) -> Any | None:
        return self._checks.get(check_id)

    def __len__(self) -> int:
        return len(self._checks)

    def __contains__(self, check_id: object) -> bool:
        return check_id in self._checks


registry = CheckRegistry()


def check(check_id: str, severity: Severity, requires_video: bool = False) -> Callable:
    """Registers the decorated function (dataset, context) -> result as a check, and returns the check."""
    return lambda run: registry.register(Check(check_id, severity, run, requires_video))


class CheckEngine:
    """Runs every applicable check, `at_once` of them side by side; one that raises gives an ERROR result and does not stop the others. Results come in the order of registration."""

    def __init__(self, checks: CheckRegistry = registry, at_once: int = 4) -> None:
        self.checks, self.at_once = checks, at_once

    def run(self, ds: TrajectoryDataset, ctx: CheckContext | None = None) -> list[CheckResult]:
        ctx = ctx or CheckContext()
        wanted = [c for c in self.checks.all_checks() if not c.requires_video or ds.cameras]
        if self.at_once <= 1 or len(wanted) < 2:
            return [self._one(c, ds, ctx) for c in wanted]
        tags = ds.spark.getTags()

        def one(c: Any) -> CheckResult:
            for t in tags:  # so that what cancels the caller's jobs cancels these
                ds.spark.addTag(t)
            try:
                return self._one(c, ds, ctx)
            finally:
                for t in tags:
                    ds.spark.removeTag(t)

        with concurrent.futures.ThreadPoolExecutor(self.at_once) as pool:
            return list(pool.map(one, wanted))

    @staticmethod
    def _one(c: Any, ds: TrajectoryDataset, ctx: CheckContext) -> CheckResult:
        try:
            return c.run(ds, ctx)
        except Exception as e:
            log.warning("check %s raised %s", c.id, type(e).__name__)
            text = str(e).split("\n\nJVM stacktrace")[0][:1000]
            return CheckResult(c.id, Severity.ERROR, f"{c.id} could not be carried out: {type(e).__name__}: {text}", {"exc_type": type(e).__name__, "exc_message": text})


def require_shards(ds: TrajectoryDataset, before: int | None = None) -> None:
    """Raises if an episode has no readable data file; with `before`, only if a check that stops at that episode would reach it."""
    for ord_, episode, why in ds.broken_shards:
        if before is None or ord_ <= before:
            raise CheckExecutionError(f"episode {episode}: {why}")


def found(check_id: str, severity: Severity, what: str, items: list[str], key: str, **more: Any) -> CheckResult:
    """A result that lists its findings under `key`."""
    return CheckResult(check_id, severity, f"{what} ({len(items)}): {items[0]}", {key: items, **more})


def passed(check_id: str, message: str, **details: Any) -> CheckResult:
    return CheckResult(check_id, Severity.INFO, message, details)
