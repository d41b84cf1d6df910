"""Column helpers: zone-free time arithmetic, Python-like comparisons, text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a blank text lacks, any character that Python's str.strip() keeps.
NONBLANK = r"[^\s\x1c-\x1f\x85\p{Z}]"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone; the session's zone plays no part."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def month(ts: Column) -> Column:
    """'2023-04' of a timestamp without zone."""
    return F.substring(ts.cast("timestamp_ntz").cast("string"), 1, 7)


def no_nan(*cols: Column) -> Column:
    """True where no value is NaN (nulls give null, which a filter drops)."""
    out = F.lit(True)
    for c in cols:
        out = out & ~F.isnan(c)
    return out


def py_gt(a: Column, b: Column) -> Column:
    """a > b as IEEE has it: false as soon as a NaN takes part."""
    return (a > b) & no_nan(a, b)


def py_le(a: Column, b: Column) -> Column:
    """a <= b as IEEE has it: false as soon as a NaN takes part."""
    return (a <= b) & no_nan(a, b)


def finite(c: Column) -> Column:
    """True where the value is neither null, NaN nor infinite."""
    d = c.cast("double")
    return c.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text (Unicode spaces included)."""
    return c.isNull() | ~c.rlike(NONBLANK)


def relative_error(stored: Column, recomputed: Column, floor: float = 1e-6) -> Column:
    """|stored - recomputed| over the recomputed size, which counts as `floor` at least."""
    return F.abs(stored - recomputed) / F.greatest(F.abs(recomputed), F.lit(floor))


def plain_source(c: Column) -> Column:
    """A source's spelling: no surrounding blanks, lower case."""
    return F.lower(F.trim(c))
