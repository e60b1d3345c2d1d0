"""Year-set arguments and temporal splits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# The published temporal split (end-exclusive ranges).
# ---------------------------------------------------------------------------
TRAIN_YEARS = {"start": 1995, "end": 2016}
VAL_YEARS = {"start": 2016, "end": 2019}
TEST_YEARS = {"start": 2019, "end": 2023}
# ---------------------------------------------------------------------------


def year_list(spec) -> list[int]:
    """The years of a year-set argument: a list, a mapping with start and end, or text ``a-b``.

    A range leaves out its end and must not be empty.
    """
    if isinstance(spec, str):
        bounds = spec.split("-")
    elif isinstance(spec, Mapping):
        bounds = [spec.get("start"), spec.get("end")]
    else:
        bounds = None
    try:
        if bounds is None:
            return list(map(int, spec))
        start, end = map(int, bounds)
    except (TypeError, ValueError):
        raise ValueError(f"not a set of years: {spec!r}") from None
    if start >= end:
        raise ValueError(f"a range of years must start before it ends: {spec!r}")
    return list(range(start, end))


def in_years(year, spec) -> Column:
    """``year IN (...)``; Catalyst pushes it to the Parquet scan / prunes partitions."""
    year = F.col(year) if isinstance(year, str) else year
    return year.isin(year_list(spec))


def split_label(year="year", train=TRAIN_YEARS, val=VAL_YEARS, test=TEST_YEARS) -> Column:
    """``'train' | 'val' | 'test'`` (NULL outside all three) for a year column."""
    year = F.col(year) if isinstance(year, str) else year
    return (
        F.when(in_years(year, train), F.lit("train"))
        .when(in_years(year, val), F.lit("val"))
        .when(in_years(year, test), F.lit("test"))
    )
