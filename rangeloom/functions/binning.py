"""Binning of values by breaks: right-closed bins, first bin optionally closed on the left."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_index(value: Column, breaks: list[float], include_lowest: bool = False, force: bool = False) -> Column:
    """0-based bin of ``value`` among (b0, b1], (b1, b2], ...; null for missing values and those outside.

    With ``include_lowest`` the first break belongs to the first bin; with
    ``force`` values outside go to the first or last bin.  Regular breaks are
    found by arithmetic, others by a search in an array.
    """
    edges = F.array(*(F.lit(float(b)) for b in breaks))
    v = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    n = len(breaks) - 1
    found = F.size(F.filter(edges, lambda b: b < v)) - 1
    found = F.when((v == breaks[0]) & F.lit(include_lowest), 0).otherwise(found)
    if force:
        return F.when(v.isNull(), None).otherwise(F.least(F.greatest(found, F.lit(0)), F.lit(n - 1)))
    return F.when(v.isNull() | (v > breaks[-1]) | (found < 0), None).otherwise(found)


def bin_label(i: int, breaks: list[float], include_lowest: bool = False) -> str:
    left = "[" if include_lowest and i == 0 else "("
    return f"{left}{breaks[i]:g},{breaks[i + 1]:g}]"


def locate(value: float, breaks: list[float], include_lowest: bool = False) -> int | None:
    """Driver-side twin of ``bin_index`` for one value."""
    if value is None or value != value or value > breaks[-1] or value < breaks[0] or (value == breaks[0] and not include_lowest):
        return None
    return max(0, bisect_left(breaks, value) - 1)
