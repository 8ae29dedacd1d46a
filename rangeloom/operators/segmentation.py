"""Segmentation and sliding Wilcoxon tests over binned tracks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from math import erfc, sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.operators.intervals import mark_overlaps
from rangeloom.operators.ranges import no_nan

#: Samples below which the normal approximation isn't trusted.
LEAST_SAMPLES = 10
#: Places that one task tests at a time.
TILE_BINS = 1 << 13


def half_window(size: int, bin_size: int) -> int:
    """Bins on each side of a window's centre."""
    return int(0.5 * size / bin_size + 0.5)


def rank_sum_z(u: float, n: int, m: int, way: int = 0) -> float:
    """z of Mann-Whitney's u of two samples of n and m, without a correction for ties.

    ``u`` counts the pairs whose first value is the larger, ties as a half.  With
    ``way`` 1 (-1) only a second sample that is the higher (lower) one counts,
    else z is 0; with 0 the smaller of both directions' u gives z.  Samples under
    LEAST_SAMPLES give 1, which is no z.
    """
    if min(n, m) < LEAST_SAMPLES:
        return 1.0
    mean = 0.5 * n * m
    deviation = (min(u, n * m - u) - mean) / sqrt(n * m * (n + m + 1) / 12)
    if (way > 0 and u >= mean) or (way < 0 and u <= mean):
        return 0.0
    return deviation


def p_of(z: float, onetailed: bool) -> float:
    return erfc(-z / sqrt(2)) * (0.5 if onetailed else 1.0)


def _z_bound(max_p: float, onetailed: bool) -> float:
    return NormalDist().inv_cdf(max_p if onetailed else max_p / 2)


def sliding_wilcoxon(bins: DataFrame, bin_size: int, small: int, large: int, max_p: float = 0.05, onetailed: bool = True, find: int = 1, tile_bins: int = TILE_BINS) -> DataFrame:
    """Regions where a small window's values differ from those of the large window around it, itself included.

    Windows hold 2 * int(0.5 * size / bin + 0.5) + 1 bins, ten or more; missing
    values are left out, and a place with under ten values in either window, or
    none of its own, is no hit.  ``find`` is 1 for peaks, -1 for lows, 0 for
    both.  Runs of hits reach half a small window beyond both ends, and regions
    that overlap or touch are one: ``chrom, start, end, pval`` with the smallest
    p-value.

    Windows are local, so that places are dealt to tiles that also get half a
    large window of bins on each side; hits are joined by running aggregates.
    """
    small, large = min(small, large), max(small, large)
    half_s, half_l = half_window(small, bin_size), half_window(large, bin_size)
    if 2 * half_s + 1 < LEAST_SAMPLES:
        raise ValueError(f"a window of {small} positions holds {2 * half_s + 1} bins, fewer than {LEAST_SAMPLES}")
    bound = _z_bound(max_p, onetailed)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key[1] * tile_bins, (key[1] + 1) * tile_bins
        base = low - half_l
        values = np.full(tile_bins + 2 * half_l, np.nan)
        values[pdf["bin"].to_numpy() - base] = pdf["value"].to_numpy(float)
        around = sorted(values[: 2 * half_l][~np.isnan(values[: 2 * half_l])].tolist())
        rows: list[tuple] = []
        for i in range(half_l, half_l + tile_bins):
            if not np.isnan(new := values[i + half_l]):
                insort(around, float(new))
            if not np.isnan(values[i]):
                inner = values[i - half_s : i + half_s + 1]
                inner = inner[~np.isnan(inner)]
                ordered = np.array(around)
                above = len(ordered) - 0.5 * (np.searchsorted(ordered, inner, "left") + np.searchsorted(ordered, inner, "right"))
                z = rank_sum_z(float(above.sum()), len(ordered), len(inner), find)
                if z <= bound:
                    at = base + i
                    rows.append((key[0], max(0, (at - half_s) * bin_size), (at + half_s + 1) * bin_size, p_of(z, onetailed)))
            if not np.isnan(old := values[i - half_l]):
                del around[bisect_left(around, float(old))]
        return pd.DataFrame(rows, columns=["chrom", "start", "end", "pval"])

    tiles = F.sequence(F.floor((F.col("bin") - half_l) / tile_bins), F.floor((F.col("bin") + half_l) / tile_bins))
    dealt = bins.select("chrom", "bin", no_nan("value").alias("value"), F.explode(tiles).alias("_tile")).where("_tile >= 0 AND value IS NOT NULL")
    hits = dealt.groupBy("chrom", "_tile").applyInPandas(run, "chrom string, start long, end long, pval double")
    regions = mark_overlaps(hits, "_region")
    return regions.groupBy("chrom", "_region").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("pval").alias("pval")).drop("_region")


def _segments(values: list[float], size: int, bound: float) -> list[int]:
    """Indexes at which segments end, past the last value of each; what follows the last belongs to the last segment.

    A segment of ``size`` values grows, value by value, while the ``size`` values
    ahead of it don't differ from it.  Once they do, the place where they differ
    most, among it and the ``size - 1`` places after it, is the segment's end.
    """
    ends, first = [], 0
    while first + 2 * size <= len(values):
        grown, ahead = sorted(values[first : first + size]), sorted(values[first + size : first + 2 * size])
        u = sum(len(grown) - 0.5 * (bisect_left(grown, x) + bisect_right(grown, x)) for x in ahead)
        at, best, since = first + size, None, 0
        while True:
            z = rank_sum_z(u, len(grown), size)
            if best is not None:
                since += 1
                best = min(best, (z, at))
                if since >= size - 1:
                    break
            elif z <= bound:
                best = (z, at)
            if at + size >= len(values):
                return ends
            old, new = values[at], values[at + size]
            u -= len(grown) - 0.5 * (bisect_left(grown, old) + bisect_right(grown, old))
            del ahead[bisect_left(ahead, old)]
            insort(grown, old)
            u += 0.5 * (bisect_left(ahead, old) + bisect_right(ahead, old))
            u += len(grown) - 0.5 * (bisect_left(grown, new) + bisect_right(grown, new))
            insort(ahead, new)
            at += 1
        first = best[1]
        ends.append(first)
    return ends


def segment_rows(rows: DataFrame, bin_size: int, min_segment: int, max_p: float = 0.05, onetailed: bool = True) -> DataFrame:
    """Greedy segments of each scope row's bins: ``chrom, start, end`` from rows ``chrom, start, end, intervalID, value``.

    A segment holds max(int(min_segment / bin + 0.5), 1) values at least, ten or
    more, and ends where the Wilcoxon test tells the values after it from its
    own; see ``_segments``.  Missing values are skipped.  Segments fill the
    scope row: each begins where the one before ends, and the last one ends with
    the row.  The greedy order asks for a scope row in one task, its bins 16
    bytes each.
    """
    size = max(int(min_segment / bin_size + 0.5), 1)
    if size < LEAST_SAMPLES:
        raise ValueError(f"segments of {size} bins are too small to test; {LEAST_SAMPLES * bin_size} positions are the least")
    bound = _z_bound(max_p, onetailed)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start")
        full = pdf.dropna(subset=["value"])
        ends = _segments(full["value"].to_numpy(float).tolist(), size, bound)
        cuts = [int(full["start"].iloc[i - 1]) + bin_size for i in ends]
        # what is left after the last segment's end makes it longer
        edges = [int(pdf["start"].iloc[0]), *cuts[:-1], int(pdf["end"].iloc[-1])]
        return pd.DataFrame({"chrom": pdf["chrom"].iloc[0], "start": edges[:-1], "end": edges[1:]})

    return rows.select("chrom", "start", "end", "intervalID", no_nan("value").alias("value")).groupBy("intervalID").applyInPandas(run, "chrom string, start long, end long")


def segment(bins: DataFrame, bin_size: int, min_segment: int, max_p: float = 0.05, onetailed: bool = True) -> DataFrame:
    """``segment_rows`` of a dense track's chromosomes, from their first bin to their last."""
    start = F.col("bin") * bin_size
    rows = bins.select("chrom", start.alias("start"), (start + bin_size).alias("end"), F.xxhash64("chrom").alias("intervalID"), "value")
    return segment_rows(rows, bin_size, min_segment, max_p, onetailed)
