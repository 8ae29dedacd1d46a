"""Iterators: the windows over which expressions are evaluated, each with its scope row's ``intervalID``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.intervals import mark_overlaps
from rangeloom.operators.ranges import BIN, overlap_join

COLUMNS = ["chrom", "start", "end", "intervalID"]


def numbered(scope: DataFrame) -> DataFrame:
    """Scope rows numbered from 1 in order of chromosome and place.  A scope is a list of places, not data."""
    if "intervalID" in scope.columns:
        return scope
    return scope.withColumn("intervalID", F.row_number().over(Window.orderBy("chrom", "start", "end")).cast("long"))


def fixed_bins(scope: DataFrame, width: int) -> DataFrame:
    """Bins of ``width`` from coordinate 0 that meet each scope row, the first and last clipped to it."""
    rows = numbered(scope).where("start < end")
    at = F.explode(F.sequence(F.floor(F.col("start") / width), F.ceil(F.col("end") / width) - 1))
    bins = rows.withColumn("_b", at)
    return bins.select("chrom", F.greatest("start", F.col("_b") * width).alias("start"), F.least("end", (F.col("_b") + 1) * width).alias("end"), "intervalID")


def relative_bins(scope: DataFrame, width: int, partial: str = "clip") -> DataFrame:
    """Bins counted from each scope row's start; the last is clipped, dropped if partial ("drop"), or all are whole ("exact")."""
    rows = numbered(scope).where("start < end")
    bins = rows.withColumn("_s", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(width).cast("long"))))
    end = F.col("_s") + width
    if partial == "exact":
        bad = F.raise_error(F.lit("an interval isn't a whole number of bins")).cast("long")
        bins = bins.withColumn("end", F.when((F.col("end") - F.col("start")) % width == 0, F.col("end")).otherwise(bad))
    if partial == "drop":
        bins = bins.where(end <= F.col("end"))
    return bins.select("chrom", F.col("_s").alias("start"), F.least(end, F.col("end")).alias("end"), "intervalID")


def over_intervals(scope: DataFrame, rows: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Intervals, overlapping ones merged and touching ones not, clipped to each scope row that they meet."""
    merged = mark_overlaps(rows.select("chrom", "start", "end"), "_g", touching=False)
    merged = merged.groupBy("chrom", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")
    found = overlap_join(merged, numbered(scope).select(*COLUMNS), bin_width)
    return found.select("chrom", F.greatest("start", "start1").alias("start"), F.least("end", "end1").alias("end"), "intervalID")
