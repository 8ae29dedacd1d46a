"""Interval sets: construction, set algebra in positions, clipping and measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rangeloom.operators.ranges import BIN, TILE, overlap_join, running
from rangeloom.storage import stored


def intervals(spark: SparkSession, chroms: DataFrame, chrom: list[str], start: list[int] | int = 0, end: list[int] | int = -1, strand: list[int] | int | None = None) -> DataFrame:
    """Intervals from lists; an end of -1 is the chromosome's end.  Sorted by chromosome order, then start."""
    n = len(chrom)
    full = lambda x: list(x) if isinstance(x, (list, tuple)) else [x] * n
    rows = list(zip(chrom, full(start), full(end), full(strand), strict=True))
    made = spark.createDataFrame(rows, "chrom string, start long, end long, strand int").join(chroms, "chrom")
    made = made.withColumn("end", F.when(F.col("end") == -1, F.col("size")).otherwise(F.col("end")))
    made = checked(made).orderBy("chrom_id", "start", "end")
    return made.select("chrom", "start", "end", *(["strand"] if strand is not None else []))


def checked(df: DataFrame) -> DataFrame:
    """Fail on rows outside ``0 <= start < end <= size``."""
    ok = (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("size"))
    bad = F.raise_error(F.concat_ws(" ", F.lit("bad interval"), "chrom", F.col("start").cast("string"), F.col("end").cast("string")))
    return df.withColumn("end", F.when(ok, F.col("end")).otherwise(bad.cast("long")))


def from_strings(df: DataFrame, column: str = "region") -> DataFrame:
    """Parse ``chrom:start-end``; thousands separators are allowed, and what doesn't parse has null places."""
    parts = F.regexp_replace(column, ",", "")
    pattern = r"^\s*([^:]+):(\d+)-(\d+)\s*$"
    pick = lambda i: F.regexp_extract(parts, pattern, i)
    return df.withColumns({"chrom": pick(1), "start": pick(2).try_cast("long"), "end": pick(3).try_cast("long")})


def to_strings(df: DataFrame, name: str = "region") -> DataFrame:
    return df.withColumn(name, F.concat(F.col("chrom"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))


def all_chroms(chroms: DataFrame) -> DataFrame:
    return chroms.select("chrom", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))


def mark_overlaps(df: DataFrame, group_col: str = "overlap_group", touching: bool = True, tile: int = TILE) -> DataFrame:
    """Add the number (from 1, in order of chromosome name and start) of the merged interval that holds each row."""
    begins = running(df, "max", F.col("end"), "_reach", [F.col("start"), F.col("end")], tile)
    new = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") if touching else F.col("start") >= F.col("_reach"))
    numbered = running(begins.withColumn("_new", new.cast("long")).drop("_reach"), "sum", F.col("_new"), "_island", [F.col("start"), F.col("end")], tile, before=False)
    numbered = stored(numbered, "islands")
    per_chrom = numbered.groupBy("chrom").agg(F.max("_island").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("chrom").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = per_chrom.select("chrom", before.alias("_base"))  # a row for each chromosome
    out = numbered.join(shifted, "chrom").withColumn(group_col, (F.col("_base") + F.col("_island")).cast("long"))
    return out.select(*df.columns, group_col)


def canonic(df: DataFrame, touching: bool = True, tile: int = TILE) -> DataFrame:
    """Merge overlapping and, by default, touching intervals: ``chrom, start, end``."""
    rows = df.select("chrom", "start", "end")
    begins = running(rows, "max", F.col("end"), "_reach", [F.col("start"), F.col("end")], tile)
    new = F.col("_reach").isNull() | (F.col("start") > F.col("_reach") if touching else F.col("start") >= F.col("_reach"))
    marked = running(begins.withColumn("_new", new.cast("long")).drop("_reach"), "sum", F.col("_new"), "_g", [F.col("start"), F.col("end")], tile, before=False)
    return marked.groupBy("chrom", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def canonic_mapping(df: DataFrame, touching: bool = True) -> DataFrame:
    """Source rows with ``mapping``, the 1-based row of ``canonic`` that holds them."""
    return mark_overlaps(df, "mapping", touching)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions that either set covers."""
    return canonic(a.select("chrom", "start", "end").unionByName(b.select("chrom", "start", "end")))


def intersect(a: DataFrame, b: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Positions that both sets cover."""
    both = overlap_join(canonic(a), canonic(b), bin_width)
    return both.select("chrom", F.greatest("start", "start1").alias("start"), F.least("end", "end1").alias("end"))


def difference(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """Positions of ``a`` that ``b`` doesn't cover.

    Both are merged, their edges become events, and running sums tell where
    only ``a`` is open.  The next event's place comes from the same sweep.
    """
    events = None
    for side, df in ((1, canonic(a)), (2, canonic(b))):
        for column, step in (("start", 1), ("end", -1)):
            part = df.select("chrom", F.col(column).alias("start"), F.lit(step if side == 1 else 0).alias("a"), F.lit(step if side == 2 else 0).alias("b"))
            events = part if events is None else events.unionByName(part)
    events = events.groupBy("chrom", "start").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = [F.col("start")]
    swept = running(running(events, "sum", F.col("a"), "in_a", order, tile, before=False), "sum", F.col("b"), "in_b", order, tile, before=False)
    swept = next_start(swept, tile)
    kept = swept.where((F.col("in_a") > 0) & (F.col("in_b") == 0)).select("chrom", "start", F.col("_next").alias("end"))
    return canonic(kept)


def next_start(df: DataFrame, tile: int = TILE, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Add ``_next``: the start of the key's next row (starts are distinct)."""
    tiled = stored(df.withColumn("_tile", F.floor(F.col("start") / tile)), "tiles")
    local = F.lead("start").over(Window.partitionBy(*keys, "_tile").orderBy("start"))
    firsts = tiled.groupBy(*keys, "_tile").agg(F.min("start").alias("_first"))
    after = firsts.select(*keys, "_tile", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_tile")).alias("_after"))
    return tiled.withColumn("_local", local).join(after, [*keys, "_tile"]).withColumn("_next", F.coalesce("_local", "_after")).drop("_tile", "_local", "_after")


def force_range(df: DataFrame, chroms: DataFrame) -> DataFrame:
    """Clip to the chromosomes; rows that lie outside, or on unknown chromosomes, go."""
    found = df.join(chroms.select("chrom", "size"), "chrom")
    found = found.withColumn("start", F.greatest("start", F.lit(0).cast("long"))).withColumn("end", F.least("end", "size"))
    return found.where("start < end").select(df.columns)


def normalize(df: DataFrame, size: Column | int, chroms: DataFrame) -> DataFrame:
    """Re-centre every interval to ``size`` positions, clipped to its chromosome.

    ``size`` may be a column, or an array column, which gives a row for each size.
    """
    size = F.lit(size) if isinstance(size, int) else size
    sized = df.withColumn("_size", size.cast("long"))
    centre = F.floor((F.col("start") + F.col("end")) / 2)
    start = centre - F.floor(F.col("_size") / 2)
    moved = sized.withColumns({"start": start, "end": start + F.col("_size")}).drop("_size")
    return force_range(moved, chroms)


def rbind(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out


def covered(df: DataFrame) -> DataFrame:
    """One row: ``covered``, the positions that the set covers."""
    return canonic(df).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).cast("long").alias("covered"))


def coverage_fraction(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ``fraction`` of the positions of ``b`` that ``a`` covers; null where ``b`` covers none."""
    both, whole = covered(intersect(a, b)).withColumnRenamed("covered", "x"), covered(b)
    return both.join(F.broadcast(whole), F.lit(True)).select(F.when(F.col("covered") > 0, F.col("x") / F.col("covered")).alias("fraction"))


def chrom_sizes(df: DataFrame, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Rows for each chromosome, or for each pair."""
    return df.groupBy(*keys).agg(F.count("*").alias("size"))


def random_intervals(spark: SparkSession, chroms: DataFrame, size: int, n: int, from_edge: int = 0, exclude: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """``n`` intervals of one size, uniform over the places that are ``from_edge`` off the edges and free of ``exclude``.

    Free places are the starts that leave the whole interval within one free
    segment; a draw over their running total is placed by an overlap join.
    """
    inside = chroms.select("chrom", F.lit(from_edge).cast("long").alias("start"), (F.col("size") - from_edge).alias("end")).where(F.col("end") - F.col("start") >= size)
    free = difference(inside, exclude) if exclude is not None else inside
    free = free.where(F.col("end") - F.col("start") >= size).withColumn("room", F.col("end") - F.col("start") - size + 1)
    per = free.groupBy("chrom").agg(F.sum("room").alias("room"))
    per = per.withColumn("high", F.sum("room").over(Window.orderBy("chrom"))).withColumn("total", F.sum("room").over(Window.partitionBy()))
    picks = spark.range(n).select("id", F.rand(seed).alias("u")).join(F.broadcast(per), F.lit(True))
    at = F.floor(F.col("u") * F.col("total"))
    picks = picks.where((at < F.col("high")) & (at >= F.col("high") - F.col("room"))).select("id", "chrom", (at - F.col("high") + F.col("room")).alias("at"))
    placed = running(free, "sum", F.col("room"), "before", [F.col("start")])
    asked = picks.select("id", "chrom", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    spans = placed.select("chrom", F.col("before").cast("long").alias("start"), (F.col("before") + F.col("room")).cast("long").alias("end"), F.col("start").alias("real"))
    found = overlap_join(asked, spans)
    start = F.col("real") + F.col("start") - F.col("start1")
    return found.select("chrom", start.alias("start"), (start + size).alias("end"))
