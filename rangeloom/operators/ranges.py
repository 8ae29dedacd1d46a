"""Building blocks: overlap joins, running aggregates over tiles, NaN handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rangeloom.storage import stored

#: Positions in a tile.  Running aggregates sort within tiles and carry over a row per tile.
TILE = 1 << 16
#: Positions in a bin of an overlap join at the lowest level; bins that a row covers at its own level, about; how much wider the next level's bins are; levels.
BIN, SPREAD, STEP, LEVELS = 1 << 8, 4, 16, 9


def no_nan(value: Column | str) -> Column:
    """NaN and null are both missing; Spark aggregates skip only null."""
    value = F.col(value) if isinstance(value, str) else value
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def level_of(length: Column, bin_width: int = BIN, spread: int = SPREAD) -> Column:
    """The level whose bins a length covers ``spread`` of at most (and one more, by its place): 0 is ``bin_width``, each next STEP times as wide."""
    level = F.when(length <= bin_width * spread, 0)
    for k in range(1, LEVELS - 1):
        level = level.when(length <= bin_width * spread * STEP**k, k)
    return level.otherwise(LEVELS - 1)


def level_width(level: Column, bin_width: int = BIN) -> Column:
    return F.element_at(F.array(*(F.lit(bin_width * STEP**k).cast("long") for k in range(LEVELS))), level + 1)


def overlap_join(
    left: DataFrame, right: DataFrame, bin_width: int = BIN, how: str = "inner", keys: tuple[str, ...] = ("chrom",), suffix: str = "1", touching: bool = False
) -> DataFrame:
    """Pairs of rows whose half-open ``[start, end)`` overlap, once each.

    Columns of ``right`` get ``suffix`` where ``left`` has the name.  Each row
    has the level of bins that suits its own length; a pair meets at the wider
    of its two levels, so a row is dealt to SPREAD + 1 bins at most for each
    level that the other side has, however long it is, and the join is an
    equi-join on (keys, levels, bin) whose work follows the pairs: bins are at
    most STEP times as wide as the wider row's length, or of BIN positions.  Most
    tables have one level or two.  A pair that meets in several bins is kept in the one that
    holds its later start.  ``how`` is inner, left, left_semi or left_anti.
    """
    if how != "inner":
        # both sides of the join below read these numbers, so they are stored
        row = stored(left.withColumn("_row", F.monotonically_increasing_id()), "left_rows")
        found = overlap_join(row.select("_row", *keys, "start", "end"), right, bin_width, "inner", keys, suffix, touching)
        if how == "left":
            extra = found.drop(*keys, "start", "end")
            return row.join(extra, "_row", "left").drop("_row")
        return row.join(found.select("_row").distinct(), "_row", how).drop("_row")
    pad = 1 if touching else 0
    names = {c: f"{c}{suffix}" if c in left.columns else c for c in right.columns}
    a = left.withColumn("_level", level_of(F.col("end") - F.col("start"), bin_width))
    b = right.select(*(F.col(c).alias(f"_r_{c}") for c in right.columns)).withColumn("_r_level", level_of(F.col("_r_end") - F.col("_r_start"), bin_width))
    levels = lambda df, c: df.select(F.collect_set(c)).scalar()

    def bins(df: DataFrame, other: Column, level: str, met: str, start: str, end: str, out: str) -> DataFrame:
        """Rows by the levels of the other side, and their bins at the wider of both."""
        df = df.withColumn(met, F.explode(other))
        width = level_width(F.greatest(level, met), bin_width)
        first, last = F.floor((F.col(start) - pad) / width), F.floor((F.greatest(F.col(end) + pad, F.col(start) + 1) - 1) / width)
        return df.withColumn(out, F.explode(F.sequence(first, last)))

    la, lb = levels(a, "_level"), levels(b, "_r_level")
    a = bins(a, lb, "_level", "_met", "start", "end", "_bin")
    b = bins(b, la, "_r_level", "_r_met", "_r_start", "_r_end", "_r_bin")
    on = (F.col("_bin") == F.col("_r_bin")) & (F.col("_level") == F.col("_r_met")) & (F.col("_met") == F.col("_r_level"))
    on = on & (F.col("start") < F.col("_r_end") + pad) & (F.col("_r_start") < F.col("end") + pad)
    for k in keys:
        on = on & (F.col(k) == F.col(f"_r_{k}"))
    first = F.floor((F.greatest("start", "_r_start") - pad) / level_width(F.greatest("_level", "_met"), bin_width))
    joined = a.join(b, on).where(F.col("_bin") == first)
    return joined.select(*left.columns, *(F.col(f"_r_{c}").alias(n) for c, n in names.items() if c not in keys))


def free_parts(rows: DataFrame, masked: DataFrame, bin_width: int = BIN) -> DataFrame:
    """What intervals that don't overlap each other leave of each row: its columns, with the part's ``start`` and ``end``.

    Rows that are equal in all columns are one; a row that is covered is left out.
    """
    hits = overlap_join(rows, masked.select("chrom", "start", "end"), bin_width, how="left")
    cuts = hits.groupBy(*rows.columns).agg(F.sort_array(F.collect_list(F.when(F.col("start1").isNotNull(), F.struct("start1", "end1")))).alias("_cuts"))
    # free parts lie between one cut's end and the next cut's start
    edges = F.transform(F.sequence(F.lit(0), F.size("_cuts")), lambda i: F.struct(
        F.when(i == 0, F.col("start")).otherwise(F.get(F.col("_cuts"), i - 1)["end1"]).alias("s"),
        F.when(i == F.size("_cuts"), F.col("end")).otherwise(F.get(F.col("_cuts"), i)["start1"]).alias("e"),
    ))
    parts = cuts.withColumn("_p", F.explode(edges)).withColumns({"start": F.col("_p.s"), "end": F.col("_p.e")})
    return parts.where("start < end").select(*rows.columns)


def running(df: DataFrame, kind: str, value: Column, name: str, order: list[Column], tile: int = TILE, keys: tuple[str, ...] = ("chrom",), before: bool = True) -> DataFrame:
    """Add a running aggregate along each key's ``start``, in two levels.

    ``kind`` is max, min, sum, count or last (of non-null values).  With
    ``before`` a row sees the rows that come before it, else itself too.  Rows
    are windowed within (keys, tile); what a tile hands on is a window over one
    row per tile.  So no key's rows meet in one task.
    """
    functions = {"max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "last": lambda c: F.last(c, ignorenulls=True)}
    f, merge = functions[kind], functions["sum" if kind == "count" else kind]
    # both levels read these rows; stored, they are made once, and chains of running aggregates don't multiply
    tiled = stored(df.withColumn("_tile", F.floor(F.col("start") / tile)).withColumn("_value", value), "tiles")
    within = Window.partitionBy(*keys, "_tile").orderBy(*order)
    local = f("_value").over(within.rowsBetween(Window.unboundedPreceding, -1 if before else 0))
    if kind == "last":
        own = tiled.groupBy(*keys, "_tile").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order_keys(order)))).alias("_own"))
    else:
        own = tiled.groupBy(*keys, "_tile").agg(f("_value").alias("_own"))
    over = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = own.select(*keys, "_tile", merge("_own").over(over).alias("_carry"))
    out = tiled.withColumn("_local", local).join(carry, [*keys, "_tile"])
    if kind in ("sum", "count"):
        both = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    elif kind == "last":
        both = F.coalesce("_local", "_carry")
    else:
        both = (F.greatest if kind == "max" else F.least)("_local", "_carry")
    return out.withColumn(name, both).drop("_tile", "_value", "_local", "_carry")


def number_rows(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Add each row's number from 1 in an order, without sorting all rows in one task.

    Rows are dealt to ranges of the order and stored; a row's number is its place
    in its range and what the ranges before hold, a sum over a row for each.
    """
    place = F.monotonically_increasing_id()  # the partition above 33 bits, the row in it below
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "numbered")
    part = F.shiftright("_place", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1).select(*df.columns, name)


def order_keys(order: list[Column]) -> list[Column]:
    """Columns of an ascending order, for use as a sort key in an aggregate."""
    return [c if isinstance(c, Column) else F.col(c) for c in order]


def chroms_schema() -> T.StructType:
    return T.StructType([T.StructField("chrom_id", T.IntegerType()), T.StructField("chrom", T.StringType()), T.StructField("size", T.LongType())])
