"""Rectangles on pairs of chromosomes: intersection, diagonal bands, area statistics, contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.intervals import canonic
from rangeloom.operators.ranges import BIN, level_of, level_width, no_nan, overlap_join
from rangeloom.storage import stored

KEYS = ("chrom1", "chrom2")
#: Positions, on each axis, in a cell of a join of rectangles at the lowest level.
CELL = 1 << 6
SIDES = ["chrom1", "start1", "end1", "chrom2", "start2", "end2"]


def all_pairs(chroms: DataFrame) -> DataFrame:
    """Every pair of chromosomes as one rectangle; grows with the number of chromosomes squared by its meaning."""
    a = chroms.select(F.col("chrom").alias("chrom1"), F.lit(0).cast("long").alias("start1"), F.col("size").alias("end1"))
    b = chroms.select(F.col("chrom").alias("chrom2"), F.lit(0).cast("long").alias("start2"), F.col("size").alias("end2"))
    return a.crossJoin(b)


def rectangle_join(left: DataFrame, right: DataFrame, bin_width: int = CELL) -> DataFrame:
    """Pairs of overlapping rectangles, once each; columns of ``right`` get the prefix ``r_``.

    On each axis a rectangle has the level of cells that suits its own extent
    there, as in ``overlap_join``; a pair meets, axis by axis, at the wider of
    its two levels.  A rectangle is dealt to (SPREAD + 1) squared cells at most
    for each pair of levels that the other side has, be it as large as two
    chromosomes, and a pair counts in the cell of its later starts.
    """

    def levelled(df: DataFrame, p: str) -> DataFrame:
        return df.withColumns({f"_{p}l{k}": level_of(F.col(f"{p}end{k}") - F.col(f"{p}start{k}"), bin_width) for k in (1, 2)})

    def levels(df: DataFrame, p: str) -> Column:
        return df.select(F.collect_set(F.struct(F.col(f"_{p}l1").alias("l1"), F.col(f"_{p}l2").alias("l2")))).scalar()

    def cells(df: DataFrame, p: str, other: Column) -> DataFrame:
        df = df.withColumn(f"_{p}met", F.explode(other))
        for k in (1, 2):
            width = level_width(F.greatest(F.col(f"_{p}l{k}"), F.col(f"_{p}met.l{k}")), bin_width)
            df = df.withColumn(f"_{p}c{k}", F.explode(F.sequence(F.floor(F.col(f"{p}start{k}") / width), F.floor((F.col(f"{p}end{k}") - 1) / width))))
        return df

    a, b = levelled(left, ""), levelled(right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)), "r_")
    la, lb = levels(a, ""), levels(b, "r_")
    a, b = cells(a, "", lb), cells(b, "r_", la)
    on = (F.col("chrom1") == F.col("r_chrom1")) & (F.col("chrom2") == F.col("r_chrom2"))
    for k in (1, 2):
        on = on & (F.col(f"_c{k}") == F.col(f"_r_c{k}")) & (F.col(f"_l{k}") == F.col(f"_r_met.l{k}")) & (F.col(f"_met.l{k}") == F.col(f"_r_l{k}"))
        on = on & (F.col(f"start{k}") < F.col(f"r_end{k}")) & (F.col(f"r_start{k}") < F.col(f"end{k}"))
    first = lambda k: F.floor(F.greatest(f"start{k}", f"r_start{k}") / level_width(F.greatest(F.col(f"_l{k}"), F.col(f"_met.l{k}")), bin_width))
    met = a.join(b, on).where((F.col("_c1") == first(1)) & (F.col("_c2") == first(2)))
    return met.select(*left.columns, *(f"r_{c}" for c in right.columns))


def intersect_2d(a: DataFrame, b: DataFrame, bin_width: int = CELL) -> DataFrame:
    """All pairwise intersections of rectangles, without merging."""
    found = rectangle_join(a.select(SIDES), b.select(SIDES), bin_width)
    edges = {f"start{k}": F.greatest(f"start{k}", f"r_start{k}") for k in (1, 2)} | {f"end{k}": F.least(f"end{k}", f"r_end{k}") for k in (1, 2)}
    return found.select(*(edges.get(c, F.col(c)).alias(c) for c in SIDES))


def union_2d(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rectangles of both sets; they aren't merged."""
    return a.select(SIDES).unionByName(b.select(SIDES))


def in_band(d1: int, d2: int) -> Column:
    """Whether a rectangle on one chromosome meets the band d1 <= x - y < d2."""
    return (F.col("chrom1") == F.col("chrom2")) & (F.col("end1") - F.col("start2") > d1) & (F.col("start1") - F.col("end2") + 1 < d2)


def band_clip(df: DataFrame, d1: int, d2: int) -> DataFrame:
    """The bounding box of each rectangle's part within the band; rectangles without one go.

    A side shrinks to where some point of the other side is within the band.
    """
    kept = df.where(in_band(d1, d2))
    box = {
        "start1": F.greatest(F.col("start1"), F.col("start2") + d1),
        "end1": F.least(F.col("end1"), F.col("end2") + d2 - 1),
        "start2": F.greatest(F.col("start2"), F.col("start1") - d2 + 1),
        "end2": F.least(F.col("end2"), F.col("end1") - d1),
    }
    clipped = kept.select(*(box.get(c, F.col(c)).alias(c) for c in df.columns))
    return clipped.where((F.col("start1") < F.col("end1")) & (F.col("start2") < F.col("end2")))


def band_area(start1: Column, end1: Column, start2: Column, end2: Column, d1: int | None = None, d2: int | None = None) -> Column:
    """Points of a rectangle, or of its part within a band, counted on the integer grid.

    Within a band the points are those left of x - y = d2 less those left of d1;
    each is a sum of an arithmetic series over the columns that it cuts.
    """
    if d1 is None:
        return (end1 - start1) * (end2 - start2)

    def below(d: int) -> Column:
        """Points with x - y < d."""
        height = end2 - start2
        # a column x has its y above x - d: all of them up to x = start2 + d - 1, none from x = end2 + d - 1 on
        full = F.greatest(F.lit(0), F.least(end1, start2 + d) - start1)
        lo = F.greatest(start1, start2 + d)
        hi = F.least(end1, end2 + d - 1)
        n = F.greatest(F.lit(0), hi - lo)
        first = end2 + d - 1 - lo
        return full * height + F.floor(n * (2 * first - n + 1) / 2)

    return below(d2) - below(d1)


def area_summary(cells: DataFrame, objects: DataFrame, value: str = "value", band: tuple[int, int] | None = None, bin_width: int = CELL) -> DataFrame:
    """Add to each cell of a 2D iterator ``avg`` (weighted by area), ``weighted_sum``, ``area``, ``min`` and ``max`` of the objects in it."""
    found = rectangle_join(cells.select(*SIDES).distinct(), objects.select(*SIDES, no_nan(value).alias("_v")), bin_width).where("r__v IS NOT NULL")
    edge = [F.greatest("start1", "r_start1"), F.least("end1", "r_end1"), F.greatest("start2", "r_start2"), F.least("end2", "r_end2")]
    found = found.withColumn("_a", band_area(*edge, *(band or ())).cast("double")).where("_a > 0")
    v, a = F.col("r__v"), F.col("_a")
    made = found.groupBy(*SIDES).agg(
        (F.sum(v * a) / F.sum(a)).alias("avg"), F.sum(v * a).alias("weighted_sum"), F.sum(a).alias("area"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    return cells.join(made, SIDES, "left").select(*cells.columns, "avg", "weighted_sum", "area", "min", "max")


def fixed_rectangles(scope: DataFrame, width: int, height: int) -> DataFrame:
    """Cells of a grid from 0 that meet each scope rectangle, clipped to it, with ``intervalID``."""
    numbered = scope if "intervalID" in scope.columns else scope.withColumn("intervalID", F.row_number().over(Window.orderBy(*SIDES)))
    at = lambda k, w: F.explode(F.sequence(F.floor(F.col(f"start{k}") / w), F.ceil(F.col(f"end{k}") / w) - 1))
    grid = numbered.withColumn("_x", at(1, width)).withColumn("_y", at(2, height))
    return grid.select(
        "chrom1", F.greatest("start1", F.col("_x") * width).alias("start1"), F.least("end1", (F.col("_x") + 1) * width).alias("end1"),
        "chrom2", F.greatest("start2", F.col("_y") * height).alias("start2"), F.least("end2", (F.col("_y") + 1) * height).alias("end2"), "intervalID",
    )


def cartesian_grid(a: DataFrame, expansion1: list[int], b: DataFrame | None = None, expansion2: list[int] | None = None, min_band: int | None = None, max_band: int | None = None) -> DataFrame:
    """Rectangles between the expansions around the centres of two interval sets.

    An expansion's neighbouring values bound a strip on each side of a centre;
    strips don't reach into a neighbour's half.  With a band of indices only the
    centres of one set whose ranks differ by min_band to max_band are paired.
    """

    def strips(df: DataFrame, expansion: list[int], k: int) -> DataFrame:
        centre = df.select("chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("c")).distinct()
        order = Window.partitionBy("chrom").orderBy("c")
        near = centre.withColumns({"rank": F.row_number().over(order), "lo": F.floor((F.lag("c").over(order) + F.col("c")) / 2), "hi": F.floor((F.lead("c").over(order) + F.col("c")) / 2)})
        bounds = sorted(set(expansion))
        cut = F.explode(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in zip(bounds, bounds[1:], strict=False))))
        near = near.withColumn("_e", cut)
        near = near.withColumns({"s": F.greatest(F.col("c") + F.col("_e.x"), F.coalesce("lo", F.lit(0))), "e": F.least(F.col("c") + F.col("_e.y"), F.coalesce(F.col("hi"), F.col("c") + F.col("_e.y")))})
        return near.where("s < e").select(F.col("chrom").alias(f"chrom{k}"), F.col("s").alias(f"start{k}"), F.col("e").alias(f"end{k}"), F.col("rank").alias(f"rank{k}"))

    left, right = strips(a, expansion1, 1), strips(a if b is None else b, expansion2 or expansion1, 2)
    if min_band is None and max_band is None:
        return left.crossJoin(right).select(SIDES)
    # the ranks' differences are enumerated, so that this is an equi-join on (chromosome, rank)
    left = left.withColumn("_rank", F.explode(F.sequence(F.col("rank1") + min_band, F.col("rank1") + max_band)))
    return left.join(right, (F.col("chrom1") == F.col("chrom2")) & (F.col("_rank") == F.col("rank2"))).select(SIDES)


def import_contacts(contacts: DataFrame, allow_duplicates: bool = True) -> DataFrame:
    """Points from contacts: each side's midpoint, mirrored within a chromosome, duplicates summed.

    Contacts on the diagonal aren't mirrored.  Without ``allow_duplicates`` two
    contacts at one point are an error.
    """
    value = no_nan("value") if "value" in contacts.columns else F.lit(1.0)
    mid = lambda k: F.floor((F.col(f"start{k}") + F.col(f"end{k}")) / 2).cast("long")
    points = contacts.select("chrom1", mid(1).alias("x"), "chrom2", mid(2).alias("y"), value.alias("value"))
    mirror = (F.col("chrom1") != F.col("chrom2")) | (F.col("x") != F.col("y"))
    turned = points.where(mirror).select(F.col("chrom2").alias("chrom1"), F.col("y").alias("x"), F.col("chrom1").alias("chrom2"), F.col("x").alias("y"), "value")
    total = points.unionByName(turned).groupBy("chrom1", "x", "chrom2", "y").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    if not allow_duplicates:
        fail = F.raise_error(F.lit("duplicate contact")).cast("double")
        total = total.withColumn("value", F.when(F.col("n") > 1, fail).otherwise(F.col("value")))
    return total.select("chrom1", F.col("x").alias("start1"), (F.col("x") + 1).alias("end1"), "chrom2", F.col("y").alias("start2"), (F.col("y") + 1).alias("end2"), "value")


def fend_contacts(pairs: DataFrame, fends: DataFrame) -> DataFrame:
    """Contacts of fragment ends: ids ``fend1`` and ``fend2`` looked up in ``fends`` (fend, chrom, coord)."""
    side = lambda k: fends.select(F.col("fend").alias(f"fend{k}"), F.col("chrom").alias(f"chrom{k}"), F.col("coord").alias(f"start{k}"), (F.col("coord") + 1).alias(f"end{k}"))
    return import_contacts(pairs.join(side(1), "fend1").join(side(2), "fend2"))


def is_points(df: DataFrame) -> bool:
    """Whether all extents are 1, so that the table is one of points."""
    flag = F.bool_and((F.col("end1") - F.col("start1") == 1) & (F.col("end2") - F.col("start2") == 1))
    return bool(df.agg(flag.alias("p")).first()["p"])


def project(df: DataFrame, side: int) -> DataFrame:
    """One axis of a 2D iterator as a 1D one."""
    return df.withColumns({"chrom": F.col(f"chrom{side}"), "start": F.col(f"start{side}"), "end": F.col(f"end{side}")})


def cis_decay(contacts: DataFrame, bin_of, src: DataFrame, domains: DataFrame, bin_width: int = BIN) -> DataFrame:
    """Counts of contact distances by bin, within and across domains.

    Contacts lie on one chromosome and begin inside ``src`` (merged); both sides
    inside one domain count as ``intra``, else as ``inter``.  ``bin_of`` turns
    the distance column into a bin, null for none.
    """
    cis = contacts.where("chrom1 = chrom2")
    distance = F.abs(F.expr("(start1 + end1 - start2 - end2) div 2"))
    cis = stored(cis.withColumn("_id", F.monotonically_increasing_id()).withColumn("bin", bin_of(distance)).where("bin IS NOT NULL"), "contacts")
    one = cis.select(F.col("chrom1").alias("chrom"), F.col("start1").alias("start"), F.col("end1").alias("end"), "_id", "bin", F.col("start2").alias("s2"), F.col("end2").alias("e2"))
    held = overlap_join(one, canonic(src), bin_width, suffix="_src").where("start >= start_src AND end <= end_src")
    doms = canonic(domains, touching=False)
    in_one = overlap_join(held.drop("start_src", "end_src"), doms, bin_width, suffix="_dom").where("start >= start_dom AND end <= end_dom AND s2 >= start_dom AND e2 <= end_dom")
    flagged = held.join(in_one.select("_id").distinct().withColumn("intra", F.lit(1)), "_id", "left")
    return flagged.groupBy("bin").agg(F.count("intra").alias("intra"), F.count(F.when(F.col("intra").isNull(), 1)).alias("inter"))


