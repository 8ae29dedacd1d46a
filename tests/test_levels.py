"""Overlap joins of rows of very unlike lengths."""

import random

from pyspark.sql import functions as F

from rangeloom.operators import ranges, two_d


def spans(rng, n, size):
    out = []
    for i in range(n):
        length = rng.choice([1, 5, 300, 4096, 70_000, 3_000_000, size])
        start = rng.randrange(max(1, size - length))
        out.append((rng.choice("ab"), start, start + length, i))
    return out


def test_overlap_join_of_all_levels(spark):
    rng = random.Random(1)
    size = 250_000_000
    left, right = spans(rng, 150, size), spans(rng, 150, size) + [("a", 0, size, 900), ("a", 5, 5 + 4096 * 16, 901), ("a", 65_536, 131_073, 902)]
    wanted = {(x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and y[1] < x[2]}
    frame = lambda rows: spark.createDataFrame(rows, "chrom string, start long, end long, i long")
    for width in (16, 4096):
        found = [(r.i, r.i1) for r in ranges.overlap_join(frame(left), frame(right), width).collect()]
        assert len(found) == len(set(found)) and set(found) == wanted
    near = {(x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2]}
    assert {(r.i, r.i1) for r in ranges.overlap_join(frame(left), frame(right), touching=True).collect()} == near
    assert ranges.overlap_join(frame(left), frame(right).limit(0)).collect() == []
    assert ranges.overlap_join(frame(left), frame(right).limit(0), how="left").count() == 150


def test_a_long_interval_makes_few_rows(spark):
    one = spark.createDataFrame([("a", 0, 250_000_000)], "chrom string, start long, end long")
    many = spark.range(200_000).select(F.lit("a").alias("chrom"), (F.col("id") * 1250).alias("start"), (F.col("id") * 1250 + 10).alias("end"))
    assert ranges.overlap_join(one, many).count() == 200_000
    level = ranges.level_of(F.col("end") - F.col("start"))
    bins = one.select((F.col("end") / ranges.level_width(level)).alias("n")).first().n
    assert bins <= ranges.SPREAD


def rectangles(rng, n, size):
    a, b = spans(rng, n, size), spans(rng, n, size)
    return [(*x[:3], *y[:3], x[3]) for x, y in zip(a, b, strict=True)]


def test_rectangle_join_of_all_levels(spark):
    rng = random.Random(2)
    size = 250_000_000
    left, right = rectangles(rng, 120, size), rectangles(rng, 120, size) + [("a", 0, size, "a", 0, size, 900), ("a", 7, 8, "b", 0, size, 901)]
    wanted = {(x[6], y[6]) for x in left for y in right if x[0] == y[0] and x[3] == y[3] and x[1] < y[2] and y[1] < x[2] and x[4] < y[5] and y[4] < x[5]}
    frame = lambda rows: spark.createDataFrame(rows, "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, i long")
    found = [(r.i, r.r_i) for r in two_d.rectangle_join(frame(left), frame(right)).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    assert two_d.rectangle_join(frame(left).limit(0), frame(right)).collect() == []


def test_the_default_scope_meets_many_points(spark):
    chroms = spark.createDataFrame([(0, "a", 250_000_000), (1, "b", 240_000_000)], "chrom_id int, chrom string, size long")
    at = (F.col("id") * 1249) % 240_000_000
    points = spark.range(100_000).select(F.lit("a").alias("chrom1"), at.alias("start1"), (at + 1).alias("end1"), F.lit("b").alias("chrom2"), (239_999_999 - at).alias("start2"), (240_000_000 - at).alias("end2"))
    assert two_d.rectangle_join(two_d.all_pairs(chroms), points).count() == 100_000


def test_short_rows_meet_in_small_bins(spark):
    """Dense short rows share a bin with few others that they don't overlap, on one axis and on two."""
    n = 20_000
    spans = spark.range(n).select(F.lit("a").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 5).alias("end"))
    rects = spans.select(F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("chrom").alias("chrom2"), F.lit(0).cast("long").alias("start2"), F.lit(9).cast("long").alias("end2"))
    assert ranges.overlap_join(spans, spans).count() == two_d.rectangle_join(rects, rects).count() == 9 * n - 20
    width = lambda length, bin_width: spark.range(1).select(ranges.level_width(ranges.level_of(F.lit(length), bin_width), bin_width).alias("w")).first().w
    assert width(5, ranges.BIN) <= 256 and width(5, two_d.CELL) <= 64
    for length in (10**3, 10**4, 10**5, 10**6):
        assert width(length, ranges.BIN) <= ranges.STEP * length
