"""Interval algebra against plain versions on random sets, and hand results."""

import random

import pytest
from pyspark.sql import functions as F

from rangeloom.operators import intervals as iv
from rangeloom.operators import nearest as nn
from rangeloom.operators.ranges import overlap_join, running

SCHEMA = "chrom string, start long, end long, strand int"


def draw(rng, n, size=3000, longest=60):
    out = []
    for _ in range(n):
        s = rng.randrange(size - longest)
        out.append((rng.choice("ab"), s, s + rng.randrange(1, longest), rng.choice([-1, 0, 1])))
    return out


def positions(rows):
    return {(c, p) for c, s, e, *_ in rows for p in range(s, e)}


def rows_of(df):
    return sorted((r.chrom, r.start, r.end) for r in df.collect())


@pytest.fixture(scope="module")
def sets(spark):
    rng = random.Random(1)
    a, b = draw(rng, 70), draw(rng, 60)
    return a, b, spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


def check_disjoint(rows):
    for (c, _, e), (c2, s2, _) in zip(rows, rows[1:]):
        assert c != c2 or e < s2


def test_algebra(sets):
    a, b, da, db = sets
    pa, pb = positions(a), positions(b)
    for made, want in ((iv.canonic(da, tile=64), pa), (iv.union(da, db), pa | pb), (iv.intersect(da, db, 128), pa & pb), (iv.difference(da, db, 64), pa - pb)):
        rows = rows_of(made)
        assert positions(rows) == want and sum(e - s for _, s, e in rows) == len(want)
    check_disjoint(rows_of(iv.union(da, db)))
    assert iv.covered(da).first().covered == len(pa)
    assert iv.coverage_fraction(da, db).first().fraction == pytest.approx(len(pa & pb) / len(pb))


def test_canonic_hand_result(spark):
    df = spark.createDataFrame([("1", 11000, 12000), ("1", 100, 200), ("1", 10000, 13000), ("1", 10500, 10600)], "chrom string, start long, end long")
    assert rows_of(iv.canonic(df)) == [("1", 100, 200), ("1", 10000, 13000)]
    assert {r.start: r.mapping for r in iv.canonic_mapping(df).collect()} == {11000: 2, 100: 1, 10000: 2, 10500: 2}
    touching = spark.createDataFrame([("1", 0, 5), ("1", 5, 9)], "chrom string, start long, end long")
    assert iv.canonic(touching).count() == 1 and iv.canonic(touching, touching=False).count() == 2
    assert iv.canonic(df.limit(0)).count() == 0 and iv.difference(df, df).count() == 0


def test_overlap_join(sets):
    a, b, da, db = sets
    want = sorted((x[:3], y[1:3]) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    for width in (16, 1000):
        got = sorted(((r.chrom, r.start, r.end), (r.start1, r.end1)) for r in overlap_join(da, db, width).collect())
        assert got == want
    lonely = [x for x in a if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b)]
    assert overlap_join(da, db, 64, "left_anti").count() == len(lonely)
    assert overlap_join(da, db, 64, "left").count() == len(want) + len(lonely)


def test_running_over_tiles(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), s, rng.choice([None, 1, 5, 2])) for s in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "chrom string, start long, v int")
    for kind, fold in (("sum", sum), ("max", max), ("count", len), ("last", lambda x: x[-1])):
        for r in running(df, kind, F.col("v"), "out", [F.col("start")], tile=50).collect():
            seen = [v for c, s, v in rows if c == r.chrom and s < r.start and v is not None]
            want = fold(seen) if seen else (0 if kind in ("sum", "count") else None)
            assert r.out == want


def plain_neighbors(a, b, k, lo, hi):
    out = []
    for q in a:
        found = []
        for t in b:
            if q[0] != t[0]:
                continue
            gap = max(t[1] - q[2], q[1] - t[2], 0)
            d = gap if t[3] == 0 else gap * t[3] * (-1 if q[2] <= t[1] else 1)
            if lo <= d <= hi:
                found.append((abs(d), t[1], t[2], t[3], d))
        out += [(q, *f[1:]) for f in sorted(found)[:k]]
    return sorted(out)


@pytest.mark.parametrize("k, lo, hi", [(1, -(10**9), 10**9), (4, -(10**9), 10**9), (2, -200, -5)])
def test_neighbors(sets, k, lo, hi):
    a, b, da, db = sets
    got = sorted(((r.chrom, r.start, r.end, r.strand), r.start1, r.end1, r.strand1, r.dist) for r in nn.neighbors(da, db, k, lo, hi, bin_width=32).collect())
    assert got == plain_neighbors(a, b, k, lo, hi)


def test_annotate_and_strands(spark):
    q = spark.createDataFrame([("a", 100, 110, 1), ("a", 500, 510, -1), ("b", 5, 6, 1)], SCHEMA)
    t = spark.createDataFrame([("a", 200, 210, "x"), ("a", 420, 430, "y")], "chrom string, start long, end long, name string")
    got = {r.start: (r.name, r.dist) for r in nn.annotate(q, t, ["name"], 80).collect()}
    assert got == {100: (None, 90), 500: ("y", 70), 5: (None, None)}
    assert {(r.start, r.name1, r.dist) for r in nn.downstream(q, t).collect()} == {(100, "x", 90), (500, "y", 70)}


def test_clipping_and_strings(spark):
    chroms = spark.createDataFrame([(0, "a", 1000), (1, "b", 500)], "chrom_id int, chrom string, size long")
    made = iv.intervals(spark, chroms, ["b", "a"], [0, 10], [-1, 20])
    assert rows_of(made) == [("a", 10, 20), ("b", 0, 500)]
    with pytest.raises(Exception, match="bad interval"):
        iv.intervals(spark, chroms, ["a"], [10], [5]).collect()
    odd = spark.createDataFrame([("a", -5, 10), ("a", 990, 1200), ("b", 600, 700), ("z", 1, 2)], "chrom string, start long, end long")
    assert rows_of(iv.force_range(odd, chroms)) == [("a", 0, 10), ("a", 990, 1000)]
    assert rows_of(iv.normalize(spark.createDataFrame([("a", 100, 120)], "chrom string, start long, end long"), 50, chroms)) == [("a", 85, 135)]
    parsed = iv.from_strings(spark.createDataFrame([("a:1,000-2,000",), ("nonsense",)], "region string")).collect()
    assert [(r.start, r.end) for r in parsed] == [(1000, 2000), (None, None)]
    free = iv.random_intervals(spark, chroms, 10, 200, 20, spark.createDataFrame([("a", 100, 900)], "chrom string, start long, end long"))
    for r in free.collect():
        size = {"a": 1000, "b": 500}[r.chrom]
        assert r.end - r.start == 10 and 20 <= r.start and r.end <= size - 20 and (r.chrom == "b" or r.end <= 100 or r.start >= 900)
    assert free.count() == 200
