"""Tracks, windows and folds on small tables with hand results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import sequence as seq
from rangeloom.functions.binning import bin_index, locate
from rangeloom.operators import aggregates as agg
from rangeloom.operators import iterators as it
from rangeloom.operators import liftover as lo
from rangeloom.operators import segmentation as sg
from rangeloom.operators import synthesis as sy
from rangeloom.operators import tracks as tr
from rangeloom.operators import two_d as td

IV = "chrom string, start long, end long"


@pytest.fixture(scope="module")
def ws(spark):
    chroms = spark.createDataFrame([(0, "a", 95), (1, "b", 40)], "chrom_id int, chrom string, size long")
    made = tr.Workspace(chroms, bin_width=16)
    values = [1.0, 2.0, float("nan"), 4.0, 5.0, 6.0, 7.0, 8.0, None, 10.0]
    made.dense("d", spark.createDataFrame([("a", i, v) for i, v in enumerate(values)] + [("b", 0, 3.0)], "chrom string, bin long, value double"), 10)
    made.sparse("s", spark.createDataFrame([("a", 5, 12, 1.0), ("a", 12, 14, 3.0), ("a", 60, 61, 9.0)], IV + ", value double"))
    return made


def test_iterators(spark, ws):
    scope = spark.createDataFrame([("a", 15, 42)], IV)
    bins = [(r.start, r.end) for r in it.fixed_bins(scope, 10).orderBy("start").collect()]
    assert bins == [(15, 20), (20, 30), (30, 40), (40, 42)]
    assert [(r.start, r.end) for r in it.relative_bins(scope, 10).orderBy("start").collect()] == [(15, 25), (25, 35), (35, 42)]
    assert it.relative_bins(scope, 10, "drop").count() == 2
    with pytest.raises(Exception, match="whole number"):
        it.relative_bins(scope, 10, "exact").collect()


def test_extract_and_screen(spark, ws):
    rows = {(r.chrom, r.start): (r.end, r.v, r.w) for r in agg.extract(ws, {"v": "d", "w": "d * 2 + 1"}).collect()}
    assert rows["a", 0] == (10, 1.0, 3.0) and rows["a", 20] == (30, None, None) and rows["a", 90] == (95, 10.0, 21.0) and rows["b", 30] == (40, None, None)
    hits = [(r.chrom, r.start, r.end) for r in agg.screen(ws, "d >= 2").orderBy("chrom", "start").collect()]
    assert hits == [("a", 10, 20), ("a", 30, 80), ("a", 90, 95), ("b", 0, 10)]
    parts = [(r.start, r.end, r.bin) for r in agg.partition(ws, "d", [0, 2, 6, 100], spark.createDataFrame([("a", 0, 95)], IV)).orderBy("start").collect()]
    assert parts == [(0, 20, 1), (30, 60, 2), (60, 80, 3), (90, 95, 3)]


def test_windows(spark, ws):
    for name, func, params in (("avg", "avg", None), ("q", "quantile", 0.5), ("lse", "lse", None), ("n", "size", None), ("e", "exists", None), ("pos", "max.pos.relative", None)):
        ws.vtrack(f"v_{name}", "d", func, params, -10, 10)
    row = agg.extract(ws, {k: f"v_{k}" for k in ("avg", "q", "lse", "n", "e", "pos")}, spark.createDataFrame([("a", 20, 30)], IV), 10).first()
    assert (row.avg, row.q, row.n, row.e, row.pos) == (3.0, 3.0, 2, 1, 20) and row.lse == pytest.approx(math.log(math.exp(2) + math.exp(4)))
    ws.vtrack("near", "s", "nearest")
    got = {r.start: r.near for r in agg.extract(ws, {"near": "near"}, spark.createDataFrame([("a", 0, 95)], IV), 10).collect()}
    assert got[0] == 1.0 and got[10] == 2.0 and got[20] == 3.0 and got[50] == 9.0
    ws.vtrack("masked", "d", "sum", mask=spark.createDataFrame([("a", 10, 95)], IV))
    got = {r.start: r.m for r in agg.extract(ws, {"m": "masked"}, spark.createDataFrame([("a", 0, 30)], IV), 15).collect()}
    assert got == {0: 1.0, 15: None}
    assert "masked" in ws.vtrack_ls("mask")
    ws.vtrack_rm("masked")
    assert "masked" not in ws.virtual


def test_folds(spark, ws):
    s = agg.summary(ws, "d").first()
    assert (s.n, s.n_missing, s.min, s.max, s.sum) == (14, 5, 1.0, 10.0, 46.0)
    assert [r.value for r in agg.quantiles(ws, "d", [0.0, 0.5, 1.0]).orderBy("percentile").collect()] == [1.0, 5.0, 10.0]
    d = {r.bin1: (r.range1, r.n) for r in agg.distribution(ws, [("d", [0, 2, 20, 30])]).collect()}
    assert d == {0: ("(0,2]", 2), 1: ("(2,20]", 7), 2: ("(20,30]", 0)}
    two = {r.pair: r for r in agg.correlation(ws, [("d", "d"), ("d", "CASE WHEN d > 2 THEN -d END")]).collect()}
    assert two[1].cor == pytest.approx(1) and two[2].n == two[1].n and two[2].n_missing > two[1].n_missing
    both = {r.pair: r for r in agg.correlation(ws, [("d", "d"), ("d", "-d")], method="spearman").collect()}
    assert both[1].cor == pytest.approx(1) and both[2].cor == pytest.approx(-1) and both[1].n_missing == both[2].n_missing == two[1].n_missing
    c = agg.correlation(ws, [("d", "d * d")], method="spearman").first()
    assert c.cor == pytest.approx(1.0) and c.n_missing == 5
    per = agg.interval_summary(ws, "d", spark.createDataFrame([("a", 0, 20), ("b", 20, 40)], IV)).orderBy("chrom").collect()
    assert [(r.n, r.n_missing, r.sum) for r in per] == [(2, 0, 3.0), (2, 2, None)]
    made = agg.interval_apply(ws, lambda v: v[0], {"v": "d"}, spark.createDataFrame([("a", 0, 20, -1)], IV + ", strand int")).first()
    assert made.value == 2.0


def test_binning(spark):
    breaks = [0.0, 1.0, 2.5, 7.0]
    values = [-1.0, 0.0, 0.5, 1.0, 1.1, 7.0, 7.1, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for low in (False, True):
        got = [r[0] for r in df.select(bin_index(F.col("v"), breaks, low)).collect()]
        assert got == [locate(v, breaks, low) for v in values]
    assert [r[0] for r in df.select(bin_index(F.col("v"), breaks, force=True)).collect()] == [0, 0, 0, 0, 1, 2, 2, None, None]


def test_dense_and_smooth(spark, ws):
    data = spark.createDataFrame([("a", 5, 15, 2.0), ("a", 12, 20, 8.0)], IV + ", value double")
    make = lambda f, **k: {r.bin: r.value for r in tr.create_dense(data, ws.chroms, 10, f, **k).collect()}
    assert make("weighted.mean") == {0: 2.0, 1: (5 * 2 + 8 * 8) / 13} and make("coverage") == {0: 0.5, 1: 1.0} and make("median") == {0: 2.0, 1: 8.0} and make("count") == {0: 1.0, 1: 2.0}
    assert len(make("max", default=0.0)) == 14 or make("max", default=0.0)[3] == 0.0
    with pytest.raises(Exception, match="overlapping"):
        tr.create_sparse(data).collect()
    dense = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 5.0, None, 3.0])], "chrom string, bin long, value double")
    got = {r.bin: r.value for r in tr.smooth(dense, 10, 20).collect()}
    assert got == {0: (2 * 1 + 5) / 3, 1: (2 * 5 + 1) / 3, 3: 3.0}
    reads = spark.createDataFrame([("a", 10, 1, 5), ("a", 10, 1, 5), ("a", 30, -1, 5)], "chrom string, pos long, strand int, length int")
    assert {(r.start, r.value) for r in tr.mapped_reads(reads, ws.chroms).collect()} == {(10, 1.0), (34, 1.0)}


def test_rectangles(spark):
    schema = "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long"
    objects = spark.createDataFrame([("a", 100, 300, "a", 120, 200, 10.0), ("a", 400, 490, "a", 180, 500, 20.0)], schema + ", value double")
    cell = spark.createDataFrame([("a", 0, 500, "a", 0, 500)], schema)
    row = td.area_summary(cell, objects, bin_width=64).first()
    area = [200 * 80, 90 * 320]
    assert row.avg == pytest.approx((10 * area[0] + 20 * area[1]) / sum(area))
    inside = lambda x, y, d1, d2: d1 <= x - y < d2
    for d1, d2 in ((150, 1000), (-50, 60), (0, 1)):
        count = [sum(inside(x, y, d1, d2) for x in range(s1, e1) for y in range(s2, e2)) for s1, e1, s2, e2 in ((100, 300, 120, 200), (400, 490, 180, 500))]
        made = td.area_summary(cell, objects, band=(d1, d2), bin_width=64).first()
        assert (made.area or 0) == sum(count)
        clipped = td.band_clip(objects, d1, d2).count()
        assert clipped == sum(c > 0 for c in count)
    contacts = spark.createDataFrame([("a", 10, 12, "a", 50, 52, 1.0), ("a", 50, 52, "a", 10, 12, 2.0), ("a", 5, 6, "a", 5, 6, 4.0)], schema + ", value double")
    assert {(r.start1, r.start2, r.value) for r in td.import_contacts(contacts).collect()} == {(11, 51, 3.0), (51, 11, 3.0), (5, 5, 4.0)}
    grid = td.cartesian_grid(spark.createDataFrame([("a", 100, 100 + 2), ("a", 150, 152)], IV), [-20, 0, 20], min_band=0, max_band=1)
    assert grid.count() == 12 and grid.where("start1 < 81 OR end1 > 171").count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([("ACGTacgtNN",), ("AC",), (None,)], "s string")
    s = F.col("s")
    got = df.select(seq.reverse_complement(s), seq.kmer_count(s, "CG"), seq.masked_count(s), seq.kmers(s, 2)).collect()
    assert got[0][0] == "NNacgtACGT" and got[0][1] == 4 and got[0][2] == 4 and got[0][3] == ["AC", "CG", "GT", "TA", "AC", "CG", "GT"] and got[1][3] == ["AC"]
    motif = seq.Motif("m", ((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0)))
    logs = motif.log_matrix()
    row = spark.createDataFrame([("TTAC",)], "s string").select(seq.pwm(s, motif, "max").alias("m"), seq.pwm(s, motif, "pos").alias("p"), seq.pwm(s, motif, "lse", bidirect=False).alias("l"), seq.pwm_edits(s, motif, logs[0][0] * 2).alias("e")).first()
    assert row.m == pytest.approx(2 * logs[0][0]) and row.p == 3 and row.e == 0
    assert row.l == pytest.approx(math.log(sum(math.exp(x) for x in seq.anchor_scores("TTAC", logs))))


def test_models(spark):
    df = spark.createDataFrame([("ACGTACGTAC",)], "seq string")
    model = sy.train(df, 1, both_strands=False)
    p = {(r.context, r.base): (r.n, r.p) for r in model.collect()}
    assert p["A", "C"] == (3, 4 / 7) and p["C", "A"] == (0, 1 / 6) and len(p) == 16
    never = sy.forbid(model, "AC")
    made = sy.sample(never, spark.range(5).withColumn("length", F.lit(300)), seed=2).collect()
    assert all(len(r.seq) == 300 and "AC" not in r.seq for r in made)
    scored = sy.score(model, df, 5).orderBy("bin").collect()
    assert scored[0].value is None and scored[1].value == pytest.approx(math.log(p["A", "C"][1]) * 2 + math.log(p["C", "G"][1]) + math.log(p["G", "T"][1]) + math.log(p["T", "A"][1]))
    assert sy.replace_kmer(df, "ACG", "GCA").first().seq.count("ACG") == 0


def test_liftover(spark):
    schema = "chrom string, start long, end long, strand int, chromsrc string, startsrc long, endsrc long, strandsrc int, chain_id long, score double"
    chain = spark.createDataFrame([("n", 1000, 1100, 1, "o", 0, 100, 1, 1, 5.0), ("n", 2000, 2050, -1, "o", 200, 250, 1, 2, 9.0)], schema)
    rows = spark.createDataFrame([("o", 90, 210), ("o", 120, 130)], IV)
    got = sorted((r.start, r.end, r.intervalID) for r in lo.liftover(rows, lo.as_chain(chain)).collect())
    assert got == [(1090, 1100, 1), (2040, 2050, 1)]
    clash = spark.createDataFrame([("n", 0, 100, 1, "o", 0, 100, 1, 1, 5.0), ("n", 50, 150, 1, "o", 500, 600, 1, 2, 9.0)], schema)
    kept = sorted((r.start, r.end, r.startsrc, r.chain_id) for r in lo.target_policy(clash, "auto").collect())
    assert kept == [(0, 50, 0, 1), (50, 100, 500, 2), (100, 150, 550, 2)]
    assert lo.target_policy(clash, "discard").count() == 0
    with pytest.raises(ValueError):
        lo.target_policy(clash, "error")
    track = spark.createDataFrame([("o", 0, 100, 2.0), ("o", 500, 600, 6.0)], IV + ", value double")
    lifted = {(r.start, r.end): r.value for r in lo.lift_track(track, clash).collect()}
    assert lifted == {(0, 50): 2.0, (50, 100): 4.0, (100, 150): 6.0}


def brute_z(large, small, way):
    n, m = len(large), len(small)
    if min(n, m) < 10:
        return 1.0
    u = sum((x > y) + 0.5 * (x == y) for x in large for y in small)
    mean = n * m / 2
    if (way > 0 and u >= mean) or (way < 0 and u <= mean):
        return 0.0
    return (min(u, n * m - u) - mean) / (n * m * (n + m + 1) / 12) ** 0.5


def test_segments(spark):
    rows = [("a", i, float(i % 5 + (50 if 40 <= i < 80 or i >= 120 else 0))) for i in range(160)]
    bins = spark.createDataFrame(rows, "chrom string, bin long, value double")
    cuts = [(r.start, r.end) for r in sg.segment(bins, 10, 100, 0.001).orderBy("start").collect()]
    assert cuts[0][0] == 0 and cuts[-1] == (800, 1600) and cuts[1] == (400, 800)
    assert sg.sliding_wilcoxon(bins, 10, 100, 600, 0.05).count() >= 1
    for run in (lambda: sg.sliding_wilcoxon(bins, 10, 40, 600), lambda: sg.segment(bins, 10, 90)):
        with pytest.raises(ValueError):
            run()


def test_sliding_wilcoxon_against_brute_force(spark):
    rng = random.Random(4)
    values = {i: float(rng.randrange(6) + (4 if 60 <= i < 90 else 0)) for i in range(200) if rng.random() < 0.9}
    bins = spark.createDataFrame([("a", i, v) for i, v in values.items()], "chrom string, bin long, value double")
    for way in (1, -1, 0):
        bound, spans = sg._z_bound(0.02, True), []
        for i in sorted(values):
            window = lambda h, c=i: [values[j] for j in range(c - h, c + h + 1) if j in values]
            if brute_z(window(30), window(6), way) <= bound:
                start, end = max(0, (i - 6) * 10), (i + 7) * 10
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = end
                else:
                    spans.append([start, end])
        for tile in (16, 4096):
            got = sg.sliding_wilcoxon(bins, 10, 120, 600, 0.02, find=way, tile_bins=tile).orderBy("start").collect()
            assert [[r.start, r.end] for r in got] == spans and all(0 <= r.pval <= 0.02 for r in got)


def test_segment_ends_against_brute_force():
    rng = random.Random(5)
    for size in (10, 13):
        values = [float(rng.randrange(5) + 5 * (i // 37 % 2)) for i in range(260)]
        bound, ends, first = sg._z_bound(0.01, True), [], 0
        while True:
            z = {i: brute_z(values[first:i], values[i : i + size], 0) for i in range(first + size, len(values) - size + 1)}
            hit = next((i for i in sorted(z) if z[i] <= bound), None)
            if hit is None or hit + size - 1 not in z:
                break
            first = min(range(hit, hit + size), key=lambda i: (z[i], i))
            ends.append(first)
        assert len(ends) > 2 and sg._segments(values, size, bound) == ends
