"""Two-dimensional expressions, matrices, sequence windows, masks and the catalog's tracks, with hand results."""

import math

import pytest
from pyspark.sql import functions as F

from rangeloom.functions import sequence as seq
from rangeloom.operators import expressions_2d as e2
from rangeloom.operators import matrices as mx
from rangeloom.operators import synthesis as sy
from rangeloom.operators.tracks import Workspace
from rangeloom.plans.catalog import Database
from rangeloom.sources import formats as fm

CHROMS = [(1, "a", 1000), (2, "b", 500)]
IV = "chrom string, start long, end long"
RECT = "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, value double"


@pytest.fixture(scope="module")
def chroms(spark):
    return spark.createDataFrame(CHROMS, "chrom_id int, chrom string, size long")


def test_masked_windows_weigh_parts(spark, chroms):
    ws = Workspace(chroms)
    ws.dense("t", spark.createDataFrame([("a", 0, 1.0), ("a", 1, 5.0)], "chrom string, bin long, value double"), 10)
    mask = spark.createDataFrame([("a", 4, 6)], IV)
    for name, func in {"m": "avg", "s": "sum", "n": "size", "hi": "max"}.items():
        ws.vtrack(name, "t", func, mask=mask)
    row = ws.evaluate({k: k for k in "msn"} | {"hi": "hi"}, iterator=spark.createDataFrame([("a", 0, 20)], IV)).first()
    # parts [0, 4) with 1.0 and [6, 20) with 1.0 and 5.0
    assert row.m == pytest.approx((4 * 1.0 + 14 * 3.0) / 18) and row.s == 7.0 and row.n == 3 and row.hi == 5.0


def test_sequence_windows_samples_and_percentiles(spark, chroms):
    letters = ("ACGTNacgta" * 100, "TTTTT" * 100)
    ws = Workspace(chroms, sequence=spark.createDataFrame([("a", 0, letters[0]), ("b", 0, letters[1])], "chrom string, chunk_start long, seq string"))
    ws.vtrack("k", None, "kmer.count", {"kmer": "ACG", "strand": 1})
    ws.vtrack("m", None, "masked.count")
    ws.vtrack("p", None, "pwm.max", {"motif": seq.Motif("x", ((0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0))), "bidirect": False, "prior": 0.0001})
    ws.dense("t", spark.createDataFrame([("a", i, float(i % 3)) for i in range(100)], "chrom string, bin long, value double"), 10)
    ws.vtrack("g", "t", "global.percentile")
    ws.vtrack("v", "t", "sample", 3)
    ws.vtrack("at", "t", "sample.pos.abs", 3)
    ws.vtrack("one", "t", "exists", [1.0, 7.0])
    rows = ws.evaluate({x: x for x in ("k", "m", "p", "g", "v", "at", "one")}, iterator=10).where("chrom = 'a'").orderBy("start").collect()
    assert rows[0].k == 2 and rows[0].m == 5 and rows[0].p == pytest.approx(2 * math.log(1.0001 / 1.0004))
    assert [round(r.g, 2) for r in rows[:3]] == [0.34, 0.67, 1.0] and [r.one for r in rows[:3]] == [0, 1, 0]
    assert all(r.v == (r.start // 10) % 3 and r["at"] == r.start for r in rows)


def test_expressions_2d(spark, chroms):
    ws = e2.Workspace2D(chroms, bin_width=64)
    ws.track("r", spark.createDataFrame([("a", 100, 300, "a", 120, 200, 10.0), ("a", 400, 490, "a", 180, 500, 20.0)], RECT))
    ws.vtrack("area", "r", "area")
    whole = spark.createDataFrame([("a", 0, 1000, "a", 0, 1000)], RECT.rsplit(",", 1)[0])
    row = ws.evaluate({"v": "r", "area": "area"}, iterator=whole).first()
    assert row.v == pytest.approx((16000 * 10 + 28800 * 20) / 44800) and row["area"] == 44800
    banded = ws.evaluate({"v": "r"}, iterator=whole, band=(150, 1000)).first()
    assert banded.v == pytest.approx(19.57182, abs=1e-4)
    cells = ws.evaluate({"v": "r"}, iterator=(500, 500)).where("v IS NOT NULL").collect()
    assert len(cells) == 1 and cells[0].v == pytest.approx(row.v)
    assert ws.evaluate({"v": "r + 1"}, iterator="r").orderBy("start1").select("v").collect() == [(11.0,), (21.0,)]
    ws.vtrack_iterator("area", sshift1=-1000, eshift1=1000)
    near = spark.createDataFrame([("a", 900, 910, "a", 100, 190)], RECT.rsplit(",", 1)[0])
    assert ws.evaluate({"x": "area"}, iterator=near).first().x == 200 * 70 + 90 * 10
    assert ws.screen("r > 15", iterator="r").count() == 1 and ws.summary("r", iterator="r").first()["sum"] == 30.0
    assert [r.value for r in ws.quantiles("r", [0.0, 0.5], iterator="r").collect()] == [10.0, 15.0]
    pairs = e2.neighbors_2d(ws.tracks["r"].where("value < 15"), ws.tracks["r"].where("value > 15"), 0, 100, 0, 5, 64).collect()
    assert [(p.dist1, p.dist2) for p in pairs] == [(100, 0)]
    made = e2.rectangles(spark, chroms, [("b", 0, -1, "a", 5, 9)]).first()
    assert (made.end1, made.end2) == (500, 9)


def test_matrices(spark):
    df = spark.createDataFrame([("a_1", 100, 200, 1, 1.5, 10), ("b", 5, 7, 2, 2.5, 20)], IV + ", intervalID long, t1 double, t2 int")
    m = mx.to_matrix(df)
    assert m.names == ("t1", "t2") and m.data.first().label == "a_1:100-200"
    both = mx.bind_rows(m.where("start < 50"), m.where("start > 50")).select(["t2"]).apply(lambda x: x * 2)
    assert {tuple(r) for r in mx.from_matrix(both).collect()} == {("b", 5, 7, 2, 40.0), ("a_1", 100, 200, 1, 20.0)}
    with pytest.raises(ValueError):
        mx.to_matrix(df.withColumn("s", F.lit("x")))


def test_model_bins_and_transplants(spark):
    breaks = [0.0, 0.25, 0.5, 0.75, 1.0]
    assert sy.bin_map(breaks, [(0.5, (0.25, 0.5)), ((-1, 0.25), (0.25, 0.5))]) == {1: 2, 2: 2, 3: 2, 4: 2}
    assert sy.cell_merge([breaks, breaks], [([0.9, 0.1], [0.3, 0.3])]) == [{"from_1": 4, "from_2": 1, "to_1": 2, "to_2": 2, "source_flat": 4, "target_flat": 6}]
    assert sy.cell_merge([breaks], [([0.5], [1.0])]) == [{"from_1": 3, "to_1": 4, "source_flat": 3, "target_flat": 4}]
    t, s = (spark.createDataFrame([("a", 0, x * 20)], "chrom string, chunk_start long, seq string") for x in "AT")
    got = sy.transplant(spark.createDataFrame([("a", 3, 6)], IV), s, t).first()
    assert got.seq == "AAATTT" + "A" * 14


def test_catalog_tracks(spark, chroms, tmp_path):
    letters = spark.createDataFrame([("a", 0, "ACGT" * 250), ("b", 0, "CCCC" * 125)], "chrom string, chunk_start long, seq string")
    db = Database.create(spark, str(tmp_path / "db"), chroms, letters)
    (tmp_path / "x.bg").write_text("a\t0\t10\t1\na\t10\t30\t4\n")
    db.import_track("x", str(tmp_path / "x.bg"))
    db.import_track("y", str(tmp_path / "x.bg"), bin_size=20)
    assert {(r.chrom, r.bin, r.value) for r in db.table("track", "y").collect()} == {("a", 0, 2.5), ("a", 1, 4.0)}
    assert db.import_set({"u.z": str(tmp_path / "x.bg"), "w": str(tmp_path / "none.bg")})["u.z"] is None and db.exists("track", "u.z") and not db.exists("track", "w")
    db.create_track("twice", "y * 2", 20)
    assert {r.value for r in db.table("track", "twice").collect()} == {5.0, 8.0}
    db.create_pwm_energy("e", seq.Motif("m", ((0.0, 1.0, 0.0, 0.0),)), 500)
    assert db.table("track", "e").count() == 3
    (tmp_path / "arr.tsv").write_text("chrom\tstart\tend\tp\tq\na\t1\t2\t0.5\t7\n")
    db.import_array("arr", str(tmp_path / "arr.tsv"))
    db.set_array_columns("arr", ["r", "s"])
    assert db.array_columns("arr") == ["r", "s"] and db.table("track", "arr").first().value == [0.5, 7.0]
    db.make_dir("empty.one")
    assert db.dirs() == ["empty", "empty.one", "u"]
    with pytest.raises(ValueError):
        db.remove_dir("u")
    db.remove_dir("u", force=True)
    copy = db.save_dataset(str(tmp_path / "set"), ["x"])
    other = Database.create(spark, str(tmp_path / "other"), chroms)
    other.attach(copy)
    assert other.datasets() == [other.path, copy.path] and other.table("track", "x").count() == 2
    db.rm("track", "x")
    assert not db.exists("track", "x") and not (tmp_path / "db/tracks/x/data").exists()
    other.unload()
    assert other.datasets() == [other.path]


def test_genes(spark, tmp_path):
    (tmp_path / "g.txt").write_text("g1\ta\t+\t100\t500\t150\t400\t2\t100,300,\t200,500,\nx\ty\ng2\ta\t-\t450\t600\t460\t600\t1\t450,\t600,\n".replace("x\ty\n", ""))
    (tmp_path / "n.txt").write_text("g1\tone\ng2\ttwo\n")
    got = {k: sorted(map(tuple, v.collect())) for k, v in fm.read_genes(spark, str(tmp_path / "g.txt"), str(tmp_path / "n.txt"), ["name"]).items()}
    assert got["tss"] == [("a", 100, 101, 1, "one"), ("a", 599, 600, -1, "two")]
    assert got["exons"] == [("a", 100, 200, 1, "one"), ("a", 300, 600, 0, "one;two")]
    assert got["utr5"] == [("a", 100, 150, 1, "one")] and got["utr3"] == [("a", 400, 500, 0, "one;two")]
