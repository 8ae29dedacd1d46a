"""Windows of a dense track put together from blocks, against plain sums; types of created tracks."""

import math
import random

import pytest

from rangeloom.operators import tracks as tr
from rangeloom.plans.catalog import Database


@pytest.mark.parametrize("least", [2, 64])
def test_wide_windows(spark, monkeypatch, least):
    monkeypatch.setattr(tr, "FOLD_LEAST", least)
    rng = random.Random(1)
    sizes = {"a": 9003, "b": 47}
    bins = {(c, i): rng.choice([rng.gauss(0, 3), None, float("nan")]) if rng.random() < 0.3 else rng.gauss(0, 3) for c, n in sizes.items() for i in range(-(-n // 10))}
    ws = tr.Workspace(spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(sizes.items())], "chrom_id int, chrom string, size long"))
    ws.dense("t", spark.createDataFrame([(c, i, v) for (c, i), v in bins.items()], "chrom string, bin long, value double"), 10)
    kinds = ["avg", "sum", "size", "min", "max", "exists", "lse", "stddev", "first"]
    for k in kinds:
        ws.vtrack(k, "t", k, sshift=-2605, eshift=1711)
    rows = ws.evaluate({k: f"`{k}`" for k in kinds}, iterator=35).collect()
    assert len(rows) == sum(-(-n // 35) for n in sizes.values())
    for r in rows:
        low, high = max(0, r.start - 2605), min(sizes[r.chrom], r.end + 1711)
        v = [x for i in range(low // 10, -(-high // 10)) if (x := bins.get((r.chrom, i))) is not None and not math.isnan(x)]
        assert (r.size, r.exists, r.min, r.max) == (len(v), 1, min(v), max(v))
        assert r.sum == pytest.approx(sum(v), abs=1e-6) and r.avg == pytest.approx(sum(v) / len(v), abs=1e-8)
        assert r.lse == pytest.approx(math.log(sum(map(math.exp, v)))) and r.first == v[0]


def test_created_tracks_keep_their_iterator(spark, tmp_path):
    db = Database.create(spark, str(tmp_path / "db"), spark.createDataFrame([(0, "a", 40)], "chrom_id int, chrom string, size long"))
    db.save_dense("p", spark.createDataFrame([("a", i, float(i)) for i in range(4)], "chrom string, bin long, value double"), 10)
    db.save_sparse("s", spark.createDataFrame([("a", 3, 8, 1.0)], "chrom string, start long, end long, value double"))
    for name, expr, iterator, kind in (("q", "p * 2", None, "dense"), ("r", "p * 2", "p", "dense"), ("t", "p + 1", 20, "dense"), ("u", "s * 3", None, "sparse"), ("v", "p", "s", "sparse")):
        db.create_track(name, expr, iterator)
        assert db.track_info(name)["type"] == kind, name
    assert sorted((r.bin, r.value) for r in db.table("track", "q").collect()) == [(0, 0.0), (1, 2.0), (2, 4.0), (3, 6.0)]
