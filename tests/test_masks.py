"""Virtual tracks under masks, distances and motif scans against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions import sequence as seq
from rangeloom.operators.tracks import Workspace

MOTIF = seq.Motif("m", ((0.7, 0.1, 0.1, 0.1), (0.1, 0.6, 0.2, 0.1), (0.2, 0.2, 0.5, 0.1)))
SIZE = 400


def unmasked(start, end, mask):
    out, at = [], start
    for s, e in sorted(mask):
        if e > at and s < end:
            if s > at:
                out.append((at, s))
            at = max(at, e)
    return out + ([(at, end)] if at < end else [])


def plain_scan(text, neutral_forward=math.log(0.25)):
    """Forward and reverse scores of each place, and those of the best."""
    logs = MOTIF.log_matrix(0.01)
    flip = logs[::-1][:, [3, 2, 1, 0, 4]]
    code = {c: i for i, c in enumerate("ACGT")}
    at = lambda m, i, n: sum(m[j][code[c]] if (c := text[i + j].upper()) in code else (m[j][4] if n is None else n) for j in range(3))
    places = range(len(text) - 2)
    return [(at(logs, i, neutral_forward), at(flip, i, None)) for i in places], [max(at(logs, i, None), at(flip, i, None)) for i in places]


@pytest.fixture(scope="module")
def text():
    rng = random.Random(3)
    return "".join(rng.choice("ACGTacgtN") for _ in range(SIZE))


@pytest.fixture(scope="module")
def space(spark, text):
    ws = Workspace(spark.createDataFrame([(0, "c", SIZE)], "chrom_id int, chrom string, size long"), bin_width=64, sequence=spark.createDataFrame([("c", k, text[k : k + 128]) for k in range(0, SIZE, 128)], "chrom string, chunk_start long, seq string"), sequence_chunk=128)
    return ws


MASK = [(20, 30), (25, 33), (90, 170), (210, 213), (220, 222), (395, 400)]


def test_masked_sequence_functions(spark, space, text):
    mask = spark.createDataFrame([("c", s, e) for s, e in MASK], "chrom string, start long, end long")
    kinds = {
        "kc": ("kmer.count", {"kmer": "AC", "strand": 1}), "kf": ("kmer.frac", {"kmer": "AC", "strand": 1}), "mc": ("masked.count", None), "mf": ("masked.frac", None), "s": ("pwm", {"motif": MOTIF}),
        "w": ("pwm", {"motif": MOTIF, "parts": "lse"}), "b": ("pwm.max", {"motif": MOTIF}), "p": ("pwm.max.pos", {"motif": MOTIF}), "n": ("pwm.count", {"motif": MOTIF, "threshold": -3.5}),
        "short": ("kmer.count", {"kmer": "AC", "strand": 1, "extend": False}),
    }
    for name, (func, params) in kinds.items():
        space.vtrack(name, None, func, params, mask=mask)
        space.vtrack_iterator(name, -5, 5)
    rows = space.evaluate({k: k for k in kinds}, iterator=40).orderBy("start").collect()
    assert [r.start for r in rows] == list(range(0, SIZE, 40))
    seen = set()
    for r in rows:
        parts = unmasked(max(0, r.start - 5), min(SIZE, r.end + 5), MASK)
        if not parts:
            assert all(r[k] is None for k in kinds)
            continue
        seen.add(len(parts))
        longer = lambda a, b, k: text[a : min(SIZE, b + k)]
        kmers = [sum(t[i : i + 2] == "AC" for i in range(len(t) - 1)) for a, b in parts for t in [longer(a, b, 1).upper()]]
        low = [sum(c.islower() for c in text[a:b]) for a, b in parts]
        lengths = [b - a for a, b in parts]
        assert r.kc == sum(kmers) and r.mc == sum(low)
        fracs = [(k / (len(longer(a, b, 1)) - 1), b - a) for k, (a, b) in zip(kmers, parts, strict=True) if len(longer(a, b, 1)) > 1]
        assert r.kf == pytest.approx(sum(f * n for f, n in fracs) / sum(n for _, n in fracs))
        assert r.mf == pytest.approx(sum(low) / sum(lengths))
        assert r.short == sum(sum(t[i : i + 2] == "AC" for i in range(len(t) - 1)) for a, b in parts for t in [text[a:b].upper()])
        scans = [(a, *plain_scan(longer(a, b, 2))) for a, b in parts if len(longer(a, b, 2)) >= 3]
        each = [np.logaddexp.reduce([x for pair in both for x in pair]) for _, both, _ in scans]
        assert r.s == pytest.approx(sum(each), abs=1e-9) and r.w == pytest.approx(np.logaddexp.reduce(each), abs=1e-9)
        best = max(x for _, _, b in scans for x in b)
        assert r.b == pytest.approx(best, abs=1e-9)
        places = {a + i + 1 - max(0, r.start - 5) for a, _, b in scans for i, x in enumerate(b) if x > best - 1e-9}
        assert abs(r.p) in places
        average = [plain_scan(longer(a, b, 2), None)[0] for a, b in parts]
        assert r.n == sum(np.logaddexp(*pair) >= -3.5 for both in average for pair in both)
    assert {1, 2, 3} & seen and max(seen) >= 2


def test_masks_count_neighbours_once_and_leave_distances_alone(spark, space):
    mask = spark.createDataFrame([("c", 45, 50), ("c", 60, 80), ("c", 70, 120)], "chrom string, start long, end long")
    source = spark.createDataFrame([("c", 41, 58, 1), ("c", 100, 110, -1), ("c", 300, 310, 0)], "chrom string, start long, end long, strand int")
    for name, func in {"n": "neighbor.count", "d": "distance", "e": "distance.edge", "c": "coverage"}.items():
        space.vtrack(name, source, func, 5 if func == "neighbor.count" else None, mask=mask)
        space.vtrack(f"{name}_open", source, func, 5 if func == "neighbor.count" else None)
    rows = {r.start: r for r in space.evaluate({x: x for n in "ndec" for x in (n, f"{n}_open")}, iterator=40).collect()}
    assert len(rows) == SIZE // 40
    assert rows[40].n == 1 and rows[80].n is None and rows[80].n_open == 1
    assert all((r.d, r.e) == (r.d_open, r.e_open) for r in rows.values()) and rows[80].d is not None
    assert rows[40].c == pytest.approx((4 + 8) / 15) and rows[80].c is None


def plain_distance(coord, intervals, margin):
    near = min(intervals, key=lambda v: (max(v[0] - coord, coord + 1 - v[1], 0), v[0], v[1]))
    s, e, strand = near
    left, right = (coord - s, coord - e) if strand == 1 else (s - coord, e - coord)
    if s <= coord < e:
        d = margin * (left + right) / (e - s)
    else:
        offset = margin if strand == 1 else -margin
        d = left - offset if abs(left) <= abs(right) else right + offset
    return d if strand else abs(d)


@pytest.mark.parametrize("parameter", [None, 0, 6])
def test_distance(spark, space, parameter):
    intervals = [(5, 17, 1), (30, 31, -1), (60, 90, 0), (200, 260, 1), (300, 330, -1)]
    source = spark.createDataFrame([("c", *v) for v in intervals], "chrom string, start long, end long, strand int")
    space.vtrack("x", source, "distance", parameter)
    for r in space.evaluate({"x": "x"}, iterator=10).collect():
        assert r.x == pytest.approx(plain_distance((r.start + r.end) // 2, intervals, (parameter or 0) / 2)), r
    bare = source.drop("strand")
    space.vtrack("x", bare, "distance", parameter)
    for r in space.evaluate({"x": "x"}, iterator=10).collect():
        assert r.x == pytest.approx(plain_distance((r.start + r.end) // 2, [(s, e, 0) for s, e, _ in intervals], (parameter or 0) / 2))


def test_distance_margin_refuses(spark, space):
    overlapping = spark.createDataFrame([("c", 5, 17), ("c", 10, 20)], "chrom string, start long, end long")
    space.vtrack("x", overlapping, "distance", 4)
    with pytest.raises(ValueError):
        space.evaluate({"x": "x"}, iterator=10)
    space.vtrack("x", overlapping, "distance", -4)
    with pytest.raises(ValueError):
        space.evaluate({"x": "x"}, iterator=10)


def test_distance_example_before_an_interval(spark, space):
    for columns, wanted in (("start long, end long", 10.0), ("start long, end long, strand int", -10.0)):
        source = spark.createDataFrame([("c", 20, 40, 1)[: 2 + len(columns.split(",")) - 1]], f"chrom string, {columns}")
        space.vtrack("x", source, "distance")
        assert space.evaluate({"x": "x"}, iterator=20).orderBy("start").first().x == wanted
    space.vtrack("x", spark.createDataFrame([("c", 3, 31)], "chrom string, start long, end long"), "distance.center")
    assert space.evaluate({"x": "x"}, iterator=20).orderBy("start").first().x == 7.0


def test_scans(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGTN-") for _ in range(rng.randrange(0, 60))) for _ in range(80)] + [None, "", "AC", "---", "A-C-G"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, s string").repartition(1)
    logs = MOTIF.log_matrix(0.01)
    for scan in (seq.Scan(), seq.Scan(5, 30), seq.Scan(5, 30, extend=True), seq.Scan(spat_factor=(1.0, 0.5, 0.1), spat_bin=7), seq.Scan(3, 50, gaps="-", spat_factor=(0.3, 2.0), spat_bin=4), seq.Scan(gaps="-")):
        for neutral in ("average", "log_quarter", "forward_quarter", "na"):
            made = df.select("i", *(seq.pwm(F.col("s"), MOTIF, m, threshold=-3.0, neutral=neutral, per_strand=True, scan=scan).alias("hits" if m == "count" else m) for m in ("lse", "max", "pos", "count"))).collect()
            forward, backward = seq.strand_logs(logs, neutral)
            for r in made:
                text = texts[r.i]
                if text is None:
                    assert r.lse is None
                    continue
                pad = 2 if scan.extend else 0
                low, high = max(0, (scan.start_pos or 1) - 1 - pad), min(len(text), (scan.end_pos or len(text)) + pad)
                at = [k for k in range(low, high) if text[k] not in scan.gaps] if scan.gaps else list(range(low, high))
                found = []
                for k in range(len(at) - 2):
                    codes = ["ACGT".index(text[x]) if text[x] in "ACGT" else 4 for x in at[k : k + 3]]
                    w = math.log(scan.spat_factor[max(0, min((at[k] + 1 - (scan.start_pos or 1)) // scan.spat_bin, len(scan.spat_factor) - 1))]) if scan.spat_factor else 0.0
                    found.append((at[k] + 1, *(sum(m[j][c] for j, c in enumerate(codes)) + w for m in (forward, backward))))
                if not found:
                    assert (r.lse, r.max, r.pos, r.hits) == (None, None, None, 0.0)
                elif any(math.isnan(x) for f in found for x in f):
                    assert neutral == "na" and r.lse is None
                else:
                    assert r.lse == pytest.approx(np.logaddexp.reduce([x for _, a, b in found for x in (a, b)]), abs=1e-9)
                    best = max(max(a, b) for _, a, b in found)
                    assert r.max == pytest.approx(best, abs=1e-9)
                    assert r.pos in {s * p for p, a, b in found for s, x in ((1, a), (-1, b)) if x > best - 1e-9}
                    assert r.hits == sum((a >= -3.0) + (b >= -3.0) for _, a, b in found)
