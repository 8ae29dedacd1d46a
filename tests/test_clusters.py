"""Groups of converted pieces and neighbours in two dimensions against plain versions."""

import random

import pytest

from rangeloom.operators import expressions_2d as e2
from rangeloom.operators import liftover as lo
from rangeloom.operators.components import connected_components

CHAIN = "chrom string, start long, end long, strand int, chromsrc string, startsrc long, endsrc long, strandsrc int, chain_id long, score double"


def plain_best(pieces, weight):
    """pieces: (start of source, end of source, chain); the indices of the heaviest group."""
    group = list(range(len(pieces)))
    for _ in pieces:
        for i, x in enumerate(pieces):
            for j, y in enumerate(pieces):
                if x[2] == y[2] or x[0] < y[1] and y[0] < x[1]:
                    group[i] = group[j] = min(group[i], group[j])
    best = None
    for g in set(group):
        mine = [p for p, k in zip(pieces, group, strict=True) if k == g]
        sizes = [e - s for s, e, _ in mine]
        mass = {"union": len({x for s, e, _ in mine for x in range(s, e)}), "sum": sum(sizes), "max": max(sizes)}[weight]
        key = (-mass, min(s for s, _, _ in mine), min(c for _, _, c in mine))
        if best is None or key < best[0]:
            best = (key, g)
    return [i for i, k in enumerate(group) if best and k == best[1]]


@pytest.mark.parametrize("policy", ["best_source_cluster", "best_cluster_union", "best_cluster_sum", "best_cluster_max"])
def test_best_cluster(spark, policy):
    rng = random.Random(policy)
    blocks = []
    for i in range(60):
        s = rng.randrange(900)
        n = rng.randrange(1, 60)
        blocks.append((f"t{rng.randrange(2)}", 5000 * i, 5000 * i + n, rng.choice([1, -1]), "s", s, s + n, 1, rng.randrange(25), 1.0))
    rows = [("s", k * 90, k * 90 + rng.randrange(1, 200), k + 1) for k in range(11)]
    chain = lo.as_chain(spark.createDataFrame(blocks, CHAIN), "keep", policy)
    found = lo.liftover(spark.createDataFrame(rows, "chrom string, start long, end long, intervalID long"), chain, metadata=True, policy=policy).collect()
    wanted = set()
    for _, a, b, i in rows:
        hit = [x for x in blocks if x[5] < b and a < x[6]]
        pieces = [(max(a, x[5]), min(b, x[6]), x[8]) for x in hit]
        for k in plain_best(pieces, lo.CLUSTERS[policy]):
            (s, e, c), x = pieces[k], hit[k]
            start = x[2] - (e - x[5]) if x[3] < 0 else x[1] + s - x[5]
            wanted.add((i, x[0], start, start + e - s, c, s, e))
    assert {(r.intervalID, r.chrom, r.start, r.end, r.chain_id, r.startsrc, r.endsrc) for r in found} == wanted and len(found) == len(wanted)


def test_clusters_by_chain_and_overlap(spark):
    """A chain's pieces stay together across a gap, and what overlaps one of them joins; masses differ by policy."""
    blocks = [("t", 0, 10, 1, "s", 0, 10, 1, 1, 1.0), ("t", 100, 110, 1, "s", 50, 60, 1, 1, 1.0), ("t", 200, 210, 1, "s", 55, 65, 1, 2, 1.0), ("t", 300, 326, 1, "s", 20, 46, 1, 3, 1.0)]
    rows = spark.createDataFrame([("s", 0, 100, 1)], "chrom string, start long, end long, intervalID long")
    chains = {p: sorted(r.chain_id for r in lo.liftover(rows, lo.as_chain(spark.createDataFrame(blocks, CHAIN), "keep", p), policy=p).collect()) for p in lo.CLUSTERS}
    assert chains == {"best_source_cluster": [3], "best_cluster_union": [3], "best_cluster_sum": [1, 1, 2], "best_cluster_max": [3]}
    with pytest.raises(ValueError):
        lo.liftover(rows, lo.as_chain(spark.createDataFrame(blocks, CHAIN), "keep", "keep"), policy="none")
    lifted = lo.lift_track(spark.createDataFrame([("s", 0, 100, 2.5)], "chrom string, start long, end long, value double"), lo.as_chain(spark.createDataFrame(blocks, CHAIN), "keep", "best_cluster_sum"), policy="best_cluster_sum")
    assert sorted((r.start, r.end, r.value) for r in lifted.collect()) == [(0, 10, 2.5), (100, 110, 2.5), (200, 210, 2.5)]


def test_components_of_structs(spark):
    links = spark.createDataFrame([((1, "a"), (1, "b")), ((1, "c"), (1, "b")), ((2, "a"), (2, "z")), ((3, "q"), (3, "q"))], "a struct<i:int,n:string>, b struct<i:int,n:string>")
    assert sorted((tuple(r.id), tuple(r.component)) for r in connected_components(links).collect()) == [((1, "a"), (1, "a")), ((1, "b"), (1, "a")), ((1, "c"), (1, "a")), ((2, "a"), (2, "a")), ((2, "z"), (2, "a"))]


RECT = "chrom1 string, start1 long, end1 long, chrom2 string, start2 long, end2 long, name long"


def rectangles(rng, n, size, wide):
    out = []
    for i in range(n):
        x, y = rng.randrange(size), rng.randrange(size) if rng.random() < 0.7 else rng.randrange(30)
        out.append((rng.choice("ab"), x, x + rng.randrange(1, wide), "c", y, y + rng.randrange(1, wide), i))
    return out


def plain_nearest(q, targets, k, bounds):
    found = []
    for t in targets:
        if (q[0], q[3]) == (t[0], t[3]):
            d1, d2 = max(t[1] - q[2], q[1] - t[2], 0), max(t[4] - q[5], q[4] - t[5], 0)
            if bounds[0] <= d1 <= bounds[1] and bounds[2] <= d2 <= bounds[3]:
                apart = (q[1] >= t[2] or q[2] <= t[1]) + (q[4] >= t[5] or q[5] <= t[4])
                found.append((d1 + d2 + apart, t[1], t[4], t[2], t[5], d1, d2))
    return sorted(found)[:k]


@pytest.mark.parametrize("bounds", [(-(10**9), 10**9, -(10**9), 10**9), (0, 400, 30, 5000), (5, 60, 5, 60)])
def test_nearest_2d(spark, bounds):
    rng = random.Random(4)
    queries, targets = rectangles(rng, 60, 20_000, 300), rectangles(rng, 150, 20_000, 60) + [("a", 0, 20_000, "c", 19_990, 20_000, 999)]
    queries.append(("z", 1, 2, "c", 1, 2, 500))
    frame = lambda rows: spark.createDataFrame(rows, RECT)
    for k in (1, 4):
        made = e2.nearest_2d(frame(queries), frame(targets), k, *bounds, keep_unmatched=True).collect()
        by = {}
        for r in made:
            by.setdefault(r.name, []).append((r.r_start1, r.r_start2, r.r_end1, r.r_end2, r.dist1, r.dist2))
        for q in queries:
            wanted = [x[1:] for x in plain_nearest(q, targets, k, bounds)] or [(None,) * 6]
            assert sorted(by[q[6]], key=str) == sorted(wanted, key=str), q
        assert e2.nearest_2d(frame(queries), frame(targets), k, *bounds).where("r_start1 IS NULL").count() == 0
    assert e2.nearest_2d(frame(queries), frame(targets).limit(0), 1).collect() == []
    assert e2.nearest_2d(frame(queries), frame(targets).limit(0), 1, keep_unmatched=True).count() == len(queries)
