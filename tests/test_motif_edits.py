"""Edits of motif places against exhaustive search."""

import math
import random
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeloom.functions import motif_edits as me
from rangeloom.functions.sequence import Motif
from rangeloom.operators.tracks import Workspace

MOTIF = Motif("m", ((0.7, 0.1, 0.1, 0.1), (0.1, 0.6, 0.2, 0.1), (0.2, 0.2, 0.5, 0.1), (0.05, 0.05, 0.1, 0.8)))
FLIP = str.maketrans("ACGTN", "TGCAN")
TOP = me.Edits(MOTIF, 0).logs()[:, :4].max(1).sum()


def rev(text):
    return text.translate(FLIP)[::-1]


def letters(e):
    """Column scores by letter, N as its column's mean."""
    return [dict(zip("ACGTN", row, strict=True)) for row in e.logs()]


def plain_window(e, text, start):
    """Fewest edits of the place at ``start`` of a strand's text by trying all edits, or None."""
    cols, best = letters(e), None
    budget = e.max_edits if e.max_edits is not None else len(cols) + e.max_indels

    def go(i, at, edits, indels, score):
        nonlocal best
        if edits > budget or (best is not None and edits >= best):
            return
        if i == len(cols):
            if e.met(score):
                best = edits
            return
        top = max(cols[i][x] for x in "ACGT")
        if at < len(text):
            own = text[at]
            if own != "N":
                go(i + 1, at + 1, edits, indels, score + cols[i][own])
            elif e.below:
                go(i + 1, at + 1, edits, indels, score + top)
            for x in "ACGT":
                if x != own:
                    go(i + 1, at + 1, edits + 1, indels, score + cols[i][x])
            if indels < e.max_indels:
                go(i, at + 1, edits + 1, indels + 1, score)
        if indels < e.max_indels:
            for x in "ACGT":
                go(i + 1, at, edits + 1, indels + 1, score + cols[i][x])

    go(0, start, 0, 0, 0.0)
    score = sum(cols[i][text[start + i]] for i in range(len(cols)))
    if (e.score_min is not None and score < e.score_min) or (e.score_max is not None and score > e.score_max):
        return None
    return best


def plain_places(e, text):
    width, out = len(e.motif.matrix), []
    for s in range(len(text) - width + 1):
        each = [plain_window(e, text if way > 0 else rev(text), s if way > 0 else len(text) - width - s) for way in e.strands()]
        known = [x for x in each if x is not None]
        out.append((max if e.below else min)(known) if known else None)
    return out


def texts(rng, n, longest, signs="ACGT"):
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(longest + 1))) for _ in range(n)]


TARGETS = [
    me.Edits(MOTIF, -3.0), me.Edits(MOTIF, -2.2), me.Edits(MOTIF, TOP - 1e-6), me.Edits(MOTIF, TOP + 1), me.Edits(MOTIF, -3.0, max_edits=1), me.Edits(MOTIF, -9.0, "below"), me.Edits(MOTIF, -6.0, "below", bidirect=False),
    me.Edits(MOTIF, -2.0, bidirect=False, strand=-1), me.Edits(MOTIF, -2.0, score_min=-7.0, score_max=-4.0), me.Edits(MOTIF, -2.0, max_indels=1), me.Edits(MOTIF, TOP - 1e-6, max_indels=2, max_edits=2), me.Edits(MOTIF, -8.0, "below", max_indels=1),
]


@pytest.mark.parametrize("target", TARGETS)
def test_fewest_edits_equal_exhaustive_search(target):
    rng = random.Random(3)
    for text in texts(rng, 40, 9, "ACGTN") + ["ACGT", "GACT", "ACACGT", "ACGGT"]:
        if len(text) < 4:
            continue
        wanted = plain_places(target, text)
        edits, _ = me._places(target, me._codes(text))
        assert [None if np.isnan(x) else int(x) for x in edits] == wanted, text
        known = [x for x in wanted if x is not None]
        found, place = me._fewest_of(target, me._codes(text))
        assert (np.isnan(found) and not known) or (found == min(known) and wanted[int(abs(place)) - 1] == found and found not in wanted[: int(abs(place)) - 1])


def lse(e, text):
    cols = letters(e)
    return np.logaddexp.reduce([sum(cols[i][text[s + i]] for i in range(len(cols))) for s in range(len(text) - len(cols) + 1)])


def plain_lse(e, text, most):
    best = None
    for way in e.strands():
        strand = text if way > 0 else rev(text)
        for k in range(most + 1):
            found = any(
                e.met(lse(e, "".join(dict(zip(places, new, strict=True)).get(i, c) for i, c in enumerate(strand))))
                for places in combinations(range(len(text)), k) for new in product("ACGT", repeat=k)
            )
            if found:
                best = k if best is None else min(best, k)
                break
    return best


@pytest.mark.parametrize("target", [me.Edits(MOTIF, -2.0), me.Edits(MOTIF, -1.75), me.Edits(MOTIF, -6.0, "below"), me.Edits(MOTIF, -5.5, "below", bidirect=False), me.Edits(MOTIF, -2.2, max_edits=1)])
def test_edits_of_the_log_sum_equal_exhaustive_search(target):
    rng = random.Random(4)
    few = 0
    for text in [t for t in texts(rng, 40, 12, "ACGTACGTN") if len(t) >= 4]:
        found, place = me._lse_of(target, me._codes(text), len(text) - 3)
        wanted = plain_lse(target, text, min(2, target.max_edits or 2))
        if wanted is not None:
            assert found == wanted, text
            few += wanted > 0
            assert np.isnan(place) == (wanted == 0)
        else:
            assert np.isnan(found) or found >= 3
            if target.max_edits is not None:
                assert np.isnan(found)
    assert few


@pytest.mark.parametrize("target", [me.Edits(MOTIF, -3.0), me.Edits(MOTIF, -2.0, bidirect=False), me.Edits(MOTIF, -8.0, "below"), me.Edits(MOTIF, -2.0, score_min=-6.0)])
def test_single_substitutions(target):
    rng = random.Random(5)
    cols = letters(target)
    for text in texts(rng, 60, 10):
        if len(text) < 4:
            continue
        best = None
        for way in target.strands():
            strand = text if way > 0 else rev(text)
            for s in range(len(text) - 3):
                score = lambda w: sum(cols[i][c] for i, c in enumerate(w))
                window = strand[s : s + 4]
                if target.score_min is not None and score(window) < target.score_min:
                    continue
                n = 0 if target.met(score(window)) else sum(target.met(score(window[:i] + x + window[i + 1 :])) for i in range(4) for x in "ACGT" if x != window[i]) or None
                best = n if best is None else max(best, n or 0) if n is not None else best
        found = me._single(target, me._codes(text))
        assert (None if np.isnan(found) else found) == best, text


def test_table(spark):
    rng = random.Random(6)
    some = texts(rng, 60, 12) + [None, "", "AC", "ACGT", "GGACGGTCC"]
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(some)], "i long, n string, s string")
    for target in (me.Edits(MOTIF, -2.5), me.Edits(MOTIF, -2.5, max_indels=1), me.Edits(MOTIF, -9.0, "below"), me.Edits(MOTIF, TOP - 1e-6, max_edits=2, max_indels=1)):
        cols = letters(target)
        rows = {}
        for r in me.edit_table(df, "s", target).collect():
            rows.setdefault(r.i, []).append(r)
        for i, text in enumerate(some):
            wanted = [x for x in plain_places(target, text) if x is not None] if text and len(text) >= 4 else []
            if not wanted:
                assert i not in rows
                continue
            mine = sorted(rows[i], key=lambda r: r.edit_num)
            n = min(wanted)
            assert {r.n_edits for r in mine} == {n} and [r.edit_num for r in mine] == ([0] if n == 0 else list(range(1, n + 1)))
            r = mine[0]
            assert len(r.mutated_seq) == 4 and target.met(r.score_after) and r.score_after == pytest.approx(sum(cols[k][c] for k, c in enumerate(r.mutated_seq)))
            strand = text if r.strand > 0 else rev(text)
            start = r.window_start - 1 if r.strand > 0 else len(text) - 4 - (r.window_start - 1)
            assert strand[start:].startswith(r.window_seq)
            # the edits turn the window into the result
            made, at = [], 0
            by = {}
            for x in mine:
                by.setdefault(x.motif_col, []).append(x)
            for column in range(1, 5):
                here = by.get(column, [])
                for x in here:
                    if x.edit_type == "del":
                        assert r.window_seq[at] == x.ref
                        at += 1
                kinds = [x for x in here if x.edit_type in ("sub", "ins")]
                if kinds:
                    made.append(kinds[0].alt)
                    if kinds[0].edit_type == "sub":
                        assert r.window_seq[at] == kinds[0].ref
                        at += 1
                else:
                    made.append(r.window_seq[at])
                    at += 1
            assert "".join(made) == r.mutated_seq and at == len(r.window_seq)
            if target.max_indels == 0 and n:
                assert r.score_after - r.score_before == pytest.approx(sum(x.gain for x in mine))


def test_edit_windows_under_a_mask(spark):
    rng = random.Random(7)
    text = "".join(rng.choice("ACGT") for _ in range(160))
    ws = Workspace(spark.createDataFrame([(0, "c", 160)], "chrom_id int, chrom string, size long"), bin_width=32, sequence=spark.createDataFrame([("c", 0, text)], "chrom string, chunk_start long, seq string"), sequence_chunk=160)
    mask = spark.createDataFrame([("c", 10, 15), ("c", 60, 81)], "chrom string, start long, end long")
    options = {"motif": MOTIF, "threshold": -2.5}
    for name in me.KINDS:
        ws.vtrack(name.replace(".", "_"), None, f"pwm.{name}", options, mask=mask)
    target = me.Edits(MOTIF, -2.5)
    names = {n.replace(".", "_"): n for n in me.KINDS}
    for r in ws.evaluate({n: n for n in names}, iterator=20).collect():
        parts = [(a, b) for a, b in ((r.start, 10), (15, r.end)) if a < b] if r.start == 0 else [] if r.start == 60 else [(81, 100)] if r.start == 80 else [(r.start, r.end)]
        cut = [(a, me._codes(text[a : b + 3])) for a, b in parts]
        cut = [(a, c) for a, c in cut if len(c) >= 4]
        least = lambda kind: [v for _, c in cut if not math.isnan(v := me.KINDS[kind](target, c)[0])]
        assert r.edit_distance == min(least("edit_distance"), default=None)
        assert r.edit_distance_lse == min(least("edit_distance.lse"), default=None)
        assert r.n_mutations == max(least("n_mutations"), default=None)
        placed = [(n, a, p + math.copysign(a - r.start, p)) for a, c in cut for p, n in [me.KINDS["edit_distance.pos"](target, c)] if not math.isnan(p)]
        assert r.edit_distance_pos == (min(placed)[2] if placed else None)
        scored = [(-s, a, n) for a, c in cut for n, s in [me.KINDS["max.edit_distance"](target, c)]]
        assert r.max_edit_distance == (min(scored)[2] if scored else None)


def test_refusals():
    with pytest.raises(ValueError):
        me.Edits(MOTIF, 0.0, "sideways")
    with pytest.raises(ValueError):
        me.measure(F.lit("A"), "n_mutations", me.Edits(MOTIF, 0.0, max_indels=1))


def test_blocks_equal_sequences_one_by_one():
    """A block of sequences of one length gives what each gives alone, and in a small part of the time."""
    import time

    rng = np.random.default_rng(5)
    motif = Motif("m", ((0.7, 0.1, 0.1, 0.1), (0.1, 0.7, 0.1, 0.1), (0.25, 0.25, 0.25, 0.25), (0.1, 0.1, 0.2, 0.6)))
    for options in ({}, {"direction": "below"}, {"max_edits": 1}, {"max_edits": 2, "bidirect": False, "strand": -1}, {"score_min": -6.0, "score_max": -2.5}):
        target = me.Edits(motif, **({"threshold": -9.0 if "direction" in options else -2.0} | options))
        codes = rng.choice(5, (12, 15), p=[0.3, 0.3, 0.2, 0.15, 0.05]).astype(np.int8)
        for kind, function in me.KINDS.items():
            together = np.stack(function(target, codes))
            alone = np.array([function(target, row) for row in codes]).T
            assert np.array_equal(together, alone, equal_nan=True), (kind, options)
    assert [x.tolist() for x in me._lse_of(me.Edits(motif, -50.0, max_edits=1), codes, 12)][0] == [0.0] * len(codes)  # none of the block needs any
    codes, target = rng.choice(4, (3000, 100)).astype(np.int8), me.Edits(motif, -0.2, max_edits=1)
    for kind in me.KINDS:
        began = time.perf_counter()
        me.KINDS[kind](target, codes[:300])
        together, began = time.perf_counter() - began, time.perf_counter()
        for row in codes[:300]:
            me.KINDS[kind](target, row)
        assert together < 0.5 * (time.perf_counter() - began), kind
