"""How many edits bring a motif's score over, or under, a threshold.

Three questions: the fewest edits of one place of the motif (substitutions, or
insertions and deletions too), the number of single substitutions that suffice,
and the fewest substitutions that move the log-sum-exp of all places at once.
Inside Arrow batches sequences of one length are handled together, a block of
rows at a time, and so are all places of a sequence; indels, and log-sum-exps
that take two substitutions or more, go sequence by sequence.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.functions.sequence import _CODE, Motif

_COMPLEMENT = np.array([3, 2, 1, 0, 4], np.int8)
_EPS = 1e-12
#: Letters, of all places of a block's sequences, that are handled at once.
_BLOCK = 1 << 16
#: Words, of five letters each to the motif's width, up to which what depends on a place's letters alone is worked out once a word.
_WORDS = 1 << 14


@dataclass(frozen=True)
class Edits:
    """A target for a motif's score.

    ``direction`` is above (reach ``threshold`` or more) or below (it or less).
    ``max_edits`` bounds the edits; places that need more count as out of reach.
    Up to ``max_indels`` of the edits of a place may be insertions and deletions.
    Places whose present score lies outside ``score_min`` to ``score_max`` are
    left out (for log-sum-exp, sequences are).  With ``bidirect`` both strands
    count: above, the better one does; below, the place needs as many edits as
    its harder strand.

    A letter without a base must be replaced to get above, and counts as the
    column's best letter on the way below.
    """

    motif: Motif
    threshold: float
    direction: str = "above"
    max_edits: int | None = None
    max_indels: int = 0
    bidirect: bool = True
    strand: int = 1
    prior: float = 0.01
    score_min: float | None = None
    score_max: float | None = None

    def __post_init__(self):
        if self.direction not in ("above", "below"):
            raise ValueError("direction is above or below")

    @property
    def below(self) -> bool:
        return self.direction == "below"

    def met(self, score):
        return score <= self.threshold + _EPS if self.below else score >= self.threshold - _EPS

    def strands(self) -> list[int]:
        return [1, -1] if self.bidirect else [1 if self.strand >= 0 else -1]

    def logs(self) -> np.ndarray:
        """Log probabilities of A, C, G, T and, for letters without a base, the mean."""
        p = np.asarray(self.motif.matrix, float) + self.prior
        with np.errstate(divide="ignore"):
            logs = np.log(p / p.sum(1, keepdims=True))
        return np.column_stack((logs, logs.mean(1)))


def _codes(text: str) -> np.ndarray:
    return _CODE[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def _windows(codes: np.ndarray, width: int, strand: int) -> np.ndarray:
    """Each place's letters as the motif sees them."""
    seen = np.lib.stride_tricks.sliding_window_view(codes, width, axis=-1)
    return seen if strand > 0 else _COMPLEMENT[seen[..., ::-1]]


def _at_places(e: Edits, codes: np.ndarray, strand: int, function: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """A function of a place's letters, as the motif sees them, for each place: of a block by a table of all words where that is small."""
    width = len(e.motif.matrix)
    if codes.ndim == 1 or 5**width > _WORDS:
        return function(_windows(codes, width, strand))
    words = np.stack(np.unravel_index(np.arange(5**width), (5,) * width), -1).astype(np.int8)
    number, places = np.zeros(1, np.int32), codes.shape[-1] - width + 1
    for j in range(width):
        number = number * 5 + codes[..., j : j + places]
    return function(words if strand > 0 else _COMPLEMENT[words[..., ::-1]])[number]


def _tables(e: Edits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each column and letter: the score that counts, the most that an edit moves it, and whether it must be edited."""
    logs = e.logs()[:, :4]
    top = logs.max(1, keepdims=True)
    finite = np.isfinite(logs)
    low = np.where(finite, logs, np.inf).min(1, keepdims=True)
    if e.below:
        score = np.column_stack((logs, top))
        gain = np.column_stack((np.where(finite, logs - low, 0.0), top - low))
        return score, gain, np.zeros(score.shape, bool)
    score = np.column_stack((np.where(finite, logs, top), top))
    return score, np.column_stack((np.where(finite, top - logs, 0.0), np.zeros(len(top)))), np.column_stack((~finite, np.ones(len(top), bool)))


def _substitutions(e: Edits, seen: np.ndarray) -> np.ndarray:
    """Fewest substitutions of each place; not a number where none suffice: those that move the score most come first."""
    score, gain, must = _tables(e)
    column = np.arange(seen.shape[-1])
    own, moves, fixed = score[column, seen].sum(-1), gain[column, seen], must[column, seen].sum(-1)
    moved = np.concatenate((np.zeros((*own.shape, 1)), np.cumsum(-np.sort(-moves, -1), -1)), -1)
    reached = e.met(own[..., None] - moved if e.below else own[..., None] + moved)
    return np.where(reached.any(-1), fixed + reached.argmax(-1), np.nan)


def _aligned(e: Edits, codes: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """Best score of each start by number of edits, insertions and deletions included.

    Columns are taken one by one: matched, replaced or put in; letters may be
    taken out before a column.  A state is how many edits and how many of them
    indels were made, and how far the place in the sequence has shifted.
    """
    score, _, must = _tables(e)
    logs = e.logs()[:, :4]
    best = logs.min(1) if e.below else logs.max(1)
    if e.below:
        best = np.where(np.isfinite(logs), logs, np.inf).min(1)
    sign = -1.0 if e.below else 1.0
    width, band, n = len(score), e.max_indels, len(starts)
    state = np.full((most + 1, band + 1, 2 * band + 1, n), -np.inf)
    state[0, 0, band] = 0.0
    for i in range(width):
        for k in range(band):  # letters taken out
            np.maximum(state[1:, k + 1, 1:], state[:-1, k, :-1], out=state[1:, k + 1, 1:])
        new = np.full_like(state, -np.inf)
        for d in range(2 * band + 1):
            at = starts + i + d - band
            there = (at >= 0) & (at < len(codes))
            letter = codes[np.clip(at, 0, len(codes) - 1)]
            match = np.where(there & ~must[i, letter], sign * score[i, letter], -np.inf)
            new[:, :, d] = np.maximum(new[:, :, d], state[:, :, d] + match)
            replaced = np.where(there, sign * best[i], -np.inf)
            new[1:, :, d] = np.maximum(new[1:, :, d], state[:-1, :, d] + replaced)
        for k in range(band):  # a letter put in for the column
            new[1:, k + 1, :-1] = np.maximum(new[1:, k + 1, :-1], state[:-1, k, 1:] + sign * best[i])
        state = new
    return sign * state.max((1, 2))


def _fewest(e: Edits, codes: np.ndarray, strand: int) -> np.ndarray:
    """Fewest edits of each place on a strand, not a number where out of reach or left out."""
    if e.max_indels and codes.ndim > 1:
        return np.vstack([_fewest(e, row, strand) for row in codes])

    def of(seen: np.ndarray) -> np.ndarray:
        edits = _substitutions(e, seen)
        if e.max_edits is not None:
            edits[edits > e.max_edits] = np.nan
        edits[~_passing(e, _plain_scores(e, seen))] = np.nan
        return edits

    if not e.max_indels:
        return _at_places(e, codes, strand, of)
    width = len(e.motif.matrix)
    seen = _windows(codes, width, strand)
    edits = _substitutions(e, seen)
    most = width + e.max_indels if e.max_edits is None else e.max_edits
    turned = codes if strand > 0 else _COMPLEMENT[codes[::-1]]
    starts = np.arange(len(seen)) if strand > 0 else len(codes) - width - np.arange(len(seen))
    met = e.met(_aligned(e, turned, starts, most))
    edits = np.fmin(edits, np.where(met.any(0), met.argmax(0), np.nan))
    if e.max_edits is not None:
        edits[edits > e.max_edits] = np.nan
    edits[~_passing(e, _plain_scores(e, seen))] = np.nan
    return edits


def _plain_scores(e: Edits, seen: np.ndarray) -> np.ndarray:
    return e.logs()[np.arange(seen.shape[-1]), seen].sum(-1)


def _passing(e: Edits, scores: np.ndarray) -> np.ndarray:
    good = np.ones(scores.shape, bool)
    if e.score_min is not None:
        good &= scores >= e.score_min
    if e.score_max is not None:
        good &= scores <= e.score_max
    return good


def _places(e: Edits, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits of each place and the strand (1 or -1) that they are for; forward first of equals."""
    each = [_fewest(e, codes, s) for s in e.strands()]
    if len(each) == 1:
        return each[0], np.full(each[0].shape, e.strands()[0])
    forward, backward = each
    if e.below:
        return np.fmax(forward, backward), np.where(np.isnan(backward) | (forward >= backward), 1, -1)
    return np.fmin(forward, backward), np.where(np.isnan(backward) | (forward <= backward), 1, -1)


def _by_row(function: Callable) -> Callable:
    """Let a function of a block (a row each sequence, all of one length) take one sequence too."""

    @functools.wraps(function)
    def run(e: Edits, codes: np.ndarray, *more):
        if codes.ndim > 1:
            return function(e, codes, *more)
        found = function(e, codes[None], *more)
        return tuple(float(x[0]) for x in found) if isinstance(found, tuple) else float(found[0])

    return run


@_by_row
def _fewest_of(e: Edits, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of any place, and that place: from 1, negative on the reverse strand if both are looked at."""
    edits, strand = _places(e, codes)
    rows, at = np.arange(len(edits)), np.where(np.isnan(edits), np.inf, edits).argmin(1)
    found = edits[rows, at]
    return found, np.where(np.isnan(found), np.nan, (at + 1) * (strand[rows, at] if e.bidirect else 1))


@_by_row
def _at_best(e: Edits, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits of the place and strand with the best score now, and that score."""
    scores = np.stack([_at_places(e, codes, s, functools.partial(_plain_scores, e)) for s in e.strands()])
    rows, at = np.arange(len(codes)), scores.max(0).argmax(1)
    way = scores[:, rows, at].argmax(0)
    return np.stack([_fewest(e, codes, s) for s in e.strands()])[way, rows, at], scores[way, rows, at]


@_by_row
def _single(e: Edits, codes: np.ndarray) -> np.ndarray:
    """Most single substitutions that suffice at a place: 0 where none is needed, not a number where none does."""
    score, _, _ = _tables(e)
    column = np.arange(len(score))

    def of(seen: np.ndarray) -> np.ndarray:
        parts = score[column, seen]
        own = parts.sum(-1)
        with np.errstate(invalid="ignore"):
            changed = (own[..., None] - parts)[..., None] + score[:, :4]
        allowed = (seen[..., None] < 4) & (np.arange(4) != seen[..., None])
        count = (e.met(changed) & allowed & np.isfinite(changed)).sum((-1, -2)).astype(float)
        count[count == 0] = np.nan
        count[e.met(own)] = 0.0
        count[~_passing(e, _plain_scores(e, seen))] = np.nan
        return count

    best = np.full(len(codes), np.nan)
    for strand in e.strands():
        best = np.fmax(best, np.fmax.reduce(_at_places(e, codes, strand, of), 1))
    return best


class _Partition:
    """The log-sum-exp of a strand's places, and what substitutions do to it."""

    def __init__(self, e: Edits, codes: np.ndarray, starts: int):
        self.logs, self.codes, self.n = e.logs(), codes.copy(), starts
        self.width = len(self.logs)
        self.refresh()

    def refresh(self) -> None:
        seen = np.lib.stride_tricks.sliding_window_view(self.codes, self.width)[: self.n]
        scores = self.logs[np.arange(self.width), seen].sum(1)
        self.top = scores.max()
        self.weights = np.exp(scores - self.top)
        self.total = self.weights.sum()

    def value(self, total=None):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log(self.total if total is None else total) + self.top

    def changes(self, weights: np.ndarray, low: int = 0, high: int | None = None) -> np.ndarray:
        """What each of the four letters at the places ``low`` to ``high`` adds to the sum."""
        high = len(self.codes) if high is None else high
        out = np.zeros((high - low, 4))
        for i in range(self.width):
            first, last = max(low, i), min(high, self.n + i)  # places whose anchor for column i is one of the starts
            if first < last:
                q = np.arange(first, last)
                out[q - low] += weights[q - i, None] * np.expm1(self.logs[i, :4] - self.logs[i, self.codes[q]][:, None])
        own = self.codes[low:high]
        out[np.flatnonzero(own < 4), own[own < 4]] = 0.0
        return out

    def moved(self, q: int, letter: int) -> np.ndarray:
        """Weights after a substitution."""
        weights = self.weights.copy()
        p = np.arange(max(0, q - self.width + 1), min(self.n - 1, q) + 1)
        weights[p] *= np.exp(self.logs[q - p, letter] - self.logs[q - p, self.codes[q]])
        return weights


def _lse(e: Edits, codes: np.ndarray, starts: int, strand: int) -> tuple[float, float]:
    """Fewest substitutions that move a strand's log-sum-exp over the threshold, and where the first of them stands.

    One and two are tried in full: two that no place of the motif covers both
    add up, and others are tried one after the other.  Beyond, the substitution
    that moves the sum most is made, again and again.
    """
    part = _Partition(e, codes if strand > 0 else _COMPLEMENT[codes[::-1]], starts)
    now = part.value()
    if (e.score_min is not None and now < e.score_min) or (e.score_max is not None and now > e.score_max):
        return np.nan, np.nan
    if e.met(now):
        return 0.0, np.nan
    most = len(codes) if e.max_edits is None else e.max_edits
    pick = (lambda x: int(np.argmin(x))) if e.below else (lambda x: int(np.argmax(x)))
    single = part.changes(part.weights)
    q, _ = divmod(pick(single), 4)
    if most < 1:
        return np.nan, np.nan
    if e.met(part.value(part.total + single.flat[pick(single)])):
        return 1.0, float(q + 1)
    if most < 2:
        return np.nan, np.nan
    best_at = single.min(1) if e.below else single.max(1)
    better = np.minimum if e.below else np.maximum
    rest = np.append(better.accumulate(best_at[::-1])[::-1], 0.0)  # the best of all places from here on
    best, first = None, -1
    for a in range(len(part.codes)):
        near = min(len(part.codes), a + part.width)
        for letter in range(4):
            if letter == part.codes[a]:
                continue
            weights = part.moved(a, letter)
            seconds = part.changes(weights, a + 1, near)
            total = weights.sum() + (better(seconds.min() if e.below else seconds.max(), rest[near]) if seconds.size else rest[near])
            if best is None or (total < best if e.below else total > best):
                best, first = total, a
    if best is not None and e.met(part.value(best)):
        return 2.0, float(first + 1)
    done: list[int] = []
    for k in range(1, most + 1):
        changes = part.changes(part.weights)
        changes[done] = 0.0
        at = pick(changes)
        if not (changes.flat[at] < 0 if e.below else changes.flat[at] > 0):
            return np.nan, np.nan
        q, letter = divmod(at, 4)
        part.codes[q] = letter
        part.refresh()
        done.append(q)
        if e.met(part.value()):
            return float(k), float(done[0] + 1)
    return np.nan, np.nan


def _lse_by_row(e: Edits, codes: np.ndarray, starts: int, strand: int) -> tuple[np.ndarray, np.ndarray]:
    """``_lse`` of each row.  What no or one substitution does is seen for all rows at once; only rows that may take more go one by one."""
    logs, seen = e.logs(), codes if strand > 0 else _COMPLEMENT[codes[:, ::-1]]
    width, n = len(logs), len(codes)
    scores = _at_places(e, seen, 1, functools.partial(_plain_scores, e))[:, :starts]
    top = scores.max(1)
    weights = np.exp(scores - top[:, None])
    total = weights.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        now = np.log(total) + top
    edits, place = np.full(n, np.nan), np.full(n, np.nan)
    open_ = _passing(e, now)
    edits[open_ & e.met(now)] = 0.0
    open_ &= ~e.met(now)
    most = codes.shape[1] if e.max_edits is None else e.max_edits
    if most < 1:
        return edits, place
    rows = np.flatnonzero(open_)
    if not len(rows):
        return edits, place
    seen, weights = seen[rows], weights[rows]
    changes = np.zeros((*seen.shape, 4))
    with np.errstate(invalid="ignore", over="ignore"):
        for i in range(width):
            # what each letter there makes of a place's weight
            table = np.expm1(logs[i, :4] - logs[i][:, None])
            made = table.take(seen[:, i : starts + i], 0)
            made *= weights[:, :, None]
            changes[:, i : starts + i] += made
    changes[seen[:, :, None] == np.arange(4)] = 0.0
    flat = changes.reshape(len(rows), -1)
    at = flat.argmin(1) if e.below else flat.argmax(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        reached = e.met(np.log(total[rows] + flat[np.arange(len(rows)), at]) + top[rows])
    edits[rows[reached]], place[rows[reached]] = 1.0, at[reached] // 4 + 1
    if most > 1:
        for i in rows[~reached]:
            edits[i], place[i] = _lse(e, codes[i], starts, strand)
    return edits, place


@_by_row
def _lse_of(e: Edits, codes: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    best, best_place = np.full(len(codes), np.nan), np.full(len(codes), np.nan)
    for strand in e.strands():
        edits, place = _lse_by_row(e, codes, starts, strand)
        better = ~np.isnan(edits) & (np.isnan(best) | (edits < best))
        place = codes.shape[1] - place + 1 if not e.bidirect and strand < 0 else place
        best, best_place = np.where(better, edits, best), np.where(better, place * (strand if e.bidirect else 1), best_place)
    return best, best_place


#: What each function gives for the sequences of a block, all of one length: one number each, and for some a second that joins the parts of a masked window.
KINDS = {
    "edit_distance": lambda e, c: (_fewest_of(e, c)[0],),
    "edit_distance.pos": lambda e, c: _fewest_of(e, c)[::-1],
    "max.edit_distance": lambda e, c: _at_best(e, c),
    "n_mutations": lambda e, c: (_single(e, c),),
    "edit_distance.lse": lambda e, c: (_lse_of(e, c, c.shape[-1] - len(e.motif.matrix) + 1)[0],),
    "edit_distance.lse.pos": lambda e, c: _lse_of(e, c, c.shape[-1] - len(e.motif.matrix) + 1)[::-1],
}


def measure(seq: Column, kind: str, target: Edits, which: int = 0) -> Column:
    """One of KINDS for each sequence; null where it is null, shorter than the motif or out of reach."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of edits {kind}")
    if target.max_indels and (kind.startswith("edit_distance.lse") or kind == "n_mutations"):
        raise ValueError(f"{kind} knows substitutions only")

    width = len(target.motif.matrix)

    @F.pandas_udf("double")
    def run(batch: pd.Series) -> pd.Series:
        texts = [None if x is None else x.encode("latin-1", "replace") for x in batch]
        sizes = np.array([-1 if x is None else len(x) for x in texts])
        out = np.full(len(texts), np.nan)
        for size in np.unique(sizes[sizes >= width]).tolist():
            alike, step = np.flatnonzero(sizes == size), max(1, _BLOCK // (size * width))
            for rows in np.split(alike, range(step, len(alike), step)):
                codes = _CODE[np.frombuffer(b"".join([texts[i] for i in rows]), np.uint8)].reshape(len(rows), size)
                out[rows] = KINDS[kind](target, codes)[which]
        return pd.Series([None if np.isnan(x) else x for x in out], dtype="float64")

    return run(seq)


def _path(e: Edits, codes: np.ndarray, start: int, strand: int, edits: int) -> list[tuple[str, int, int, str, str, float]]:
    """Edits of one place, in the motif's order: (kind, column from 1, place in the strand's sequence, letter, new letter, gain).

    Of the ways with so few edits one with the best score, and of those one that replaces rather than puts in or takes out.
    """
    score, _, must = _tables(e)
    logs = np.where(np.isfinite(e.logs()[:, :4]), e.logs()[:, :4], np.inf if e.below else -np.inf)
    pick = logs.argmin(1) if e.below else logs.argmax(1)
    sign, width, band = (-1.0 if e.below else 1.0), len(score), e.max_indels
    turned = codes if strand > 0 else _COMPLEMENT[codes[::-1]]
    layers = [{(0, 0, 0): (0.0, 0, None)}]  # (edits, indels, shift) -> (score, indels so far, way)

    def put(layer, key, value):
        if key not in layer or (value[0], -value[1]) > (layer[key][0] + _EPS, -layer[key][1]) or (abs(value[0] - layer[key][0]) <= _EPS and value[1] < layer[key][1]):
            layer[key] = value

    for i in range(width):
        layer = layers[-1]
        for k in range(band):
            for (n, m, d), (s, _, _) in [x for x in layer.items() if x[0][1] == k and x[0][0] < edits and x[0][2] < band]:
                put(layer, (n + 1, m + 1, d + 1), (s, m + 1, ("del", (n, m, d))))
        new: dict = {}
        for (n, m, d), (s, _, _) in layer.items():
            at = start + i + d
            if 0 <= at < len(turned):
                letter = turned[at]
                if not must[i, letter]:
                    put(new, (n, m, d), (s + sign * score[i, letter], m, ("match", (n, m, d))))
                if n < edits and letter != pick[i]:
                    put(new, (n + 1, m, d), (s + sign * logs[i, pick[i]], m, ("sub", (n, m, d))))
            if n < edits and m < band and d > -band:
                put(new, (n + 1, m + 1, d - 1), (s + sign * logs[i, pick[i]], m + 1, ("ins", (n, m, d))))
        layers.append(new)
    ends = {k: v for k, v in layers[-1].items() if k[0] == edits}
    if not ends:
        return []
    key = max(ends, key=lambda k: (round(ends[k][0], 9), -k[1]))
    i, out = width, []
    while True:
        way = layers[i][key][2]
        if way is None:
            break
        kind, before = way
        if kind == "del":
            at = start + i + before[2]
            out.append((kind, i + 1, at, "ACGTN"[turned[at]], "-", 0.0))
        else:
            at, own = start + i - 1 + before[2], e.logs()[i - 1]
            if kind == "sub":
                out.append((kind, i, at, "ACGTN"[turned[at]], "ACGT"[pick[i - 1]], float(own[pick[i - 1]] - own[turned[at]])))
            elif kind == "ins":
                out.append((kind, i, at, "-", "ACGT"[pick[i - 1]], float(own[pick[i - 1]])))
            i -= 1
        key = before
    return out[::-1]


TABLE = "strand int, window_start long, score_before double, score_after double, n_edits int, edit_num int, edit_type string, motif_col int, ref string, alt string, gain double, window_seq string, mutated_seq string"


def _rows(e: Edits, text: str) -> Iterator[tuple]:
    """A row for each edit of the place that needs fewest, the first of equals; one row without an edit where none is needed."""
    width = len(e.motif.matrix)
    if text is None or len(text) < width:
        return
    codes = _codes(text)
    edits, strands = _places(e, codes)
    if np.isnan(edits).all():
        return
    at = int(np.nanargmin(edits))
    strand, n = int(strands[at]), int(edits[at])
    turned = codes if strand > 0 else _COMPLEMENT[codes[::-1]]
    start = at if strand > 0 else len(codes) - width - at
    seen = turned[start : start + width]
    logs = e.logs()
    before = float(logs[np.arange(width), seen].sum())
    # fewest substitutions alone, or a way through the alignment; below, those that lose most
    path = _path(e, codes, start, strand, n) if n else []
    span = width + sum(k == "del" for k, *_ in path) - sum(k == "ins" for k, *_ in path)
    window = "".join("ACGTN"[c] for c in turned[start : start + span])
    letters: list[str] = []
    made = {(i - 1): alt for k, i, _, _, alt, _ in path if k != "del"}
    place, taken = start, {p for k, _, p, _, _, _ in path if k == "del"}
    put = {i - 1 for k, i, *_ in path if k == "ins"}
    for i in range(width):
        while place in taken:
            place += 1
        letters.append(made.get(i, "ACGTN"[turned[place]] if place < len(turned) else "N"))
        place += i not in put
    after = float(sum(logs[i, "ACGTN".index(x)] for i, x in enumerate(letters)))
    head = (strand, at + 1, before, after, n)
    if not path:
        yield (*head, 0, None, None, None, None, None, window, "".join(letters))
    for k, (kind, column, _, ref, alt, gain) in enumerate(path, 1):
        yield (*head, k, kind, column, ref, alt, gain, window, "".join(letters))


def edit_table(df: DataFrame, seq_col: str, target: Edits) -> DataFrame:
    """Rows of ``df``, without the sequence, with a row for each edit that its best place needs.

    The best place needs fewest edits; the first of equals, forward before
    reverse.  Adds the columns of TABLE: the place from 1 (its leftmost letter),
    the strand whose letters ``window_seq`` and ``mutated_seq`` show, the score
    before and after all edits, and each edit's kind (sub, ins, del), column,
    letters and gain.  A sequence that needs no edit has one row with
    ``edit_num`` 0; one out of reach, null or too short has none.
    """
    keys = [c for c in df.columns if c != seq_col]
    names = [x.split()[0] for x in TABLE.split(", ")]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys), TABLE])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*own, *row) for *own, text in batch[[*keys, seq_col]].itertuples(index=False) for row in _rows(target, text)]
            yield pd.DataFrame(rows, columns=[*keys, *names])

    return df.select(*keys, seq_col).mapInPandas(run, schema)
