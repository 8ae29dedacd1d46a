"""Sequence functions: complements, k-mers, masks, and motif scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FROM, _TO = "ACGTUNacgtun", "TGCAANtgcaan"


def complement(seq: Column) -> Column:
    return F.translate(seq, _FROM, _TO)


def reverse(seq: Column) -> Column:
    return F.reverse(seq)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def _gapless(seq: Column, gaps: str) -> Column:
    return F.translate(seq, gaps, "") if gaps else seq


def window(seq: Column, start: int | None = None, end: int | None = None, extend: int = 0) -> Column:
    """Part of a sequence from 1-based ``start`` to ``end``, ``extend`` bases longer."""
    if start is None and end is None:
        return seq
    first = start or 1
    length = F.length(seq) if end is None else F.lit(end - first + 1 + extend)
    return F.substring(seq, F.lit(first), length)


def kmer_count(seq: Column, kmer: str, strand: int = 0, gaps: str = "") -> Column:
    """Overlapping occurrences of a k-mer; strand 1 forward, -1 reverse, 0 both.

    A k-mer that is its own reverse complement counts on each strand.
    """
    s = F.upper(_gapless(seq, gaps))
    flip = kmer.upper().translate(str.maketrans("ACGT", "TGCA"))[::-1]
    count = lambda k: F.coalesce(F.regexp_count(s, F.lit(f"(?={k})")), F.lit(0))
    if strand == 1:
        return count(kmer.upper()).cast("long")
    if strand == -1:
        return count(flip).cast("long")
    return (count(kmer.upper()) + count(flip)).cast("long")


def kmer_frac(seq: Column, kmer: str, strand: int = 0, gaps: str = "") -> Column:
    """Occurrences for each place a k-mer can stand at; twice as many places on both strands."""
    places = (F.length(_gapless(seq, gaps)) - len(kmer) + 1) * (2 if strand == 0 else 1)
    return F.when(places > 0, kmer_count(seq, kmer, strand, gaps) / places)


def kmers(seq: Column, k: int) -> Column:
    """All k-mers of A, C, G, T in order, as an array; those with other letters are left out.

    The letters become an array once, bound as a variable, so that a k-mer costs
    k lookups wherever it stands.
    """

    def of(letters: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(letters) - k, F.lit(0)))
        parts = F.transform(places, lambda i: F.concat(*(F.get(letters, i + j) for j in range(k))))
        return F.filter(parts, lambda x: F.coalesce(F.length(F.translate(x, "ACGT", "")) == 0, F.lit(False)))

    return F.transform(F.array(F.split(F.upper(seq), "")), of)[0]


def kmer_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """``kmer`` and ``n``: how often each k-mer of A, C, G and T stands in a column's sequences, case ignored.

    A batch's sequences are counted at once as numbers to the base of 4; a task
    hands on one row for each k-mer that it met.  ``k`` is 12 at most.
    """
    if not 1 <= k <= 12:
        raise ValueError("k-mers of 1 to 12 letters can be counted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4**k, np.int64)
        for batch in batches:
            for codes in _codes(batch.column(0)):
                total += np.bincount(_numbers(codes, k), minlength=4**k)
        met = np.flatnonzero(total)
        names = ["".join("ACGT"[i >> 2 * j & 3] for j in range(k - 1, -1, -1)) for i in met.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total[met])], ["kmer", "n"])

    return df.select(F.col(column).cast("string")).mapInArrow(run, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))


def _codes(column: pa.Array) -> Iterator[np.ndarray]:
    """Each sequence's letters as 0 to 3, and 4 for any other byte."""
    column = column.cast(pa.large_binary())
    for at in range(len(column)):
        value = column[at].as_buffer()
        if value is not None and value.size:
            yield _CODE[np.frombuffer(value, np.uint8)]


def _numbers(codes: np.ndarray, k: int) -> np.ndarray:
    """The k-mers of a sequence of codes as numbers to the base of 4; those with other letters are left out."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    number, good = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(k):
        part = codes[j : j + n]
        number = number * 4 + part
        good &= part < 4
    return number[good]


def masked_count(seq: Column) -> Column:
    """Lower-case (soft-masked) letters."""
    return (F.length(seq) - F.length(F.regexp_replace(seq, "[a-z]", ""))).cast("long")


def masked_frac(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, masked_count(seq) / F.length(seq))


@dataclass(frozen=True)
class Motif:
    """A position matrix with columns A, C, G, T, as probabilities."""

    name: str
    matrix: tuple[tuple[float, float, float, float], ...]

    def log_matrix(self, prior: float = 0.01) -> np.ndarray:
        """Log probabilities after adding ``prior`` to each cell and normalising; a fifth column stands for other letters."""
        p = np.asarray(self.matrix, float) + prior
        logs = np.log(p / p.sum(1, keepdims=True))
        return np.column_stack((logs, logs.mean(1)))


_CODE = np.full(256, 4, np.int8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    for _c in _pair:
        _CODE[ord(_c)] = _i


#: How letters without a base (N and *) score: the column's mean, log(1/4), or log(1/4) on the forward strand and the mean on the reverse.
NEUTRAL = ("average", "log_quarter", "forward_quarter", "na")


def strand_logs(logs: np.ndarray, neutral: str = "average") -> tuple[np.ndarray, np.ndarray]:
    """Log matrices of both strands; the fifth column, of other letters, follows ``neutral``."""
    if neutral not in NEUTRAL:
        raise ValueError(f"neutral is one of {NEUTRAL}")
    forward, backward = logs.copy(), logs[::-1][:, [3, 2, 1, 0, 4]].copy()
    if neutral in ("log_quarter", "forward_quarter"):
        forward[:, 4] = np.log(0.25)
    if neutral == "log_quarter":
        backward[:, 4] = np.log(0.25)
    if neutral == "na":
        forward[:, 4] = backward[:, 4] = np.nan
    return forward, backward


def _letters(seq: str) -> np.ndarray:
    return _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


def anchor_scores(seq: str | np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log score of the motif at each place of a sequence."""
    width = len(logs)
    codes = _letters(seq) if isinstance(seq, str) else seq
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0)
    return sum(logs[j][codes[j : j + n]] for j in range(width))


@dataclass(frozen=True)
class Scan:
    """Where, and with what weight, a motif is looked for.

    Places lie within ``start_pos`` to ``end_pos`` (1-based, inclusive; all by
    default), which ``extend`` widens by that many letters on both sides, or by
    the motif's width less one if true.  ``spat_factor`` weighs a place by the
    bin of ``spat_bin`` letters that it lies in, counted from the region's start;
    the last factor serves all places beyond.  Letters in ``gaps`` are skipped: a
    motif is matched to the letters around them, and its place is that of its
    first letter in the sequence with gaps.
    """

    start_pos: int | None = None
    end_pos: int | None = None
    extend: bool | int = False
    spat_factor: tuple[float, ...] = ()
    spat_bin: int = 1
    gaps: str = ""

    def places(self, seq: str, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the letters left, the places (0-based, in them) that are looked at, and the letters' places in ``seq``."""
        pad = width - 1 if self.extend is True else int(self.extend)
        first = (self.start_pos or 1) - 1
        last = len(seq) - 1 if self.end_pos is None else self.end_pos - 1
        low, high = max(0, first - pad), min(len(seq), last + 1 + pad)
        at = np.arange(low, max(low, high))
        codes = _letters(seq[low:high])
        if self.gaps:
            solid = ~np.isin(np.frombuffer(seq[low:high].encode("latin-1", "replace"), np.uint8), np.frombuffer(self.gaps.encode("latin-1"), np.uint8))
            codes, at = codes[solid], at[solid]
        return codes, np.arange(max(0, len(codes) - width + 1)), at

    def weights(self, at: np.ndarray) -> np.ndarray:
        """Log weights of places in the sequence."""
        if not self.spat_factor:
            return np.zeros(len(at))
        offset = at - ((self.start_pos or 1) - 1)
        return np.log(np.asarray(self.spat_factor))[np.clip(offset // max(1, self.spat_bin), 0, len(self.spat_factor) - 1)]


def pwm(
    seq: Column, motif: Motif, mode: str = "lse", bidirect: bool = True, strand: int = 1, prior: float = 0.01, threshold: float | None = None,
    neutral: str = "average", per_strand: bool = False, scan: Scan = Scan(),
) -> Column:
    """Score of a motif over its places in a sequence, as ``scan`` says.

    ``mode``: lse (log-sum-exp over places and strands), max, pos (1-based place
    of the best, negative on the reverse strand; the first of equals, forward
    before reverse) or count: places whose strands' log-sum-exp is ``threshold``
    or more, or with ``per_strand`` strands that reach it.  Null where no place
    fits the motif, 0 for a count.  ``neutral`` says how letters without a base
    score; with ``na`` a sequence in which one is scored is null.
    """
    forward_logs, backward_logs = strand_logs(motif.log_matrix(prior), neutral)
    ways = ([forward_logs] if bidirect or strand >= 0 else []) + ([backward_logs] if bidirect or strand < 0 else [])

    def one(s: str | None) -> float | None:
        if s is None:
            return None
        codes, starts, at = scan.places(s, len(motif.matrix))
        if not len(starts):
            return 0.0 if mode == "count" else None
        scores = np.vstack([anchor_scores(codes, w) for w in ways])
        if neutral == "na" and np.isnan(scores).any():
            return None
        scores = scores + scan.weights(at[starts])
        if mode == "lse":
            return float(np.logaddexp.reduce(scores, axis=None))
        if mode == "max":
            return float(scores.max())
        if mode == "count":
            return float(((scores if per_strand else np.logaddexp.reduce(scores, axis=0)) >= threshold).sum())
        if mode != "pos":
            raise ValueError(f"unknown mode {mode}")
        best = scores.max(0)
        k = int(best.argmax())
        reverse_ = not bidirect and strand < 0 or len(scores) == 2 and scores[1, k] > scores[0, k]
        return float(-(at[k] + 1) if reverse_ else at[k] + 1)

    @F.pandas_udf("double")
    def scores(batch: pd.Series) -> pd.Series:
        return pd.Series([one(s) for s in batch], dtype="float64")

    return scores(seq)


def pwm_edits(seq: Column, motif: Motif, threshold: float, max_edits: int | None = None, bidirect: bool = True, prior: float = 0.01) -> Column:
    """Fewest substitutions that bring some place of the motif to ``threshold`` or above; null where none can."""
    from rangeloom.functions.motif_edits import Edits, measure

    return measure(seq, "edit_distance", Edits(motif, threshold, max_edits=max_edits, bidirect=bidirect, prior=prior))
