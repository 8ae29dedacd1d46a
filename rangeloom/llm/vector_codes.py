"""Compression of vectors to short codes: a codebook for each part of a vector, fitted in whole numbers.

Rounds of assignment carry bounds from one to the next.  A part keeps the entry
that it was given, a lower bound of its distance from every other entry, and the
round in which that bound was measured.  As the codebooks of all rounds are
kept, a later round knows how far each entry has truly moved since then (the
norm of the sum of its moves, not the sum of their norms), takes that off the
bound and scans all entries only where the bound no longer tells.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm._store import stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
#: Components are held within plus and minus this, so that squared distances are exact.
LARGEST = 1 << 24
#: Up to here products of components add up exactly in doubles.
_SMALL = 1 << 20
#: Parts of vectors handled at once.
CHUNK_ROWS = 4096


@dataclass(frozen=True)
class Codes:
    """``rows`` has vec_id, label, codes (array of int) and error; ``codebooks`` is (part, entry, component)."""

    rows: DataFrame
    codebooks: np.ndarray


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of whole numbers as rows, zeros after the end of those shorter than ``width``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def quantized(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Whole-number vectors of the rows whose vector is whole: not null, and no component null, infinite or not a number."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            whole = column.is_valid().to_numpy(zero_copy_only=False)
            flat = column.flatten()
            good = np.isfinite(flat.to_numpy(zero_copy_only=False)) & flat.is_valid().to_numpy(zero_copy_only=False)
            sizes = np.where(whole, np.diff(column.offsets.to_numpy()), 0)
            bad = np.bincount(np.repeat(np.arange(len(sizes)), sizes), ~good, len(sizes)) > 0
            keep = whole & ~bad
            values = np.clip(np.floor(flat.to_numpy(zero_copy_only=False)[np.repeat(keep, sizes)] * SCALE), -LARGEST, LARGEST).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes[keep]))).astype(np.int32), pa.array(values))
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), lists], ["vec_id", "label", "v"])

    types = {x: rows.schema[x].dataType.simpleString() for x in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {types['vec_id']}, label {types['label']}, v array<int>")


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` from each entry."""
    if max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) <= _SMALL:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.zeros((len(x), len(entries)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - entries[None, :, k]) ** 2
    return out


@dataclass
class Bounds:
    """What one part of some vectors carries: its entry, the lower bound of the others' distances, the bound's round."""

    code: np.ndarray
    low: np.ndarray
    stamp: np.ndarray


def moved(history: list[np.ndarray], since: int) -> np.ndarray:
    """How far each entry of one part has moved, net, from round ``since`` to the last."""
    return np.sqrt(((history[-1] - history[since]).astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)


def assign(x: np.ndarray, history: list[np.ndarray], known: Bounds | None = None) -> tuple[Bounds, np.ndarray, int]:
    """Nearest entry of the last codebook for each row, ties to the lower index.

    ``history`` has the part's codebook of each round.  Returns the new bounds,
    the exact squared distances from the entries given, and how many rows had
    to be compared with all entries.
    """
    now, last = history[-1], len(history) - 1
    n = len(x)
    if known is None:
        known = Bounds(np.zeros(n, np.uint8), np.zeros(n, np.float32), np.zeros(n, np.uint8))
        error, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    else:
        error = ((x - now[known.code]) ** 2).sum(1)
        bound = known.low.astype(np.float64)
        for since in range(last):
            at = np.flatnonzero(known.stamp == since)
            far = moved(history, since)
            first = int(far.argmax())
            others = np.delete(far, first).max(initial=0.0)
            bound[at] -= np.where(known.code[at] == first, others, far[first])
        bound = np.maximum(bound, 0.0)
        open_ = ~(bound * bound * (1 - 1e-9) > error)
    code, low, stamp = known.code.copy(), known.low.copy(), known.stamp.copy()
    at = np.flatnonzero(open_)
    if len(at):
        far = distances(x[at], now)
        best = far.argmin(1)
        error[at] = far[np.arange(len(at)), best]
        code[at], stamp[at] = best, last
        if len(now) > 1:
            far[np.arange(len(at)), best] = np.iinfo(np.int64).max
            low[at] = np.sqrt(far.min(1).astype(np.float64)) * (1 - 1e-6)
        else:
            low[at] = np.inf
    return Bounds(code, low, stamp), error, len(at)


def _bytes(column: pa.Array, kind: str, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), parts)


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.ascontiguousarray(values)], pa.binary())


def assigned(rows: DataFrame, history: list[np.ndarray], ids: dict[str, str]) -> DataFrame:
    """One round: rows ``vec_id, label, v`` (and, after the first, ``code, low, stamp``) with new bounds and the ``error``."""
    parts, _, width = history[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(first, CHUNK_ROWS)
                x = _matrix(batch.column(2), parts * width).reshape(-1, parts, width)
                known = [_bytes(batch.column(i), kind, parts) for i, kind in ((3, "u1"), (4, "<f4"), (5, "u1"))] if batch.num_columns > 3 else None
                made = [assign(x[:, p], [h[p] for h in history], Bounds(*(k[:, p] for k in known)) if known else None) for p in range(parts)]
                state = [_binary(np.stack([getattr(m[0], name) for m in made], 1)) for name in ("code", "low", "stamp")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *state, pa.array(sum(m[1] for m in made))], ["vec_id", "label", "v", "code", "low", "stamp", "error"])

    return rows.mapInArrow(run, f"vec_id {ids['vec_id']}, label {ids['label']}, v array<int>, code binary, low binary, stamp binary, error long")


def updated(rows: DataFrame, now: np.ndarray) -> np.ndarray:
    """The codebooks of means, rounded down; an entry that no part was given stays.

    Each task adds up what it reads; its sums, as many as the codebooks have
    components, meet by key.
    """
    parts, entries, width = now.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK_ROWS):
                batch = whole.slice(first, CHUNK_ROWS)
                x = _matrix(batch.column(0), parts * width).reshape(-1, parts, width)
                np.add.at(total, _bytes(batch.column(1), "u1", parts) + entries * np.arange(parts), np.concatenate([x, np.ones((len(x), parts, 1), np.int64)], 2))
        at = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([*total[at]], pa.list_(pa.int64()))], ["entry", "sums"])

    found = rows.select("v", "code").mapInArrow(run, "entry int, sums array<long>")
    found = found.select("entry", F.posexplode("sums").alias("place", "value")).groupBy("entry", "place").agg(F.sum("value").alias("value"))
    sums = np.zeros((parts * entries, width + 1), np.int64)
    for r in found.collect():
        sums[r.entry, r.place] = r.value
    counts = sums[:, -1:]
    means = sums[:, :-1] // np.maximum(counts, 1)
    return np.where(counts > 0, means, now.reshape(-1, width)).reshape(now.shape)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codes:
    """Codes of all vectors, and the codebooks behind them.

    Rows whose vector is null or has a null, infinite or undefined component are
    left out.  A component x becomes floor(256 x), held within 2**24 either way;
    a vector is cut into equal parts, after zeros at its end where the longest
    vector, rounded up to a multiple of ``parts``, is longer.  Codebooks start
    from the rows of the smallest ids (null ids last, equal ids by their
    vectors), at most ``entries`` of them (256 at most); each round assigns all
    parts and moves each entry to the floor of its parts' mean; a last
    assignment follows.  Repeated rows are rows of their own.  An empty table
    gives no rows and empty codebooks.

    Every round reads the table that the one before it wrote to the shared
    folder, so a lost executor costs its tasks only.  The driver holds codebooks
    (``entries`` times the components of a vector for each round), which are
    also what tasks get.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    rows = stored(quantized(vectors, id_col, vector_col, label_col), "vectors")
    ids = {x: rows.schema[x].dataType.simpleString() for x in ("vec_id", "label")}
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    if not seeds:
        empty = rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return Codes(empty, np.zeros((parts, 0, width), np.int64))
    start = _matrix(pa.array([r.v for r in seeds], pa.list_(pa.int32())), parts * width)
    history = [np.ascontiguousarray(start.reshape(len(seeds), parts, width).transpose(1, 0, 2))]
    for _ in range(rounds):
        rows = stored(assigned(rows, history, ids), "vector_round").drop("error")
        history.append(updated(rows, history[-1]))
    made = assigned(rows, history, ids).select("vec_id", "label", F.transform(F.sequence(F.lit(1), F.lit(parts)), _code_at).alias("codes"), "error")
    return Codes(stored(made, "vector_codes"), history[-1])


def _code_at(place: Column) -> Column:
    return F.conv(F.hex(F.substring(F.col("code"), place, F.lit(1))), 16, 10).cast("int")


def decompress(codes: Codes) -> DataFrame:
    """The vectors that codes stand for, in whole numbers: ``vec_id`` and ``v``."""
    books = F.array(*(F.array(*(F.array(*map(F.lit, entry.tolist())) for entry in part)) for part in codes.codebooks))
    return codes.rows.select("vec_id", F.flatten(F.transform("codes", lambda c, i: F.get(F.get(books, i), c))).alias("v"))


def digests(codes: Codes) -> DataFrame:
    """Codes in hexadecimal, errors, their sums over equal labels (null ones together) and the SHA-256 of the codebooks."""
    print_ = hashlib.sha256(",".join(map(str, codes.codebooks.ravel().tolist())).encode()).hexdigest()
    sums = codes.rows.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    # two columns that are never null, so that null labels meet each other in an ordinary join
    key = [F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit(0)).alias("_label")]
    joined = codes.rows.select("*", *key).join(sums.select("label_error", *key), ["_none", "_label"])
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return joined.select("vec_id", code.alias("code"), "error", "label_error", F.lit(print_).alias("codebooks_sha256"))
