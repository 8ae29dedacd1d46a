"""Word and shingle helpers shared by the text operators.

Two forms of the same word definition live here: Spark column expressions for
operators that stay in the JVM, and numpy kernels over an Arrow batch's UTF-8
bytes for operators that run inside ``mapInArrow``.  Neither loops over words
in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words, as a Java and Python character class body.
SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Text bytes handled at once by the numpy kernels; bounds their temporaries.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def words(text: Column) -> Column:
    """Array of white-space separated words; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    """Number of words, as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    A higher-order function's body would otherwise evaluate an expression that
    does not depend on its element once per element.
    """
    return F.transform(F.array(value), body)[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that every bit depends on every other."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, up to n."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE, np.uint64)])
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(_BASE, -1, 1 << 64), np.uint64)])
    return _powers, _inverses


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets) of bounded size.

    A single text above the bound forms a chunk of its own; texts are never cut.
    """
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-case the ASCII capitals of UTF-8 bytes."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and one past the last) in a chunk."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, inside[:-1]] if len(data) else inside
    after = np.r_[inside[1:], False] if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, by prefix sums of a rolling polynomial."""
    powers, inverses = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=prefix[1:])
    value = (prefix[ends] - prefix[starts]) * inverses[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(words_: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word shingles and the bounds of each text's run of them.

    A text with fewer words than ``width`` has its whole sequence as its only
    shingle; one without words has none.
    """
    counts = np.diff(bounds)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.concatenate(([0], np.cumsum(n)))
    first = np.repeat(bounds[:-1] - out[:-1], n) + np.arange(out[-1])
    length = np.repeat(np.minimum(counts, width), n)
    total = length.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for k in range(width):
        use = k < length
        at = np.where(use, first + k, 0)
        word = words_[at] if len(words_) else np.zeros(len(at), np.uint64)
        total = np.where(use, mix(total + word) * np.uint64(0xE7037ED1A0B428DB | 1), total)
    return mix(total), out
