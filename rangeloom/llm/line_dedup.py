"""Fuzzy line deduplication across documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm import _text as T
from rangeloom.llm._store import stored
from rangeloom.llm.components import connected_components

#: Lines of fewer words are left alone; a line needs one word at least.
MIN_WORDS = 1
#: Percent of edit similarity, over words, that makes two lines one.
PERCENT = 90
#: Least percent at which two lines as near as that always share a pair of neighbouring words.
LEAST_PERCENT = 67
#: Words are counted by bucket, to tell rare ones from frequent ones.
BUCKETS = 1 << 18
#: Words up to which lines have signs, as comparing those takes the words times the allowed edits; longer ones are told apart by the rest.
SIGNED_WORDS = 64
#: Orders in which a line's least key is noted, to count a pair of lines at one of the keys that they share.
KEY_MINIMA = 8
#: Text bytes handled at once, few enough for the caches of cores that all do so.
CHUNK_BYTES = 1 << 17
#: Counted buckets in one row.
SLICE = 1 << 12
#: Bytes of normalised lines: A-Z are lower-cased, other ASCII characters than letters and digits are spaces.
_PLAIN = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def normalised(line: bytes) -> bytes:
    """A-Z lower-cased; every run of other ASCII characters than letters and digits is one space, and none at the ends."""
    return b" ".join(line.translate(_PLAIN).split())


def _line_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each bounded chunk of texts: every line's row and number in its text, the bounds of its words, and the words' hashes."""
    table = np.frombuffer(_PLAIN, np.uint8)
    for row, end, data, offsets in T.chunks(column, CHUNK_BYTES):
        plain = table[data]
        breaks = np.flatnonzero(data == 10) + 1
        # a text's lines begin at its start and after each newline; an empty text has one line
        owner = np.searchsorted(offsets, breaks - 1, "right") - 1
        begins = np.concatenate((offsets[:-1], breaks))
        owners = np.concatenate((np.arange(end - row), owner))
        order = np.lexsort((np.concatenate((np.zeros(end - row, np.int8), np.ones(len(breaks), np.int8))), begins, owners))
        begins, owners = begins[order], owners[order]
        first = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(owners) else np.zeros(0, np.int64)
        number = np.arange(len(owners)) - np.repeat(first, np.diff(np.r_[first, len(owners)]))
        starts, ends, _ = T.word_spans(plain, np.append(begins, len(data)))
        yield owners + row, number, np.append(np.searchsorted(starts, begins), len(starts)), T.word_hashes(plain, starts, ends)


def _line_ids(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hash of each line's words in order; 0 for a line without words."""
    counts = np.diff(bounds)
    full = np.flatnonzero(counts)
    ids = np.zeros(len(counts), np.uint64)
    if len(full):
        at = bounds[:-1][full]
        place = np.arange(len(words)) - np.repeat(at, counts[full])
        ids[full] = T.mix(np.add.reduceat(T.mix(words + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), at) + counts[full].astype(np.uint64))
    return ids


def line_prints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, line, id, low_print, high_print, signs, n_words, counted) of every line of (doc_id, text_hash, text) rows.

    Each task ends with rows of line -1 that hold how many of the task's words
    fell in each of SLICE hash buckets, as unsigned numbers of 32 bits in
    ``counted`` (else null), and the slice as text_hash; ``word_levels`` adds them
    up.  Each text has a row of line -2 with its number of lines as id.

    ``id`` is a 64-bit hash of the normalised line and ``line`` counts the text's
    lines from 0.  A print has 128 bits, each the parity of the number of words
    that hash to it, so that one edit changes two bits at most.  ``signs`` has a
    character of 127 for each word of a line of SIGNED_WORDS or fewer, so that
    its edit distances are those over words or, where different words have one
    sign, below.
    """

    names = ["doc_id", "text_hash", "line", "id", "low_print", "high_print", "signs", "n_words", "counted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids_type, fresh = np.zeros(BUCKETS, np.int64), None, []
        for batch in batches:
            ids_type, n_lines = batch.column(0).type, np.zeros(batch.num_rows, np.int64)
            for owners, number, bounds, words in _line_words(batch.column(2)):
                n_lines += np.bincount(owners, minlength=len(n_lines))
                fresh.append((words & np.uint64(BUCKETS - 1)).astype(np.int32))
                if sum(map(len, fresh)) > 4 * BUCKETS:
                    total += np.bincount(np.concatenate(fresh), minlength=BUCKETS)
                    fresh = []
                counts = np.diff(bounds)
                full = np.flatnonzero(counts)
                prints = np.zeros((2, len(counts)), np.uint64)
                if len(full):
                    one = np.uint64(1) << (words & np.uint64(63))
                    for half in (0, 1):
                        mine = (words >> np.uint64(6)) & np.uint64(1) == half
                        prints[half, full] = np.bitwise_xor.reduceat(np.where(mine, one, np.uint64(0)), bounds[:-1][full])
                signed = counts <= SIGNED_WORDS
                signs = np.maximum(words >> np.uint64(57), np.uint64(1)).astype(np.uint8)[np.repeat(signed, counts)]
                edges = np.append(0, np.cumsum(np.where(signed, counts, 0))).astype(np.int32)
                signs = pa.StringArray.from_buffers(len(counts), pa.py_buffer(edges), pa.py_buffer(signs))
                take = pa.array(owners)
                ids, low, high = (pa.array(x.view(np.int64)) for x in (_line_ids(words, bounds), prints[0], prints[1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(number.astype(np.int32)), ids, low, high, signs, pa.array(counts.astype(np.int32)), pa.nulls(len(counts), pa.binary())],
                    names,
                )
            zero, small = pa.array(np.zeros(len(n_lines), np.int64)), pa.array(np.zeros(len(n_lines), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.full(len(n_lines), -2, np.int32)), pa.array(n_lines), zero, zero]
                + [pa.array([""] * len(n_lines)), small, pa.nulls(len(n_lines), pa.binary())],
                names,
            )
        if fresh:
            total += np.bincount(np.concatenate(fresh), minlength=BUCKETS)
        while total.any():
            part = np.minimum(total, (1 << 32) - 1)
            total -= part
            slices = [x.tobytes() for x in part.astype(np.uint32).reshape(-1, SLICE)]
            zero, small = pa.array(np.zeros(len(slices), np.int64)), pa.array(np.zeros(len(slices), np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(slices), ids_type), pa.array(np.arange(len(slices))), pa.array(np.full(len(slices), -1, np.int32)), zero, zero, zero]
                + [pa.array([""] * len(slices)), small, pa.array(slices, pa.binary())],
                names,
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_hash long, line int, id long, low_print long, high_print long, signs string, n_words int, counted binary")


def word_levels(prints: DataFrame) -> np.ndarray:
    """How frequent the words of each hash bucket are in all texts, on a logarithmic scale, from the rows of ``line_prints``."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[at] = totals.get(at, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array([x.tobytes() for x in totals.values()], pa.binary())], ["slice", "counted"])

    counts = prints.where("line = -1").select(F.col("text_hash").alias("slice"), "counted").repartition("slice").mapInArrow(added, "slice long, counted binary").toArrow()
    levels = np.zeros(BUCKETS, np.int64)
    for at, counted in zip(counts.column(0).to_pylist(), counts.column(1).to_pylist(), strict=True):
        levels[at * SLICE : (at + 1) * SLICE] = (4 * np.log2(1 + np.frombuffer(counted, np.int64))).astype(np.int64)
    return levels


def pairs_needed(longest: int, percent: int) -> np.ndarray:
    """For each number of words up to ``longest``: how many of a line's pairs of neighbouring words, the first in a common order, meet every line like it.

    A longer line of m words keeps m - 1 - 2e of its m - 1 pairs through e
    edits; so a line of n words lacks at most n - m + 2e of its own, and one
    pair more is shared.
    """
    n = np.arange(longest + 1)
    need = np.zeros(longest + 1, np.int64)
    for more in range(longest * (100 - percent) // percent + 1):
        m = n + more
        near = n * 100 >= m * percent
        need = np.maximum(need, np.where(near, 2 * (m * (100 - percent) // 100) - more + 1, 0))
    return need


def _by_line_and_level(line: np.ndarray, level: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Order of pairs by line, level and hash: one sort of the packed columns, and a full one where those don't tell all pairs apart."""
    if not len(line):
        return np.zeros(0, np.int64)
    above, middle = int(line.max()).bit_length(), int(level.max()).bit_length()
    below = 64 - above - middle
    packed = (line.astype(np.uint64) << np.uint64(64 - above)) if above else np.zeros(len(line), np.uint64)
    packed |= (level.astype(np.uint64) << np.uint64(below)) | (pair >> np.uint64(64 - below))
    order = np.argsort(packed)
    packed, tied = packed[order], pair[order]
    if ((packed[1:] == packed[:-1]) & (tied[1:] != tied[:-1])).any():
        return np.lexsort((pair, level, line))
    return order


def edits_allowed(longest: int, percent: int) -> np.ndarray:
    """For each number of words up to ``longest``: the most edits to any line like it."""
    return np.arange(longest + 1) * 100 // percent * (100 - percent) // 100


def first_pairs(line: np.ndarray, order: np.ndarray, need: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Which pairs, in ``order``, are among the first of their line that its edits can't reach all of.

    ``line`` has each pair's line, by place, and ``order`` sorts pairs by line
    first.  An edit reaches two pairs at most, and those are neighbours.  Pairs
    that come before both of their neighbours are no neighbours of each other,
    so edits reach no more of them than there are edits.  A line's pairs are
    taken until more than its ``edits`` such ones are, or ``need`` in all.
    """
    if not len(order):
        return np.zeros(0, bool)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    edge = line[1:] != line[:-1]
    rises = rank[1:] > rank[:-1]
    lone = (np.r_[True, ~rises | edge] & np.r_[rises | edge, True])[order]
    # lines keep their places in the order
    first = np.flatnonzero(np.r_[True, edge])
    length = np.diff(np.r_[first, len(order)])
    before = np.cumsum(lone) - lone
    before -= np.repeat(before[first], length)
    place = np.arange(len(order)) - np.repeat(first, length)
    return (place < need[line]) & (before <= edits[line])


def line_keys(docs: DataFrame, levels: np.ndarray, percent: int, fewest: int) -> DataFrame:
    """Rows (key, id) of the lines of ``fewest`` words or more of (text) rows; lines alike by ``percent`` share a key.

    The keys are a line's first pairs of neighbouring words in a common order,
    until the allowed edits can't reach all of them: as many as
    ``pairs_needed`` says, or until more than the edits have no word in common
    (``first_pairs``).  So one of them stands in each line as near, and of two
    lines the one whose last key comes first has it among the other's keys
    too.  A pair counts at all of its places and is one key.  Any order of the
    pairs would lose nothing; the levels of rare words keep groups small, and as
    the first word weighs more than the second, a rare word brings one of its
    two pairs to the front, not both.
    """
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, need, edits = shared.value, pairs_needed(256, percent), edits_allowed(256, percent)
        for batch in batches:
            for _, _, bounds, words in _line_words(batch.column(0)):
                counts = np.diff(bounds)
                if len(counts) and counts.max() >= len(need):
                    longest = 2 * int(counts.max())
                    need, edits = pairs_needed(longest, percent), edits_allowed(longest, percent)
                line = np.repeat(np.arange(len(counts)), counts)
                at = np.flatnonzero((line[1:] == line[:-1]) & (counts[line[1:]] >= fewest))
                line = line[at]
                level = levels[(words & np.uint64(BUCKETS - 1)).astype(np.int64)]
                level = 4 * level[at] + level[at + 1]
                pair = T.mix(words[at] * np.uint64(0x9E3779B97F4A7C15) + T.mix(words[at + 1]))
                order = _by_line_and_level(line, level, pair)
                taken = first_pairs(line, order, need[counts], edits[counts])
                line, pair = line[order], pair[order]
                taken &= np.r_[True, (pair[1:] != pair[:-1]) | (line[1:] != line[:-1])][: len(pair)]
                keys, ids = pair[taken], _line_ids(words, bounds)[line[taken]]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids.view(np.int64))], ["key", "id"])

    return docs.select("text").mapInArrow(run, "key long, id long")


def shared_blocks(keyed: DataFrame) -> DataFrame:
    """Rows (key, id, size) of the keys that several ids have; keys that the same ids have become one.

    A block's new key is a hash of its ids, so that lines which share many keys
    meet once; ``size`` counts its ids.
    """
    block = Window.partitionBy("key")
    several = keyed.repartition("key").select("key", "id", F.min("id").over(block).alias("lo"), F.max("id").over(block).alias("hi")).where("lo < hi")
    # sums of 32 bits can't overflow
    parts = [F.sum(F.xxhash64(F.lit(i), "id").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).over(block) for i in (0, 1)]
    several = several.select("key", "id").distinct().select("id", F.count("*").over(block).alias("size"), *parts).toDF("id", "size", "p", "q")
    return several.select(F.xxhash64("size", "p", "q").alias("key"), "id", "size").distinct()


def block_keys(print_: Column, blocks: int, radius: int) -> Column:
    """A key for each choice of blocks - radius blocks; prints within radius bits agree on one of them at least."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.xxhash64(F.lit(n), print_.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def edits_within(a: list, b: list, most: int) -> bool:
    """Whether at most ``most`` words need be put in, taken out or replaced to turn a into b.

    Walks diagonals by the farthest place that each number of edits reaches, so
    that near texts cost their length and the square of their few edits.
    """
    if abs(len(a) - len(b)) > most:
        return False
    lo, end_a, end_b = 0, len(a), len(b)
    while lo < min(end_a, end_b) and a[lo] == b[lo]:
        lo += 1
    while min(end_a, end_b) > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[lo:end_a], b[lo:end_b]
    n, m = len(a), len(b)
    goal = m - n
    far = {0: -1}
    for e in range(most + 1):
        now = {}
        # no farther from the last diagonal than the edits left
        for k in range(max(-min(e, n), goal - most + e), min(e, m, goal + most - e) + 1):
            if e == 0:
                i = 0
            else:
                # a word replaced, taken out of a, or put in from b
                i = max(far.get(k, -2) + 1, far.get(k + 1, -2) + 1, far.get(k - 1, -2))
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            if k == goal and i >= n:
                return True
            now[k] = i
        far = now
    return False


def word_signs(texts: DataFrame) -> DataFrame:
    """Rows (id, signs) of (id, text) rows of normalised lines in UTF-8, however long: a character of 127 for each word."""
    sign = lambda word: F.char(F.pmod(F.xxhash64(word), F.lit(127)) + 1)
    return texts.select("id", F.array_join(F.transform(F.split(F.col("text").cast("string"), " "), sign), "").alias("signs"))


def alike_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, s, t) whose texts in UTF-8 have the edit similarity, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = s.split(b" "), t.split(b" ")
                most = max(len(x), len(y)) * (100 - percent) // 100
                good.append((len(x) == len(y) and sum(map(ne, x, y)) <= most) or edits_within(x, y, most))
            kept = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return pairs.select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def wanted_lines(texts: DataFrame) -> DataFrame:
    """Rows (id, text in UTF-8) of the normalised lines whose ids and numbers (text, ids, lines) rows list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            texts = batch.column(0).cast(pa.large_binary())
            for row in range(len(texts)):
                lines = texts[row].as_py().split(b"\n")
                ids += batch.column(1)[row].as_py()
                found += [normalised(lines[i]) for i in batch.column(2)[row].as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary())], ["id", "text"])

    return texts.mapInArrow(run, "id long, text binary")


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT
) -> DataFrame:
    """Which lines of each document repeat another line.

    Returns ``doc_id``, ``text_hash``, ``n_lines`` (split at \\n; none for null
    text), ``n_removed`` and ``removed`` (line numbers from 0, ascending), one
    row for each input row.  Lines of fewer than ``min_words`` words stay.

    Equal normalised lines are one line.  Different ones are linked if their
    normalised texts have an edit similarity over words (1 - distance / words
    of the longer) of ``percent`` / 100 or more; ``percent`` is 67 at least.
    Candidates are found without loss: they share one of their rarest pairs of
    neighbouring words, enough of which are taken for the edits that their
    lengths allow; the parities of their words differ in no more bits, and the
    signs of those compared within a block in no more edits, than that
    similarity allows (of lines of over SIGNED_WORDS words once their texts are
    at hand).  Pairs that the same lines share are one block, and a pair of
    lines counts at one of the blocks that it shares.  A block of lines
    that share a pair is compared with its most frequent and its smallest line
    first, and within itself only where that leaves several groups; so a block
    of copies costs what it holds, and no link between groups is lost.  The
    words of all candidates are compared in the end.  Of all occurrences in a
    connected group the one with the smallest document id and line number
    stays.  Null ids sort first; rows that repeat an id and text have their
    lines removed alike.  An empty table gives an empty result; other columns
    are ignored.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"percent is {percent}; lines less alike than {LEAST_PERCENT} need share no pair of words")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    prints = line_prints(base.where("text IS NOT NULL").select("doc_id", "text_hash", "text"))
    prints = stored(prints.where((F.col("n_words") >= max(1, min_words)) | (F.col("line") < 0)), "lines")
    lines = prints.where("line >= 0")
    values = [F.min(c).alias(c) for c in ("low_print", "high_print", "signs")]
    distinct = lines.groupBy("id").agg(F.min(F.struct("doc_id", "line", "text_hash")).alias("first"), F.count("*").alias("n"), F.min("n_words").alias("words"), *values)
    distinct = stored(distinct, "distinct_lines")

    # a line of so few words that no edit is allowed has no other line like it
    fewest = max(min_words, -(-100 // (100 - percent)) - 1) if percent < 100 else 1 << 30
    block = Window.partitionBy("key")
    keyed = stored(shared_blocks(line_keys(base.where("text IS NOT NULL"), word_levels(prints), percent, fewest)), "line_keys")
    # blocks of two lines are compared as stars; in others, a pair counts at the first least key that both
    # lines have, and at every shared key only if they have none
    least = keyed.where("size > 2").groupBy("id").agg(*(F.min_by("key", F.xxhash64(F.lit(i), "key")).alias(f"m{i}") for i in range(KEY_MINIMA)))
    least = least.select("id", F.array(*(f"m{i}" for i in range(KEY_MINIMA))).alias("least"))
    columns = ["id", "low_print", "high_print", "words"]
    busy = stored(distinct.select(*columns, "signs").join(least, "id"), "busy_lines")

    def near(x: str, y: str) -> Column:
        """Of lengths and words' parities that the similarity allows; among e edits of lines whose lengths differ by d are d that change one bit."""
        a, b = F.col(f"{x}words"), F.col(f"{y}words")
        sizes = F.least(a, b) * 100 >= F.greatest(a, b) * percent
        edits = F.floor(F.greatest(a, b) * (100 - percent) / 100).cast("int")
        bits = [F.bit_count(F.col(f"{x}{half}_print").bitwiseXOR(F.col(f"{y}{half}_print"))) for half in ("low", "high")]
        return sizes & (bits[0] + bits[1] <= 2 * edits - F.abs(a - b))

    def near_signs(x: str, y: str) -> Column:
        """Of signs within the edits that the similarity allows, where both lines have signs."""
        edits = F.floor(F.greatest(F.col(f"{x}words"), F.col(f"{y}words")) * (100 - percent) / 100).cast("int")
        signs = F.col(f"{x}signs"), F.col(f"{y}signs")
        return (F.least(*map(F.length, signs)) == 0) | (F.call_function("levenshtein", *signs, edits) >= 0)

    one = F.struct(*columns)
    leads = [F.max_by(one, F.struct("n", "id")).over(block), F.min_by(one, "id").over(block)]
    stars = keyed.join(distinct.select(*columns, "n"), "id").select("key", *columns, F.array(*leads).alias("leads"))
    stars = stars.select(*columns, F.explode(F.array_distinct("leads")).alias("lead")).where((F.col("id") != F.col("lead.id")) & near("", "lead."))
    stars = stars.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b")).distinct()
    stars = stored(stars, "line_stars")

    def across(groups: DataFrame, among: DataFrame | None = None, signs: DataFrame | None = None) -> DataFrame:
        """Near pairs that share a block but no group, from blocks that hold several groups (of those in ``among`` only, with the ``signs``, if given)."""
        placed = keyed.where("size > 2").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("g"))
        if among is not None:
            placed = placed.join(among, "g", "left_semi")
        values = busy if signs is None else busy.drop("signs").join(signs, "id")
        mixed = placed.select("*", F.min("g").over(block).alias("lo"), F.max("g").over(block).alias("hi")).where("lo < hi")
        placed = stored(mixed.select("key", "id", "g").join(values, "id"), "mixed_blocks")
        once = F.lit(True)
        for i in reversed(range(KEY_MINIMA)):
            once = F.when(F.get("x.least", F.lit(i)) == F.get("y.least", F.lit(i)), F.col("x.key") == F.get("x.least", F.lit(i))).otherwise(once)
        same = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.g") != F.col("y.g")) & near("x.", "y.") & once & near_signs("x.", "y.")
        return placed.alias("x").join(placed.alias("y"), same).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()

    # candidates that join the stars' groups; with them, every line that has a candidate is known
    first = stored(stars.unionByName(across(connected_components(stars))), "line_pairs")
    wanted = first.select(F.col("a").alias("id")).union(first.select("b")).distinct().join(distinct.select("id", "first"), "id")
    wanted = wanted.groupBy("first.doc_id", "first.text_hash").agg(F.collect_list(F.struct("id", "first.line")).alias("wanted"))
    texts = wanted.hint("shuffle_hash").alias("w").join(base.alias("t"), F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.text_hash") == F.col("t.text_hash")))
    texts = wanted_lines(texts.select("text", F.col("wanted.id").alias("ids"), F.col("wanted.line").alias("lines")))
    texts = stored(texts.dropDuplicates(["id"]), "line_texts")
    x, y = texts.select(F.col("id").alias("a"), F.col("text").alias("s")), texts.select(F.col("id").alias("b"), F.col("text").alias("t"))
    alike = lambda pairs: alike_pairs(pairs.join(x, "a").join(y, "b"), percent)
    links = stored(alike(first), "line_links")
    # candidates whose lines are still apart, now that alike ones are known; lines that candidates linked
    # are apart only if one of those between their groups wasn't alike
    groups = connected_components(links)
    ends = [groups.select(F.col("id").alias(c), F.col("component").alias(f"g{c}")) for c in ("a", "b")]
    apart = first.join(links, ["a", "b"], "left_anti").join(ends[0], "a", "left").join(ends[1], "b", "left")
    apart = apart.select(F.coalesce("ga", "a").alias("x"), F.coalesce("gb", "b").alias("y")).where("x != y")
    apart = stored(apart.select(F.explode(F.array("x", "y")).alias("g")).distinct(), "line_groups")
    own = groups.join(apart, groups["component"] == apart["g"], "left_semi").select("id").union(apart.select("g")).distinct()
    rest = across(groups, apart, word_signs(texts.join(own, "id", "left_semi"))).join(first, ["a", "b"], "left_anti")
    group = connected_components(links.unionByName(alike(rest)))

    grouped = distinct.select("id", "first", "n").join(group, "id", "left").where("n > 1 OR component IS NOT NULL")
    grouped = grouped.select("id", F.coalesce("component", "id").alias("group"), "first", "n")
    keeper = grouped.groupBy("group").agg(F.min("first").alias("keeper"), F.sum("n").alias("n")).where("n > 1")
    kept = grouped.join(keeper.drop("n"), "group").select("id", "keeper")
    other = ~(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("line") == F.col("keeper.line")) & (F.col("text_hash") == F.col("keeper.text_hash")))
    removed = lines.join(kept, "id").where(other).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line")).alias("removed"))
    none = base.where("text IS NULL").select("doc_id", "text_hash", F.lit(0).cast("long").alias("n_lines"))
    counts = prints.where("line = -2").select("doc_id", "text_hash", F.col("id").alias("n_lines")).union(none).alias("c")
    found = counts.join(removed.alias("r"), F.col("c.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("c.text_hash") == F.col("r.text_hash")), "left")
    removed_ = F.coalesce("removed", F.array().cast("array<int>"))
    return found.select("c.doc_id", "c.text_hash", "n_lines", F.size(removed_).cast("long").alias("n_removed"), removed_.alias("removed"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts; other columns and all rows stay."""
    found = repeated_lines(docs, id_col, text_col, **options).where("n_removed > 0").dropDuplicates(["doc_id", "text_hash"])
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("removed").alias("_removed"))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_hash"))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains(F.col("_removed"), i)), "\n")
    return docs.join(found, same, "left").withColumn(text_col, F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(kept)).select(docs.columns)
