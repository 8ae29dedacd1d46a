"""Audit of filters in every order: what each removes, what others would have removed, and what it costs."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm import _text as T
from rangeloom.llm._store import stored

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
#: Counters of the sketch for each document, and how many of a block's 64 a text has.
SLOTS, PROBES = 16, 4
#: A sketch of as many blocks at most is sent to every task (some 48 bytes a block there).
BROADCAST_BLOCKS = 1 << 20


def failed_filters(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A (short), B (repetitive), C (capitals) and D (symbols)."""
    sized = T.let(T.words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))

    def bits(s: Column) -> Column:
        tests = [
            s["n"] < 100,
            s["d"] * 100 < s["n"] * 80,
            F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
            text.rlike(r"[#$%&*|]"),
        ]
        return reduce(lambda a, b: a + b, (F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)))

    return T.let(sized, bits)


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g")]


def _probes() -> Column:
    """The places, within its block, that a text counts at; each once."""
    return F.array_distinct(F.array(*(F.shiftrightunsigned("g", 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(PROBES))))


def counting_sketch(keys: DataFrame, blocks: int) -> DataFrame:
    """Counters of a blocked counting Bloom filter, as the bits of those that counted two texts or more.

    Each task counts what it reads; its counters are merged by their place.  One
    row, ``block`` and ``many``, for each block with such a counter.
    """
    counted = keys.select(F.pmod("h", F.lit(blocks)).alias("block"), F.explode(_probes()).alias("place")).groupBy("block", "place").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").groupBy("block").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("many"))


def with_possible(rows: DataFrame, sketch: DataFrame, blocks: int, small: bool, how: str) -> DataFrame:
    """Rows with keys ``h, g`` and ``possible``: whether all of the text's counters counted other texts too."""
    mask = reduce(lambda a, b: a.bitwiseOR(b), (F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(g, {6 * i}) & 63L AS INT))") for i in range(PROBES)))
    joined = rows.withColumn("block", F.pmod("h", F.lit(blocks))).join(F.broadcast(sketch) if small else sketch, "block", how)
    return joined.withColumn("possible", F.coalesce(F.col("many").bitwiseAND(mask) == mask, F.lit(False))).drop("block", "many")


def failures(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", blocks: int | None = None, broadcast_blocks: int = BROADCAST_BLOCKS
) -> DataFrame:
    """The filters that each document fails: ``doc_id``, ``part`` and ``mask``, one row for each input row.

    A: under 100 words; B: fewer than 80% distinct words; C: over 10% capitals
    A-Z; D: one of ``#$%&*|``; E: the text of a smaller id, wherever that is.
    Null text counts as empty, null part as the empty string.  Rows with equal
    ids are told apart by their texts; rows of the smallest id of a text all
    pass E.  A null id is smaller than none, and its row passes E.

    Texts are told to be unique by a counting Bloom sketch, merged from those of
    all tasks: a text with a counter at one has no copy.  Only the others meet
    by their full text for its smallest id.  The sketch grows with the table
    (SLOTS counters a document).  Up to ``broadcast_blocks`` blocks it goes to
    every task, and texts without a copy stay where they are; beyond, rows of
    two hashes, length and SHA-256 of the whole text take the texts' place, so
    that no text moves at all.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    marked = stored(base.select("doc_id", "part", *_keys(F.col("text")), failed_filters(F.col("text")).alias("mask")), "filter_marks")
    blocks = blocks or max(1, marked.count() * SLOTS // 64)
    sketch = stored(counting_sketch(marked, blocks), "filter_sketch")
    small = sketch.count() <= broadcast_blocks
    whole = [F.col("text")] if small else [F.length("text").alias("length"), F.sha2("text", 256).alias("text")]
    repeats = with_possible(base.select("doc_id", *_keys(F.col("text")), *whole), sketch, blocks, small, "inner").where("possible")
    firsts = repeats.groupBy("h", "g", *(["text"] if small else ["length", "text"])).agg(F.min("doc_id").alias("doc_id"))
    firsts = firsts.select("doc_id", "h", "g", F.lit(True).alias("first"))
    rows = with_possible(marked, sketch, blocks, small, "left").join(firsts, ["doc_id", "h", "g"], "left")
    repeated = F.col("possible") & F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.select("doc_id", "part", (F.col("mask") + F.when(repeated, REPEATED).otherwise(0)).alias("mask"))


def mask_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """How many documents of each part fail exactly the filters of each mask, and how many of them are good or toxic.

    An id is good, or toxic, if any of its rows in ``labels`` says so.
    """
    said = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    return failed.join(said, "doc_id", "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """What every filter does at every step of every order, by part.

    See ``failures`` for the filters and odd rows.  Returns one row for each
    ``part``, ``filter_order`` and ``step``: documents ``kept`` after the step,
    ``removed`` by it, ``redundant`` (failing its filter, removed before),
    ``unique_fails`` (failing its filter only), ``good_lost`` and
    ``toxic_lost`` (removed, of that label) and ``shapley`` (removed by the
    filter, summed over all orders).  All of them are sums over the masks of
    failed filters, of which a part has 32 at most.  No document, no row.
    """
    counts = mask_counts(failures(docs, **columns), labels)
    orders = F.array(*(F.lit("".join(x)) for x in permutations(FILTERS)))
    rows = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = lambda place: F.expr(f"shiftleft(1, instr('{FILTERS}', substring(filter_order, {place}, 1)) - 1)")
    before = reduce(lambda a, b: a + b, (F.when(F.col("step") > i, bit(i)).otherwise(0) for i in range(1, len(FILTERS))))
    rows = rows.select("*", bit("step").alias("own"), before.alias("before"))
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    orders_first = F.lit(len(list(permutations(FILTERS)))) / F.greatest(F.bit_count("mask"), F.lit(1))

    def total(test: Column, value: Column | str = "n") -> Column:
        return F.sum(F.when(test, F.col(value) if isinstance(value, str) else value).otherwise(0)).cast("long")

    return rows.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier).alias("kept"),
        total(fails & ~earlier).alias("removed"),
        total(fails & earlier).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(fails & ~earlier, "good").alias("good_lost"),
        total(fails & ~earlier, "toxic").alias("toxic_lost"),
        # of a mask's filters each comes first in an equal share of the orders, a whole number of them
        total(fails, F.col("n") * orders_first.cast("long")).alias("shapley"),
    )
