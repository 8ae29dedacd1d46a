"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm import _text as T
from rangeloom.llm._store import stored

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 128
SHARD_WORDS = 1 << 20
#: Sources up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 100_000
_UNIT = 1 << 20


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: int = 150, cap: int = 2) -> DataFrame:
    """Targets of sources (``source``, ``source_size``): shares by weight, held to ``cap`` times the size.

    Weights repeat over the sources in code point order, null last.  What the
    cap cuts off is shared again by weight until no target is above its cap.
    That ends at min(cap * size, weight * level) for one level, found from
    running sums over the sources sorted by cap / weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank - 1) % len(weights) + 1)
    ranked = sources.select("source", "source_size", rank.alias("rank"), weight.alias("weight")).withColumn("cap", (F.col("source_size") * cap).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total = F.sum("source_size").over(everything) * (percent / 100)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", level).withColumn("at", F.row_number().over(order))
    first_free = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("at", "level"))).over(everything)["level"]
    target = F.when(first_free.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * first_free))
    return level.select("source", "source_size", "rank", target.alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Allot each group's ``seats`` to its parties by the highest quotients votes / (2k + 1).

    A party's seats are its votes by the common divisor, rounded.  Rounding moves
    each of n parties by a half at most, so votes by divisor add up to the seats
    give or take n / 2; only the quotients within those bounds compete, two or
    so for each party in all.  Ties go to the smaller key.
    """
    whole = Window.partitionBy(*group)
    share = F.when(F.sum(votes).over(whole) > 0, F.col(votes) / F.sum(votes).over(whole)).otherwise(F.lit(0.0))
    half = F.count(F.when(F.col(votes) > 0, 1)).over(whole) / 2
    low, high = share * (F.col(seats) - half) - 0.5, share * (F.col(seats) + half) + 0.5
    sure = parties.withColumns({"_sure": F.greatest(F.floor(low) - 1, F.lit(0)).cast("long"), "_most": (F.ceil(high) + 1).cast("long")})
    sure = sure.withColumn("_open", F.col(seats) - F.sum("_sure").over(whole))
    rivals = sure.where(F.col(votes) > 0).select("*", F.explode(F.sequence(F.col("_sure"), F.col("_most"))).alias("_k"))
    rivals = rivals.withColumn("_place", F.row_number().over(whole.orderBy((F.col(votes) / (2 * F.col("_k") + 1)).desc(), key)))
    won = rivals.groupBy(*group, key).agg((F.min("_sure") + F.count(F.when(F.col("_place") <= F.col("_open"), 1))).alias("quota"))
    return parties.join(won, [*group, key], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def _taken_before(x: Column, block: int) -> Column:
    """Words taken of a shard's first ``x``: full passes, chosen whole blocks, and part of the block that x is in."""
    chosen = lambda j: F.expr(f"({j} * extra * {_UNIT}L + phase * blocks) div (blocks * {_UNIT}L)")
    at = f"({x} div {block})"
    return F.expr(f"passes * {x}") + chosen(at) * block + (chosen(f"({at} + 1)") - chosen(at)) * F.expr(f"{x} % {block}")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    percent: int = 150,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 17,
) -> DataFrame:
    """How many words of each document a mix takes.

    Returns ``doc_id``, ``size``, ``source_size``, ``target`` (of its source)
    and ``taken``, and for cutting texts ``text_hash``, ``start`` (words of its
    shard before it), ``passes``, ``extra``, ``blocks`` and ``phase``; one row
    for each input row.  Null and blank texts have size 0 and are taken 0 times;
    a null source is a source of its own; ids may be null or repeat.  An empty
    table gives an empty result.

    A source's documents fall into shards by a seeded hash, as many as its size
    asks for, so a source with a third of all words is many shards.  Within a
    shard they stand in seeded order and are cut into blocks of ``block_words``.
    Sainte-Lague quotients give each source, then each of its shards, a whole
    number of blocks.  A shard is taken whole as often as its quota allows, and
    of the rest evenly spaced blocks from a seeded start.  All of that is
    arithmetic on a running sum per shard.  A source ends within a block for
    each of its shards from its target, and no document is taken more than twice.
    """
    text = F.col(text_col).cast("string")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), T.n_words(text).alias("size"), F.xxhash64(text).alias("text_hash"))
    sizes = stored(sizes, "sizes")
    sources = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent)
    sources = sources.withColumn("all", F.lit(1)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long"))
    sources = sainte_lague(sources, ["all"], "rank", "target", "seats").withColumn("shards", F.ceil(F.greatest("source_size", F.lit(1)) / shard_words).cast("long"))
    sources = stored(sources.select("source", "source_size", "rank", "target", "shards", F.col("quota").alias("seats")), "sources")

    side = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), F.col("shards"))
    dealt = sizes.join(side.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", spread)
    shards = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"))
    shards = sainte_lague(shards, ["rank"], "shard", "shard_size", "seats")
    blocks = F.greatest(F.ceil(F.col("shard_size") / block_words).cast("long"), F.lit(1))
    shards = shards.withColumn("blocks", blocks).withColumn("quota", F.least("quota", 2 * F.col("blocks")))
    shards = shards.select(
        "rank",
        "shard",
        "blocks",
        F.expr("quota div blocks").alias("passes"),
        F.expr("quota % blocks").alias("extra"),
        F.pmod(F.xxhash64(F.lit(seed), "rank", "shard"), F.lit(_UNIT)).alias("phase"),
    )
    shards = stored(shards, "shards")

    order = Window.partitionBy("rank", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), "doc_id", "text_hash", "size")
    placed = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("start", F.col("end") - F.col("size")).join(shards, ["rank", "shard"])
    taken = (_taken_before("end", block_words) - _taken_before("start", block_words)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "text_hash", "start", "passes", "extra", "blocks", "phase")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, length_col: str | None = None, **options) -> DataFrame:
    """The mix itself: a row for each full pass over a document, and one with the words of its chosen blocks.

    Columns are those of ``docs``; ``length_col``, where named, is set to the new text's length.
    """
    plan = mix(docs, id_col, text_col, block_words=block_words, **options).where("taken > 0").withColumn("part", F.expr("taken - passes * size"))
    plan = plan.dropDuplicates(["doc_id", "text_hash", "start"]).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.struct("start", "passes", "extra", "blocks", "phase", "part", "size").alias("_plan")
    )
    # A document that the table repeats has a plan for each copy, and the table's rows are taken once.
    own = docs.withColumn("_hash", F.xxhash64(F.col(text_col).cast("string"))).dropDuplicates([id_col, "_hash"])
    found = own.join(plan, F.col(id_col).eqNullSafe(F.col("_id")) & (own["_hash"] == plan["_hash"])).drop("_id", "_hash")
    copies = F.concat(
        F.when(F.col("_plan.passes") > 0, F.sequence(F.lit(1), F.col("_plan.passes").cast("int"))).otherwise(F.array().cast("array<int>")),
        F.when(F.col("_plan.part") > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
    )
    found = found.withColumn("_copy", F.explode(copies))

    def chosen(j: Column) -> Column:
        p = F.col("_plan")
        return F.floor((j * p["extra"] * _UNIT + p["phase"] * p["blocks"]) / (p["blocks"] * _UNIT))

    def inside(_, i: Column) -> Column:
        j = F.floor((F.col("_plan.start") + i) / block_words)
        return chosen(j + 1) > chosen(j)

    cut = F.array_join(F.filter(T.words(F.col(text_col)), inside), " ")
    text = F.when((F.col("_copy") == 0) & (F.col("_plan.part") < F.col("_plan.size")), cut).otherwise(F.col(text_col))
    found = found.withColumn(text_col, text)
    if length_col:
        found = found.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return found.select(docs.columns)
