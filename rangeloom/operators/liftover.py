"""Conversion of intervals between assemblies by alignment chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.operators.components import connected_components
from rangeloom.operators.intervals import canonic, difference
from rangeloom.operators.ranges import BIN, no_nan, number_rows, overlap_join, running
from rangeloom.storage import stored

SOURCE = ["chromsrc", "startsrc", "endsrc"]
TARGET = ["chrom", "start", "end"]


#: Target policies that keep all blocks, and what weighs the groups of blocks that a converted row falls into.
CLUSTERS = {"best_source_cluster": "union", "best_cluster_union": "union", "best_cluster_sum": "sum", "best_cluster_max": "max"}


def _side(chain: DataFrame, columns: list[str]) -> DataFrame:
    return chain.select(F.col(columns[0]).alias("chrom"), F.col(columns[1]).alias("start"), F.col(columns[2]).alias("end"))


def _shared(spans: DataFrame) -> DataFrame:
    """Places that more than one row covers."""
    reach = running(spans, "max", F.col("end"), "_reach", [F.col("start"), F.col("end")])
    return canonic(reach.where("start < _reach").select("chrom", "start", F.least("end", "_reach").alias("end")))


def source_policy(chain: DataFrame, policy: str = "error") -> DataFrame:
    """What becomes of blocks whose source sides overlap: error, keep, or discard both."""
    if policy == "keep":
        return chain
    shared = _shared(_side(chain, SOURCE))
    if policy == "error":
        if not shared.isEmpty():
            raise ValueError("source sides of the chain overlap")
        return chain
    if policy != "discard":
        raise ValueError(f"unknown source policy {policy}")
    rows = chain.select(*(F.col(c).alias(f"c_{c}") for c in chain.columns), F.col("chromsrc").alias("chrom"), F.col("startsrc").alias("start"), F.col("endsrc").alias("end"))
    kept = overlap_join(rows, shared, how="left_anti")
    return kept.select(*(F.col(f"c_{c}").alias(c) for c in chain.columns))


def target_policy(chain: DataFrame, policy: str = "auto") -> DataFrame:
    """What becomes of blocks whose target sides overlap.

    error; keep; discard; auto or auto_score (the contested part goes to the
    block with the higher score, then the longer one, then the smaller chain
    id); auto_longer (length first); auto_first (smaller chain id first);
    agg (blocks are cut at each other's edges, and all parts stay).  The
    policies of CLUSTERS keep all blocks here; ``liftover`` with the same policy
    then keeps one group of blocks for each row.
    """
    policy = "auto_score" if policy == "auto" else policy
    if policy == "keep" or policy in CLUSTERS:
        return chain
    shared = _shared(_side(chain, TARGET))
    if policy == "error":
        if not shared.isEmpty():
            raise ValueError("target sides of the chain overlap")
        return chain
    if policy == "discard":
        return overlap_join(chain, shared, how="left_anti")
    # cut every block at the edges of the blocks that it overlaps
    numbered = chain.withColumn("_b", F.xxhash64(*chain.columns))
    edges = canonic(shared).select("chrom", F.explode(F.array("start", "end")).alias("start")).unionByName(overlap_join(chain.select(*TARGET), shared).select("chrom", F.explode(F.array("start", "end")).alias("start")))
    points = edges.distinct().withColumn("end", F.col("start") + 1)
    cuts = overlap_join(numbered.select("_b", *TARGET), points, how="left").groupBy("_b").agg(F.sort_array(F.collect_set("start1")).alias("cuts"))
    cut = numbered.join(cuts, "_b", "left")
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda x: (x > F.col("start")) & (x < F.col("end")))
    places = F.concat(F.array("start"), inner, F.array("end"))
    parts = cut.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(0), F.size(places) - 2), lambda i: F.struct(F.get(places, i).alias("s"), F.get(places, i + 1).alias("e")))))
    parts = parts.withColumn("_l", F.col("end") - F.col("start"))
    if policy != "agg":
        orders = {
            "auto_score": [F.col("score").desc(), F.col("_l").desc(), F.col("chain_id")],
            "auto_longer": [F.col("_l").desc(), F.col("score").desc(), F.col("chain_id")],
            "auto_first": [F.col("chain_id"), F.col("startsrc")],
        }
        if policy not in orders:
            raise ValueError(f"unknown target policy {policy}")
        place = F.row_number().over(Window.partitionBy("chrom", "_p.s", "_p.e").orderBy(*orders[policy], "_b"))
        parts = parts.withColumn("_k", place).where("_k = 1").drop("_k")
    offset, size = F.col("_p.s") - F.col("start"), F.col("_p.e") - F.col("_p.s")
    backward = F.col("strand") * F.col("strandsrc") < 0
    src = F.when(backward, F.col("endsrc") - offset - size).otherwise(F.col("startsrc") + offset)
    return parts.select(
        "chrom", F.col("_p.s").alias("start"), F.col("_p.e").alias("end"), "strand", "chromsrc", src.alias("startsrc"), (src + size).alias("endsrc"), "strandsrc", "chain_id", "score"
    )


def as_chain(blocks: DataFrame, source: str = "error", target: str = "auto", min_score: float | None = None) -> DataFrame:
    """A chain table with its overlaps settled."""
    need = {"chrom", "start", "end", "strand", "chromsrc", "startsrc", "endsrc", "strandsrc", "chain_id", "score"}
    if missing := need - set(blocks.columns):
        raise ValueError(f"a chain lacks {sorted(missing)}")
    kept = blocks if min_score is None else blocks.where(F.col("score") >= min_score)
    return target_policy(source_policy(kept, source), target)


def liftover(rows: DataFrame, chain: DataFrame, metadata: bool = False, merge: bool = False, bin_width: int = BIN, policy: str = "keep") -> DataFrame:
    """Rows converted to the target assembly, a row for each block that they meet.

    Adds ``intervalID`` (1-based, in order of place) and ``chain_id``, with
    ``metadata`` also ``score`` and the block's source part; ``merge`` joins
    touching pieces of one row and chain.  With a ``policy`` of CLUSTERS only the
    heaviest group of a row's pieces stays; see ``best_cluster``.
    """
    if policy not in CLUSTERS and policy not in ("keep", "error", "discard", "auto", "auto_score", "auto_longer", "auto_first", "agg"):
        raise ValueError(f"unknown target policy {policy}")
    numbered = rows if "intervalID" in rows.columns else number_rows(rows, "intervalID", ["chrom", "start", "end"])
    source = chain.select(
        F.col("chromsrc").alias("chrom"), F.col("startsrc").alias("start"), F.col("endsrc").alias("end"), F.col("chrom").alias("t_chrom"), F.col("start").alias("t_start"), F.col("end").alias("t_end"),
        "strand", "strandsrc", "chain_id", "score",
    )
    hit = overlap_join(numbered, source, bin_width)
    strand = "strand1" if "strand" in numbered.columns else "strand"
    low, high = F.greatest("start", "start1"), F.least("end", "end1")
    backward = F.col(strand) * F.col("strandsrc") < 0
    start = F.when(backward, F.col("t_end") - (high - F.col("start1"))).otherwise(F.col("t_start") + low - F.col("start1"))
    extra = [c for c in numbered.columns if c not in ("chrom", "start", "end", "strand", "intervalID")]
    made = hit.select(F.col("t_chrom").alias("chrom"), start.alias("start"), (start + high - low).alias("end"), "intervalID", "chain_id", *extra, "score", low.alias("startsrc"), high.alias("endsrc"))
    if policy in CLUSTERS:
        made = best_cluster(made, CLUSTERS[policy])
    if not metadata:
        made = made.drop("score", "startsrc", "endsrc")
    if not merge:
        return made
    keys = ["chrom", "intervalID", "chain_id", *extra]
    order = Window.partitionBy(*keys).orderBy("start")
    flagged = made.withColumn("_new", F.when(F.lag("end").over(order) >= F.col("start"), 0).otherwise(1))
    runs = flagged.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).select(*made.columns[:3], "intervalID", "chain_id", *extra)


def clusters(pieces: DataFrame) -> DataFrame:
    """Pieces with ``_piece``, ``_island`` and the ``_group`` that they belong to within their ``intervalID``.

    Pieces belong together if they have one ``chain_id`` or their source parts
    (``startsrc`` to ``endsrc``) overlap, directly or by others.  Overlapping pieces first make islands, by a sweep in tiles; islands and
    chains are then the two kinds of nodes of a link table, whose components
    are the groups, so no row's pieces are gathered, however many it has.
    """
    rows = stored(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    spans = rows.select("intervalID", "_piece", "chain_id", F.col("startsrc").alias("start"), F.col("endsrc").alias("end"))
    order = [F.col("start"), F.col("end"), F.col("_piece")]
    reach = running(spans, "max", F.col("end"), "_reach", order, keys=("intervalID",))
    new = (F.col("_reach").isNull() | (F.col("start") >= F.col("_reach"))).cast("long")
    islands = stored(running(reach.withColumn("_new", new), "sum", F.col("_new"), "_island", order, keys=("intervalID",), before=False), "islands")
    node = lambda kind, name: F.struct("intervalID", F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"))
    links = islands.select(node(0, "_island").alias("a"), node(1, "chain_id").alias("b")).distinct()
    groups = connected_components(links).where("id.kind = 0").select(F.col("id.intervalID").alias("intervalID"), F.col("id.name").cast("long").alias("_island"), F.col("component").alias("_group"))
    labels = islands.join(groups, ["intervalID", "_island"]).select("_piece", "_island", "_group")
    return stored(rows.join(labels, "_piece"), "clusters")


def best_cluster(pieces: DataFrame, weight: str = "union") -> DataFrame:
    """The heaviest group of each ``intervalID``'s pieces (those of ``clusters``, or pieces that it is called on).

    A group weighs as many source positions as it covers (union), as its pieces
    cover one by one (sum) or as its longest piece does (max); of equals the one
    that begins first stays, then that of the smaller chain id.
    """
    if weight not in ("union", "sum", "max"):
        raise ValueError(f"unknown weight {weight}")
    labelled = pieces if "_group" in pieces.columns else clusters(pieces)
    size = F.col("endsrc") - F.col("startsrc")
    held = labelled.groupBy("intervalID", "_group", "_island").agg(
        (F.max("endsrc") - F.min("startsrc")).alias("u"), F.sum(size).alias("s"), F.max(size).alias("m"), F.min("startsrc").alias("first"), F.min("chain_id").alias("chain")
    )
    mass = {"union": F.sum("u"), "sum": F.sum("s"), "max": F.max("m")}[weight]
    weighed = held.groupBy("intervalID", "_group").agg(mass.alias("mass"), F.min("first").alias("first"), F.min("chain").alias("chain"))
    best = weighed.groupBy("intervalID").agg(F.min_by("_group", F.struct(-F.col("mass"), "first", "chain")).alias("_group"))
    return labelled.join(best, ["intervalID", "_group"], "left_semi").drop("_piece", "_island", "_group")


def _aggregate(kind: str, na_rm: bool, nth: int) -> Column:
    v, n, share = F.col("value"), F.col("end") - F.col("start"), (F.col("end") - F.col("start")) / F.col("source_length")
    plain = {
        "mean": F.avg(v), "median": F.percentile(v, 0.5), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "count": F.count(v).cast("double"),
        "first": F.min_by(v, F.struct("chain_id", "start")), "last": F.max_by(v, F.struct("chain_id", "start")),
        "nth": F.get(F.sort_array(F.collect_list(F.struct("chain_id", "start", "value"))), F.lit(nth - 1))["value"],
        "max.coverage_len": F.max_by(v, n), "min.coverage_len": F.min_by(v, n), "max.coverage_frac": F.max_by(v, share), "min.coverage_frac": F.min_by(v, share),
    }
    if kind not in plain:
        raise ValueError(f"unknown aggregate {kind}")
    return plain[kind] if na_rm else F.when(F.count(F.when(v.isNull(), 1)) == 0, plain[kind])


def lift_track(
    track: DataFrame, chain: DataFrame, aggregate: str = "mean", na_rm: bool = True, nth: int = 1, min_count: int | None = None, bin_width: int = BIN, policy: str = "keep"
) -> DataFrame:
    """A sparse track converted; where several records land on one place their values are aggregated.

    Converted records are cut at each other's edges, so that every piece is
    covered by whole records; touching pieces stay apart.  With a ``policy`` of
    CLUSTERS a record first keeps its heaviest group of pieces only.
    """
    rows = track.select("chrom", "start", "end", no_nan("value").alias("value"), (F.col("end") - F.col("start")).alias("source_length"))
    if policy not in CLUSTERS:
        # records need no numbers but for their groups
        rows = rows.withColumn("intervalID", F.lit(0).cast("long"))
    lifted = liftover(rows, chain, bin_width=bin_width, policy=policy).select("chrom", "start", "end", "value", "source_length", "chain_id")
    edges = lifted.select("chrom", F.explode(F.array("start", "end")).alias("start")).distinct()
    from rangeloom.operators.intervals import next_start

    pieces = next_start(edges).select("chrom", "start", F.col("_next").alias("end")).where("end IS NOT NULL")
    hit = overlap_join(pieces, lifted, bin_width)
    hit = hit.select(F.struct("chrom", "start", "end").alias("p"), F.col("start1").alias("s"), "value", "source_length", "chain_id")
    hit = hit.select("p", F.col("p.start").alias("start"), F.col("p.end").alias("end"), "value", "source_length", "chain_id")
    made = hit.groupBy("p").agg(_aggregate(aggregate, na_rm, nth).alias("value"), F.count("value").alias("n"))
    made = made if min_count is None else made.where(F.col("n") >= min_count)
    return made.select("p.chrom", "p.start", "p.end", "value")


def unmapped(rows: DataFrame, chain: DataFrame) -> DataFrame:
    """Places of the rows that no block's source covers."""
    return difference(rows, _side(chain, SOURCE))
