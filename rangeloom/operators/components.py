"""Connected components of a link table, without gathering links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from rangeloom.storage import stored


def _neighbours(both: DataFrame) -> tuple[DataFrame, bool]:
    """Each id's smallest neighbour, stored, and whether every id is the smallest of its neighbours or has one alone, a smaller one."""
    seen = Observation()
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above"))
    open_ = F.count_if((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") > 0)))
    low = stored(low.observe(seen, open_.alias("open")).select("u", "m"), "neighbours")
    return low, seen.get["open"] == 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every linked id with the smallest id it can reach.

    ``links`` has two id columns of one type that can be ordered; their order,
    repeats and self links don't matter, and links with a null end are no links.
    Returns ``id`` and ``component`` for each id that has a link; an id without
    links is its own component and isn't listed.

    Alternates two star steps: every id hands its larger neighbours, then its
    smaller ones, to the smallest id that it knows.  Each step is a grouped
    minimum (combined on the map side) and a join, so one id's neighbours are
    never gathered, and the number of rounds grows with the logarithm of the
    longest path.  Rounds end once all links lead straight to the smallest id.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))
    )
    edges = stored(edges.distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near, done = _neighbours(both)
        low = near.select("u", F.least("u", "m").alias("m"))
        if done:
            return low.select(F.col("u").alias("id"), F.col("m").alias("component"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u != v").distinct(), "links")
