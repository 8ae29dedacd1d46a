"""Tracks, interval sets and rectangles made of the driver's tables, in Spark and as SQL common table expressions.

Positions: days since 1992-01-01 times 1000 plus a place within the day taken
from the order's key, so that a chromosome is about 2.6 million positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators.tracks import Workspace

DAY = 1000
DAYS = 4000
SIZE = DAY * DAYS
BIN = 7 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str) -> Column:
    return F.datediff(F.col(column).cast("date"), F.lit("1992-01-01").cast("date")).cast("long")


def chroms_of(df: DataFrame, size: int = SIZE) -> DataFrame:
    """A chromosome for each distinct name."""
    names = df.select("chrom").distinct()
    return names.select((F.crc32("chrom") % 1_000_000_007).cast("int").alias("chrom_id"), "chrom", F.lit(size).cast("long").alias("size"))


def price_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense: mean price of the line items that shipped in a week, by return flag and status."""
    items = table(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL")
    keyed = items.select(F.concat("l_returnflag", "l_linestatus").alias("chrom"), F.floor(_day("l_shipdate") / 7).alias("bin"), "l_extendedprice", "l_quantity")
    # whole cents add up exactly, in any order
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return keyed.groupBy("chrom", "bin").agg((cents.cast("double") / F.count("l_extendedprice") / 100).alias("value"))


def quantity_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_shipdate IS NOT NULL")
    keyed = items.select(F.concat("l_returnflag", "l_linestatus").alias("chrom"), F.floor(_day("l_shipdate") / 7).alias("bin"), "l_quantity")
    return keyed.groupBy("chrom", "bin").agg(F.sum("l_quantity").alias("value"))


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse: mean event value by minute and type; positions are seconds since 2024-01-01."""
    events = table(spark, sf_dir, "events").where("ts IS NOT NULL AND event_type IS NOT NULL")
    second = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lit(1704067200)
    start = (F.floor(second / 60) * 60).cast("long")
    made = events.select(F.col("event_type").alias("chrom"), start.alias("start"), "value").groupBy("chrom", "start").agg(F.avg("value").alias("value"))
    return made.where("start >= 0").select("chrom", "start", (F.col("start") + 60).alias("end"), "value")


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals with a value: an order's day and place, as long as its key says."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL")
    start = _day("o_orderdate") * DAY + (F.col("o_orderkey") * 7919) % DAY
    return orders.select(F.col("o_orderpriority").alias("chrom"), start.alias("start"), (start + 1 + F.col("o_orderkey") % 300).alias("end"), F.col("o_totalprice").alias("value"))


def customer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals with a strand: the same orders at another place of the day, as long as the customer's key says."""
    orders = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL")
    start = _day("o_orderdate") * DAY + (F.col("o_orderkey") * 104729) % DAY
    strand = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return orders.select(F.col("o_orderpriority").alias("chrom"), start.alias("start"), (start + 1 + F.col("o_custkey") % 200).alias("end"), strand.alias("strand"))


def part_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of parts on brand and type, which may overlap."""
    part = table(spark, sf_dir, "part")
    s1, s2 = F.col("p_size").cast("long") * 10, F.floor(F.col("p_partkey") / 10)
    return part.select(
        F.col("p_brand").alias("chrom1"), s1.alias("start1"), (s1 + 10).alias("end1"), F.col("p_brand").alias("chrom2"), s2.alias("start2"), (s2 + 5).alias("end2"), F.col("p_retailprice").alias("value")
    )


def trade_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts between customers and suppliers by nation, weighted by quantity."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customers, suppliers = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    found = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    made = found.groupBy("c_nationkey", "c_custkey", "s_nationkey", "s_suppkey").agg(F.sum("l_quantity").alias("value"))
    return made.select(
        F.concat(F.lit("n"), "c_nationkey").alias("chrom1"), F.col("c_custkey").alias("start1"), (F.col("c_custkey") + 1).alias("end1"),
        F.concat(F.lit("n"), "s_nationkey").alias("chrom2"), F.col("s_suppkey").alias("start2"), (F.col("s_suppkey") + 1).alias("end2"), "value",
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as sequences: letters stand for bases, others for N."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    letters = F.translate(F.col("text"), LETTERS, BASES)
    return docs.select("doc_id", F.regexp_replace(letters, "[^ACGTacgt]", "N").alias("seq"))


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "acgtacgtacgtacgtacgtacgtacACGTACGTACGTACGTACGTACGTAC"


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The dense tracks ``price`` and ``qty``; positions are days."""
    price = price_bins(spark, sf_dir)
    ws = Workspace(chroms_of(price, DAYS))
    ws.dense("price", price, 7)
    ws.dense("qty", quantity_bins(spark, sf_dir), 7)
    return ws


def event_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The sparse track ``ev``; positions are seconds, up to the hour that holds the last event."""
    ev = event_records(spark, sf_dir)
    last = ev.agg(F.max("end")).first()[0] or 0
    ws = Workspace(chroms_of(ev, -(-last // 3600) * 3600))
    ws.sparse("ev", ev)
    return ws


SQL = f"""
price AS (SELECT l_returnflag || l_linestatus AS chrom, (date_diff('day', DATE '1992-01-01', l_shipdate::DATE) // 7)::BIGINT AS bin, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / count(l_extendedprice) / 100 AS value
          FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2),
qty AS (SELECT l_returnflag || l_linestatus AS chrom, (date_diff('day', DATE '1992-01-01', l_shipdate::DATE) // 7)::BIGINT AS bin, sum(l_quantity) AS value
        FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1, 2),
ev AS (SELECT event_type AS chrom, (floor((floor(epoch(ts))::BIGINT - 1704067200) / 60) * 60)::BIGINT AS "start", (floor((floor(epoch(ts))::BIGINT - 1704067200) / 60) * 60 + 60)::BIGINT AS "end", avg(value) AS value
       FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL AND floor(epoch(ts))::BIGINT >= 1704067200 GROUP BY ALL),
a AS (SELECT o_orderpriority AS chrom, (d * {DAY} + (o_orderkey * 7919) % {DAY})::BIGINT AS "start", (d * {DAY} + (o_orderkey * 7919) % {DAY} + 1 + o_orderkey % 300)::BIGINT AS "end", o_totalprice AS value
      FROM (SELECT *, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL)),
b AS (SELECT o_orderpriority AS chrom, (d * {DAY} + (o_orderkey * 104729) % {DAY})::BIGINT AS "start", (d * {DAY} + (o_orderkey * 104729) % {DAY} + 1 + o_custkey % 200)::BIGINT AS "end",
             CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS strand
      FROM (SELECT *, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL)),
rect AS (SELECT p_brand AS chrom1, (p_size * 10)::BIGINT AS start1, (p_size * 10 + 10)::BIGINT AS end1, p_brand AS chrom2, (p_partkey // 10)::BIGINT AS start2, (p_partkey // 10 + 5)::BIGINT AS end2, p_retailprice AS value FROM part),
pts AS (SELECT 'n' || c_nationkey AS chrom1, c_custkey AS start1, 'n' || s_nationkey AS chrom2, s_suppkey AS start2, sum(l_quantity) AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
seqs AS (SELECT doc_id, regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGTacgt]', 'N', 'g') AS seq FROM documents WHERE text IS NOT NULL),
chroms AS (SELECT DISTINCT chrom, {DAYS} AS size FROM price),
bins AS (SELECT chrom, size, unnest(range(0, ((size + 6) // 7)::BIGINT)) AS bin FROM chroms)
"""


def canonic_sql(name: str, out: str, touching: bool = True) -> str:
    """CTEs that merge the intervals of ``name`` into ``out``."""
    op = ">" if touching else ">="
    return f"""
{out}_r AS (SELECT chrom, "start", "end", max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}),
{out}_g AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" {op} reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM {out}_r),
{out} AS (SELECT chrom, min("start") AS "start", max("end") AS "end" FROM {out}_g GROUP BY chrom, g)"""
