"""More queries over the driver's tables: windows, two dimensions, sequences, neighbours and round trips, with their DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangeloom.functions import sequence as seq
from rangeloom.operators import aggregates as agg
from rangeloom.operators import expressions_2d as e2
from rangeloom.operators import intervals as iv
from rangeloom.operators import iterators as it
from rangeloom.operators import matrices as mx
from rangeloom.operators import nearest as nn
from rangeloom.operators import strata as st
from rangeloom.operators import synthesis as sy
from rangeloom.operators import tracks as tr
from rangeloom.operators import two_d as td
from rangeloom.plans import fixtures as fx
from rangeloom.plans.queries import MOTIF, _rounded, _with, query
from rangeloom.sources.formats import read_array
from rangeloom.storage import scratch_path, stored

#: Letters in a chunk of a text as a sequence.
CHUNK = 1 << 12

# windows of tracks and interval sets

_MASKED = """mk AS (SELECT DISTINCT chrom, y * 364 AS ms, y * 364 + 10 AS me FROM chroms, range(0, 11) r(y)),
 w AS (SELECT chrom, s AS "start", least(s + 28, size) AS "end" FROM (SELECT chrom, size, unnest(range(0, size::BIGINT, 28)) AS s FROM chroms)),
 part AS (SELECT w.chrom, w."start", w."end", CASE WHEN ms IS NULL THEN w."start" ELSE unnest([w."start", least(me, w."end")]) END AS ps, CASE WHEN ms IS NULL THEN w."end" ELSE unnest([greatest(ms, w."start"), w."end"]) END AS pe
   FROM w LEFT JOIN mk ON mk.chrom = w.chrom AND ms < w."end" AND w."start" < me),
 one AS (SELECT DISTINCT * FROM part WHERE ps < pe),
 st AS (SELECT o.chrom, o."start", o."end", o.ps, o.pe, avg(value) AS m, sum(value) AS s, count(value) AS n, max(value) AS hi FROM one o JOIN price p ON p.chrom = o.chrom AND p.bin * 7 < o.pe AND p.bin * 7 + 7 > o.ps GROUP BY ALL)"""


def _mask(ws: tr.Workspace) -> DataFrame:
    years = ws.chroms.select("chrom", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("y"))
    return years.select("chrom", (F.col("y") * 364).cast("long").alias("start"), (F.col("y") * 364 + 10).cast("long").alias("end"))


@query(
    _with(
        _MASKED,
        """SELECT w.chrom, w."start", w."end", round(sum(m * (pe - ps)) / sum(pe - ps), 6) AS m, round(sum(s), 4) AS s, coalesce(sum(n), 0)::BIGINT AS n, round(max(hi), 6) AS hi
        FROM w LEFT JOIN st USING (chrom, "start", "end") WHERE EXISTS (SELECT 1 FROM one o WHERE o.chrom = w.chrom AND o."start" = w."start") GROUP BY ALL""",
    )
)
def vtrack_masked(spark, d):
    """Windows of four weeks, without the first ten days of each 52 weeks."""
    ws = fx.workspace(spark, d)
    for name, func in {"m": "avg", "s": "sum", "n": "size", "hi": "max"}.items():
        ws.vtrack(name, "price", func, mask=_mask(ws))
    made = ws.evaluate({k: k for k in ("m", "s", "n", "hi")}, iterator=28).drop("intervalID")
    return made.select("chrom", "start", "end", F.round("m", 6).alias("m"), F.round("s", 4).alias("s"), "n", F.round("hi", 6).alias("hi"))


@query(
    _with(
        """w AS (SELECT chrom, s AS "start", least(s + 21, size) AS "end" FROM (SELECT chrom, size, unnest(range(0, size::BIGINT, 21)) AS s FROM chroms)),
        t AS (SELECT w.chrom, w."start", w."end", price.bin, value FROM w JOIN price ON w.chrom = price.chrom AND price.bin * 7 < w."end" + 14 AND price.bin * 7 + 7 > greatest(w."start" - 14, 0) WHERE value IS NOT NULL)""",
        """SELECT w.chrom, w."start", w."end", CASE WHEN count(bin) > 0 THEN greatest(min(bin) * 7, greatest(w."start" - 14, 0)) END AS fa, greatest(max(bin) * 7, CASE WHEN count(bin) > 0 THEN greatest(w."start" - 14, 0) END) AS la,
        CASE WHEN count(bin) > 0 THEN greatest(min(bin) * 7, greatest(w."start" - 14, 0)) - (w."start" - 14) END AS fr
        FROM w LEFT JOIN t USING (chrom, "start", "end") GROUP BY w.chrom, w."start", w."end" """,
    )
)
def vtrack_places(spark, d):
    """Where the first and last value of each window stand."""
    ws = fx.workspace(spark, d)
    for name, func in {"fa": "first.pos.abs", "la": "last.pos.abs", "fr": "first.pos.relative"}.items():
        ws.vtrack(name, "price", func, sshift=-14, eshift=14)
    return ws.evaluate({k: k for k in ("fa", "la", "fr")}, iterator=21).drop("intervalID")


@query(
    _with(
        """g AS (SELECT value, (rank() OVER (ORDER BY value) - 1 + count(*) OVER (PARTITION BY value))::DOUBLE / count(*) OVER () AS p FROM price WHERE value IS NOT NULL),
        h AS (SELECT DISTINCT value, p FROM g)""",
        'SELECT chrom, bin * 7 AS "start", round(h.p, 9) AS p FROM price JOIN h USING (value)',
    )
)
def vtrack_global_percentile(spark, d):
    ws = fx.workspace(spark, d)
    ws.vtrack("g", "price", "global.percentile")
    return ws.evaluate({"p": "g"}, iterator=7).where("p IS NOT NULL").select("chrom", "start", F.round("p", 9).alias("p"))


_NEAR = """near AS (SELECT q.chrom, q."start", q."end", b."start" AS s1, b."end" AS e1, b.strand, greatest(b."start" - q.b, q.a - b."end", 0) AS gap, q.a, q.b
 FROM {q} q JOIN b ON q.chrom = b.chrom AND b."start" < q.b + 40000 AND q.a < b."end" + 40000),
 r AS (SELECT *, CASE WHEN gap = 0 THEN 0 WHEN b <= s1 THEN -gap * strand ELSE gap * strand END AS dist FROM near),
 k AS (SELECT *, row_number() OVER (PARTITION BY chrom, "start", "end" ORDER BY abs(dist), s1, e1, strand) AS k FROM r)"""


def _distance_query(func: str, a: str, b: str):
    ctes = fx.canonic_sql("a", "ca") + f', q AS (SELECT chrom, "start", "end", {a} AS a, {b} AS b FROM ca), ' + _NEAR.format(q="q")

    @query(_with(ctes, 'SELECT q.chrom, q."start", q."end", dist::DOUBLE AS d FROM q LEFT JOIN k ON k.chrom = q.chrom AND k."start" = q."start" AND k."end" = q."end" AND k = 1'), name=f"vtrack_{func.replace('.', '_')}")
    def run(spark, d):
        rows = fx.order_spans(spark, d)
        ws = tr.Workspace(fx.chroms_of(rows))
        ws.vtrack("x", fx.customer_spans(spark, d), func)
        return ws.evaluate({"d": "x"}, iterator=iv.canonic(rows)).drop("intervalID")


# from the centre to the nearer edge of the nearest interval: strand 1 counts from the edge on, -1 towards it
_CENTRES = """q AS (SELECT chrom, "start", "end", ("start" + "end") // 2 AS c FROM ca),
 near AS (SELECT q.*, s."start" AS s1, s."end" AS e1, s.strand, greatest(s."start" - q.c, q.c + 1 - s."end", 0) AS away FROM q JOIN {source} s ON q.chrom = s.chrom AND s."start" < q.c + 60000 AND q.c < s."end" + 60000),
 k AS (SELECT *, CASE WHEN strand = 1 THEN c - s1 ELSE s1 - c END AS l, CASE WHEN strand = 1 THEN c - e1 ELSE e1 - c END AS r, row_number() OVER (PARTITION BY chrom, "start", "end" ORDER BY away, s1, e1, strand) AS k FROM near)"""


@query(
    _with(
        fx.canonic_sql("a", "ca") + ", " + _CENTRES.format(source="b"),
        """SELECT q.chrom, q."start", q."end", CASE WHEN c >= s1 AND c < e1 THEN 0.0 WHEN abs(l) <= abs(r) THEN l ELSE r END::DOUBLE AS d
        FROM ca q LEFT JOIN k ON k.chrom = q.chrom AND k."start" = q."start" AND k."end" = q."end" AND k = 1""",
    )
)
def vtrack_distance(spark, d):
    rows = fx.order_spans(spark, d)
    ws = tr.Workspace(fx.chroms_of(rows))
    ws.vtrack("x", fx.customer_spans(spark, d), "distance")
    return ws.evaluate({"d": "x"}, iterator=iv.canonic(rows)).drop("intervalID")


@query(
    _with(
        fx.canonic_sql("a", "ca") + ", " + fx.canonic_sql("b", "cb") + ', sb AS (SELECT chrom, "start", "end", ("start" % 3 - 1) AS strand FROM cb), ' + _CENTRES.format(source="sb"),
        """SELECT q.chrom, q."start", q."end", round(CASE WHEN strand = 0 THEN abs(d) ELSE d END, 6) AS d FROM ca q LEFT JOIN (
          SELECT *, CASE WHEN c >= s1 AND c < e1 THEN 50.0 * (l + r) / (e1 - s1) WHEN abs(l) <= abs(r) THEN l - CASE WHEN strand = 1 THEN 50 ELSE -50 END ELSE r + CASE WHEN strand = 1 THEN 50 ELSE -50 END END::DOUBLE AS d FROM k WHERE k = 1
        ) k ON k.chrom = q.chrom AND k."start" = q."start" AND k."end" = q."end" """,
    )
)
def vtrack_distance_margin(spark, d):
    """A margin of 50 on each side; intervals of all three strands."""
    rows = fx.order_spans(spark, d)
    source = iv.canonic(fx.customer_spans(spark, d))
    ws = tr.Workspace(fx.chroms_of(rows))
    ws.vtrack("x", source.withColumn("strand", (F.col("start") % 3 - 1).cast("int")), "distance", 100)
    return ws.evaluate({"d": "x"}, iterator=iv.canonic(rows)).select("chrom", "start", "end", F.round("d", 6).alias("d"))


_distance_query("distance.edge", '"start"', '"end"')


@query(
    _with(
        fx.canonic_sql("a", "ca")
        + """, h AS (SELECT ca.chrom, ca."start", ca."end", ((ca."start" + ca."end") // 2 - (b."start" + b."end") // 2) * b.strand AS d FROM ca JOIN b ON ca.chrom = b.chrom AND (ca."start" + ca."end") // 2 >= b."start" AND (ca."start" + ca."end") // 2 < b."end"),
        k AS (SELECT *, row_number() OVER (PARTITION BY chrom, "start", "end" ORDER BY abs(d), d) AS k FROM h)""",
        'SELECT ca.chrom, ca."start", ca."end", d::DOUBLE AS d FROM ca LEFT JOIN k ON k.chrom = ca.chrom AND k."start" = ca."start" AND k."end" = ca."end" AND k = 1',
    )
)
def vtrack_distance_center(spark, d):
    rows = fx.order_spans(spark, d)
    ws = tr.Workspace(fx.chroms_of(rows))
    ws.vtrack("x", fx.customer_spans(spark, d), "distance.center")
    return ws.evaluate({"d": "x"}, iterator=iv.canonic(rows)).drop("intervalID")


@query('SELECT chrom, s AS "start", least(s + 40, "end") AS "end" FROM (SELECT chrom, "end", unnest(range("start", "end", 40)) AS s FROM a)')
def iterator_relative_bins(spark, d):
    return it.relative_bins(fx.order_spans(spark, d), 40).select("chrom", "start", "end")


def _sided(name: str, low: int, high: int, function):
    way = f"CASE WHEN gap = 0 THEN 0 WHEN q.\"end\" <= b.\"start\" THEN gap * q.strand ELSE -gap * q.strand END"
    ctes = f"""p AS (SELECT q.chrom, q."start", q."end", q.strand, b."start" AS start1, b."end" AS end1, greatest(b."start" - q."end", q."start" - b."end", 0) AS gap, {way.replace('gap', 'greatest(b."start" - q."end", q."start" - b."end", 0)')} AS dist
      FROM (SELECT DISTINCT chrom, "start", "end", strand FROM b) q JOIN a b ON q.chrom = b.chrom AND b."start" < q."end" + 5001 AND q."start" < b."end" + 5001),
      k AS (SELECT *, row_number() OVER (PARTITION BY chrom, "start", "end", strand ORDER BY abs(dist), start1, end1) AS k FROM p WHERE dist BETWEEN {low} AND {high})"""

    @query(_with(ctes, 'SELECT chrom, "start", "end", strand, start1, end1, dist::BIGINT AS dist FROM k WHERE k = 1'), name=name)
    def run(spark, d):
        queries = fx.customer_spans(spark, d).distinct()
        return function(queries, fx.order_spans(spark, d).drop("value"), 1, 5000).drop("chrom1")


_sided("neighbors_upstream", -5000, 0, nn.upstream)
_sided("neighbors_downstream", 0, 5000, nn.downstream)


@query(
    _with(
        """m AS (SELECT l_returnflag || l_linestatus AS chrom, (date_diff('day', DATE '1992-01-01', l_shipdate::DATE) * 1000 + l_partkey % 1000)::BIGINT AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS strand FROM lineitem WHERE l_shipdate IS NOT NULL),
        e AS (SELECT DISTINCT chrom, CASE WHEN strand = -1 THEN pos + 35 ELSE pos END AS p, strand FROM m)""",
        'SELECT chrom, p AS "start", p + 1 AS "end", count(*)::DOUBLE AS value FROM e GROUP BY chrom, p',
    )
)
def mapped_reads(spark, d):
    return tr.mapped_reads(_reads(spark, d), fx.chroms_of(_reads(spark, d)))


def _reads(spark, d) -> DataFrame:
    items = fx.table(spark, d, "lineitem").where("l_shipdate IS NOT NULL")
    pos = fx._day("l_shipdate") * 1000 + F.col("l_partkey") % 1000
    return items.select(F.concat("l_returnflag", "l_linestatus").alias("chrom"), pos.alias("pos"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("strand"), F.lit(36).alias("length"))


@query(
    _with(
        """c AS (SELECT l_partkey % 5000 // 50 AS bin, least(count(CASE WHEN l_linenumber % 2 = 0 THEN 1 END), 1000000) AS f, least(count(CASE WHEN l_linenumber % 2 <> 0 THEN 1 END), 1000000) AS r FROM lineitem GROUP BY 1),
        s AS (SELECT min(bin) AS lo, max(bin) AS hi FROM c), g AS (SELECT unnest(range((SELECT lo FROM s), (SELECT hi FROM s) + 1)) AS bin), z AS (SELECT g.bin, coalesce(f, 0) AS f, coalesce(r, 0) AS r FROM g LEFT JOIN c USING (bin)),
        p AS (SELECT o, x.f, y.r FROM range(-8, 8) t(o), z x, z y WHERE y.bin = x.bin + o)""",
        'SELECT o * 50 AS "offset", round(corr(f, r), 9) AS cor FROM p GROUP BY o',
    )
)
def strands_autocorrelation(spark, d):
    items = fx.table(spark, d, "lineitem")
    reads = items.select((F.col("l_partkey") % 5000).alias("pos"), F.when(F.col("l_linenumber") % 2 == 0, 1).otherwise(-1).alias("strand"))
    return _rounded(agg.strands_autocorrelation(reads, 50, 400, 1_000_000), 9)


@query(_with(fx.canonic_sql("a", "c"), """SELECT chrom, "start", "end", chrom || ':' || "start" || '-' || "end" AS label, ("end" - "start")::DOUBLE * 2 AS len FROM c"""))
def interval_matrix(spark, d):
    rows = iv.canonic(fx.order_spans(spark, d)).withColumn("len", F.col("end") - F.col("start")).withColumn("mid", F.col("start") + 1)
    m = mx.to_matrix(rows).select(["len"]).apply(lambda x: x * 2)
    return mx.from_matrix(m).join(m.data.select("chrom", "start", "label"), ["chrom", "start"])


# two dimensions


def _parts(spark, d) -> tuple[e2.Workspace2D, DataFrame]:
    rows = fx.part_rectangles(spark, d)
    ends = rows.groupBy(F.col("chrom1").alias("chrom")).agg(F.max(F.greatest("end1", "end2")).alias("size"))
    ws = e2.Workspace2D(ends.select((F.crc32("chrom") % 1_000_000_007).cast("int").alias("chrom_id"), "chrom", "size"), 64)
    ws.track("rect", rows)
    return ws, rows


_CELLS = """ch AS (SELECT chrom1 AS chrom, greatest(max(end1), max(end2)) AS size FROM rect GROUP BY 1),
 cell AS (SELECT chrom AS chrom1, i * 100 AS start1, least(i * 100 + 100, size) AS end1, chrom AS chrom2, j * 50 AS start2, least(j * 50 + 50, size) AS end2 FROM ch, LATERAL (SELECT unnest(range(0, (size + 99) // 100)) AS i) x, LATERAL (SELECT unnest(range(0, (size + 49) // 50)) AS j) y),
 o AS (SELECT c.*, r.value, (least(c.end1, r.end1) - greatest(c.start1, r.start1)) * (least(c.end2, r.end2) - greatest(c.start2, r.start2)) AS area
   FROM cell c JOIN rect r ON c.chrom1 = r.chrom1 AND c.chrom2 = r.chrom2 AND c.start1 < r.end1 AND r.start1 < c.end1 AND c.start2 < r.end2 AND r.start2 < c.end2),
 v AS (SELECT chrom1, start1, end1, chrom2, start2, end2, sum(value * area) / sum(area) AS a, sum(area)::DOUBLE AS area, sum(value * area) AS w FROM o GROUP BY ALL)"""


def _same_pairs(ws: e2.Workspace2D) -> DataFrame:
    return td.all_pairs(ws.chroms).where("chrom1 = chrom2")


@query(_with(_CELLS, "SELECT chrom1, start1, end1, chrom2, start2, end2, round(a, 6) AS price, area, round(w, 2) AS w FROM v"))
def extract_2d(spark, d):
    ws, _ = _parts(spark, d)
    ws.vtrack("area", "rect", "area")
    ws.vtrack("w", "rect", "weighted.sum")
    made = ws.evaluate({"price": "rect", "area": "area", "w": "w"}, _same_pairs(ws), (100, 50), where="rect IS NOT NULL").drop("intervalID")
    return made.withColumns({"price": F.round("price", 6), "w": F.round("w", 2)})


@query(_with(_CELLS, "SELECT chrom1, start1, end1, chrom2, start2, end2 FROM v WHERE a > 930"))
def screen_2d(spark, d):
    ws, _ = _parts(spark, d)
    return ws.screen("rect > 930", _same_pairs(ws), (100, 50))


@query(_with(_CELLS, "SELECT (SELECT count(*) FROM cell) AS n, (SELECT count(*) FROM cell) - count(*) AS n_missing, round(min(a), 6) AS min, round(max(a), 6) AS max, round(avg(a), 6) AS mean FROM v"))
def summary_2d(spark, d):
    ws, _ = _parts(spark, d)
    return _rounded(ws.summary("rect", _same_pairs(ws), (100, 50)).drop("sum", "stddev"))


@query(_with(_CELLS, "SELECT unnest([0.1, 0.5]) AS percentile, round(unnest(quantile_cont(a, [0.1, 0.5])), 6) AS value FROM v"))
def quantiles_2d(spark, d):
    ws, _ = _parts(spark, d)
    return _rounded(ws.quantiles("rect", [0.1, 0.5], _same_pairs(ws), (100, 50)))


@query(
    """SELECT x.chrom1, x.start1, x.end1, x.chrom2, x.start2, x.end2, round(sum(y.value * a) / sum(a), 6) AS v FROM
    (SELECT x.chrom1, x.start1, x.end1, x.chrom2, x.start2, x.end2, y.value, (least(x.end1, y.end1) - greatest(x.start1, y.start1)) * (least(x.end2, y.end2) - greatest(x.start2, y.start2)) AS a
     FROM (SELECT DISTINCT chrom1, start1, end1, chrom2, start2, end2 FROM rect) x JOIN rect y ON x.chrom1 = y.chrom1 AND x.chrom2 = y.chrom2 AND x.start1 < y.end1 AND y.start1 < x.end1 AND x.start2 < y.end2 AND y.start2 < x.end2) x, (SELECT 1) y0
    GROUP BY ALL""".replace("y.value * a", "value * a")
)
def iterator_track_rectangles(spark, d):
    ws, _ = _parts(spark, d)
    return _rounded(ws.evaluate({"v": "rect"}, _same_pairs(ws), "rect").drop("intervalID").distinct())


@query(
    """SELECT x.chrom1, x.start1, x.end1, x.chrom2, x.start2, x.end2, y.chrom1 AS r_chrom1, y.start1 AS r_start1, y.end1 AS r_end1, y.chrom2 AS r_chrom2, y.start2 AS r_start2, y.end2 AS r_end2,
    greatest(y.start1 - x.end1, x.start1 - y.end1, 0)::BIGINT AS dist1, greatest(y.start2 - x.end2, x.start2 - y.end2, 0)::BIGINT AS dist2
    FROM rect x JOIN rect y ON x.chrom1 = y.chrom1 AND x.chrom2 = y.chrom2 WHERE greatest(y.start1 - x.end1, x.start1 - y.end1, 0) BETWEEN 1 AND 40 AND greatest(y.start2 - x.end2, x.start2 - y.end2, 0) BETWEEN 0 AND 2"""
)
def neighbors_2d(spark, d):
    rows = fx.part_rectangles(spark, d)
    return e2.neighbors_2d(rows, rows, 1, 40, 0, 2, 64)


@query("SELECT chrom1, greatest(start1 - 20, 0) AS start1, least(end1 + 20, 300) AS end1, chrom2, greatest(start2 - 20, 0) AS start2, least(end2 + 20, 300) AS end2 FROM rect WHERE start1 - 20 < 300 AND start2 - 20 < 300")
def force_range_2d(spark, d):
    rows = fx.part_rectangles(spark, d)
    wide = rows.select("chrom1", (F.col("start1") - 20).alias("start1"), (F.col("end1") + 20).alias("end1"), "chrom2", (F.col("start2") - 20).alias("start2"), (F.col("end2") + 20).alias("end2"))
    return e2.force_range_2d(wide, fx.chroms_of(rows.select(F.col("chrom1").alias("chrom")), 300))


@query("SELECT x.chrom AS chrom1, 0::BIGINT AS start1, 4000000::BIGINT AS end1, y.chrom AS chrom2, 0::BIGINT AS start2, 4000000::BIGINT AS end2 FROM (SELECT DISTINCT chrom FROM a) x, (SELECT DISTINCT chrom FROM a) y")
def all_pairs_2d(spark, d):
    return td.all_pairs(fx.chroms_of(fx.order_spans(spark, d)))


# sequences


@query("SELECT doc_id, reverse(seq) AS rev, translate(seq, 'ACGTNacgtn', 'TGCANtgcan') AS comp FROM seqs")
def reverse_and_complement(spark, d):
    return fx.sequences(spark, d).select("doc_id", seq.reverse(F.col("seq")).alias("rev"), seq.complement(F.col("seq")).alias("comp"))


_LOGS = [[float(x) for x in row[:4]] for row in MOTIF.log_matrix(0.01)]
_BASE = "CASE c{j} WHEN 'A' THEN {a} WHEN 'C' THEN {c} WHEN 'G' THEN {g} WHEN 'T' THEN {t} ELSE {n} END"
_SCORE = " + ".join(_BASE.format(j=j, a=r[0], c=r[1], g=r[2], t=r[3], n=sum(r) / 4) for j, r in enumerate(_LOGS))
_SCORE_BACK = " + ".join(_BASE.format(j=len(_LOGS) - 1 - j, a=r[3], c=r[2], g=r[1], t=r[0], n=sum(r) / 4) for j, r in enumerate(_LOGS))
_LETTERS = """l AS (SELECT doc_id, unnest(string_split(upper(seq), '')) AS c0, unnest(range(length(seq))) AS i FROM seqs WHERE seq <> ''),
 m AS (SELECT doc_id, c0, lead(c0) OVER w AS c1, lead(c0, 2) OVER w AS c2, lead(c0, 3) OVER w AS c3 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


@query(
    _with(
        f"{_LETTERS}, p AS (SELECT doc_id, {_SCORE} AS f, {_SCORE_BACK} AS r FROM m WHERE c3 IS NOT NULL)",
        "SELECT s.doc_id, round(ln(sum(exp(f) + exp(r))), 6) AS lse, round(max(greatest(f, r)), 6) AS best, sum(CASE WHEN ln(exp(f) + exp(r)) >= -3.0 THEN 1 ELSE 0 END)::DOUBLE AS hits FROM seqs s LEFT JOIN p USING (doc_id) GROUP BY s.doc_id",
    )
)
def pwm_sums(spark, d):
    s = F.col("seq")
    return _rounded(fx.sequences(spark, d).select("doc_id", seq.pwm(s, MOTIF, "lse").alias("lse"), seq.pwm(s, MOTIF, "max").alias("best"), seq.pwm(s, MOTIF, "count", threshold=-3.0).alias("hits")))


_TILES = "w AS (SELECT doc_id::VARCHAR AS chrom, seq, s AS \"start\", least(s + 500, length(seq)) AS \"end\" FROM (SELECT doc_id, seq, unnest(range(0, length(seq)::BIGINT, 500)) AS s FROM seqs WHERE length(seq) > 0))"


@query(
    _with(
        f"""{_TILES}, k AS (SELECT chrom, "start", unnest(range(1, ("end" - "start" + 1)::BIGINT)) AS i, upper(substr(seq, "start" + 1, "end" - "start" + 2)) AS s FROM w),
        c AS (SELECT chrom, "start", count(CASE WHEN substr(s, i, 3) = 'ACG' THEN 1 END) AS kf FROM k GROUP BY ALL)""",
        """SELECT w.chrom, w."start", w."end", coalesce(kf, 0) AS kf, length(regexp_replace(substr(seq, "start" + 1, "end" - "start"), '[^acgt]', '', 'g'))::BIGINT AS masked FROM w LEFT JOIN c USING (chrom, "start")""",
    )
)
def vtrack_sequence(spark, d):
    """K-mers that begin in, and masked letters of, windows of 500 letters of each text."""
    rows = fx.sequences(spark, d).where("length(seq) > 0").select(F.col("doc_id").cast("string").alias("chrom"), "seq")
    chroms = rows.select((F.crc32("chrom") % 1_000_000_007).cast("int").alias("chrom_id"), "chrom", F.length("seq").cast("long").alias("size"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.length("seq").cast("long") - 1, F.lit(1 << 16).cast("long")))
    chunks = rows.withColumn("chunk_start", at).select("chrom", "chunk_start", F.substring("seq", (F.col("chunk_start") + 1).cast("int"), F.lit(1 << 16)).alias("seq"))
    ws = tr.Workspace(chroms, sequence=chunks, sequence_chunk=1 << 16)
    ws.vtrack("k", None, "kmer.count", {"kmer": "ACG", "strand": 1})
    ws.vtrack("m", None, "masked.count")
    return ws.evaluate({"kf": "k", "masked": "m"}, iterator=500).drop("intervalID")


def _sequence_workspace(spark, d):
    """Texts as chromosomes of their own, in chunks; the letters are made once, as every use of the sizes would make them again."""
    rows = fx.sequences(spark, d).where("length(seq) > 0").select(F.col("doc_id").cast("string").alias("chrom"), F.length("seq").cast("long").alias("size"), "seq")
    rows = stored(rows, "sequences")
    chroms = rows.select((F.crc32("chrom") % 1_000_000_007).cast("int").alias("chrom_id"), "chrom", "size")
    # short chunks: a letter's place in a string is found by counting from its start
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(CHUNK).cast("long")))
    chunks = rows.withColumn("chunk_start", at).select("chrom", "chunk_start", F.substring("seq", (F.col("chunk_start") + 1).cast("int"), F.lit(CHUNK)).alias("seq"))
    return tr.Workspace(chroms, sequence=chunks, sequence_chunk=CHUNK)


def _score_sql(back: bool, neutral: str | None = None, letter: str = "c") -> str:
    """Sum of a place's log scores by letter; ``neutral`` is what N counts, else the column's mean."""
    parts = []
    for j, row in enumerate(_LOGS):
        a, c, g, t = row if not back else row[::-1]
        place = len(_LOGS) - 1 - j if back else j
        parts.append(f"CASE {letter}{place} WHEN 'A' THEN '{a}'::DOUBLE WHEN 'C' THEN '{c}'::DOUBLE WHEN 'G' THEN '{g}'::DOUBLE WHEN 'T' THEN '{t}'::DOUBLE ELSE {neutral or repr(str(float(np.mean(row))))}::DOUBLE END")
    return " + ".join(parts if not back else parts[::-1])


@query(
    _with(
        f"""l AS (SELECT doc_id::VARCHAR AS chrom, length(seq) AS size, unnest(string_split(seq, '')) AS c, unnest(range(length(seq))) AS i FROM seqs WHERE seq <> ''),
        m AS (SELECT *, upper(c) AS c0, upper(lead(c) OVER w) AS c1, upper(lead(c, 2) OVER w) AS c2, upper(lead(c, 3) OVER w) AS c3, i // 500 * 500 AS s, CASE WHEN i % 500 < 200 THEN 0 WHEN i % 500 >= 260 THEN 1 END AS part FROM l WINDOW w AS (PARTITION BY chrom ORDER BY i)),
        f AS (SELECT chrom, s, part, max(size) AS size, count(*) AS n, sum((c0 = 'A' AND c1 = 'C' AND c2 = 'G')::INT) AS k, count(c2) AS places, sum((c IN ('a', 'c', 'g', 't'))::INT) AS low,
              ln(sum(CASE WHEN c3 IS NOT NULL THEN exp({_score_sql(False, 'ln(0.25)')}) + exp({_score_sql(True)}) END)) AS lse, max(CASE WHEN c3 IS NOT NULL THEN greatest({_score_sql(False)}, {_score_sql(True)}) END) AS best
              FROM m WHERE part IS NOT NULL GROUP BY ALL)""",
        """SELECT chrom, s AS "start", least(s + 500, max(size)) AS "end", coalesce(sum(k), 0)::BIGINT AS kc, round(sum(CASE WHEN places > 0 THEN coalesce(k, 0) / places * n END) / sum(CASE WHEN places > 0 THEN n END), 6) AS kf,
        sum(low)::BIGINT AS mc, round(sum(low)::DOUBLE / sum(n), 6) AS mf, round(sum(lse), 5) AS lse, round(ln(sum(exp(lse))), 5) AS whole, round(max(best), 6) AS best FROM f GROUP BY chrom, s""",
    )
)
def vtrack_masked_sequence(spark, d):
    """K-mers, masked letters and motifs in windows of 500 letters that a mask cuts in two."""
    ws = _sequence_workspace(spark, d)
    at = F.explode(F.sequence(F.lit(200).cast("long"), F.col("size") + 500, F.lit(500).cast("long")))
    mask = ws.chroms.withColumn("start", at).select("chrom", "start", (F.col("start") + 60).alias("end"))
    kinds = {
        "kc": ("kmer.count", {"kmer": "ACG", "strand": 1}), "kf": ("kmer.frac", {"kmer": "ACG", "strand": 1}), "mc": ("masked.count", None), "mf": ("masked.frac", None),
        "lse": ("pwm", {"motif": MOTIF}), "whole": ("pwm", {"motif": MOTIF, "parts": "lse"}), "best": ("pwm.max", {"motif": MOTIF}),
    }
    for name, (func, params) in kinds.items():
        ws.vtrack(name, None, func, params, mask=mask)
    places = {"kf": 6, "mf": 6, "lse": 5, "whole": 5, "best": 6}
    made = ws.evaluate({k: k for k in kinds}, iterator=500)
    return made.where("mc IS NOT NULL").select("chrom", "start", "end", *(F.round(k, places[k]).alias(k) if k in places else k for k in kinds))


_REGION = """p AS (SELECT doc_id, i, CASE WHEN i < 60 THEN 0.0 ELSE ln(0.25) END AS w, {f} AS f, {r} AS r FROM m WHERE c3 IS NOT NULL{where}),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY greatest(f, r) + w DESC, i) AS k FROM p)"""


def _region_query(name: str, ctes: str, where: str, text: str, scan: seq.Scan):
    region = _REGION.format(f=_score_sql(False), r=_score_sql(True), where=where)

    @query(
        _with(
            f"{ctes}, {region}",
            """SELECT s.doc_id, round(ln(sum(exp(f + w) + exp(r + w))), 6) AS lse, round(max(greatest(f, r) + w), 6) AS best,
            max(CASE WHEN k = 1 THEN CASE WHEN r > f THEN -(i + 1) ELSE i + 1 END END)::DOUBLE AS pos, coalesce(sum((f + w >= -4.0)::INT + (r + w >= -4.0)::INT), 0)::DOUBLE AS hits FROM seqs s LEFT JOIN k USING (doc_id) GROUP BY s.doc_id""",
        ),
        name=name,
    )
    def run(spark, d):
        s = F.col("seq")
        kinds = {"lse": {}, "max": {}, "pos": {}, "count": {"threshold": -4.0, "per_strand": True}}
        names = {"lse": "lse", "max": "best", "pos": "pos", "count": "hits"}
        made = fx.sequences(spark, d).select("doc_id", *(seq.pwm(s, MOTIF, mode, scan=scan, **more).alias(names[mode]) for mode, more in kinds.items()))
        return made.select("doc_id", F.round("lse", 6).alias("lse"), F.round("best", 6).alias("best"), "pos", "hits")

    run.__doc__ = text


_PLACES = """l AS (SELECT doc_id, unnest(string_split(upper(seq), '')) AS c0, unnest(range(length(seq))) AS i FROM seqs WHERE seq <> ''),
 m AS (SELECT doc_id, i, c0, lead(c0) OVER w AS c1, lead(c0, 2) OVER w AS c2, lead(c0, 3) OVER w AS c3 FROM l{where} WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""
_region_query("pwm_spatial", _PLACES.format(where=""), " AND i >= 10 AND i + 3 < 200", "Places 11 to 200 of each text; those from place 61 on weigh a quarter.", seq.Scan(11, 200, spat_factor=(1.0, 0.25), spat_bin=50))
_region_query(
    "pwm_gaps",
    _PLACES.format(where=" WHERE c0 <> 'N'"),
    "",
    "Letters without a base are gaps that a motif reaches over; places beyond the 60th weigh a quarter.",
    seq.Scan(gaps="Nn", spat_factor=(1.0, 0.25), spat_bin=60),
)


@query("SELECT doc_id, replace(seq, 'ACG', 'CAG') AS seq FROM seqs")
def replace_kmer(spark, d):
    """No target arises anew around this replacement, so that SQL's one pass does too."""
    return sy.replace_kmer(fx.sequences(spark, d), "ACG", "CAG").select("doc_id", "seq")


# round trips through files and the catalog


@query('SELECT chrom, bin * 7 AS "start", bin * 7 + 7 AS "end", round(value, 6) AS value FROM price')
def bedgraph_round_trip(spark, d):
    from rangeloom.sources import formats as fm

    path = scratch_path(spark, "bedgraph")
    track = tr.Track(fx.price_bins(spark, d), 7)
    fm.write_bedgraph(track.records(), path)
    return _rounded(fm.read_bedgraph(spark, path))


@query('SELECT chrom, bin, round(value * 2, 6) AS value FROM price')
def create_track(spark, d):
    from rangeloom.plans.catalog import Database

    price = fx.price_bins(spark, d)
    db = Database.create(spark, scratch_path(spark, "catalog"), fx.chroms_of(price, fx.DAYS))
    db.save_dense("price", price, 7)
    db.create_track("twice", "price * 2", 7)
    return _rounded(db.table("track", "twice"))


# groups of blocks in conversions, and neighbours in two dimensions

CLUSTER_WIDTH = 8 * fx.DAY


def customer_chain(spark, d):
    """Blocks whose source is an order's span and whose chain is a hundred customers' orders; sources overlap, targets don't."""
    orders = fx.table(spark, d, "orders").where("o_orderdate IS NOT NULL")
    start = fx._day("o_orderdate") * fx.DAY + (F.col("o_orderkey") * 7919) % fx.DAY
    size = 1 + F.col("o_orderkey") % 300
    at = F.col("o_orderkey") * 1000
    return orders.select(
        F.concat(F.lit("t"), "o_orderpriority").alias("chrom"), at.alias("start"), (at + size).alias("end"), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1).alias("strand"),
        F.col("o_orderpriority").alias("chromsrc"), start.alias("startsrc"), (start + size).alias("endsrc"), F.lit(1).alias("strandsrc"), F.expr("o_custkey div 100").alias("chain_id"), F.lit(1.0).alias("score"),
    )


@query(
    _with(
        f"""c AS (SELECT o_orderpriority AS chrom, (d * {fx.DAY} + (o_orderkey * 7919) % {fx.DAY})::BIGINT AS s, (d * {fx.DAY} + (o_orderkey * 7919) % {fx.DAY} + 1 + o_orderkey % 300)::BIGINT AS e,
               o_orderkey * 1000 AS t, o_orderkey % 2 = 1 AS back, o_custkey // 100 AS chain_id FROM (SELECT *, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS d FROM orders WHERE o_orderdate IS NOT NULL)),
        r AS (SELECT chrom, w * {CLUSTER_WIDTH} AS a, (w + 1) * {CLUSTER_WIDTH} AS b FROM (SELECT chrom, unnest(range((max(e) // {CLUSTER_WIDTH} + 1)::BIGINT)) AS w FROM c GROUP BY chrom)),
        p AS (SELECT row_number() OVER () AS i, r.chrom, r.a, greatest(s, r.a) AS lo, least(e, r.b) AS hi, s, e, t, back, chain_id FROM c JOIN r ON c.chrom = r.chrom AND s < r.b AND r.a < e),
        l AS (SELECT x.i AS x, y.i AS y FROM p x JOIN p y ON x.chrom = y.chrom AND x.a = y.a AND (x.chain_id = y.chain_id OR x.lo < y.hi AND y.lo < x.hi)),
        g AS (WITH RECURSIVE z AS (SELECT x, y FROM l UNION SELECT z.x, l.y FROM z JOIN l ON z.y = l.x) SELECT x AS i, min(y) AS g FROM z GROUP BY x),
        n AS (SELECT p.*, g, max(hi) OVER (PARTITION BY p.chrom, p.a, g ORDER BY lo, hi, p.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p JOIN g USING (i)),
        m AS (SELECT chrom, a, g, sum(greatest(hi - greatest(lo, coalesce(reach, lo)), 0)) AS u, sum(hi - lo) AS s, max(hi - lo) AS m, min(lo) AS f, min(chain_id) AS k FROM n GROUP BY ALL),
        w AS (SELECT chrom, a, g, row_number() OVER (PARTITION BY chrom, a ORDER BY u DESC, f, k) AS ru, row_number() OVER (PARTITION BY chrom, a ORDER BY s DESC, f, k) AS rs, row_number() OVER (PARTITION BY chrom, a ORDER BY m DESC, f, k) AS rm FROM m),
        o AS (SELECT 't' || p.chrom AS chrom, CASE WHEN back THEN t + e - s - (hi - s) ELSE t + lo - s END AS "start", hi - lo AS n, p.chain_id, ru, rs, rm FROM n p JOIN w ON w.chrom = p.chrom AND w.a = p.a AND w.g = p.g)""",
        " UNION ALL ".join(f"""SELECT '{name}' AS policy, chrom, "start"::BIGINT AS "start", ("start" + n)::BIGINT AS "end", chain_id FROM o WHERE {rank} = 1""" for name, rank in (("best_cluster_union", "ru"), ("best_cluster_sum", "rs"), ("best_cluster_max", "rm"))),
    )
)
def liftover_clusters(spark, d):
    """Windows of eight days converted, each by its heaviest group of blocks."""
    from rangeloom.operators.liftover import CLUSTERS, as_chain, best_cluster, clusters
    from rangeloom.operators.liftover import liftover as run

    blocks = customer_chain(spark, d)
    rows = blocks.groupBy(F.col("chromsrc").alias("chrom")).agg(F.floor(F.max("endsrc") / CLUSTER_WIDTH).alias("last"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    rows = rows.select("chrom", at.alias("w")).select("chrom", (F.col("w") * CLUSTER_WIDTH).alias("start"), ((F.col("w") + 1) * CLUSTER_WIDTH).alias("end"))
    grouped = clusters(run(rows, as_chain(blocks, "keep", "keep"), metadata=True))
    made = None
    for policy in ("best_cluster_union", "best_cluster_sum", "best_cluster_max"):
        one = best_cluster(grouped, CLUSTERS[policy]).select(F.lit(policy).alias("policy"), "chrom", "start", "end", "chain_id")
        made = one if made is None else made.unionByName(one)
    return made


@query(
    _with(
        """t AS (SELECT DISTINCT p_brand AS chrom, (l_quantity * 10)::BIGINT AS x, (l_partkey // 10)::BIGINT AS y FROM lineitem JOIN part ON l_partkey = p_partkey),
        q AS (SELECT row_number() OVER () AS i, * FROM rect),
        k AS (SELECT q.*, t.x, t.y, greatest(t.x - end1, start1 - t.x - 1, 0) AS d1, greatest(t.y - end2, start2 - t.y - 1, 0) AS d2, (start1 >= t.x + 1 OR end1 <= t.x)::INT + (start2 >= t.y + 1 OR end2 <= t.y)::INT AS apart FROM q JOIN t ON t.chrom = chrom1),
        r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d1 + d2 + apart, x, y) AS k FROM k)""",
        "SELECT chrom1, start1, end1, start2, end2, value, x AS r_start1, y AS r_start2, d1 AS dist1, d2 AS dist2 FROM r WHERE k <= 3",
    )
)
def nearest_rectangles(spark, d):
    """The three sold (quantity, part) points nearest to each part's rectangle on its brand."""
    items, part = fx.table(spark, d, "lineitem"), fx.table(spark, d, "part")
    sold = items.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", (F.col("l_quantity") * 10).cast("long").alias("x"), F.expr("l_partkey div 10").alias("y")).distinct()
    points = sold.select(F.col("p_brand").alias("chrom1"), F.col("x").alias("start1"), (F.col("x") + 1).alias("end1"), F.col("p_brand").alias("chrom2"), F.col("y").alias("start2"), (F.col("y") + 1).alias("end2"))
    found = e2.nearest_2d(fx.part_rectangles(spark, d), points, 3)
    return found.select("chrom1", "start1", "end1", "start2", "end2", "value", "r_start1", "r_start2", "dist1", "dist2")


# edits of motif places

EDIT_WIDTH, EDIT_TARGET, LSE_TARGET = 100, -2.0, -0.2


def _edit_terms(back: bool) -> dict[str, str]:
    """SQL of a place's parts on a strand: score now, score that counts, letters that must go, gains, and what each letter would score."""
    now, own, must, gain, new = [], [], [], [], []
    for j, row in enumerate(_LOGS):
        letter = f"c{len(_LOGS) - 1 - j if back else j}"
        codes = dict(zip("TGCA" if back else "ACGT", row, strict=True))
        case = lambda other, codes=codes, letter=letter: f"CASE {letter} " + " ".join(f"WHEN '{x}' THEN '{v}'::DOUBLE" for x, v in codes.items()) + f" ELSE '{other}'::DOUBLE END"
        now.append(case(float(np.mean(row))))
        own.append(case(max(row)))
        must.append(f"({letter} NOT IN ('A', 'C', 'G', 'T'))::INT")
        gain.append(f"'{max(row)}'::DOUBLE - ({case(max(row))})")
        new += [(int(letter[1]), j, x, v) for x, v in codes.items()]
    return {"now": " + ".join(now), "own": " + ".join(own), "must": " + ".join(must), "gain": "[" + ", ".join(gain) + "]", "parts": now, "new": new}


def _edit_sql() -> str:
    sides = {"f": _edit_terms(False), "r": _edit_terms(True)}
    strands = " UNION ALL ".join(
        f"""SELECT chrom, s, i, '{k}' AS strand, {t["now"]} AS now, {t["own"]} AS own, {t["must"]} AS must, list_reverse_sort({t["gain"]}) AS g, c0, c1, c2, c3,
        [{", ".join(f"({p})" for p in t["parts"])}] AS parts FROM m WHERE c3 IS NOT NULL"""
        for k, t in sides.items()
    )
    #: for each column and letter: place in the window, and what the letter scores there
    news = "[" + ", ".join(f"struct_pack(strand := '{k}', at := {at}, j := {j}, x := '{x}', v := '{v}'::DOUBLE)" for k, t in sides.items() for at, j, x, v in t["new"]) + "]"
    met = lambda x: f"{x} >= {EDIT_TARGET} - 1e-12"
    fewest = f"must + CASE WHEN {met('own')} THEN 0 " + " ".join(f"WHEN {met(f'own + list_sum(g[1:{k}])')} THEN {k}" for k in (1, 2, 3, 4)) + " END"
    return _with(
        f"""l AS (SELECT doc_id::VARCHAR AS chrom, length(seq) AS size, unnest(string_split(upper(seq), '')) AS c0, unnest(range(length(seq))) AS i FROM seqs WHERE seq <> ''),
        m AS (SELECT *, i // {EDIT_WIDTH} * {EDIT_WIDTH} AS s, lead(c0) OVER w AS c1, lead(c0, 2) OVER w AS c2, lead(c0, 3) OVER w AS c3 FROM l WINDOW w AS (PARTITION BY chrom, i // {EDIT_WIDTH} ORDER BY i)),
        p AS ({strands}),
        e AS (SELECT *, {fewest} AS edits FROM p),
        z AS (SELECT chrom, s, strand, sum(exp(now)) AS z FROM p GROUP BY ALL),
        u AS (SELECT *, unnest({news}) AS n FROM p),
        v AS (SELECT chrom, s, strand, i + n.at AS q, n.x AS x, sum(exp(now - parts[n.j + 1] + n.v) - exp(now)) AS d FROM u WHERE n.strand = strand GROUP BY ALL),
        y AS (SELECT chrom, s, strand, max(d) AS d FROM v GROUP BY ALL),
        k AS (SELECT chrom, s, min(CASE WHEN ln(z) >= {LSE_TARGET} THEN 0 WHEN ln(z + d) >= {LSE_TARGET} THEN 1 END) AS lse FROM z JOIN y USING (chrom, s, strand) GROUP BY ALL),
        o AS (SELECT chrom, s, strand, i, CASE WHEN {met("own")} THEN 0 ELSE nullif(list_sum(list_transform(list_filter({news}, lambda n: n.strand = strand AND [c0, c1, c2, c3][n.at + 1] IN ('A', 'C', 'G', 'T') AND [c0, c1, c2, c3][n.at + 1] <> n.x),
              lambda n: ({met("own - parts[n.j + 1] + n.v")})::INT)), 0) END AS n FROM p),
        fewest_of AS (SELECT chrom, s, edits, i - s + 1 AS place, strand, row_number() OVER (PARTITION BY chrom, s ORDER BY edits NULLS LAST, i, strand) AS k FROM e),
        h AS (SELECT chrom, s, edits, row_number() OVER (PARTITION BY chrom, s ORDER BY now DESC, i, strand) AS k FROM e)""",
        f"""SELECT w.chrom, w.s AS "start", least(w.s + {EDIT_WIDTH}, w.size) AS "end", b.edits::DOUBLE AS fewest, CASE WHEN b.edits IS NOT NULL THEN CASE WHEN b.strand = 'r' THEN -b.place ELSE b.place END END::DOUBLE AS place, h.edits::DOUBLE AS at_best, o.n::DOUBLE AS single, k.lse::DOUBLE AS lse
        FROM (SELECT DISTINCT chrom, s, size FROM m) w LEFT JOIN fewest_of b ON b.chrom = w.chrom AND b.s = w.s AND b.k = 1 LEFT JOIN h ON h.chrom = w.chrom AND h.s = w.s AND h.k = 1
        LEFT JOIN (SELECT chrom, s, max(n) AS n FROM o GROUP BY ALL) o ON o.chrom = w.chrom AND o.s = w.s LEFT JOIN k ON k.chrom = w.chrom AND k.s = w.s""",
    )


@query(_edit_sql())
def vtrack_motif_edits(spark, d):
    """Fewest substitutions that make a motif's place, or the log-sum-exp of a window of 100 letters (one at most), reach a score."""
    ws = _sequence_workspace(spark, d)
    options = {"motif": MOTIF, "threshold": EDIT_TARGET, "extend": False}
    kinds = {"fewest": "pwm.edit_distance", "place": "pwm.edit_distance.pos", "at_best": "pwm.max.edit_distance", "single": "pwm.n_mutations"}
    for name, func in kinds.items():
        ws.vtrack(name, None, func, options)
    ws.vtrack("lse", None, "pwm.edit_distance.lse", options | {"threshold": LSE_TARGET, "max_edits": 1})
    return ws.evaluate({k: k for k in (*kinds, "lse")}, iterator=EDIT_WIDTH).drop("intervalID")


@query(
    _with(
        """x AS (SELECT p_brand AS chrom, p_size AS bin, sum(round(p_retailprice * 100)::BIGINT)::DOUBLE / count(*) / 100 AS value FROM part GROUP BY ALL),
        y AS (SELECT p_brand AS chrom, (l_partkey // 10)::BIGINT AS s, sum(l_quantity::BIGINT)::DOUBLE / count(*) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
        cell AS (SELECT DISTINCT chrom1, start1, end1, start2, end2 FROM rect),
        r AS (SELECT c.*, max(r.value) AS r FROM cell c JOIN rect r ON r.chrom1 = c.chrom1 AND r.start1 < c.end1 AND c.start1 < r.end1 AND r.start2 < c.end2 AND c.start2 < r.end2 GROUP BY ALL),
        q AS (SELECT c.*, avg(y.value) AS y, count(y.value) AS n FROM cell c LEFT JOIN y ON y.chrom = c.chrom1 AND y.s >= greatest(c.start2 - 20, 0) AND y.s < c.end2 + 20 GROUP BY ALL)""",
        """SELECT r.chrom1, r.start1, r.end1, r.start2, r.end2, round(r.r - x.value, 6) AS above, round(q.y, 6) AS sold, q.n FROM rect JOIN r USING (chrom1, start1, end1, start2, end2)
        JOIN q USING (chrom1, start1, end1, start2, end2) LEFT JOIN x ON x.chrom = r.chrom1 AND x.bin = r.start1 // 10""",
    )
)
def expression_of_axes(spark, d):
    """Rectangles of parts against the mean price of their size (axis 1) and the quantities sold around their keys (axis 2)."""
    part, items = fx.table(spark, d, "part"), fx.table(spark, d, "lineitem")
    price = part.groupBy(F.col("p_brand").alias("chrom"), F.col("p_size").cast("long").alias("bin")).agg((F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).cast("double") / F.count("*") / 100).alias("value"))
    key = F.expr("l_partkey div 10")
    sold = items.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("chrom"), key.alias("start")).agg((F.sum(F.col("l_quantity").cast("long")).cast("double") / F.count("*")).alias("value"))
    rect = fx.part_rectangles(spark, d)
    size = rect.agg(F.greatest(F.max("end1"), F.max("end2"))).first()[0] or 0
    chroms = fx.chroms_of(rect.withColumnRenamed("chrom1", "chrom"), size + 100)
    line = tr.Workspace(chroms)
    line.dense("price", price, 10)
    line.sparse("sold", sold.withColumn("end", F.col("start") + 1).select("chrom", "start", "end", "value"))
    for name, func in {"around": "avg", "near": "size"}.items():
        line.vtrack(name, "sold", func, sshift=-20, eshift=20)
    ws = e2.Workspace2D(chroms, line=line)
    ws.track("rect", rect)
    ws.vtrack("r", "rect", "max")
    ws.axis("x", "price", 1)
    ws.axis("y", "around", 2)
    ws.axis("n", "near", 2)
    made = ws.evaluate({"above": "r - x", "sold": "y", "n": "n"}, iterator="rect")
    return made.select("chrom1", "start1", "end1", "start2", "end2", F.round("above", 6).alias("above"), F.round("sold", 6).alias("sold"), "n")


@query(
    _with(
        """one AS (SELECT p_brand AS chrom, p_partkey * 10 AS s, p_retailprice AS price, p_size::DOUBLE AS size FROM part),
        two AS (SELECT p_brand AS chrom, p_partkey * 10 AS s, p_retailprice AS price, sum(l_quantity::BIGINT)::DOUBLE AS sold FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
        three AS (SELECT n_name AS chrom, s_suppkey * 10 AS s, s_acctbal AS sold FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
        """SELECT coalesce(one.chrom, two.chrom) AS chrom, coalesce(one.s, two.s) AS "start", coalesce(one.s, two.s) + 10 AS "end", coalesce(one.price, two.price) AS price, size, sold FROM one FULL JOIN two ON one.chrom = two.chrom AND one.s = two.s
        UNION ALL SELECT chrom, s, s + 10, NULL, NULL, sold FROM three WHERE sold IS NOT NULL""",
    )
)
def array_import(spark, d):
    """An array track of two files and a table that share columns and places: parts' prices and sizes, prices and quantities sold, and balances."""
    part, items = fx.table(spark, d, "part"), fx.table(spark, d, "lineitem")
    place = [F.col("p_brand").alias("chrom"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + 10).alias("end")]
    one = part.select(*place, F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    sold = items.groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).cast("double").alias("sold"))
    two = part.join(sold, F.col("p_partkey") == F.col("l_partkey")).select(*place, F.col("p_retailprice").alias("price"), "sold")
    files = []
    for name, table in (("one", one), ("two", two)):
        path = scratch_path(spark, f"array_{name}")
        table.write.option("sep", "\t").option("header", True).csv(path)
        files.append(read_array(spark, path))
    key = F.col("s_suppkey") * 10
    three = fx.table(spark, d, "supplier").join(fx.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    three = three.select(F.col("n_name").alias("chrom"), key.alias("start"), (key + 10).alias("end"), F.array("s_acctbal").alias("value"))
    made, names = tr.merge_arrays([*files, (three, ["sold"])])
    return made.select("chrom", "start", "end", *(F.get("value", F.lit(i)).alias(n) for i, n in enumerate(names)))


@query(
    _with(
        """w AS (SELECT chrom, size, bin * 7 AS s, greatest(bin * 7 - 1400, 0) AS a, least(least(bin * 7 + 7, size) + 1400, size) AS e FROM bins),
        t AS (SELECT w.chrom, w.s, w.size, value, max(value) OVER (PARTITION BY w.chrom, w.s) AS top FROM w LEFT JOIN price p ON p.chrom = w.chrom AND p.bin * 7 < w.e AND p.bin * 7 + 7 > w.a)""",
        """SELECT chrom, s AS "start", least(s + 7, max(size)) AS "end", round(avg(value), 5) AS m, round(sum(value), 3) AS t, count(value) AS n, min(value) AS lo, max(value) AS hi, round(max(top) + ln(sum(exp(value - top))), 5) AS l
        FROM t GROUP BY chrom, s""",
    )
)
def vtrack_wide_windows(spark, d):
    """Windows of 400 weeks around each week."""
    ws = fx.workspace(spark, d)
    for name, func in {"m": "avg", "t": "sum", "n": "size", "lo": "min", "hi": "max", "l": "lse"}.items():
        ws.vtrack(name, "price", func, sshift=-1400, eshift=1400)
    made = ws.evaluate({k: k for k in ("m", "t", "n", "lo", "hi", "l")}, iterator=7).drop("intervalID")
    return made.select("chrom", "start", "end", F.round("m", 5).alias("m"), F.round("t", 3).alias("t"), "n", "lo", "hi", F.round("l", 5).alias("l"))


# models over strata along the sequence

_STRATA = """l AS (SELECT doc_id::VARCHAR AS chrom, length(seq) AS size, unnest(string_split(seq, '')) AS c, unnest(range(length(seq))) AS i FROM seqs WHERE seq <> ''),
 m AS (SELECT chrom, size, i, c, i // 500 * 500 AS s, upper(c) AS c0, upper(lead(c) OVER w) AS c1, upper(lead(c, 2) OVER w) AS c2 FROM l WINDOW w AS (PARTITION BY chrom ORDER BY i)),
 f AS (SELECT chrom, s, sum((c0 = 'A' AND c1 = 'C' AND c2 = 'G')::INT) AS kc, sum((c IN ('a', 'c', 'g', 't'))::INT) AS mc FROM m GROUP BY ALL),
 z AS (SELECT chrom, s, CASE WHEN mc < 300 THEN 1 WHEN mc < 400 THEN 2 ELSE 3 END + 3 * CASE WHEN coalesce(kc, 0) < 2 THEN 0 ELSE 1 END AS stratum FROM f),
 k AS (SELECT m.chrom, m.size, i, stratum, c0 || c1 AS context, c2 AS base, i BETWEEN 100 AND 159 AS masked, regexp_matches(c0 || c1 || c2, '^[ACGT]{3}$') AS good FROM m JOIN z USING (chrom, s) WHERE c2 IS NOT NULL),
 fwd AS (SELECT stratum, context, base FROM k WHERE good AND NOT masked),
 cnt AS (SELECT stratum, context, base, count(*) AS n FROM (FROM fwd UNION ALL SELECT stratum, reverse(translate(substr(context, 2, 1) || base, 'ACGT', 'TGCA')), translate(substr(context, 1, 1), 'ACGT', 'TGCA') FROM fwd) GROUP BY ALL),
 p AS (SELECT stratum, context, base, n, (n + sum(n) OVER (PARTITION BY stratum, base) / sum(n) OVER (PARTITION BY stratum)) / (sum(n) OVER (PARTITION BY stratum, context) + 1) AS p FROM cnt)"""


def _strata_model(spark, d) -> tuple[tr.Workspace, st.StrataModel, DataFrame]:
    """Texts as sequences, with strata by soft-masked letters and ACGs of 500 letters; the third bin of ACGs counts as the second."""
    ws = _sequence_workspace(spark, d)
    ws.vtrack("k", None, "kmer.count", {"kmer": "ACG", "strand": 1})
    ws.vtrack("m", None, "masked.count")
    dims = (st.Dimension("m", (0, 300, 400, 500)), st.Dimension("k", (0, 2, 6, 500), ((3, 2),)))
    mask = ws.chroms.where("size > 100").select("chrom", F.lit(100).cast("long").alias("start"), F.least("size", F.lit(160).cast("long")).alias("end"))
    return ws, st.train(ws, 2, dims, iterator=500, mask=mask), mask


@query(_with(_STRATA, "SELECT stratum, context, base, n, round(p, 9) AS p FROM p"))
def synth_strata(spark, d):
    _, model, _ = _strata_model(spark, d)
    return model.table.where("n > 0").select("stratum", "context", "base", "n", F.round("p", 9).alias("p"))


@query(
    _with(
        _STRATA + """, v AS (SELECT l.chrom, l.i, ln(p.p) AS value FROM l LEFT JOIN k ON k.chrom = l.chrom AND k.i = l.i - 2 AND NOT l.i BETWEEN 100 AND 159 LEFT JOIN p ON k.good AND p.stratum = k.stratum AND p.context = k.context AND p.base = k.base)""",
        "SELECT chrom, i // 40 AS bin, CASE WHEN count(value) = count(*) THEN round(sum(value), 6) END AS value FROM v GROUP BY ALL",
    )
)
def synth_score(spark, d):
    ws, model, mask = _strata_model(spark, d)
    return st.score(ws, model, 40, mask=mask).select("chrom", "bin", F.round("value", 6).alias("value"))


@query("SELECT doc_id::VARCHAR AS chrom, length(seq) AS size, length(seq) - length(replace(seq, 'N', '')) AS unknown, substr(seq, 101, 60) AS copied FROM seqs WHERE seq <> ''")
def synth_sample(spark, d):
    """What a sample keeps: sizes, unknown letters and the mask's places; ``tests/test_strata.py`` holds its frequencies against the model's."""
    ws, model, mask = _strata_model(spark, d)
    made = st.sample(ws, model, mask_copy=mask).withColumn("unknown", F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit(""))))
    copied = F.coalesce(F.max(F.when(F.col("chunk_start") == 0, F.substring("seq", 101, 60))), F.lit(""))
    return made.groupBy("chrom").agg(F.sum(F.length("seq")).alias("size"), F.sum("unknown").alias("unknown"), copied.alias("copied"))
