"""Scans and folds of expressions: extract, screen, summaries, quantiles, histograms, correlations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.functions.binning import bin_index, bin_label
from rangeloom.operators import iterators as it
from rangeloom.operators.intervals import canonic
from rangeloom.operators.ranges import TILE, no_nan, running
from rangeloom.operators.tracks import Workspace
from rangeloom.storage import stored


def extract(ws: Workspace, exprs: dict[str, str], scope: DataFrame | None = None, iterator=None) -> DataFrame:
    """Iterator rows with each expression's value, and the scope row's ``intervalID``; overlapping scope rows repeat."""
    return ws.evaluate(exprs, scope, iterator)


def merge_runs(rows: DataFrame, flag: Column, carry: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Join consecutive touching rows for which ``flag`` holds, and whose ``carry`` columns agree, into one."""
    carry = carry or []
    marked = stored(rows.withColumn("_k", F.when(flag, F.struct(F.col("end").alias("e"), *carry))), "runs")
    order = [F.col("start"), F.col("end")]
    prev = Window.partitionBy("chrom", F.floor(F.col("start") / tile)).orderBy(*order)
    # what the row before a tile's first row was
    tiles = marked.withColumn("_tile", F.floor(F.col("start") / tile))
    last = tiles.groupBy("chrom", "_tile").agg(F.max_by(F.struct("_k"), F.struct("start", "end")).alias("_l"))
    last = last.select("chrom", "_tile", F.lag("_l").over(Window.partitionBy("chrom").orderBy("_tile")).alias("_before"))
    tiles = tiles.withColumn("_p", F.lag(F.struct("_k")).over(prev)).join(last, ["chrom", "_tile"])
    before = F.coalesce("_p", "_before")["_k"]
    same = before.isNotNull() & (before["e"] == F.col("start"))
    for c in carry:
        same = same & before[c].eqNullSafe(F.col(c))
    hits = tiles.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("long")).where(flag).drop("_tile", "_p", "_before", "_k")
    runs = running(hits, "sum", F.col("_new"), "_run", order, tile, before=False)
    return runs.groupBy("chrom", "_run", *carry).agg(F.min("start").alias("start"), F.max("end").alias("end")).select("chrom", "start", "end", *carry)


def _merged(ws: Workspace, scope: DataFrame | None) -> DataFrame:
    """Folds merge their scope, so that no position counts twice."""
    return ws.scope(None if scope is None else canonic(scope))


def screen(ws: Workspace, condition: str, scope: DataFrame | None = None, iterator=None) -> DataFrame:
    """Intervals where the condition holds; neighbours that touch are merged, false and null both break a run."""
    rows = ws.evaluate({"hit": condition}, _merged(ws, scope), iterator)
    return merge_runs(rows, F.coalesce(F.col("hit"), F.lit(False)))


def sample(ws: Workspace, expr: str, n: int, scope: DataFrame | None = None, iterator=None, seed: int = 1) -> DataFrame:
    """A uniform sample of ``n`` values, missing ones included."""
    return ws.evaluate({"value": expr}, _merged(ws, scope), iterator).select("value").orderBy(F.rand(seed)).limit(n)


def partition(ws: Workspace, expr: str, breaks: list[float], scope: DataFrame | None = None, iterator=None, include_lowest: bool = False) -> DataFrame:
    """Runs of consecutive iterator rows whose value falls in one bin: ``chrom, start, end, bin`` (from 1)."""
    rows = ws.evaluate({"_v": expr}, _merged(ws, scope), iterator)
    rows = rows.withColumn("bin", bin_index(F.col("_v"), breaks, include_lowest) + 1)
    return merge_runs(rows, F.col("bin").isNotNull(), ["bin"])


def lookup(ws: Workspace, table: list, exprs: list[tuple[str, list[float]]], scope: DataFrame | None = None, iterator=None, include_lowest: bool = False, force: bool = True) -> DataFrame:
    """Value of a (nested) lookup table addressed by binned expressions, for each iterator row."""
    rows = ws.evaluate({f"_e{i}": e for i, (e, _) in enumerate(exprs)}, scope, iterator)

    def flat(x) -> list[float]:
        return [z for y in x for z in flat(y)] if isinstance(x, (list, tuple)) else [float(x)]

    values, place = F.array(*(F.lit(v) for v in flat(table))), F.lit(0)
    for i, (_, breaks) in enumerate(exprs):
        place = place * (len(breaks) - 1) + bin_index(F.col(f"_e{i}"), breaks, include_lowest, force)
    return rows.select(*it.COLUMNS, F.get(values, place.cast("int")).alias("value"))


def summary_columns(v: Column) -> list[Column]:
    """Bins, missing bins, min, max, sum, mean and sample deviation of a value column."""
    v = no_nan(v)
    return [
        F.count(F.lit(1)).alias("n"), F.count(F.when(v.isNull(), 1)).alias("n_missing"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"),
    ]


def summary(ws: Workspace, expr: str, scope: DataFrame | None = None, iterator=None) -> DataFrame:
    return ws.evaluate({"_v": expr}, _merged(ws, scope), iterator).agg(*summary_columns(F.col("_v")))


def quantiles(ws: Workspace, expr: str, percentiles: list[float], scope: DataFrame | None = None, iterator=None) -> DataFrame:
    """Rows (``percentile``, ``value``): exact, interpolated at (n - 1) * p."""
    rows = ws.evaluate({"_v": expr}, _merged(ws, scope), iterator)
    made = exact_quantiles(rows.select(no_nan("_v").alias("_v")), "_v", percentiles)
    return made.select(F.posexplode("q").alias("i", "value")).select(F.get(F.array(*map(F.lit, percentiles)), F.col("i")).alias("percentile"), "value")


def exact_quantiles(rows: DataFrame, column: str, percentiles: list[float], keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and an array ``q`` of exact percentiles, interpolated at (n - 1) * p, of a column's non-null values.

    They are picked by rank among counted distinct values, so that no task holds
    all values of a key.
    """
    ranked = cumulative(rows.where(F.col(column).isNotNull()), column, keys=keys)
    total = ranked.groupBy(*keys).agg(F.sum("c").alias("_n"))
    ranked = ranked.join(total, list(keys)) if keys else ranked.join(F.broadcast(total), F.lit(True))

    def pick(p: float, end: Callable) -> Column:
        at = end((F.col("_n") - 1) * float(p))
        return F.max(F.when((F.col("before") <= at) & (at < F.col("before") + F.col("c")), F.col(column)))

    picks = [x for i, p in enumerate(percentiles) for x in (pick(p, F.floor).alias(f"_l{i}"), pick(p, F.ceil).alias(f"_h{i}"))]
    found = ranked.groupBy(*keys).agg(F.first("_n").alias("_n"), *picks)
    part = lambda p: (F.col("_n") - 1) * float(p) - F.floor((F.col("_n") - 1) * float(p))
    values = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * part(p) for i, p in enumerate(percentiles)]
    return found.select(*keys, F.array(*values).alias("q"))


def interval_summary(ws: Workspace, expr: str, scope: DataFrame, iterator=None) -> DataFrame:
    """Summary for each scope row; rows without iterator rows have 0 bins."""
    numbered = it.numbered(scope)
    made = ws.evaluate({"_v": expr}, numbered, iterator).groupBy("intervalID").agg(*summary_columns(F.col("_v")))
    out = numbered.select(*it.COLUMNS).join(made, "intervalID", "left")
    return out.withColumns({"n": F.coalesce("n", F.lit(0)), "n_missing": F.coalesce("n_missing", F.lit(0))})


def interval_quantiles(ws: Workspace, expr: str, percentiles: list[float], scope: DataFrame, iterator=None) -> DataFrame:
    """A column ``q<p>`` for each percentile, for each scope row."""
    numbered = it.numbered(scope)
    rows = ws.evaluate({"_v": expr}, numbered, iterator).select("intervalID", no_nan("_v").alias("_v"))
    made = exact_quantiles(rows, "_v", percentiles, ("intervalID",))
    out = numbered.select(*it.COLUMNS).join(made, "intervalID", "left")
    return out.select(*it.COLUMNS, *(F.get("q", F.lit(i)).alias(f"q{p:g}") for i, p in enumerate(percentiles)))


def interval_apply(ws: Workspace, function: Callable, exprs: dict[str, str], scope: DataFrame, iterator=None, name: str = "value") -> DataFrame:
    """A user's function of the vectors of all expressions for each scope row.

    ``function`` takes a numpy array per expression and returns a number; the
    vectors are in order of place, reversed where the row's strand is -1.  Rows
    of one scope row are gathered in one task, as a function of a whole vector asks.
    """
    numbered = it.numbered(scope)
    rows = ws.evaluate(exprs, numbered, iterator)
    if "strand" in numbered.columns:
        rows = rows.join(numbered.select("intervalID", "strand"), "intervalID")
    columns = list(exprs)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start", ascending=not ("strand" in pdf and pdf["strand"].iloc[0] == -1))
        return pd.DataFrame({"intervalID": [pdf["intervalID"].iloc[0]], name: [float(function(*(pdf[c].to_numpy() for c in columns)))]})

    made = rows.groupBy("intervalID").applyInPandas(one, f"intervalID long, {name} double")
    return numbered.select(*it.COLUMNS).join(made, "intervalID", "left")


def _binned(ws: Workspace, exprs: list[tuple[str, list[float]]], value: str | None, scope, iterator, include_lowest: bool) -> DataFrame:
    named = {f"_e{i}": e for i, (e, _) in enumerate(exprs)} | ({"_v": value} if value else {})
    rows = ws.evaluate(named, _merged(ws, scope), iterator)
    for i, (_, breaks) in enumerate(exprs):
        rows = rows.withColumn(f"bin{i + 1}", bin_index(F.col(f"_e{i}"), breaks, include_lowest))
    return rows.where(" AND ".join(f"bin{i + 1} IS NOT NULL" for i in range(len(exprs))))


def _cells(ws: Workspace, exprs: list[tuple[str, list[float]]]) -> DataFrame:
    """Every combination of bins, as many as the caller's breaks make."""
    spark = ws.chroms.sparkSession
    grid = spark.range(1).select()
    for i, (_, breaks) in enumerate(exprs):
        grid = grid.withColumn(f"bin{i + 1}", F.explode(F.sequence(F.lit(0), F.lit(len(breaks) - 2))))
    return grid


def _labelled(df: DataFrame, exprs: list[tuple[str, list[float]]], include_lowest: bool) -> DataFrame:
    for i, (_, breaks) in enumerate(exprs):
        labels = [bin_label(j, breaks, include_lowest) for j in range(len(breaks) - 1)]
        df = df.withColumn(f"range{i + 1}", F.get(F.array(*map(F.lit, labels)), F.col(f"bin{i + 1}")))
    return df


def distribution(ws: Workspace, exprs: list[tuple[str, list[float]]], scope: DataFrame | None = None, iterator=None, include_lowest: bool = False) -> DataFrame:
    """Histogram over the bins of one or more expressions, empty cells included: ``bin1.., range1.., n``."""
    keys = [f"bin{i + 1}" for i in range(len(exprs))]
    made = _binned(ws, exprs, None, scope, iterator, include_lowest).groupBy(*keys).agg(F.count("*").alias("n"))
    out = _cells(ws, exprs).join(made, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _labelled(out, exprs, include_lowest)


def bins_summary(ws: Workspace, exprs: list[tuple[str, list[float]]], value: str, scope: DataFrame | None = None, iterator=None, include_lowest: bool = False) -> DataFrame:
    """Summary of one expression for each cell of other expressions' bins."""
    keys = [f"bin{i + 1}" for i in range(len(exprs))]
    made = _binned(ws, exprs, value, scope, iterator, include_lowest).groupBy(*keys).agg(*summary_columns(F.col("_v")))
    out = _cells(ws, exprs).join(made, keys, "left")
    return _labelled(out.withColumns({"n": F.coalesce("n", F.lit(0)), "n_missing": F.coalesce("n_missing", F.lit(0))}), exprs, include_lowest)


def bins_quantiles(ws: Workspace, exprs: list[tuple[str, list[float]]], value: str, percentiles: list[float], scope: DataFrame | None = None, iterator=None, include_lowest: bool = False) -> DataFrame:
    keys = [f"bin{i + 1}" for i in range(len(exprs))]
    rows = _binned(ws, exprs, value, scope, iterator, include_lowest)
    made = exact_quantiles(rows.select(*keys, no_nan("_v").alias("_v")), "_v", percentiles, tuple(keys))
    out = _cells(ws, exprs).join(made, keys, "left")
    return _labelled(out.select(*keys, *(F.get("q", F.lit(i)).alias(f"q{p:g}") for i, p in enumerate(percentiles))), exprs, include_lowest)


def correlation(ws: Workspace, pairs: list[tuple[str, str]], scope: DataFrame | None = None, iterator=None, method: str = "pearson") -> DataFrame:
    """Rows (``pair``, ``n``, ``n_missing``, ``mean1``, ``mean2``, ``sd1``, ``sd2``, ``cov``, ``cor``) for pairs of expressions.

    Iterator rows with a missing value are left out.  ``spearman`` ranks with
    ties averaged; ranks come from counts of distinct values, so that equal
    values cost one row in the ranking.
    """
    named = {f"_{s}{i}": e for i, p in enumerate(pairs) for s, e in zip("xy", p, strict=True)}
    rows = ws.evaluate(named, _merged(ws, scope), iterator)
    if method == "spearman":
        rows = stored(rows.select(*(no_nan(c).alias(c) for c in named)), "ranked")
        lines = [_correlations(_ranked(rows, f"_x{i}", f"_y{i}"), [(i, "_x", "_y")]) for i in range(len(pairs))]
        return reduce(DataFrame.unionByName, lines)
    return _correlations(rows, [(i, f"_x{i}", f"_y{i}") for i in range(len(pairs))])


def _ranked(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Average ranks of two columns among the rows that have both; the other rows follow as nulls."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    full = rows.where(both).select(x, y)
    for c in (x, y):
        full = full.join(average_ranks(full, c).withColumnRenamed("rank", f"r{c}"), c)
    rest = rows.where(~both).select(F.lit(None).cast("double").alias("_x"), F.lit(None).cast("double").alias("_y"))
    return full.select(F.col(f"r{x}").cast("double").alias("_x"), F.col(f"r{y}").cast("double").alias("_y")).unionByName(rest)


def _correlations(rows: DataFrame, pairs: list[tuple[int, str, str]]) -> DataFrame:
    """A row for each numbered pair of columns, all from one aggregation."""
    made = []
    for i, a, b in pairs:
        x, y = no_nan(a), no_nan(b)
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        made.append(F.struct(
            F.lit(i + 1).alias("pair"), F.count("*").alias("n"), F.count(F.when(~both, 1)).alias("n_missing"), F.avg(x).alias("mean1"), F.avg(y).alias("mean2"),
            F.stddev_samp(x).alias("sd1"), F.stddev_samp(y).alias("sd2"), F.covar_samp(x, y).alias("cov"), F.corr(x, y).alias("cor"),
        ))
    return rows.agg(F.array(*made).alias("_pairs")).select(F.inline("_pairs"))


def cumulative(df: DataFrame, column: str, weight: str | None = None, parts: int = 64, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct values of ``column`` with their count ``c`` (or sum of ``weight``) and ``before``, that of all smaller values, for each of ``keys``.

    Values are counted, cut into ranges at approximate quantiles, and summed
    within (keys, range); what the ranges before hold is a sum over a row for
    each.  So no task sorts all values, and a value costs one row.
    """
    counts = stored(df.groupBy(*keys, column).agg((F.sum(weight) if weight else F.count("*")).alias("c")), "counts")
    cuts = counts.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)]).alias("cuts"))
    ranged = counts.join(F.broadcast(cuts), F.lit(True)).withColumn("_r", F.size(F.filter(F.array_distinct("cuts"), lambda b: b < F.col(column)))).drop("cuts")
    own = ranged.groupBy(*keys, "_r").agg(F.sum("c").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = own.select(*keys, "_r", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_r").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_before", F.coalesce(F.sum("c").over(within), F.lit(0))).join(base, [*keys, "_r"])
    return placed.select(*keys, column, "c", (F.col("_base") + F.col("_before")).alias("before"))


def average_ranks(df: DataFrame, column: str, parts: int = 64) -> DataFrame:
    """``column`` and its average ``rank`` from 1, a row for each distinct value."""
    return cumulative(df, column, parts=parts).select(column, (F.col("before") + (F.col("c") + 1) / 2).alias("rank"))


def strands_autocorrelation(reads: DataFrame, bin_size: int, max_distance: int, cap: int = 10) -> DataFrame:
    """Correlation of forward and reverse binned read counts at each offset of bins.

    ``reads`` has ``pos`` and ``strand``; counts are capped.  Bins from the first
    to the last read take part, empty ones as zeros: the sums of products come
    from joins of the bins that hold reads.
    """
    counts = reads.groupBy(F.floor(F.col("pos") / bin_size).alias("bin")).agg(
        F.least(F.count(F.when(F.col("strand") >= 0, 1)), F.lit(cap)).alias("f"), F.least(F.count(F.when(F.col("strand") < 0, 1)), F.lit(cap)).alias("r")
    )
    reach = int(max_distance / bin_size)
    ends = counts.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    offsets = F.explode(F.sequence(F.lit(-reach), F.lit(reach - 1)))
    span = ends.withColumn("offset", offsets).withColumns({"lo1": F.greatest(F.col("lo"), F.col("lo") - F.col("offset")), "hi1": F.least(F.col("hi"), F.col("hi") - F.col("offset"))})
    sent = counts.where("f > 0").withColumn("offset", offsets).withColumn("to", F.col("bin") + F.col("offset"))
    xy = sent.join(counts.select(F.col("bin").alias("to"), F.col("r").alias("r2")), "to").groupBy("offset").agg(F.sum(F.col("f") * F.col("r2")).alias("xy"))
    both = counts.join(F.broadcast(span), F.lit(True))
    inside = both.groupBy("offset").agg(
        *(F.sum(F.when(F.col("bin").between(F.col("lo1"), F.col("hi1")), F.col("f") ** p)).alias(f"f{p}") for p in (1, 2)),
        *(F.sum(F.when(F.col("bin").between(F.col("lo1") + F.col("offset"), F.col("hi1") + F.col("offset")), F.col("r") ** p)).alias(f"r{p}") for p in (1, 2)),
        F.first(F.col("hi1") - F.col("lo1") + 1).alias("n"),
    )
    made = inside.join(xy, "offset", "left").withColumn("xy", F.coalesce("xy", F.lit(0)))
    top = F.col("n") * F.col("xy") - F.col("f1") * F.col("r1")
    low = F.sqrt((F.col("n") * F.col("f2") - F.col("f1") ** 2) * (F.col("n") * F.col("r2") - F.col("r1") ** 2))
    return made.select((F.col("offset") * bin_size).alias("offset"), F.when(low > 0, top / low).alias("cor"))
