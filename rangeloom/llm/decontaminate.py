"""Benchmark passages in documents, by shingles shared in windows of the items' sizes; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rangeloom.llm import _text as T
from rangeloom.llm._store import stored

WIDTH = 5
PERCENT = 75
#: Benchmark shingles up to which they are broadcast (32 bytes each); beyond, they are joined by a shuffle.
BROADCAST_SHINGLES = 1_000_000


def _shingles(words: Column, width: Column) -> Column:
    """Hashes of the word shingles of an array of words, in order."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(F.slice(words, i + 1, width)))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shared_weight(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def contaminated_passages(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """Documents and the benchmark items that they hold.

    Returns ``doc_id``, ``text_hash``, ``item_id``, ``similarity`` (best of the
    document's windows, 0 to 1) and ``start_word`` (the first best window), one
    row for each document and item with a window of the item's number of words
    whose multiset of five-word shingles has a weighted Jaccard similarity of
    ``percent`` / 100 or more with the item's; a shingle weighs as often as it
    stands there.  Words are lower-cased (A-Z) and split at white space; an item
    of fewer than five words is one shingle; a document shorter than the item is
    one window.  Items without words or id, and documents without words, match
    nothing.  Repeated document rows are reported once; a null ``doc_id`` is
    reported as such.  Items with equal texts are each reported.

    A window can only reach the threshold if that share of the item's shingle
    count stands in it, so the windows that hold as many shingles of an item of
    their size are compared with that item and no others; that loses nothing.
    Exact similarity decides.
    """
    known = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), T.words(T.ascii_lower(F.col(item_text).cast("string"))).alias("words"))
    known = known.where(F.size("words") > 0).withColumn("length", F.size("words")).withColumn("width", F.least("length", F.lit(width)))
    known = known.withColumn("shingles", _shingles(F.col("words"), F.col("width"))).withColumn("hashes", _word_hashes(F.col("words"))).drop("words")
    known = stored(known.dropDuplicates(["item_id", "hashes"]).withColumn("n", F.size("shingles")), "items")
    widths = known.agg(F.collect_set("width")).first()[0]

    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.where("text IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))
    key = ["doc_id", "text_hash"]
    entries = known.select("item_id", "width", "n", F.explode("shingles").alias("h")).distinct()
    entries = stored(entries, "item_shingles")
    if entries.count() <= BROADCAST_SHINGLES:
        entries = F.broadcast(entries)

    hits = None
    for k in sorted(widths) or [width]:
        words = base.select(*key, T.words(T.ascii_lower(F.col("text"))).alias("words")).where(F.size("words") >= k)
        at = words.select(*key, (F.size("words") - k + 1).alias("n_doc"), F.posexplode(_shingles(F.col("words"), F.lit(k))).alias("pos", "h"))
        at = at.join(entries.where(F.col("width") == k), "h")
        hits = at if hits is None else hits.unionByName(at)
    # a shared shingle counts in the windows that begin up to n - 1 places before it: one more from there on, one less past it
    group = [*key, "item_id", "n", "width"]
    hits = hits.repartition(*key, "item_id").dropDuplicates([*group, "pos"])
    edges = F.array(
        F.struct(F.greatest(F.col("pos") - F.col("n") + 1, F.lit(0)).alias("at"), F.lit(1).alias("step")),
        F.struct((F.col("pos") + 1).alias("at"), F.lit(-1).alias("step")),
    )
    edges = hits.select(*group, (F.greatest(F.col("n_doc") - F.col("n"), F.lit(0))).alias("last"), F.explode(edges).alias("e")).select(*group, "last", "e.at", "e.step")
    order = Window.partitionBy(*group).orderBy("at")
    held = F.sum("step").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edges = edges.select(*group, "last", "at", held.alias("held"), F.lead("at").over(order).alias("next"))
    # the windows that begin from one edge to the next hold as many; of edges at one place only the last has any
    spans = edges.where(F.expr(f"held * 100 >= n * {percent} AND at < next AND at <= last"))
    windows = spans.select(*group, F.explode(F.sequence(F.col("at"), F.least(F.col("next") - 1, F.col("last")))).alias("start"))
    windows = windows.groupBy(*key).agg(F.collect_list(F.struct("item_id", "n", "width", "start")).alias("windows"))

    joined = windows.alias("w").join(base.alias("t"), F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.text_hash") == F.col("t.text_hash")))
    joined = joined.select("w.doc_id", "w.text_hash", "windows", T.words(T.ascii_lower(F.col("text"))).alias("words")).dropDuplicates(key)
    joined = joined.select(*key, "words", F.explode("windows").alias("w"))
    cut = F.slice("words", F.col("w.start") + 1, F.col("w.n") + F.col("w.width") - 1)
    joined = joined.select(*key, "w.item_id", "w.n", "w.width", "w.start", cut.alias("words"))
    marked = stored(joined.select(*key, "item_id", "n", "width", "start", _shingles(F.col("words"), F.col("width")).alias("x")), "windows")
    near = marked.join(known.select("item_id", "n", "width", F.col("shingles").alias("y")), ["item_id", "n", "width"])
    shared = _shared_weight(F.col("x"), F.col("y"))
    scored = near.withColumn("shared", shared).where(F.expr(f"shared * {100 + percent} >= (size(x) + size(y)) * {percent}"))
    scored = scored.withColumn("similarity", F.col("shared") / (F.size("x") + F.size("y") - F.col("shared")))
    best = scored.groupBy(*key, "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best"))
    return best.select(*key, "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.before")).alias("start_word"))


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``items``, with all their columns."""
    bad = contaminated_passages(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_hash"))
    return docs.join(bad, same, "left_anti")
