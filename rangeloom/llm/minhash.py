"""Near-duplicate documents: MinHash bands, odd-sketch verification, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rangeloom.llm import _text as T
from rangeloom.llm._store import stored
from rangeloom.llm.components import connected_components

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 40, 5
#: Bits of the odd sketch of the MinHash samples, and of the parity bitmap of the whole set.
ODD_BITS, SET_BITS = 512, 1024
#: Standard deviations by which an odd sketch's estimate may fall short before a pair is dropped.
MARGIN = 5.0

_ODD = [f"o{i}" for i in range(ODD_BITS // 64)]
_PARITY = [f"p{i}" for i in range(SET_BITS // 64)]


def _multipliers(k: int) -> np.ndarray:
    return T.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _parity(rows: np.ndarray, places: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Parity bitmaps, one row of 64-bit integers for each of n rows."""
    flat = np.bincount(rows * bits + places, minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(flat.astype(np.uint8), axis=1).view(np.int64)


def shingle_sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each chunk of texts: its first row, and the sorted distinct shingle hashes of each text."""
    for row, end, data, offsets in T.chunks(column):
        data = T.lower_bytes(data)
        starts, ends, bounds = T.word_spans(data, offsets)
        hashes, cuts = T.shingle_hashes(T.word_hashes(data, starts, ends), bounds, width)
        yield row, [np.unique(hashes[cuts[i] : cuts[i + 1]]) for i in range(end - row)]


def _signatures(sets: list[np.ndarray], bands: int, rows: int, factors: np.ndarray) -> dict[str, np.ndarray]:
    n, k = len(sets), bands * rows
    low = np.full((n, k), 0xFFFFFFFF, np.uint32)
    for i, values in enumerate(sets):
        for at in range(0, len(values), 512):
            block = ((values[at : at + 512, None] * factors) >> np.uint64(32)).astype(np.uint32)
            np.minimum(low[i], block.min(0), out=low[i])
    sizes = np.array([len(x) for x in sets], np.int64)
    everything = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    places = (T.mix(low.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(ODD_BITS)).astype(np.int64)
    out = {"n_shingles": sizes}
    odd = _parity(np.repeat(np.arange(n), k), places.ravel(), n, ODD_BITS)
    parity = _parity(owner, (everything >> np.uint64(54)).astype(np.int64), n, SET_BITS)
    out |= {name: odd[:, i] for i, name in enumerate(_ODD)} | {name: parity[:, i] for i, name in enumerate(_PARITY)}
    for name, salt in (("k0", 0x5851F42D4C957F2D), ("k1", 0x14057B7EF767814F)):
        total = np.zeros(n, np.uint64)
        np.add.at(total, owner, T.mix(everything ^ np.uint64(salt)))
        out[name] = T.mix(total + sizes.astype(np.uint64)).view(np.int64)
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25), (n, 1))
    for r in range(rows):
        key = T.mix(key + low[:, r::rows].astype(np.uint64)) * np.uint64(0xE7037ED1A0B428DB)
    out["bands"] = key.view(np.int64)
    return out


def signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Set size, 128-bit set key, band keys, odd sketch and parity bitmap of each (id, text) row."""
    numbers = ["n_shingles", "k0", "k1", *_ODD, *_PARITY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _multipliers(bands * rows)
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), width):
                made = _signatures(sets, bands, rows, factors)
                keys = pa.ListArray.from_arrays(np.arange(0, bands * len(sets) + 1, bands, dtype=np.int32), pa.array(made["bands"].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(sets)), *(pa.array(np.ascontiguousarray(made[x])) for x in numbers), keys],
                    ["id", *numbers, "bands"],
                )

    return docs.mapInArrow(run, "id long, " + ", ".join(f"{x} long" for x in numbers) + ", bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in shingle_sets(batch.column(1), width):
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(sets)), pa.ListArray.from_arrays(cuts, values)], ["id", "hashes"])

    return docs.mapInArrow(run, "id long, hashes array<long>")


def _differing(names: list[str], x: str, y: str) -> Column:
    total = F.lit(0)
    for name in names:
        total = total + F.bit_count(F.col(f"{x}.{name}").bitwiseXOR(F.col(f"{y}.{name}")))
    return total


def may_link(x: str, y: str, samples: int, percent: int) -> Column:
    """Whether two sketched documents may reach the threshold.

    The odd sketch's XOR count z estimates the similarity as
    1 + n / 4k * ln(1 - 2z / n) for k samples in n bits; a pair is dropped when
    that lies MARGIN standard deviations below the threshold.  The whole sets'
    parity bitmaps differ in no more bits than the sets differ in elements,
    so that test, and the one on sizes, lose nothing at all.
    """
    t = percent / 100
    least = t - MARGIN * (t * (1 - t) / samples) ** 0.5 * 1.3
    most_odd = ODD_BITS / 2 * (1 - np.exp(-4 * samples * (1 - least) / ODD_BITS))
    a, b = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    return (
        (F.least(a, b) * 100 >= F.greatest(a, b) * percent)
        & (_differing(_PARITY, x, y) * (100 + percent) <= (a + b) * (100 - percent))
        & (_differing(_ODD, x, y) <= F.lit(float(most_odd)))
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Group documents whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable
    over links) and ``kept`` (the document is its component's smallest), one row
    for each input row.

    Texts are lower-cased (A-Z) and split at ASCII white space; a text of fewer
    than ``width`` words is one shingle, and a null, empty or blank text has no
    shingle and no link.  A row without an id can't be named: it has no links, a
    null component, and is kept.  Repeated rows share their id and component.
    An empty table gives an empty result; other columns of ``docs`` are ignored.

    Documents with equal sets form classes first, so copies cost one row each.
    Class representatives that agree on a band of MinHash samples are compared
    in two rounds: with the band's smallest id, then (only in bands that still
    hold several components) across components.  Sketches are compared inside
    the join, and what passes is confirmed on the full sets.  A pair at the
    threshold misses all 40 bands of 5 with probability (1 - 0.75**5)**40, about
    2e-5; nothing else is lost.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(signatures(base, width, bands, rows), "signatures")
    named = signed.where("n_shingles > 0 AND id IS NOT NULL")
    classes = named.groupBy("k0", "k1").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    copies = named.join(classes.where("n > 1"), ["k0", "k1"]).select(F.col("rep").alias("a"), F.col("id").alias("b")).where("a != b")
    reps = named.join(classes, ["k0", "k1"]).where("id = rep").dropDuplicates(["k0", "k1"])
    reps = stored(reps.drop("rep", "n", "k0", "k1"), "representatives")

    members = reps.select("id", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader < last")
    members = stored(members.join(buckets, "key").select("key", "id", "leader"), "buckets")
    sketch = reps.drop("bands")
    busy = stored(members.select("id").distinct(), "busy")
    sketch = stored(sketch.join(busy, "id", "left_semi"), "sketches")
    sets = stored(_sets(base.join(busy, "id", "left_semi"), width), "sets")
    samples = bands * rows

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return pairs.join(x, "a").join(y, "b").where(both * (100 + percent) >= (F.size("x") + F.size("y")) * percent).select("a", "b")

    stars = members.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(sketch.alias("x"), F.col("a") == F.col("x.id")).join(sketch.alias("y"), F.col("b") == F.col("y.id"))
    first = stored(confirmed(stars.where(may_link("x", "y", samples, percent)).select("a", "b")), "stars")

    label = connected_components(first)
    label = label.withColumnRenamed("component", "label")
    rest = members.join(label, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    rest = stored(rest.join(mixed, "key", "left_semi").join(sketch, "id"), "mixed")
    across = rest.alias("x").join(
        rest.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & may_link("x", "y", samples, percent)
    )
    second = confirmed(across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())

    component = connected_components(first.union(second).union(copies))
    found = signed.select(F.col("id").alias(id_col), "n_shingles").join(component.withColumnRenamed("id", id_col), id_col, "left")
    return found.select(
        id_col,
        "n_shingles",
        F.coalesce("component", id_col).alias("component_id"),
        F.coalesce(F.col(id_col) == F.coalesce("component", id_col), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    Rows that repeat a kept id are dropped too, down to the one whose text has the smallest hash; a row without an id stays.
    """
    verdict = near_duplicates(docs, id_col, text_col, **options).where(F.col("kept") & F.col(id_col).isNotNull())
    kept = docs.join(verdict.select(id_col).distinct(), id_col, "left_semi")
    one = kept.groupBy(id_col).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(F.col(text_col).cast("string"))).alias("_row"))
    return one.select("_row.*").unionByName(docs.where(F.col(id_col).isNull())).select(docs.columns)
