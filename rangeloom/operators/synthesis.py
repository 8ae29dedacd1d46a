"""Order-k Markov models of sequences: counting, sampling and scoring."""

from __future__ import annotations

from bisect import bisect_right
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions.sequence import kmer_counts, kmers, reverse_complement

MAX_ORDER = 8


def train(sequences: DataFrame, k: int, pseudocount: float = 1.0, both_strands: bool = True, strata: str | None = None) -> DataFrame:
    """Model table: ``context`` (k bases), ``base``, ``n`` and ``p`` = (n + pseudocount) / (total + 4 * pseudocount).

    Words with other letters aren't counted.  ``strata`` names a column whose
    values get models of their own.  The table has 4 ** (k + 1) rows a stratum at
    most, whatever the sequences' size; words are counted with map-side combination.
    """
    if not 1 <= k <= MAX_ORDER:
        raise ValueError(f"order must be 1 to {MAX_ORDER}")
    keys = [strata] if strata else []
    rows = sequences.select(*keys, F.upper("seq").alias("seq"))
    if both_strands:
        rows = rows.unionByName(rows.withColumn("seq", reverse_complement(F.col("seq"))))
    if keys:
        words = rows.select(*keys, F.explode(kmers(F.col("seq"), k + 1)).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("n"))
    else:
        words = kmer_counts(rows, "seq", k + 1).withColumnRenamed("kmer", "w")
    spark = sequences.sparkSession
    bases = F.array(*map(F.lit, "ACGT"))
    grid = spark.range(1).select(F.lit("").alias("w"))
    for _ in range(k + 1):
        grid = grid.select(F.explode(F.transform(bases, lambda b: F.concat("w", b))).alias("w"))
    if keys:
        grid = grid.join(rows.select(*keys).distinct(), F.lit(True))
    made = grid.join(words, [*keys, "w"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    made = made.select(*keys, F.substring("w", 1, k).alias("context"), F.substring("w", k + 1, 1).alias("base"), "n")
    total = made.groupBy(*keys, "context").agg(F.sum("n").alias("_t"))
    return made.join(total, [*keys, "context"]).select(*keys, "context", "base", "n", ((F.col("n") + pseudocount) / (F.col("_t") + 4 * pseudocount)).alias("p"))


def forbid(model: DataFrame, pattern: str) -> DataFrame:
    """A model that never completes ``pattern`` (k + 1 bases or fewer); the other bases share its probability."""
    keys = [c for c in model.columns if c not in ("context", "base", "n", "p")]
    ends = F.concat("context", "base").endswith(pattern.upper())
    cut = model.withColumn("p", F.when(ends, 0.0).otherwise(F.col("p")))
    total = cut.groupBy(*keys, "context").agg(F.sum("p").alias("_t"))
    return cut.join(total, [*keys, "context"]).withColumn("p", F.when(F.col("_t") > 0, F.col("p") / F.col("_t")).otherwise(0.0)).drop("_t")


def _matrix(model: DataFrame) -> tuple[int, np.ndarray]:
    """The model as an array over context codes; of a size that its order fixes."""
    rows = model.select("context", "base", "p").toPandas()
    k = len(rows["context"].iloc[0])
    index = {"".join(c): i for i, c in enumerate(product("ACGT", repeat=k))}
    out = np.full((4**k, 4), 0.25)
    for context, base, p in rows.itertuples(index=False):
        out[index[context], "ACGT".index(base)] = p
    return k, out


def sample(model: DataFrame, lengths: DataFrame, seed: int = 1) -> DataFrame:
    """``seq`` of each row's ``length``, drawn from a model; a row's draw depends on ``seed`` and its ``id``."""
    k, table = _matrix(model)
    cumulative = np.cumsum(table, axis=1)

    def one(identifier: int, length: int) -> str:
        rng = np.random.default_rng([seed, int(identifier) & (2**63 - 1)])
        codes = list(rng.integers(0, 4, min(k, length)))
        state = 0
        for c in codes:
            state = state * 4 + int(c)
        for u in rng.random(max(0, length - k)):
            c = min(3, int(np.searchsorted(cumulative[state], u * cumulative[state][-1], "right")))
            codes.append(c)
            state = (state * 4 + c) % 4**k
        return "".join("ACGT"[c] for c in codes)

    @F.pandas_udf("string")
    def draw(ids: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series([one(i, n) for i, n in zip(ids, sizes, strict=True)], dtype="object")

    return lengths.withColumn("seq", draw("id", "length"))


def score(model: DataFrame, sequences: DataFrame, resolution: int) -> DataFrame:
    """``bin`` and summed log probability ``value`` of each sequence's bins; null where a base, or one of the first k, is unknown."""
    k, table = _matrix(model)
    logs = np.log(np.maximum(table, 1e-300))
    columns = [c for c in sequences.columns if c != "seq"]
    lookup = np.full(256, -1)
    for i, (a, b) in enumerate(zip("ACGT", "acgt", strict=True)):
        lookup[ord(a)] = lookup[ord(b)] = i

    @F.pandas_udf("array<double>")
    def values(batch: pd.Series) -> pd.Series:
        out = []
        for s in batch:
            codes = lookup[np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)]
            per = np.full(len(codes), np.nan)
            if len(codes) > k:
                state = sum(codes[i : len(codes) - k + i] * 4 ** (k - 1 - i) for i in range(k))
                known = np.all([codes[i : len(codes) - k + i] >= 0 for i in range(k + 1)], axis=0)
                at = np.flatnonzero(known)
                per[k + at] = logs[state[at], codes[k + at]]
            out.append([float(per[i : i + resolution].sum()) for i in range(0, len(per), resolution)])
        return pd.Series(out, dtype="object")

    scored = sequences.select(*columns, F.posexplode(values("seq")).alias("bin", "value"))
    return scored.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def random_sequences(lengths: DataFrame, probabilities: dict[str, float] | None = None, seed: int = 1) -> DataFrame:
    """Independent random bases."""
    p = probabilities or dict.fromkeys("ACGT", 0.25)
    letters, weights = list(p), np.array(list(p.values())) / sum(p.values())

    @F.pandas_udf("string")
    def draw(ids: pd.Series, sizes: pd.Series) -> pd.Series:
        return pd.Series(["".join(np.random.default_rng([seed, int(i)]).choice(letters, int(n), p=weights)) for i, n in zip(ids, sizes, strict=True)], dtype="object")

    return lengths.withColumn("seq", draw("id", "length"))


def replace_kmer(sequences: DataFrame, target: str, replacement: str, check_composition: bool = True) -> DataFrame:
    """Replace a k-mer until it no longer occurs."""
    if check_composition and sorted(target.upper()) != sorted(replacement.upper()):
        raise ValueError("the replacement has other bases")
    if target.upper() in replacement.upper():
        raise ValueError("the replacement holds the target")

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        out = []
        for s in batch:
            while s is not None and target in s:
                s = s.replace(target, replacement)
            out.append(s)
        return pd.Series(out, dtype="object")

    return sequences.withColumn("seq", run("seq"))


def implant(sequence: DataFrame, donors: DataFrame) -> DataFrame:
    """Chunks (``chrom, chunk_start, seq``) with donors (``chrom, start, end, seq`` of that length) put in their place."""
    from rangeloom.operators.ranges import overlap_join

    chunks = sequence.withColumns({"start": F.col("chunk_start"), "end": F.col("chunk_start") + F.length("seq")})
    hits = overlap_join(chunks.select("chrom", "chunk_start", "start", "end"), donors.withColumnRenamed("seq", "donor"))
    per = hits.groupBy("chrom", "chunk_start").agg(F.sort_array(F.collect_list(F.struct("start1", "end1", "donor"))).alias("d"))

    def put(acc, x):
        low = F.greatest(x["start1"], F.col("chunk_start"))
        high = F.least(x["end1"], F.col("chunk_start") + F.length("seq"))
        part = F.substring(x["donor"], (low - x["start1"] + 1).cast("int"), (high - low).cast("int"))
        return F.overlay(acc, part, (low - F.col("chunk_start") + 1).cast("int"), (high - low).cast("int"))

    joined = sequence.join(per, ["chrom", "chunk_start"], "left")
    return joined.select("chrom", "chunk_start", F.when(F.col("d").isNull(), F.col("seq")).otherwise(F.aggregate("d", F.col("seq"), put)).alias("seq"))


def transplant(intervals: DataFrame, source: DataFrame, target: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """The sequence table ``target`` with the places of ``intervals`` taken from ``source``; both have chunks of one size."""
    from rangeloom.sources.formats import extract_sequence

    return implant(target, extract_sequence(source, intervals.select("chrom", "start", "end"), chunk))


def bin_map(breaks: list[float], merges: list[tuple]) -> dict[int, int]:
    """Bins (from 1) to the bins that they merge into.

    A merge is (from, to): a range of values, or one value for all above it, and
    the range of a bin.  A bin is merged if it lies within the range; the rest
    stay as they are.
    """
    out = {i: i for i in range(1, len(breaks))}
    for source, to in merges:
        low, high = source if isinstance(source, (tuple, list)) else (source, float("inf"))
        goal = next((i for i in range(1, len(breaks)) if abs(breaks[i - 1] - to[0]) < 1e-9 and abs(breaks[i] - to[1]) < 1e-9), None)
        if goal is None:
            raise ValueError(f"{to} is no bin of the breaks")
        out |= {i: goal for i in range(1, len(breaks)) if breaks[i - 1] >= low - 1e-9 and breaks[i] <= high + 1e-9}
    return out


def merge_bins(df: DataFrame, column: str, mapping: dict[int, int]) -> DataFrame:
    """A column of bins (from 1) put through ``bin_map``; bins that it doesn't name stay."""
    pairs = F.create_map(*(F.lit(x) for pair in sorted(mapping.items()) for x in pair))
    return df.withColumn(column, F.coalesce(F.element_at(pairs, F.col(column).cast("int")), F.col(column)))


def cell_merge(dims: list[list[float]], merges: list[tuple[list[float], list[float]]], maps: list[dict[int, int]] | None = None) -> list[dict[str, int]]:
    """Cells of several binned dimensions that stand for others, from representative values (from, to).

    Each entry has the bins of both cells (from 1, after ``maps``) and their
    flat numbers (from 1, the first dimension running fastest).
    """
    out = []
    for source, target in merges:
        row, flats = {}, []
        for kind, values in (("from", source), ("to", target)):
            flat, step = 0, 1
            for d, (breaks, value) in enumerate(zip(dims, values, strict=True)):
                if not breaks[0] <= value <= breaks[-1]:
                    raise ValueError(f"{value} is in no bin of dimension {d + 1}")
                # a break begins the bin above it, but for the last
                at = min(bisect_right(breaks, value), len(breaks) - 1) - 1
                at = maps[d].get(at + 1, at + 1) if maps else at + 1
                row[f"{kind}_{d + 1}"] = at
                flat, step = flat + (at - 1) * step, step * (len(breaks) - 1)
            flats.append(flat + 1)
        out.append(row | {"source_flat": flats[0], "target_flat": flats[1]})
    return out


def save_model(model: DataFrame, path: str) -> None:
    """A model's table as Parquet."""
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
