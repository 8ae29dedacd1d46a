"""Text formats of intervals, tracks and sequences, read and written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither blank nor headers or comments, cut at tabs, or at white space where there are none."""
    text = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$") & ~F.col("value").rlike(r"^(#|track\b|browser\b)"))
    return text.withColumn("f", F.when(F.instr("value", "\t") > 0, F.split("value", "\t")).otherwise(F.split(F.trim("value"), r"\s+")))


def _strand(c: Column) -> Column:
    return F.when(c == "+", 1).when(c == "-", -1).otherwise(0)


def read_bed(spark: SparkSession, path: str, name: bool = True, score: bool = True, strand: bool = True) -> DataFrame:
    """BED: ``chrom, start, end`` as they stand, and name, score and strand (1, -1, 0) where asked for."""
    f = F.col("f")
    columns = [F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start"), F.get(f, F.lit(2)).cast("long").alias("end")]
    if name:
        columns.append(F.get(f, F.lit(3)).alias("name"))
    if score:
        columns.append(F.get(f, F.lit(4)).try_cast("double").alias("score"))
    if strand:
        columns.append(_strand(F.get(f, F.lit(5))).alias("strand"))
    return _lines(spark, path).select(*columns)


def read_gff(spark: SparkSession, path: str, feature: str | None = None, strand: bool = True, attrs: bool = True) -> DataFrame:
    """GFF or GTF: 1-based closed places become 0-based half-open."""
    f = F.col("f")
    rows = _lines(spark, path).select(
        F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(3)).cast("long") - 1).alias("start"), F.get(f, F.lit(4)).cast("long").alias("end"), F.get(f, F.lit(2)).alias("feature"),
        *([_strand(F.get(f, F.lit(6))).alias("strand")] if strand else []), *([F.get(f, F.lit(8)).alias("attributes")] if attrs else []),
    )
    return rows.where(F.col("feature") == feature) if feature else rows


def read_vcf(spark: SparkSession, path: str, info: bool = True) -> DataFrame:
    """VCF: a row per record, as long as its reference allele."""
    f = F.col("f")
    start = F.get(f, F.lit(1)).cast("long") - 1
    return _lines(spark, path).select(
        F.get(f, F.lit(0)).alias("chrom"), start.alias("start"), (start + F.length(F.get(f, F.lit(3)))).alias("end"), F.get(f, F.lit(2)).alias("id"),
        F.get(f, F.lit(3)).alias("ref"), F.get(f, F.lit(4)).alias("alt"), F.get(f, F.lit(5)).try_cast("double").alias("qual"), F.get(f, F.lit(6)).alias("filter"),
        *([F.get(f, F.lit(7)).alias("info")] if info else []),
    )


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """bedGraph, or tab-separated intervals with a value: ``chrom, start, end, value``."""
    f = F.col("f")
    rows = _lines(spark, path).select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("end"), F.get(f, F.lit(3)).try_cast("double").alias("value"))
    return rows.where("start IS NOT NULL")


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """WIG with fixed or variable step: ``chrom, start, end, value``; places become 0-based.

    A value's place depends on the declaration before it, so each file is cut at
    its declarations (the record separator is "Step"), and a section is parsed
    as a row of its own.  A declaration's values should fit in a task's memory.
    """
    sections = spark.read.option("lineSep", "Step").text(path).select("value", F.lead("value").over(Window.partitionBy(F.input_file_name()).orderBy(F.monotonically_increasing_id())).alias("next"))
    kind = F.regexp_extract("value", r"(fixed|variable)$", 1)
    body = sections.select(kind.alias("kind"), F.split("next", r"\r?\n").alias("lines")).where("kind != ''")
    head = F.get("lines", F.lit(0))
    pick = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(head, rf"\b{k}=(\S+)", 1), F.lit("")), F.lit(default))
    named = body.select("kind", pick("chrom", "").alias("chrom"), pick("start", "1").cast("long").alias("first"), pick("step", "1").cast("long").alias("step"), pick("span", "1").cast("long").alias("span"), F.posexplode("lines").alias("i", "line"))
    values = named.where((F.col("i") > 0) & F.col("line").rlike(r"^\s*-?[0-9.]"))
    fields = F.split(F.trim("line"), r"\s+")
    start = F.when(F.col("kind") == "fixed", F.col("first") + (F.col("i") - 1) * F.col("step")).otherwise(F.get(fields, F.lit(0)).try_cast("long")) - 1
    value = F.when(F.col("kind") == "fixed", F.get(fields, F.lit(0))).otherwise(F.get(fields, F.lit(1)))
    return values.select("chrom", start.alias("start"), (start + F.col("span")).alias("end"), value.try_cast("double").alias("value"))


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """FASTA as chunks ``chrom, chunk_start, seq`` of at most ``chunk`` bases."""
    records = spark.read.option("lineSep", ">").text(path).where("length(trim(value)) > 0")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    bases = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    rows = records.select(name.alias("chrom"), bases.alias("bases"))
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.length("bases") - 1, F.lit(0)).cast("long"), F.lit(chunk).cast("long")))
    return rows.withColumn("chunk_start", at).select("chrom", "chunk_start", F.substring("bases", (F.col("chunk_start") + 1).cast("int"), F.lit(chunk)).alias("seq"))


def extract_sequence(sequence: DataFrame, intervals: DataFrame, chunk: int = 1 << 20) -> DataFrame:
    """``seq`` of each interval, reverse complemented where its strand is -1."""
    from rangeloom.functions.sequence import reverse_complement

    rows = intervals.withColumn("_id", F.monotonically_increasing_id())
    asked = rows.withColumn("_c", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    asked = asked.withColumn("chunk_start", F.col("_c") * chunk).drop("_c")
    found = asked.join(sequence, ["chrom", "chunk_start"])
    first = F.greatest(F.col("start") - F.col("chunk_start"), F.lit(0))
    last = F.least(F.col("end") - F.col("chunk_start"), F.lit(chunk))
    found = found.withColumn("part", F.substring("seq", (first + 1).cast("int"), (last - first).cast("int")))
    whole = found.groupBy(*rows.columns).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_start", "part"))), lambda x: x["part"]), "").alias("seq"))
    if "strand" in intervals.columns:
        whole = whole.withColumn("seq", F.when(F.col("strand") == -1, reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    return whole.drop("_id")


def read_array(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """A tab-separated table with a header, chrom, start, end and a column for each element, as records of an array track, and the elements' names."""
    table = spark.read.option("sep", "\t").option("header", True).csv(path)
    names = [c for c in table.columns if c not in ("chrom", "start", "end", "intervalID")]
    values = F.array(*(F.col(f"`{c}`").try_cast("double") for c in names))
    return table.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), values.alias("value")), names


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text: mapped reads ``chrom, pos`` (0-based), ``strand, length``."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("@"))
    flag = F.get(f, F.lit(1)).cast("int")
    made = rows.select(F.get(f, F.lit(2)).alias("chrom"), (F.get(f, F.lit(3)).cast("long") - 1).alias("pos"), F.when(flag.bitwiseAND(16) > 0, -1).otherwise(1).alias("strand"), F.length(F.get(f, F.lit(9))).alias("length"), flag.alias("flag"))
    return made.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("chrom") != "*")).drop("flag")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Alignment chains as blocks ``chrom,start,end,strand,chromsrc,startsrc,endsrc,strandsrc,chain_id,score``.

    The chain's reference side is the source and its query side the target.  A
    chain is one record of the file; its block offsets are running sums.
    """
    chains = spark.read.option("lineSep", "chain ").text(path).where(F.col("value").rlike(r"^\s*[-0-9.]+\s"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    head = F.split(F.trim(F.get(lines, F.lit(0))), r"\s+")
    names = ["score", "chromsrc", "sizesrc", "strandsrc", "s0", "e0", "chrom", "size", "strand", "t0", "t1", "chain_id"]
    rows = chains.select(*(F.get(head, F.lit(i)).alias(n) for i, n in enumerate(names)), F.slice(lines, F.lit(2), F.size(lines)).alias("body"))
    blocks = F.transform("body", lambda x: F.transform(F.split(F.trim(x), r"\s+"), lambda y: y.cast("long")))
    step = lambda acc, b: F.struct(
        (acc["s"] + b[0] + F.coalesce(F.get(b, F.lit(1)), F.lit(0))).alias("s"),
        (acc["t"] + b[0] + F.coalesce(F.get(b, F.lit(2)), F.lit(0))).alias("t"),
        F.concat(acc["out"], F.array(F.struct(acc["s"].alias("s"), acc["t"].alias("t"), b[0].alias("n")))).alias("out"),
    )
    zero = F.struct(F.col("s0").cast("long").alias("s"), F.col("t0").cast("long").alias("t"), F.array().cast("array<struct<s:bigint,t:bigint,n:bigint>>").alias("out"))
    rows = rows.withColumn("b", F.explode(F.aggregate(blocks, zero, step)["out"]))
    turn = F.col("strand") == "-"
    size, b = F.col("size").cast("long"), F.col("b")
    start = F.when(turn, size - b["t"] - b["n"]).otherwise(b["t"])
    return rows.select(
        "chrom", start.alias("start"), (start + b["n"]).alias("end"), F.when(turn, -1).otherwise(1).alias("strand"), "chromsrc", b["s"].alias("startsrc"), (b["s"] + b["n"]).alias("endsrc"),
        F.when(F.col("strandsrc") == "-", -1).otherwise(1).alias("strandsrc"), F.col("chain_id").cast("long").alias("chain_id"), F.col("score").cast("double").alias("score"),
    )


def read_rectangles(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rectangles with a header: six coordinate columns and a value."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    value = next(c for c in rows.columns if c not in ("chrom1", "start1", "end1", "chrom2", "start2", "end2"))
    return rows.select("chrom1", *(F.col(c).cast("long").alias(c) for c in ("start1", "end1")), "chrom2", *(F.col(c).cast("long").alias(c) for c in ("start2", "end2")), F.col(value).cast("double").alias("value"))


def write_bedgraph(rows: DataFrame, path: str, value: str = "value", compress: bool = False) -> None:
    """bedGraph parts in order of place; missing values are left out."""
    from rangeloom.operators.ranges import no_nan

    kept = rows.select("chrom", "start", "end", no_nan(value).alias("value")).where("value IS NOT NULL")
    kept.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start").write.option("sep", "\t").option("compression", "gzip" if compress else "none").csv(path)


def write_fasta(sequence: DataFrame, path: str, width: int = 80) -> None:
    """FASTA parts in order of chromosome and place.

    Chunks are a whole number of lines where ``width`` divides them; a chunk's
    last line is else shorter, which FASTA allows.
    """
    lines = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    text = F.when(F.col("chunk_start") == 0, F.concat(F.lit(">"), F.col("chrom"), F.lit("\n"), lines)).otherwise(lines)
    sequence.repartitionByRange("chrom", "chunk_start").sortWithinPartitions("chrom", "chunk_start").select(text.alias("value")).write.text(path)


def read_genes(spark: SparkSession, path: str, annotations: str | None = None, names: list[str] | None = None) -> dict[str, DataFrame]:
    """A gene table (name, chrom, strand, txStart, txEnd, cdsStart, cdsEnd, exonCount, exonStarts, exonEnds): ``tss``, ``exons``, ``utr3`` and ``utr5``.

    Overlapping rows of a set become one; its strand is 0 where theirs differ.
    ``annotations`` is a table by gene name, whose further columns are named by
    ``names``; distinct values of united rows are joined by semicolons.
    """
    from rangeloom.operators.intervals import mark_overlaps

    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    numbers = lambda i: F.transform(F.filter(F.split(at(i), ","), lambda x: x != ""), lambda x: x.cast("long"))
    genes = spark.read.text(path).where("value NOT LIKE '#%' AND trim(value) <> ''").select(
        at(0).alias("gene"), at(1).alias("chrom"), _strand(at(2)).alias("strand"), at(3).cast("long").alias("tx0"), at(4).cast("long").alias("tx1"),
        at(5).cast("long").alias("cds0"), at(6).cast("long").alias("cds1"), F.arrays_zip(numbers(8).alias("s"), numbers(9).alias("e")).alias("parts"),
    )
    extra = names or []
    if annotations:
        table = spark.read.text(annotations)
        genes = genes.join(table.select(at(0).alias("gene"), *(at(i + 1).alias(n) for i, n in enumerate(extra))).dropDuplicates(["gene"]), "gene", "left")
    first = F.when(F.col("strand") == -1, F.col("tx1") - 1).otherwise(F.col("tx0"))
    tss = genes.select("chrom", first.alias("start"), (first + 1).alias("end"), "strand", *extra)
    exons = genes.select("chrom", "strand", "cds0", "cds1", *extra, F.explode("parts").alias("p")).withColumns({"start": F.col("p.s"), "end": F.col("p.e")})
    # parts of exons before and after the coding part; which is which depends on the strand
    before = exons.where("cds0 < cds1 AND start < cds0").withColumns({"end": F.least("end", "cds0"), "five": F.col("strand") != -1})
    after = exons.where("cds0 < cds1 AND end > cds1").withColumns({"start": F.greatest("start", "cds1"), "five": F.col("strand") == -1})
    ends = before.unionByName(after)

    def united(rows: DataFrame) -> DataFrame:
        marked = mark_overlaps(rows.select("chrom", "start", "end", "strand", *extra), "_g", touching=False)
        strand = F.when(F.min("strand") == F.max("strand"), F.min("strand")).otherwise(0)
        texts = [F.array_join(F.array_sort(F.collect_set(n)), ";").alias(n) for n in extra]
        return marked.groupBy("chrom", "_g").agg(F.min("start").alias("start"), F.max("end").alias("end"), strand.alias("strand"), *texts).drop("_g")

    return {"tss": united(tss), "exons": united(exons), "utr3": united(ends.where("NOT five")), "utr5": united(ends.where("five"))}
