"""Motif files; they are small and read whole, from a path that Spark opens."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rangeloom.functions.sequence import Motif


def _text(spark: SparkSession, path: str) -> list[str]:
    return spark.read.text(path, wholetext=True).first()["value"].splitlines()



def _motif(name: str, rows: list[list[float]]) -> Motif:
    return Motif(name, tuple(tuple(v / (sum(r) or 1.0) for v in r[:4]) for r in rows))


def read_meme(spark: SparkSession, path: str) -> list[Motif]:
    """MEME minimal format: ``MOTIF name`` and a letter-probability matrix."""
    out, name, rows, taking = [], None, [], False
    for line in [*_text(spark, path), "MOTIF"]:
        if line.startswith("MOTIF"):
            if name and rows:
                out.append(_motif(name, rows))
            name, rows, taking = (line.split() + [None, None])[1], [], False
        elif line.startswith("letter-probability"):
            taking = True
        elif taking and re.match(r"^\s*[0-9.]", line):
            rows.append([float(x) for x in line.split()])
        elif rows:
            taking = False
    return out


def read_jaspar(spark: SparkSession, path: str) -> list[Motif]:
    """JASPAR: a header and four rows of counts, with or without letters and brackets."""
    out, name, counts = [], None, []
    for line in [*_text(spark, path), ">"]:
        if line.startswith(">"):
            if name and len(counts) == 4:
                out.append(_motif(name, [list(c) for c in zip(*counts, strict=True)]))
            name, counts = (line[1:].split() + [None])[0], []
        elif numbers := re.findall(r"-?\d+(?:\.\d+)?(?:[eE]-?\d+)?", re.sub(r"^\s*[ACGT]", "", line)):
            counts.append([float(x) for x in numbers])
    return out


def read_homer(spark: SparkSession, path: str) -> list[Motif]:
    """HOMER: a header and a row of four probabilities for each position."""
    out, name, rows = [], None, []
    for line in [*_text(spark, path), ">"]:
        if line.startswith(">"):
            if name and rows:
                out.append(_motif(name, rows))
            name, rows = (re.split(r"\t", line[1:]) + [None, None])[1], []
        elif line.strip():
            rows.append([float(x) for x in line.split()])
    return out


def motif_table(spark: SparkSession, motifs: list[Motif]) -> DataFrame:
    """``motif, pos, A, C, G, T``."""
    rows = [(m.name, i, *map(float, r)) for m in motifs for i, r in enumerate(m.matrix)]
    return spark.createDataFrame(rows, "motif string, pos int, A double, C double, G double, T double")
