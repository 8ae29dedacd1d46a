"""Interval-indexed matrices: interval tables whose value columns are one array column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLACES = ("chrom", "start", "end")
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


@dataclass(frozen=True)
class IntervalMatrix:
    """Rows ``chrom, start, end`` (and ``intervalID``, ``label`` where there are any) with ``values`` (array<double>) under column names."""

    data: DataFrame
    names: tuple[str, ...]

    def select(self, columns: list[str]) -> IntervalMatrix:
        """The matrix with chosen columns, in that order."""
        values = F.array(*(F.get("values", F.lit(self.names.index(c))) for c in columns))
        return IntervalMatrix(self.data.withColumn("values", values), tuple(columns))

    def where(self, condition) -> IntervalMatrix:
        """The rows for which a condition holds; intervals go with their rows."""
        return IntervalMatrix(self.data.where(condition), self.names)

    def apply(self, function: Callable) -> IntervalMatrix:
        """Each value put through a column function."""
        return IntervalMatrix(self.data.withColumn("values", F.transform("values", function)), self.names)


def to_matrix(df: DataFrame, id_col: str | None = None, value_cols: list[str] | None = None, labels: bool = True) -> IntervalMatrix:
    """An interval table as a matrix.

    Value columns are those named, else all but the places, ``intervalID`` and
    ``id_col``, which must then be numbers.  ``label`` is ``id_col``, or
    ``chrom:start-end``; it is for display and never parsed.
    """
    if lacking := [c for c in _PLACES if c not in df.columns]:
        raise ValueError(f"missing columns {lacking}")
    kinds = dict(df.dtypes)
    names = value_cols or [c for c in df.columns if c not in (*_PLACES, "intervalID", id_col)]
    if bad := [c for c in names if kinds[c] not in _NUMBERS and not kinds[c].startswith("decimal")]:
        raise ValueError(f"columns {bad} aren't numbers")
    label = F.col(id_col).cast("string") if id_col else F.concat("chrom", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    kept = [*_PLACES, *(["intervalID"] if "intervalID" in df.columns else [])]
    return IntervalMatrix(df.select(*kept, *([label.alias("label")] if labels else []), F.array(*(F.col(c).cast("double") for c in names)).alias("values")), tuple(names))


def from_matrix(matrix: IntervalMatrix) -> DataFrame:
    """The interval table of a matrix: places, then a column for each name."""
    kept = [c for c in matrix.data.columns if c not in ("values", "label")]
    return matrix.data.select(*kept, *(F.get("values", F.lit(i)).alias(c) for i, c in enumerate(matrix.names)))


def bind_rows(*matrices: IntervalMatrix) -> IntervalMatrix:
    """Matrices with the same columns, one below the other."""
    first = matrices[0]
    if any(m.names != first.names for m in matrices):
        raise ValueError("the matrices have other columns")
    data = first.data
    for m in matrices[1:]:
        data = data.unionByName(m.data, allowMissingColumns=True)
    return IntervalMatrix(data, first.names)
