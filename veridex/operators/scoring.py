"""Scoring: equality of result sets and accuracy of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType


def _rounded(df: DataFrame, places: int) -> DataFrame:
    """Columns by position, floats rounded, numbers as text alike whatever their type."""
    out = []
    for k, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        c = F.round(c.cast("double"), places) + F.lit(0.0) if isinstance(f.dataType, FractionalType) else c.cast("double") if f.dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else c.cast("string")
        out.append(c.alias(f"c{k}"))
    return df.select(*out)


def same_rows(given: DataFrame, wanted: DataFrame, places: int = 6, bag: bool = True) -> bool:
    """As many columns and rows, and equal rows after rounding: with their multiplicity (bag), or as sets.

    Rows are compared by position of columns. One aggregation over both sides; nothing is collected but one flag.
    """
    if len(given.columns) != len(wanted.columns):
        return False
    a, b = _rounded(given, places), _rounded(wanted, places)
    for k, (x, y) in enumerate(zip(a.dtypes, b.dtypes)):
        if x[1] != y[1]:
            a, b = a.withColumn(f"c{k}", F.col(f"c{k}").cast("string")), b.withColumn(f"c{k}", F.col(f"c{k}").cast("string"))
    counted = a.withColumns({"_a": F.lit(1), "_b": F.lit(0)}).union(b.withColumns({"_a": F.lit(0), "_b": F.lit(1)})).groupBy(*a.columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    wrong = F.col("_a") != F.col("_b") if bag else (F.col("_a") > 0) != (F.col("_b") > 0)
    r = counted.agg(F.coalesce(F.bool_or(wrong), F.lit(False)), F.coalesce(F.sum("_a"), F.lit(0)), F.coalesce(F.sum("_b"), F.lit(0))).first()
    return not r[0] and r[1] == r[2]


def accuracy(scored: DataFrame, by: list[str] = (), passed: str = "passed") -> DataFrame:
    """passed, total and accuracy, by columns if asked; a null counts as not passed."""
    hit = F.coalesce(F.col(passed).cast("long"), F.lit(0))
    grouped = scored.groupBy(*by) if by else scored.groupBy()
    return grouped.agg(F.sum(hit).alias("passed"), F.count("*").alias("total"), F.avg(hit).alias("accuracy"))


def report(scored: DataFrame, by: list[str] = ()) -> dict:
    """The accuracy as plain data, for a JSON file; one row per group comes to the driver."""
    return {"rows": [r.asDict() for r in accuracy(scored, by).collect()]}
