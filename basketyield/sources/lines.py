"""Plain text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row ``value`` per line."""
    return spark.read.text(path)


def count_lines_containing(df: DataFrame, column: str, needles: dict[str, str]) -> DataFrame:
    """One row: ``n`` lines in all and, per ``{output name: substring}``, the lines that contain it.

    All the predicates are counted in one pass, so the lines need no cache.
    """
    counts = [F.count_if(F.contains(F.col(column), F.lit(text))).alias(name) for name, text in needles.items()]
    return df.agg(*counts, F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, n: int) -> list[Row]:
    """The first ``n`` rows, for looking at."""
    return df.take(n)
