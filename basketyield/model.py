"""The two shapes of a transaction database, and how to get into them.

Long form, one row per cell, unique on ``(tid, item)``:
    ``tid, item, utility bigint``
Array form, one row per transaction:
    ``tid, items array, utils array<bigint>, tu bigint``
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import array_sum

INVALID_UTILITY = "utility must be a whole number >= 0 with a transaction id and an item"


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


#: Rows of a partition, about, that a task sums or collects; more rows make more partitions.
PARTITION_ROWS = 1 << 18


def in_all_partitions(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Shuffled by ``keys`` into partitions that adaptive execution leaves as they are.

    They are ``spark.sql.shuffle.partitions``, or more where ``rows``, how many
    ``df`` has, would put over ``PARTITION_ROWS`` into each.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(partitions, -(-(rows or 0) // PARTITION_ROWS)), *keys)


def sum_repeats(cells: DataFrame, rows: int) -> DataFrame:
    """Long form of ``rows`` cells ``tid, item, utility``, of which some may repeat an item of a transaction.

    Few cells repeat, so sums before the shuffle would hold about every row of
    a task.
    """
    return in_all_partitions(cells, "tid", "item", rows=rows).groupBy("tid", "item").agg(F.sum("utility").alias("utility"))


def from_table(
    df: DataFrame,
    tid: str | Column,
    item: str | Column,
    utility: str | Column,
    *,
    unique: bool = False,
    on_invalid: str = "error",
    rows: int | None = None,
) -> DataFrame:
    """Long form of any table with a transaction id, an item and a utility.

    Utilities of the same item in the same transaction are summed after a
    shuffle by ``(tid, item)``, so that a huge transaction spreads over the
    cluster.  Its partitions grow in number with ``rows``, about how many
    ``df`` has; where that is not given, they are counted here.
    ``unique=True`` says the table has no such repeats and skips that shuffle.

    Rows with a null, negative or fractional utility, or without tid or item,
    fail the job (``on_invalid='error'``), are left out (``'quarantine'``), or
    are the only rows returned, unaggregated (``'only'``).
    """
    cells = df.select(_column(tid).alias("tid"), _column(item).alias("item"), _column(utility).alias("raw"))
    whole = F.col("raw").try_cast("bigint")
    valid = F.coalesce(
        F.col("tid").isNotNull() & F.col("item").isNotNull() & (whole >= 0) & (whole == F.col("raw")),
        F.lit(False),
    )
    if on_invalid == "only":
        return cells.where(~valid).withColumnRenamed("raw", "utility")
    if on_invalid == "quarantine":
        cells = cells.where(valid).select("tid", "item", whole.alias("utility"))
    elif on_invalid == "error":
        checked = F.when(valid, whole).otherwise(F.raise_error(F.lit(INVALID_UTILITY)).cast("bigint"))
        cells = cells.select("tid", "item", checked.alias("utility"))
    else:
        raise ValueError(f"on_invalid must be 'error', 'quarantine' or 'only', not {on_invalid!r}")
    if unique:
        return cells
    return sum_repeats(cells, df.count() if rows is None else rows)


def to_transactions(long_df: DataFrame) -> DataFrame:
    """Array form of the long form, items ascending.

    ``(tid, item)`` is unique, so an array is never longer than the number of
    different items.
    """
    cells = F.sort_array(F.collect_list(F.struct("item", "utility")))
    return (
        long_df.groupBy("tid")
        .agg(cells.alias("cells"), F.sum("utility").alias("tu"))
        .select("tid", F.col("cells.item").alias("items"), F.col("cells.utility").alias("utils"), "tu")
    )


def explode_transactions(array_df: DataFrame) -> DataFrame:
    """Long form of the array form."""
    return array_df.select("tid", "utils", F.posexplode("items").alias("pos", "item")).select(
        "tid", "item", F.get("utils", F.col("pos")).alias("utility")
    )


def checked_arrays(array_df: DataFrame) -> DataFrame:
    """Array form with its transaction utilities recomputed; a row that breaks its rules fails the job."""
    ok = """
        tid is not null and size(utils) = size(items) and size(array_distinct(items)) = size(items)
        and forall(items, x -> x is not null) and forall(utils, x -> x is not null and x >= 0)
    """
    message = "a transaction needs an id and different items, each with a utility >= 0"
    return array_df.where(f"if(coalesce({ok}, false), true, boolean(raise_error('{message}')))").selectExpr(
        "tid", "items", "utils", f"{array_sum('utils')} as tu"
    )


def is_array_form(df: DataFrame) -> bool:
    return {"tid", "items", "utils", "tu"} <= set(df.columns)


def long_form(df: DataFrame) -> DataFrame:
    """Accept either shape, return the long form."""
    return explode_transactions(df) if is_array_form(df) else df.select("tid", "item", "utility")


def from_local(spark: SparkSession, rows: Iterable[tuple[int, int, int]]) -> DataFrame:
    """Small local ``(tid, item, utility)`` tuples as long form; for tests and examples."""
    table = spark.createDataFrame(list(rows), "tid bigint, item bigint, utility bigint")
    return from_table(table, "tid", "item", "utility")


def check_min_util(min_util: int) -> int:
    if isinstance(min_util, bool) or not isinstance(min_util, int) or min_util <= 0:
        raise ValueError(f"min_util must be a positive integer, not {min_util!r}")
    return min_util
