"""Whole transactions: array form, order, first N."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import in_all_partitions
from .ranking import global_row_number
from ..stage import Stage

# A limit is taken by one task; longer ones are cut by place in a range sort.
SMALL_LIMIT = 1_000_000


def to_array_form(revised: DataFrame, rows: int | None = None) -> DataFrame:
    """Revised cells as ``tid, items, utils, tu``, with ranks as items, ascending.

    An array holds each ranked item at most once, so its length is bounded by
    the dictionary.  Few cells of a transaction are in one task before the
    shuffle, so lists are made after it only; ``rows``, the number of cells
    where known, adds partitions to it.
    """
    revised = in_all_partitions(revised, "tid", rows=rows)
    cells = F.sort_array(F.collect_list(F.struct(F.col("rk").cast("int").alias("rk"), "utility")))
    return (
        revised.groupBy("tid")
        .agg(cells.alias("cells"), F.sum("utility").alias("tu"))
        .select("tid", F.col("cells.rk").alias("items"), F.col("cells.utility").alias("utils"), "tu")
    )


def reverse_lex_order(array_df: DataFrame) -> DataFrame:
    """Add ``pos``, the place in reverse-lexicographic order; equal item lists share one.

    Lists are compared from the last item, larger rank first, and a list that
    is the tail of another one comes before it.  Only the different lists are
    sorted.
    """
    keyed = array_df.withColumn("_key", F.reverse(F.transform("items", lambda x: -x)))
    places = global_row_number(keyed.select("_key").distinct(), ["_key"], "pos", Stage(array_df.sparkSession))
    return keyed.join(places, "_key").drop("_key")


def first_transactions(long_df: DataFrame, n: int) -> DataFrame:
    """Cells of the ``n`` transactions with the smallest ids; all for n <= 0."""
    if n <= 0:
        return long_df
    ids = long_df.select("tid").distinct()
    if n <= SMALL_LIMIT:
        first = ids.orderBy("tid").limit(n)
    else:
        first = global_row_number(ids, ["tid"], "_place", Stage(long_df.sparkSession)).where(F.col("_place") <= n)
    return long_df.join(first.select("tid"), "tid", "left_semi")
