"""Steps before the search: item bounds, ranking and transaction revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import suffix_sums
from ..model import check_min_util, in_all_partitions, is_array_form, long_form
from .ranking import global_row_number
from ..stage import Stage

# Dictionaries up to this many items are ranked by one sort and broadcast
# (about 40 bytes an item); larger ones are range-sorted and shuffle-joined.
SMALL_DICTIONARY = 2_000_000

# A running sum is cut into groups of at most this many cells.
BLOCK = 1 << 16


def max_item(df: DataFrame) -> DataFrame:
    """One row ``max_item``: the largest item id."""
    return long_form(df).agg(F.max("item").alias("max_item"))


def item_twu(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``item, twu, support``: utility and number of the transactions that hold the item.

    Array form needs one shuffle of per-task partial sums.  Long form first
    gets the transaction utilities by a join.  Where the number of its ``rows``
    is known, one shuffle serves both sides, in partitions that grow in number
    with them.
    """
    if is_array_form(df):
        cells = df.select("tu", F.explode("items").alias("item"))
    else:
        if rows is not None:
            # The filters make the shuffle of both sides alike, so that it runs once.
            df = in_all_partitions(df.where("utility is not null and tid is not null"), "tid", rows=rows)
        totals = df.groupBy("tid").agg(F.sum("utility").alias("tu"))
        # The utility is read on both sides, always true here, because only
        # then are they alike and Spark runs the shuffle below them once.
        cells = df.where("utility is not null").join(totals, "tid").select("tu", "item")
    return cells.groupBy("item").agg(F.sum("tu").alias("twu"), F.count(F.lit(1)).alias("support"))


def promising_items(df: DataFrame, min_util: int) -> DataFrame:
    """Items whose TWU reaches ``min_util``; ``df`` is a database or the result of :func:`item_twu`."""
    twu = df if "twu" in df.columns else item_twu(df)
    return twu.where(F.col("twu") >= check_min_util(min_util))


def item_rank(twu: DataFrame, min_util: int | None = None) -> DataFrame:
    """``item, twu, support, rk``: rank from 1 by ascending ``(twu, item)``.

    The items are written once and counted, to choose between one sort and a
    range sort.
    """
    stage = Stage(twu.sparkSession)
    items = stage.write(twu if min_util is None else promising_items(twu, min_util), "promising")
    return rank_items(items, items.count(), stage)


def rank_items(items: DataFrame, count: int, stage: Stage) -> DataFrame:
    """:func:`item_rank` of ``count`` written items."""
    if count <= SMALL_DICTIONARY:
        return items.withColumn("rk", F.row_number().over(Window.orderBy("twu", "item")).cast("bigint"))
    return global_row_number(items, ["twu", "item"], "rk", stage)


def broadcast_if(df: DataFrame, rows: int | None, limit: int) -> DataFrame:
    """Hint a broadcast only for a side whose row count is known to be within ``limit``."""
    return F.broadcast(df) if rows is not None and rows <= limit else df


def revise_transactions(df: DataFrame, dictionary: DataFrame, dictionary_rows: int | None = None) -> DataFrame:
    """Keep ranked items only: ``tid, item, rk, utility``.

    Pass ``dictionary_rows`` where it is known; small dictionaries are then
    broadcast, and otherwise the planner decides from the table sizes.
    """
    ranks = broadcast_if(dictionary.select("item", "rk"), dictionary_rows, SMALL_DICTIONARY)
    return long_form(df).join(ranks, "item").select("tid", "item", "rk", "utility")


def emptied_transactions(df: DataFrame, revised: DataFrame) -> DataFrame:
    """Ids of transactions of which revision left nothing."""
    # Both sides are reduced to ids before they meet.
    before = df.select("tid") if is_array_form(df) else df.select("tid").distinct()
    return before.join(revised.select("tid").distinct(), "tid", "left_anti")


def suffix_utilities(revised: DataFrame, max_rank: int | None = None) -> DataFrame:
    """Add ``sfx``: the utility of this item and of all later ones in its transaction.

    The sum runs in blocks of ranks, so no window group is longer than
    ``BLOCK`` cells; the totals of the later blocks of the transaction are
    added.  One block is enough where ``max_rank`` is known to be small.
    """
    blocked = revised.withColumn("_block", F.floor(F.col("rk") / BLOCK))
    inside = (
        Window.partitionBy("tid", "_block")
        .orderBy(F.desc("rk"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = blocked.withColumn("sfx", F.sum("utility").over(inside))
    if max_rank is not None and max_rank < BLOCK:
        return summed.drop("_block")
    later = Window.partitionBy("tid").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        blocked.groupBy("tid", "_block")
        .agg(F.sum("utility").alias("_total"))
        .select("tid", "_block", F.coalesce(F.sum("_total").over(later), F.lit(0)).alias("_later"))
    )
    return (
        summed.join(totals, ["tid", "_block"])
        .withColumn("sfx", F.col("sfx") + F.col("_later"))
        .drop("_block", "_later")
    )


def root_subtree_utility(df: DataFrame, max_rank: int | None = None) -> DataFrame:
    """Sub-tree utility of every item at the root.

    Long revised form gives ``item, rk, su``; rank-ordered array form, which
    needs no window, gives ``rk, su``.
    """
    if is_array_form(df):
        cells = df.selectExpr(f"{suffix_sums('utils')} as sfx", "posexplode(items) as (pos, rk)")
        return cells.groupBy("rk").agg(F.expr("sum(get(sfx, pos)) as su"))
    cells = df if "sfx" in df.columns else suffix_utilities(df, max_rank)
    return cells.groupBy("item", "rk").agg(F.sum("sfx").alias("su"))


def primary_items(subtree: DataFrame, min_util: int) -> DataFrame:
    """Items worth exploring: sub-tree utility of at least ``min_util``."""
    return subtree.where(F.col("su") >= check_min_util(min_util))
