"""Results and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import long_form
from .ranking import global_row_number
from ..stage import Stage
from .bounds import SMALL_DICTIONARY, broadcast_if


# Itemsets of up to so many items are decoded place by place.
PLACES = 24


def decode_itemsets(
    df: DataFrame, dictionary: DataFrame, dictionary_rows: int | None = None, longest: int | None = None
) -> DataFrame:
    """Ranks back to items: ``prefix, utility`` -> ``itemset, size, utility``, items ascending.

    Where the dictionary is known to be small and no prefix has more than
    ``longest`` ranks, each place is looked up in one broadcast and no row
    is shuffled.
    """
    names = broadcast_if(
        dictionary.select("item", F.col("rk").cast("int").alias("rk")), dictionary_rows, SMALL_DICTIONARY
    )
    if longest is not None and longest <= PLACES and dictionary_rows is not None and dictionary_rows <= SMALL_DICTIONARY:
        found = df.select("prefix", "utility")
        for k in range(longest):
            place = F.broadcast(dictionary.select(F.col("item").alias(f"_{k}"), F.col("rk").cast("int").alias(f"_rk{k}")))
            found = found.join(place, F.expr(f"get(prefix, {k}) = _rk{k}"), "left").drop(f"_rk{k}")
        held = F.array(*[F.col(f"_{k}") for k in range(longest)]) if longest else F.array()
        itemset = F.sort_array(F.slice(held, 1, F.size("prefix")))
        return found.select(itemset.alias("itemset"), F.size("prefix").alias("size"), "utility")
    cells = df.select("prefix", "utility", F.explode("prefix").alias("rk")).join(names, "rk")
    return (
        cells.groupBy("prefix", "utility")
        .agg(F.sort_array(F.collect_list("item")).alias("itemset"))
        .select("itemset", F.size("itemset").alias("size"), "utility")
    )


def itemset_level_counts(itemsets: DataFrame) -> DataFrame:
    """``size, n``: itemsets per size, and in all where size is null."""
    return itemsets.rollup("size").agg(F.count(F.lit(1)).alias("n"))


def itemset_report(itemsets: DataFrame) -> DataFrame:
    """Itemsets by size, then items, with a running ``pattern`` number from 0."""
    numbered = global_row_number(itemsets, ["size", "itemset"], "pattern", Stage(itemsets.sparkSession))
    return numbered.select((F.col("pattern") - 1).alias("pattern"), "size", "itemset", "utility")


def without_item(itemsets: DataFrame, item: int | str | Column) -> DataFrame:
    """Itemsets that hold ``item``, plus ``rest``: the items but that one."""
    value = item if isinstance(item, Column) else F.lit(item)
    held = itemsets.where(F.array_contains("itemset", value))
    return held.withColumn("rest", F.array_remove("itemset", value))


def db_profile(df: DataFrame) -> DataFrame:
    """One row: number of transactions and items, largest item, total utility.

    Ids and items are counted by two-step aggregations of their own, instead of
    multiplying the cells for several distinct counts in one.
    """
    cells = long_form(df)
    transactions = cells.groupBy("tid").agg(F.sum("utility").alias("u"))
    transactions = transactions.agg(F.count("u").alias("n_transactions"), F.sum("u").alias("total_utility"))
    items = cells.groupBy("item").agg(F.sum("utility").alias("u"))
    items = items.agg(F.count("u").alias("n_items"), F.max("item").alias("max_item"))
    both = transactions.unionByName(items, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in ("n_transactions", "n_items", "max_item", "total_utility")])
