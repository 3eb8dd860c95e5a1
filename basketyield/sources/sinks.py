"""Text renderings of itemsets and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import element, format_cells, itemset_line, utilities_of


def itemset_lines(itemsets: DataFrame) -> DataFrame:
    """One text line ``value`` per itemset."""
    return itemsets.selectExpr(f"{itemset_line('itemset', 'utility')} as value")


def write_itemsets_text(itemsets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``i j k #UTIL: u`` lines, one part file per partition."""
    itemset_lines(itemsets).write.mode(mode).text(path)


def format_transactions(df: DataFrame) -> DataFrame:
    """One text line ``value`` per transaction, with its remaining and its prefix utility.

    Array form also keeps ``tid`` and has a prefix utility of 0; projected rows
    (see ``operators.projection``) keep ``prefix`` and ``n``.
    """
    if "prefix_util" in df.columns:
        names, utils, rest, own = ["prefix", "n"], utilities_of("sfx"), element("sfx", "0"), "prefix_util"
    else:
        names, utils, rest, own = ["tid"], "utils", "tu", "0"
    cells = format_cells("items", utils)
    return df.selectExpr(*names, f"concat({cells}, ' Remaining Utility:', {rest}, ' Prefix Utility:', {own}) as value")
