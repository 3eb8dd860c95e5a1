"""High-utility itemset mining as Spark DataFrame jobs."""

from .model import explode_transactions, from_local, from_table, to_transactions
from .operators import (
    decode_itemsets,
    db_profile,
    emptied_transactions,
    extension_bounds,
    first_transactions,
    item_rank,
    item_twu,
    itemset_level_counts,
    itemset_report,
    itemset_utilities,
    max_item,
    merge_transactions,
    primary_items,
    project_on_items,
    promising_items,
    reverse_lex_order,
    revise_transactions,
    root_projection,
    root_subtree_utility,
    suffix_utilities,
    to_array_form,
    without_item,
)
from .plans import MiningResult, mine, mine_high_utility_itemsets, mining_stats
from .sources import (
    count_lines_containing,
    format_transactions,
    header_mismatches,
    malformed_lines,
    preview,
    read_lines,
    read_utility_transactions,
    write_itemsets_text,
)
from .stage import Stage

__all__ = [
    "MiningResult",
    "Stage",
    "count_lines_containing",
    "db_profile",
    "decode_itemsets",
    "emptied_transactions",
    "explode_transactions",
    "extension_bounds",
    "first_transactions",
    "format_transactions",
    "from_local",
    "from_table",
    "header_mismatches",
    "item_rank",
    "item_twu",
    "itemset_level_counts",
    "itemset_report",
    "itemset_utilities",
    "malformed_lines",
    "max_item",
    "merge_transactions",
    "mine",
    "mine_high_utility_itemsets",
    "mining_stats",
    "preview",
    "primary_items",
    "project_on_items",
    "promising_items",
    "read_lines",
    "read_utility_transactions",
    "reverse_lex_order",
    "revise_transactions",
    "root_projection",
    "root_subtree_utility",
    "suffix_utilities",
    "to_array_form",
    "to_transactions",
    "without_item",
    "write_itemsets_text",
]
