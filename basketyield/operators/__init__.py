from .bounds import (
    emptied_transactions,
    item_rank,
    item_twu,
    max_item,
    primary_items,
    promising_items,
    revise_transactions,
    root_subtree_utility,
    suffix_utilities,
)
from .projection import (
    extension_bounds,
    itemset_utilities,
    merge_transactions,
    project_on_items,
    root_projection,
)
from .report import (
    db_profile,
    decode_itemsets,
    itemset_level_counts,
    itemset_report,
    without_item,
)
from .transactions import first_transactions, reverse_lex_order, to_array_form

__all__ = [
    "db_profile",
    "decode_itemsets",
    "emptied_transactions",
    "extension_bounds",
    "first_transactions",
    "item_rank",
    "item_twu",
    "itemset_level_counts",
    "itemset_report",
    "itemset_utilities",
    "max_item",
    "merge_transactions",
    "primary_items",
    "project_on_items",
    "promising_items",
    "reverse_lex_order",
    "revise_transactions",
    "root_projection",
    "root_subtree_utility",
    "suffix_utilities",
    "to_array_form",
    "without_item",
]
