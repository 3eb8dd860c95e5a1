"""Expressions shared by the operators."""

from .arrays import (
    array_sum,
    element,
    format_cells,
    itemset_line,
    itemset_text,
    merge_duplicate_items,
    set_has,
    strict_int,
    suffix_sums,
    utilities_of,
)

__all__ = [
    "array_sum",
    "element",
    "format_cells",
    "itemset_line",
    "itemset_text",
    "merge_duplicate_items",
    "set_has",
    "strict_int",
    "suffix_sums",
    "utilities_of",
]
