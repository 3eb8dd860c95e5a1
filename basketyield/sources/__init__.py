from .lines import count_lines_containing, preview, read_lines
from .sinks import format_transactions, write_itemsets_text
from .utility_text import header_mismatches, malformed_lines, read_utility_transactions

__all__ = [
    "count_lines_containing",
    "format_transactions",
    "header_mismatches",
    "malformed_lines",
    "preview",
    "read_lines",
    "read_utility_transactions",
    "write_itemsets_text",
]
