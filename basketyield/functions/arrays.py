"""Array expressions built from Spark SQL functions only (no Python UDFs).

Every helper takes and returns SQL text, so that a whole expression reaches
the JVM in one call; wrap the outermost one in ``F.expr``.  Lambda variables start
with an underscore, which keeps them apart from the columns passed in.
"""

from __future__ import annotations


def element(array: str, position: str) -> str:
    """0-based element, 0 outside of the array."""
    return f"coalesce(get({array}, {position}), 0L)"


def array_sum(values: str) -> str:
    return f"aggregate({values}, 0L, (_acc, _x) -> _acc + _x)"


def suffix_sums(values: str) -> str:
    """``out[i] = values[i] + values[i+1] + ...`` for an ``array<bigint>``.

    Doubling scan: round k adds the element 2^k places to the right, so a row
    of n values costs n*log2(n) additions and never rebuilds the array once
    per element.
    """
    shifted = "slice(_acc, shiftleft(1, _k) + 1, size(_acc))"
    add = f"(_acc, _k) -> zip_with(_acc, {shifted}, (_a, _b) -> _a + coalesce(_b, 0L))"
    rounds = f"sequence(0, cast(ceil(log2(size({values}))) as int) - 1)"
    return f"if(size({values}) > 1, aggregate({rounds}, {values}, {add}), {values})"


def utilities_of(sfx: str) -> str:
    """Undo :func:`suffix_sums`."""
    return f"zip_with({sfx}, slice({sfx}, 2, size({sfx})), (_a, _b) -> _a - coalesce(_b, 0L))"


def set_has(members: str, first_word: str, value: str) -> str:
    """Membership in a set of ranks, without a search.

    ``members`` holds 64-bit words, by what ``first_word`` says:

    * 0 or more: every word of the set, from this one on;
    * -2 - b: a directory of blocks of 64 words, from block b on, and then only
      the words in use.  The directory is its length, a bit per word of each
      block, and the place of each block's first word; the bits below a word's
      own one count the words before it;
    * -1: the ranks themselves, for a few that lie thousands apart.
    """
    word = f"coalesce(get({members}, shiftright({value}, 6) - {first_word}), 0L)"
    dense = f"getbit({word}, {value} & 63) = 1"
    listed = f"array_contains({members}, bigint({value}))"
    block, blocks = f"(shiftright({value}, 12) + 2 + {first_word})", f"int(get({members}, 0))"
    used = f"if({block} >= 0 and {block} < {blocks}, get({members}, {block} + 1), 0L)"
    bit = f"(shiftright({value}, 6) & 63)"
    place = f"int(get({members}, {block} + 1 + {blocks})) + bit_count({used} & ~shiftleft(-1L, {bit}))"
    indexed = f"if(getbit({used}, {bit}) = 1, getbit(get({members}, {place}), {value} & 63) = 1, false)"
    return f"if({first_word} >= 0, {dense}, if({first_word} = -1, {listed}, {indexed}))"


def itemset_text(itemset: str) -> str:
    """``[2, 3, 4]`` -> ``'2 3 4'``."""
    return f"array_join(transform({itemset}, _x -> string(_x)), ' ')"


def itemset_line(itemset: str, utility: str) -> str:
    """``'2 3 4 #UTIL: 34'``."""
    return f"concat({itemset_text(itemset)}, ' #UTIL: ', {utility})"


def format_cells(items: str, utils: str) -> str:
    """``'item[utility] item[utility] '`` for one transaction."""
    return f"array_join(zip_with({items}, {utils}, (_i, _u) -> concat(_i, '[', _u, '] ')), '')"


def merge_duplicate_items(items: str, utils: str) -> str:
    """Utilities of ``array_distinct(items)``: repeats are folded into the first occurrence.

    Rows without repeats, the normal case, pass through untouched.
    """
    own = f"filter({utils}, (_u, _i) -> get({items}, _i) = _y)"
    folded = f"transform(array_distinct({items}), _y -> {array_sum(own)})"
    return f"if(size(array_distinct({items})) = size({items}), {utils}, {folded})"


def strict_int(token: str, dtype: str) -> str:
    """Signed decimal digits to ``dtype``; null for anything else, also under ANSI."""
    return f"if({token} rlike '^[+-]?[0-9]+$', try_cast({token} as {dtype}), null)"
