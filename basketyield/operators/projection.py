"""Projected databases: the rows below a search node, and what they bound.

A node is a prefix of ranks.  Its projected rows hold what follows the prefix
in each transaction:

    prefix       array<int>     ranks of the node
    items        array<int>     later ranks, ascending
    sfx          array<bigint>  suffix sums of their utilities
    prefix_util  bigint         utility of the prefix
    n            bigint         transactions merged into this row

Suffix sums are kept instead of utilities because they survive both slicing
and element-wise addition: a projection is a slice, and the terms of both
bounds are single array reads.

Two optional columns keep the utility of items that were dropped from the row
after its transaction was ranked: ``after`` (per position, everything that
follows it) and ``rest`` (everything that follows the prefix).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import element, set_has, suffix_sums

# Rows of up to this many items are merged by one aggregation of their positions.
CHUNK = 16

# Longer rows are cut into chunks of this many positions, each of which carries
# the whole item list as its key.
WIDE_CHUNK = 64

# Sets that span more words than this for each of their items get a directory of
# the words in use.
SPARSE = 4

# Sets that span more words than this for each item are lists, as the directory
# itself would take two words for every 64 words spanned.
LISTED = 128

# Rows with more items than this are cut by position before they expand.
LONG_ROW = 1024


def _value_arrays(df: DataFrame) -> list[str]:
    return [name for name in ("sfx", "after") if name in df.columns]


def root_projection(array_df: DataFrame, keep_dropped: bool = False) -> DataFrame:
    """Rank-ordered transactions as the projected rows of the empty prefix."""
    rows = array_df.selectExpr(
        "cast(array() as array<int>) as prefix",
        "cast(items as array<int>) as items",
        f"{suffix_sums('utils')} as sfx",
        "0L as prefix_util",
        "1L as n",
    )
    if keep_dropped:
        after = f"transform(items, (x, i) -> {element('sfx', 'i + 1')})"
        rows = rows.selectExpr("*", f"{after} as after", f"{element('sfx', '0')} as rest")
    return rows


def _trimmed(rows: DataFrame) -> DataFrame:
    """Drop the items that are not secondary at the node of the row."""
    # _keep, the positions that stay, is null for the many rows that keep all
    # of theirs; they pass through.
    whole = f"forall(items, x -> {set_has('secondary', 'first_word', 'x')})"
    if "whole" in rows.columns:
        whole = f"(whole or {whole})"
    keep = f"filter(sequence(0, size(items) - 1), i -> {set_has('secondary', 'first_word', 'get(items, i)')})"
    utils = f"transform(_keep, i -> get(sfx, i) - {element('sfx', 'i + 1')})"
    trimmed = {
        "items": "transform(_keep, i -> get(items, i))",
        "sfx": suffix_sums("_utils"),
        "after": "transform(_keep, i -> get(after, i))",
    }
    cut = rows.selectExpr("*", f"if({whole}, null, {keep}) as _keep").selectExpr("*", f"{utils} as _utils")
    return cut.selectExpr(
        *[f"if(_keep is null, {name}, {trimmed[name]}) as {name}" if name in trimmed else name for name in rows.columns]
    )


def _occurrences(rows: DataFrame, positions: str | None = None) -> DataFrame:
    """One row per item of a row that is primary there: the item ``_e`` and its position ``_p``."""
    # The outer form, as the filter that Spark adds to the other one would
    # work out the trimmed items a second time.
    if positions is None:
        exploded = rows.selectExpr("*", "posexplode_outer(items) as (_p, _e)").where("_e is not null")
    else:
        exploded = rows.selectExpr("*", f"explode_outer({positions}) as _p").selectExpr("*", "get(items, _p) as _e")
    return exploded.where(set_has("primary", "first_word", "_e")) if "primary" in rows.columns else exploded


CHILD_UTIL = f"prefix_util + get(sfx, _p) - {element('sfx', '_p + 1')}"


def _children(found: DataFrame) -> DataFrame:
    """The item of each occurrence joins the prefix and what follows it stays."""
    columns = [
        "concat(prefix, array(_e)) as prefix",
        *[f"slice({name}, _p + 2, size(items)) as {name}" for name in ("items", *_value_arrays(found))],
        f"{CHILD_UTIL} as prefix_util",
        "n",
    ]
    return found.selectExpr(*columns, *(["get(after, _p) as rest"] if "after" in found.columns else []))


def _pairs(found: DataFrame) -> DataFrame:
    """What each occurrence adds to the sums of its candidate and of the items after it.

    The cells of :func:`node_bounds` of the projected rows, without these rows:
    every number is read from the row above at a position ``_q``, of which the
    first one, that of the item itself, stands for the candidate.
    """
    rest = "get(after, _p)" if "after" in found.columns else element("sfx", "_p + 1")
    pairs = found.selectExpr(
        "prefix",
        "_e",
        "_p",
        "n",
        "items",
        "sfx",
        f"{CHILD_UTIL} as _own",
        f"{rest} as _rest",
        "explode_outer(sequence(_p, size(items) - 1)) as _q",
    )
    return pairs.selectExpr(
        "prefix",
        "_e",
        "if(_q = _p, 0, get(items, _q)) as z",
        "_own + _rest as _lu",
        "_own + if(_q = _p, 0L, get(sfx, _q)) as _su",
        "n",
        "size(items) - _q - 1 as _size",
    )


def _at_nodes(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the nodes that have primary items, with the sets of their node."""
    whole = [name for name in ("whole",) if name in nodes.columns]
    return rows.join(nodes.where("n_primary > 0").select("prefix", "first_word", "secondary", "primary", *whole), "prefix")


def lone_rows(rows: DataFrame, nodes: DataFrame, *, trimmed: bool = False) -> DataFrame:
    """Rows that hold lone items of their node (see :func:`node_state`): ``starts`` has the positions of these.

    Such a row is all there is below the children on these items.  It is cut to
    the first of them and what follows.
    """
    lone = nodes.where("n_lone > 0").select("prefix", "first_word", "secondary", "lone", "whole")
    held = rows.where("size(items) > 0").join(lone, "prefix")
    held = (held if trimmed else _trimmed(held)).where("size(items) > 0")
    starts = f"filter(sequence(0, size(items) - 1), i -> {set_has('lone', 'first_word', 'get(items, i)')})"
    found = held.selectExpr("*", f"{starts} as _at").where("size(_at) > 0")
    return found.selectExpr(
        "prefix",
        *[f"slice({name}, get(_at, 0) + 1, size(items)) as {name}" for name in ("items", "sfx")],
        "prefix_util",
        "n",
        "transform(_at, i -> i - get(_at, 0)) as starts",
    )


def keep_secondary(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of the nodes that have primary items, cut to the secondary ones; rows of which nothing is left go."""
    return _trimmed(_at_nodes(rows, nodes)).where("size(items) > 0").select(*rows.columns)


def _on_items(rows: DataFrame, nodes: DataFrame | None, width: int | None, trimmed: bool, then) -> DataFrame:
    """``then`` of the occurrences of every item; see :func:`project_on_items`."""

    def at_nodes(part: DataFrame) -> DataFrame:
        if nodes is None:
            return part
        held = _at_nodes(part, nodes)
        return held if trimmed else _trimmed(held)

    if width is not None and width <= LONG_ROW:
        return then(_occurrences(at_nodes(rows.where("size(items) > 0"))))
    short = at_nodes(rows.where(f"size(items) between 1 and {LONG_ROW}"))
    long = at_nodes(rows.where(f"size(items) > {LONG_ROW}"))
    starts = f"if(size(items) > 0, sequence(0, size(items) - 1, {LONG_ROW}), null)"
    long = long.selectExpr("*", f"explode_outer({starts}) as _start").where("_start is not null")
    # Dealt in turn: a key made of the items would send all equal rows one way.
    # Spark sorts before it deals, so a repeated task deals alike.
    long = long.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    block = f"sequence(_start, least(_start + {LONG_ROW}, size(items)) - 1)"
    return then(_occurrences(short)).unionByName(then(_occurrences(long, block)))


def project_on_items(
    rows: DataFrame, nodes: DataFrame | None = None, *, width: int | None = None, trimmed: bool = False
) -> DataFrame:
    """Project every row on each of its items.

    ``nodes`` (see :func:`node_state`) restricts this to the primary items of
    the node of the row, after dropping the items that are not secondary there;
    ``trimmed`` says that :func:`keep_secondary` has dropped them already.
    Rows longer than ``LONG_ROW`` are spread by position over the cluster
    first, as the children of one of them are its length squared in cells;
    ``width``, the longest row where known, saves that branch.
    """
    return _on_items(rows, nodes, width, trimmed, _children)


def candidate_bounds(
    rows: DataFrame, nodes: DataFrame | None = None, *, width: int | None = None, trimmed: bool = False
) -> DataFrame:
    """:func:`node_bounds` of what :func:`project_on_items` returns, straight from the rows above.

    Nothing is projected: a candidate's sums are read by position from the
    rows of its parent, and are partly done before the shuffle.
    """
    pairs = _on_items(rows, nodes, width, trimmed, _pairs)
    return _sums(pairs, "prefix", "_e", "z").selectExpr("concat(prefix, array(_e)) as prefix", "z", *BOUNDS)


def _aggregate_sql(scalars: list[str], arrays: list[str], width: int) -> list:
    """Plain sums of the scalars and of each array position."""
    sums = [f"sum({name}) as {name}" for name in scalars]
    sums += [f"sum(get({name}, {i})) as {name}_{i}" for name in arrays for i in range(width)]
    return [F.expr(text) for text in sums]


def _summed_array(name: str, width: int, length: str) -> str:
    sums = ", ".join(f"{name}_{i}" for i in range(width))
    return f"slice(cast(array({sums}) as array<bigint>), 1, {length}) as {name}"


def merge_transactions(rows: DataFrame, *, width: int | None = None) -> DataFrame:
    """Merge the rows of a node that have the same items; utilities add up.

    Each position is a plain ``sum``, so equal rows are combined before the
    shuffle and a group of any size stays a handful of numbers.  Rows of more
    than ``CHUNK`` items are summed chunk by chunk and put together again: a
    chunk carries its own items and two hashes of all, so it costs its own
    length only.  ``width`` is the longest row where known.
    """
    arrays = _value_arrays(rows)
    scalars = ["prefix_util", "n"] + (["rest"] if "rest" in rows.columns else [])
    keys = ["prefix", "items"]
    columns = rows.columns

    def merged(part: DataFrame, span: int) -> DataFrame:
        summed = part.groupBy(*keys).agg(*_aggregate_sql(scalars, arrays, span))
        whole = [_summed_array(name, span, "size(items)") for name in arrays]
        return summed.selectExpr(*keys, *scalars, *whole).select(*columns)

    if width is not None and width <= CHUNK:
        # A power of two, so that levels share their generated code.
        return merged(rows, 1 << (width - 1).bit_length() if width > 0 else 0)

    short = merged(rows.where(f"size(items) <= {CHUNK}"), CHUNK)
    # Rows of one list have one of these keys, and two lists with the same one
    # are told apart by their chunks.
    row = ["prefix", "_size", "_h1", "_h2"]
    long = rows.where(f"size(items) > {CHUNK}").selectExpr(
        "*", "size(items) as _size", "xxhash64(items) as _h1", "xxhash64(reverse(items)) as _h2"
    )
    pieces = long.selectExpr("*", f"explode(sequence(0, (_size - 1) div {WIDE_CHUNK})) as _chunk").selectExpr(
        *row,
        "_chunk",
        *[f"slice({name}, int(_chunk * {WIDE_CHUNK} + 1), {WIDE_CHUNK}) as {name}" for name in ("items", *arrays)],
        # Counted once a row, in its first chunk.
        *[f"if(_chunk = 0, {name}, 0L) as {name}" for name in scalars],
    )
    summed = pieces.groupBy(*row, "_chunk", "items").agg(*_aggregate_sql(scalars, arrays, WIDE_CHUNK))
    parts = summed.selectExpr(
        *row, *scalars, "_chunk", "items", *[_summed_array(name, WIDE_CHUNK, "size(items)") for name in arrays]
    )
    part = ", ".join(["_chunk", "items", *arrays])
    # More chunks than a row has: two lists with equal hashes, which cannot be put together.
    whole = f"size(_parts) = (_size - 1) div {WIDE_CHUNK} + 1"
    joined = (
        parts.groupBy(*row)
        .agg(*_aggregate_sql(scalars, [], 0), F.expr(f"sort_array(collect_list(struct({part}))) as _parts"))
        .where(f"if({whole}, true, boolean(raise_error('two item lists of a node have the same hashes')))")
        .selectExpr("prefix", *scalars, *[f"flatten(_parts.{name}) as {name}" for name in ("items", *arrays)])
        .select(*columns)
    )
    return short.unionByName(joined)


def itemset_utilities(rows: DataFrame) -> DataFrame:
    """``prefix, utility, support``: exact utility of every node that has rows."""
    return rows.groupBy("prefix").agg(F.sum("prefix_util").alias("utility"), F.sum("n").alias("support"))


BOUNDS = ["lu", "su", "n", "cells", "width"]


def _sums(cells: DataFrame, *keys: str) -> DataFrame:
    cells_or_rows = "sum(if(z = 0, _size, 1)) as cells"
    sums = ["sum(_lu) as lu", "sum(_su) as su", "sum(n) as n", cells_or_rows, "max(_size) as width"]
    return cells.groupBy(*keys).agg(*map(F.expr, sums))


def node_bounds(rows: DataFrame) -> DataFrame:
    """Everything a level needs to know about its nodes, in one aggregation.

    One row per ``(prefix, z)``.  ``z = 0`` stands for the node itself: ``su``
    is then its exact utility, ``n`` the transactions in its rows, ``cells`` and
    ``width`` the total and largest length of these.
    For an item z, ``su`` and ``lu`` are its sub-tree and local utility,
    ``cells`` the rows that hold it, and ``width`` the most items after it.
    """
    rest = "rest" if "rest" in rows.columns else element("sfx", "0")
    cells = rows.selectExpr(
        "prefix",
        f"prefix_util + {rest} as _lu",
        "prefix_util",
        "sfx",
        "n",
        "size(items) as _length",
        "posexplode(concat(array(0), items)) as (_p, z)",
    )
    su = "prefix_util + if(_p = 0, 0L, get(sfx, _p - 1)) as _su"
    return _sums(cells.selectExpr("*", su, "_length - _p as _size"), "prefix", "z")


def extension_bounds(rows: DataFrame) -> DataFrame:
    """``prefix, z, lu, su``: local and sub-tree utility of each item z below each node."""
    return node_bounds(rows).where("z > 0").select("prefix", "z", "lu", "su")


def node_state(
    bounds: DataFrame, min_util: int, *, subtree_pruning: bool = True, keep_all: bool = False, lone: int | None = None
) -> DataFrame:
    """One row per node: its exact utility and sizes, and the split of its items.

    Secondary items have ``lu >= min_util`` (all items with ``keep_all``),
    primary ones ``su >= min_util`` (all secondary ones without sub-tree
    pruning).  Both sets come as bits in the shapes of :func:`set_has`, so that
    looking an item up takes the same time in any set and a node never takes
    more than a few words an item: all words in a row; where these would be too
    many, a directory and the words in use; and a list only where less than one
    rank in 64 * ``LISTED`` is held.

    With ``lone``, primary items that a single row holds, with at most so many
    items after them, go to a third set of that name instead of ``primary``;
    ``n_primary`` counts them too, ``n_lone`` only them.

    ``whole`` says that every item is secondary, so that rows of the node need
    not be looked through for others.
    """
    secondary = "z > 0" if keep_all else f"(z > 0 and lu >= {min_util})"
    primary = f"({secondary} and su >= {min_util})" if subtree_pruning else secondary
    alone = f"({primary} and cells = 1 and width <= {lone})" if lone is not None else "false"
    shared = f"({primary} and not {alone})" if lone is not None else primary
    own = ["su", "n", "cells", "width"]
    words = (
        bounds.groupBy("prefix", F.expr("shiftright(z, 6) as w"))
        .agg(
            F.expr(f"bit_or(if({secondary}, shiftleft(1L, z & 63), 0L)) as s"),
            F.expr(f"bit_or(if({shared}, shiftleft(1L, z & 63), 0L)) as p"),
            F.expr(f"bit_or(if({alone}, shiftleft(1L, z & 63), 0L)) as l"),
            F.expr(f"count_if({primary}) as n_primary"),
            F.expr(f"count_if(z > 0 and not {secondary}) as n_dropped"),
            *[F.expr(f"max(if(z = 0, {name}, null)) as {name}") for name in own],
        )
    )
    nodes = words.groupBy("prefix").agg(
        F.expr("sort_array(collect_list(if(s != 0, struct(w, s, p, l), null))) as words"),
        F.expr("sum(n_primary) as n_primary"),
        F.expr("sum(bit_count(l)) as n_lone"),
        F.expr("sum(n_dropped) = 0 as whole"),
        *[F.expr(f"max({name}) as {name}") for name in own],
    )

    span = "get(words, size(words) - 1).w - get(words, 0).w"
    held = "aggregate(words, 0L, (a, x) -> a + bit_count(x.s))"
    nodes = nodes.selectExpr(
        "*",
        f"""case when {span} > {LISTED} * {held} then 'list' when {span} > {SPARSE} * {held} then 'directory'
            else 'words' end as _shape""",
    )
    # The first word of each block of 64 in use, and a bit for each of its words.
    new_block = "i = 0 or shiftright(get(words, i).w, 6) != shiftright(get(words, i - 1).w, 6)"
    starts = f"filter(sequence(0, size(words) - 1), i -> {new_block})"
    nodes = nodes.selectExpr("*", f"if(_shape = 'directory', {starts}, cast(array() as array<int>)) as _starts")
    own_words = "slice(words, i + 1, coalesce(get(_starts, k + 1), size(words)) - i)"
    used = f"aggregate({own_words}, 0L, (a, x) -> a | shiftleft(1L, x.w & 63))"
    nodes = nodes.selectExpr(
        "*", f"transform(_starts, (i, k) -> struct(shiftright(get(words, i).w, 6) as w, bigint(i) as i, {used} as used)) as _blocks"
    )

    def filled(table: str, value: str) -> str:
        # Each entry, then zeros up to the next one in use.
        gap = f"coalesce(get({table}, i + 1).w - x.w - 1, 0)"
        return f"flatten(transform({table}, (x, i) -> concat(array({value}), array_repeat(0L, {gap}))))"

    def members(name: str) -> str:
        bits = f"filter(sequence(0, 63), b -> getbit(x.{name}, b) = 1)"
        listed = f"flatten(transform(words, x -> transform({bits}, b -> x.w * 64L + b)))"
        length = "(get(_blocks, size(_blocks) - 1).w - get(_blocks, 0).w + 1L)"
        parts = [f"array({length})", filled("_blocks", "x.used"), filled("_blocks", f"x.i + 1 + 2 * {length}")]
        directory = f"concat({', '.join(parts)}, transform(words, x -> x.{name}))"
        return f"case _shape when 'words' then {filled('words', f'x.{name}')} when 'directory' then {directory} else {listed} end"

    return nodes.selectExpr(
        "prefix",
        "su as utility",
        "n",
        "cells",
        "width",
        "n_primary",
        "case _shape when 'words' then get(words, 0).w when 'directory' then -2 - get(_blocks, 0).w else -1 end as first_word",
        f"{members('s')} as secondary",
        f"{members('p')} as primary",
        "whole",
        *(["n_lone", f"{members('l')} as lone"] if lone is not None else []),
    )
