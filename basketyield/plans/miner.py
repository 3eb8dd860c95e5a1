"""The search for high-utility itemsets, one level of the search tree at a time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import check_min_util, checked_arrays, from_table, is_array_form, sum_repeats
from ..operators.bounds import item_twu, promising_items, rank_items, revise_transactions
from ..operators.projection import (
    candidate_bounds,
    keep_secondary,
    lone_rows,
    merge_transactions,
    node_bounds,
    node_state,
    project_on_items,
    root_projection,
)
from ..operators.report import decode_itemsets
from ..operators.transactions import to_array_form
from ..stage import Stage
from .subtree import LONE_ITEMS, MAX_TASK_WORK, ROW, SCORED, finish_lone, finish_subtrees

# Node sets up to this many 64-bit words (16 MB for the two sets) are broadcast.
BROADCAST_WORDS = 1 << 20

# Cells of one sub-tree that a single task may finish, about 25 MB.
MAX_GROUP_CELLS = 1 << 21


@dataclass(frozen=True)
class MiningResult:
    """``itemsets``: ``itemset, size, utility``; ``nodes``: every candidate the search scored.

    Both are read from tables that the run has written.  ``counters`` has the
    rows of the nodes that were expanded, if they were counted.  ``items`` is
    the size of the dictionary, ``longest`` the size of the largest candidate.
    """

    itemsets: DataFrame
    nodes: DataFrame
    counters: DataFrame | None
    dictionary: DataFrame
    min_util: int
    stage: Stage
    items: int
    longest: int

    def decoded(self, df: DataFrame) -> DataFrame:
        """:func:`decode_itemsets` of ``prefix, utility`` rows of this result."""
        return decode_itemsets(df, self.dictionary, self.items, self.longest)

    def discard(self) -> None:
        """Delete the written tables; the three DataFrames cannot be read any more."""
        self.stage.drop()


def _side(nodes: DataFrame, sizes: dict) -> DataFrame:
    """The join side of a node table: broadcast where it was measured to be small."""
    # A node itself counts as a few words.
    return F.broadcast(nodes) if sizes["words"] + 8 * sizes["nodes"] <= BROADCAST_WORDS else nodes


def mine(
    df: DataFrame,
    min_util: int,
    *,
    merging: bool = True,
    subtree_pruning: bool = True,
    strategy: str = "level",
    trim_secondary: bool = True,
    max_group_cells: int = MAX_GROUP_CELLS,
    max_task_work: int = MAX_TASK_WORK,
    unique: bool = False,
    counters: bool = False,
) -> MiningResult:
    """Find every itemset with a utility of at least ``min_util``.

    ``df`` is a transaction database in long or array form.  Utilities of the
    same item in the same transaction are summed (``unique=True`` says there
    are none, in long form); a null, negative or fractional utility, a missing
    id, or an array row with repeated items or lists of different lengths fails
    the job.  The flags change the work, never the result:

    * ``merging`` combines projected rows of a node that have the same items;
      without it a level needs no shuffle of its rows at all.
    * ``subtree_pruning`` explores only items whose sub-tree utility suffices.
    * ``strategy='level'`` expands all nodes of a level in one job.
      ``'subtree'`` does so only for nodes of more than ``max_group_cells``
      cells and lets one task finish each smaller one.  A task that has gone
      through ``max_task_work`` cells hands the nodes it has left back as rows,
      and the next round gives each of them to a task of its own.
    * ``trim_secondary`` also takes dropped items out of the local utility,
      which makes that bound tighter; tasks of ``'subtree'`` always do so.

    A level is scored before it is projected: the sums of its candidates come
    straight from the rows above, and only rows of candidates that go on are
    written, without the items that are no longer secondary.  The last level
    writes none.  A candidate whose only row is a short one (``LONE_ITEMS``) is
    finished with all below it from that row, without a further shuffle.  With
    ``merging``, equal transactions are one row from the start.  The driver
    sees a handful of sizes per level.

    ``counters`` also counts the rows of the nodes, for :func:`mining_stats`.
    """
    check_min_util(min_util)
    if strategy not in ("level", "subtree"):
        raise ValueError(f"strategy must be 'level' or 'subtree', not {strategy!r}")
    stage = Stage(df.sparkSession)
    try:
        return _mine(
            df, min_util, stage, merging, subtree_pruning, strategy, trim_secondary, max_group_cells, max_task_work, unique, counters
        )
    except BaseException:
        stage.drop()
        raise


def _mine(
    df: DataFrame,
    min_util: int,
    stage: Stage,
    merging: bool,
    subtree_pruning: bool,
    strategy: str,
    trim_secondary: bool,
    max_group_cells: int,
    max_task_work: int,
    unique: bool,
    counters: bool,
) -> MiningResult:
    # Two steps read the cells, and their checks run once.  Their number sets that of the partitions.
    if is_array_form(df):
        df, seen = stage.write_observed(checked_arrays(df), "cells", cells="coalesce(sum(size(items)), 0)")
    else:
        checked = from_table(df, "tid", "item", "utility", unique=True)
        df, seen = stage.write_observed(checked, "cells" if unique else "lines", cells="count(1)")
        if not unique:
            df = stage.write(sum_repeats(df, seen["cells"]), "cells")
            stage.drop("lines")
    cells = seen["cells"]

    promising, sizes = stage.write_observed(promising_items(item_twu(df, cells), min_util), "promising", items="count(1)")
    items = sizes["items"]
    dictionary = rank_items(promising, items, stage)
    revised = revise_transactions(df, dictionary, items)
    whole = root_projection(to_array_form(revised, cells), keep_dropped=not trim_secondary)
    if merging:
        whole, sizes = stage.write_observed(whole, "whole", width="coalesce(max(size(items)), 0)")
        whole = merge_transactions(whole, width=sizes["width"])
    rows = stage.write(whole, "rows_0")
    stage.drop("whole")
    stage.drop("cells")

    # Without trimming, bounds also count what a row no longer has.
    lone = LONE_ITEMS if trim_secondary else -1

    def scored_nodes(bounds: DataFrame | None, depth: int, in_task: str, done: DataFrame | None) -> tuple[DataFrame, dict]:
        """The nodes of a level; ``done`` are candidates of this level and below with nothing left to do."""
        keep_all = depth == 0 and not trim_secondary
        goes_on = f"n_primary > 0 and not ({in_task})"
        if bounds is None:
            bounds = candidate_bounds(rows.limit(0))
        found = node_state(bounds, min_util, subtree_pruning=subtree_pruning, keep_all=keep_all, lone=lone).selectExpr(
            "*", "bigint(0) as rows", "bigint(0) as kept", f"{goes_on} as goes_on"
        )
        return stage.write_observed(
            found if done is None else found.unionByName(done, allowMissingColumns=True),
            f"nodes_{depth}",
            nodes=f"count_if({goes_on})",
            lone=f"coalesce(sum(if({goes_on}, n_lone, 0)), 0)",
            shared=f"coalesce(sum(if({goes_on}, n_primary - n_lone, 0)), 0)",
            words=f"coalesce(sum(if({goes_on}, size(secondary), 0)), 0)",
            width=f"coalesce(max(if({goes_on}, width, 0)), 0)",
            finished=f"count_if(n_primary > 0 and {in_task})",
            longest="coalesce(max(size(prefix)), 0)",
        )

    def finish_all(group_rows: DataFrame, name: str) -> None:
        """Search in rounds until no task has left a node unfinished."""
        unfinished, rounds = True, 0
        while unfinished:
            done = finish_subtrees(
                group_rows, min_util, merging=merging, subtree_pruning=subtree_pruning, work=max_task_work
            )
            scored.append(f"{name}_{rounds}")
            done, seen = stage.write_observed(
                done, scored[-1], unfinished="count(items)", longest="coalesce(max(size(prefix)), 0)"
            )
            lengths.append(seen["longest"])
            unfinished, rounds = seen["unfinished"] > 0, rounds + 1
            group_rows = done.where("items is not null").select(*ROW)

    # The root is always split, so that its sub-trees go to different tasks.
    nodes, sizes = scored_nodes(node_bounds(rows), 0, "false", None)
    scored, counted, lengths, depth = [], [], [0], 0
    while sizes["nodes"]:
        going = _side(nodes.where("goes_on"), sizes)
        at_hand = {"width": sizes["width"], "trimmed": depth > 0}
        bounds = candidate_bounds(rows, going, **at_hand) if sizes["shared"] else None
        children = project_on_items(rows, going, **at_hand)
        done = None
        if sizes["lone"]:
            done = finish_lone(lone_rows(rows, going, trimmed=depth > 0), min_util, subtree_pruning=subtree_pruning)
        depth += 1
        in_task = f"cells <= {max_group_cells}" if strategy == "subtree" else "false"
        nodes, sizes = scored_nodes(bounds, depth, in_task, done)
        scored.append(f"nodes_{depth}")
        lengths.append(sizes["longest"])
        if sizes["finished"]:
            small = nodes.where("n_primary > 0 and not goes_on").select("prefix")
            group_rows = children.join(small, "prefix", "left_semi")
            group_rows = merge_transactions(group_rows) if merging else group_rows
            finish_all(group_rows, f"finished_{depth}")
        if sizes["nodes"]:
            written = keep_secondary(children, _side(nodes.where("goes_on"), sizes))
            if merging:
                written = merge_transactions(written, width=sizes["width"])
            written = stage.write(written, f"rows_{depth}")
            stage.drop(f"rows_{depth - 1}")
            rows = written
            if counters:
                counts = "prefix, cast(null as bigint) as utility, cast(null as bigint) as n, rows, kept".split(", ")
                by_node = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("kept"))
                stage.write(by_node.selectExpr(*counts), f"counted_{depth}")
                counted.append(f"counted_{depth}")
    for name in [*{f"rows_{depth}", f"rows_{max(depth - 1, 0)}"}, "nodes_0"]:
        stage.drop(name)

    none = df.sparkSession.createDataFrame([], SCORED)
    found = stage.read(SCORED, *scored) if scored else none
    candidates = found.where("utility is not null").select("prefix", "utility", "n")
    winners = candidates.where(F.col("utility") >= min_util).select("prefix", "utility")
    rows_of = stage.read(SCORED, *scored, *counted) if scored and counters else none if counters else None
    itemsets = decode_itemsets(winners, dictionary, items, max(lengths))
    return MiningResult(itemsets, candidates, rows_of, dictionary, min_util, stage, items, max(lengths))


def mine_high_utility_itemsets(df: DataFrame, min_util: int, **options) -> DataFrame:
    """``itemset, size, utility`` of every high-utility itemset; options as for :func:`mine`.

    They are one written table; everything else of the run is deleted.
    """
    result = mine(df, min_util, **options)
    try:
        return Stage(df.sparkSession).write(result.itemsets, "itemsets")
    finally:
        result.discard()


def mining_stats(result: MiningResult) -> DataFrame:
    """Per itemset size: candidates scored, itemsets found, and the transactions that hold the candidates.

    If the run counted rows, also ``rows``, those of the expanded candidates
    after merging, and ``merges``, how many others merging saved.  Both are the
    same for either strategy.
    """
    size = F.size("prefix").alias("size")
    stats = result.nodes.groupBy(size).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if(F.col("utility") >= result.min_util).alias("itemsets"),
        F.sum("n").alias("transactions"),
    )
    if result.counters is not None:
        rows = result.counters.groupBy(size).agg(F.sum("rows").alias("rows"), (F.sum("kept") - F.sum("rows")).alias("merges"))
        stats = stats.join(rows, "size")
    return stats.orderBy("size")
