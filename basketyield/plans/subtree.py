"""Finish whole sub-trees inside tasks, for nodes of a measured size."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Executors need not have this package installed: the task function travels whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows per result batch.
BATCH = 10_000

# Opening a node costs about as much as so many cells, however small it is.
NODE_COST = 256

# Nodes of a task are opened together up to about so many cells, some 30 MB.
TOGETHER = 1 << 18

# Cells that one call goes through before it hands back what is left, about a minute.
MAX_TASK_WORK = 1 << 26

# A child whose only row has at most so many items after it is finished with all
# that is below it, up to 2^16 candidates.
LONE_ITEMS = 16

# Candidates below lone children that are gone through at once.
LONE_BATCH = 1 << 15

# A row without utility has the counters of a node that was scored elsewhere.
SCORED = "prefix array<int>, utility bigint, n bigint, rows bigint, kept bigint"

# A row with items is a projected row of a node that a call has left unfinished.
FINISHED = f"{SCORED}, items array<int>, sfx array<bigint>, prefix_util bigint"
ROW = ["prefix", "items", "sfx", "prefix_util", "n"]


class _Rows:
    """Projected rows of some nodes of a level; the items of all rows lie end to end."""

    def __init__(self, items, sfx, lengths, prefix_util, n, node):
        self.items, self.sfx, self.lengths = items, sfx, lengths
        self.prefix_util, self.n, self.node = prefix_util, n, node
        self.starts = np.cumsum(lengths) - lengths
        self.owner = np.repeat(np.arange(len(lengths)), lengths)

    @classmethod
    def of(cls, table: pa.Table) -> _Rows:
        """Rows of a table; they count as rows of one node."""
        items, sfx = (table[name].combine_chunks() for name in ("items", "sfx"))
        lengths = np.diff(items.offsets.to_numpy()).astype(np.int64)
        return cls(
            items.flatten().to_numpy(),
            sfx.flatten().to_numpy(),
            lengths,
            table["prefix_util"].to_numpy(),
            table["n"].to_numpy(),
            np.zeros(len(lengths), np.int64),
        )

    def utils(self):
        following = np.append(self.sfx[1:], 0)
        last = self.starts + self.lengths - 1
        following[last[self.lengths > 0]] = 0
        return self.sfx - following

    def keys(self, span: int):
        """One number for the node and the item of each cell; ``span`` is above all items."""
        return self.node[self.owner] * span + self.items

    def after(self, at):
        """How many items follow the cells."""
        return self.starts[self.owner[at]] + self.lengths[self.owner[at]] - 1 - at

    def bounds(self, span: int):
        """Different keys in ascending order with their local and sub-tree utility, and the place of each cell there."""
        keys, slot = np.unique(self.keys(span), return_inverse=True)
        lu, su = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        np.add.at(su, slot, self.prefix_util[self.owner] + self.sfx)
        np.add.at(lu, slot, self.prefix_util[self.owner] + self.sfx[self.starts[self.owner]])
        return keys, lu, su, slot

    def keep(self, mask) -> _Rows:
        """Only the masked cells, with new suffix sums."""
        lengths = np.bincount(self.owner[mask], minlength=len(self.lengths))
        ends = np.cumsum(lengths)
        # The sum from a cell to the end of its row, out of one running sum.
        running = np.concatenate([[0], np.cumsum(self.utils()[mask])])
        owner = self.owner[mask]
        sfx = running[ends[owner]] - running[: len(owner)]
        return _Rows(self.items[mask], sfx, lengths, self.prefix_util, self.n, self.node)

    def filled(self) -> _Rows:
        """Without the rows that have no items."""
        full = self.lengths > 0
        return _Rows(self.items, self.sfx, self.lengths[full], self.prefix_util[full], self.n[full], self.node[full])

    def found(self, span: int, keys):
        """The cells that have one of ``keys``, and which one."""
        own = self.keys(span)
        slot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        at = np.flatnonzero(keys[slot] == own)
        return at, slot[at]

    def scores(self, span: int, keys):
        """Of the children on ``keys``: utility, transactions, and cells in their rows.

        Then which of them have a single row, and that a short one, and where
        the cells of these are.
        """
        at, slot = self.found(span, keys)
        owner, after = self.owner[at], self.after(at)
        utility, n, cells = (np.zeros(len(keys), np.int64) for _ in range(3))
        np.add.at(utility, slot, self.prefix_util[owner] + self.utils()[at])
        np.add.at(n, slot, self.n[owner])
        np.add.at(cells, slot, after)
        rows = np.bincount(slot, minlength=len(keys))
        rows[slot[after > LONE_ITEMS]] = 0
        return utility, n, cells, rows == 1, at[rows[slot] == 1]

    def project(self, span: int, keys) -> _Rows:
        """Rows of the children on ``keys``, which become the nodes."""
        at, node = self.found(span, keys)
        row, lengths = self.owner[at], self.after(at)
        cells = np.repeat(at + 1 - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        prefix_util = self.prefix_util[row] + self.utils()[at]
        return _Rows(self.items[cells], self.sfx[cells], lengths, prefix_util, self.n[row], node)

    def merge(self) -> _Rows:
        """One row per node and different list of items."""
        flat, width = self.items.tobytes(), self.items.itemsize
        ends = (self.starts + self.lengths) * width
        keys = [flat[start:end] for start, end in zip((self.starts * width).tolist(), ends.tolist())]
        lists, different = pd.factorize(np.array(keys, dtype=object))
        group, _ = pd.factorize(self.node * (len(different) + 1) + lists)
        count = group.max(initial=-1) + 1
        if count == len(group):
            return self
        first = np.full(count, len(group))
        np.minimum.at(first, group, np.arange(len(group)))
        lengths = self.lengths[first]
        starts = np.cumsum(lengths) - lengths
        source = np.repeat(self.starts[first] - starts, lengths) + np.arange(lengths.sum())
        sfx = np.zeros(lengths.sum(), np.int64)
        place = starts[group][self.owner] + np.arange(len(self.items)) - self.starts[self.owner]
        np.add.at(sfx, place, self.sfx)
        prefix_util, n = np.zeros(count, np.int64), np.zeros(count, np.int64)
        np.add.at(prefix_util, group, self.prefix_util)
        np.add.at(n, group, self.n)
        return _Rows(self.items[source], sfx, lengths, prefix_util, n, self.node[first])


def _lists(flat, lengths) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(flat))


class _Output:
    """Result rows, held as arrays until they fill a batch."""

    def __init__(self):
        self.held, self.count = [], 0

    def opened(self, nodes, counts: tuple, prefixes, utility, n) -> None:
        """The counters of opened nodes, and their candidates."""
        m, k = len(nodes), len(prefixes)
        flat = np.concatenate([nodes.ravel(), prefixes.ravel()])
        lengths = np.append(np.full(m, nodes.shape[1]), np.full(k, prefixes.shape[1]))
        none = np.zeros(m, np.int64)
        rows, kept = (np.append(c, np.zeros(k, np.int64)) for c in counts)
        self.held.append((flat, lengths, np.append(none, utility), np.append(none, n), rows, kept, np.arange(m + k) < m))
        self.count += m + k

    def batch(self) -> pa.RecordBatch:
        flat, lengths, utility, n, rows, kept, unscored = map(np.concatenate, zip(*self.held))
        self.held, self.count = [], 0
        scored = {
            "prefix": _lists(flat, lengths),
            "utility": pa.array(utility, mask=unscored),
            "n": pa.array(n, mask=unscored),
            "rows": pa.array(rows),
            "kept": pa.array(kept),
        }
        none = {
            "items": pa.nulls(len(n), pa.list_(pa.int32())),
            "sfx": pa.nulls(len(n), pa.list_(pa.int64())),
            "prefix_util": pa.nulls(len(n), pa.int64()),
        }
        return pa.RecordBatch.from_pydict({**scored, **none})


def _scored(flat, length: int, utility, n, rows, kept) -> pa.RecordBatch:
    """Result rows of candidates with ``length`` items each."""
    lists = _lists(flat.ravel(), np.full(len(n), length))
    columns = {"prefix": lists, "utility": utility, "n": n, "rows": rows, "kept": kept}
    none = {"items": pa.list_(pa.int32()), "sfx": pa.list_(pa.int64()), "prefix_util": pa.int64()}
    return pa.RecordBatch.from_pydict(
        {**{k: v if k == "prefix" else pa.array(v) for k, v in columns.items()}, **{k: pa.nulls(len(n), t) for k, t in none.items()}}
    )


def _below_lone(rows: _Rows, prefixes, at, min_util: int, subtree_pruning: bool) -> Iterator[pa.RecordBatch]:
    """The children on the cells ``at``, each in a single row, and every candidate below them.

    A row is all there is below such a child, so utilities and bounds are sums
    of its own cells: nothing is projected, merged or shuffled, and candidates
    of many rows are worked out together.  ``prefixes`` has a line for each row.
    A candidate with candidates below it carries its own counters: one row.
    """
    utils, ends = rows.utils(), rows.starts + rows.lengths
    owner = rows.owner[at]
    flat = np.column_stack([prefixes[owner], rows.items[at]]).astype(np.int32)
    todo = [(flat, owner, at, rows.prefix_util[owner] + utils[at])]
    while todo:
        flat, owner, at, utility = todo.pop()
        if len(at) > LONE_BATCH:
            for part in (slice(LONE_BATCH, None), slice(LONE_BATCH)):
                todo.append((flat[part], owner[part], at[part], utility[part]))
            continue
        after = ends[owner] - at - 1
        source = np.repeat(np.arange(len(at)), after)
        cells = np.repeat(at + 1 - (np.cumsum(after) - after), after) + np.arange(after.sum())
        # The sub-tree utility of the item, or the local one, that of the first item after.
        bound = cells if subtree_pruning else at[source] + 1
        going = utility[source] + rows.sfx[bound] >= min_util
        source, cells = source[going], cells[going]
        opened = np.bincount(source, minlength=len(at)) > 0
        n = rows.n[owner]
        yield _scored(flat, flat.shape[1], utility, n, opened.astype(np.int64), np.where(opened, n, 0))
        if len(cells):
            below = np.column_stack([flat[source], rows.items[cells]])
            todo.append((below, owner[source], cells, utility[source] + utils[cells]))


def finish_lone(found: DataFrame, min_util: int, *, subtree_pruning: bool) -> DataFrame:
    """Candidates on the ``starts`` of rows (see ``lone_rows``) and all that is below them, as ``SCORED``."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows.of(pa.Table.from_batches([batch]))
            prefixes = batch["prefix"].flatten().to_numpy().reshape(batch.num_rows, -1)  # of one level, so alike in length
            starts = batch["starts"]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts.offsets.to_numpy()))
            at = rows.starts[owner] + starts.flatten().to_numpy()
            for done in _below_lone(rows, prefixes, at, min_util, subtree_pruning):
                yield done.select(["prefix", "utility", "n", "rows", "kept"])

    return found.select(*ROW, "starts").mapInArrow(finish, SCORED)


def _unfinished(prefixes, rows: _Rows) -> Iterator[pa.RecordBatch]:
    """The rows of nodes as result rows."""
    for start in range(0, len(rows.n), BATCH):
        part = slice(start, start + BATCH)
        lengths = rows.lengths[part]
        cells = slice(rows.starts[start], rows.starts[start] + lengths.sum())
        count = len(lengths)
        zeros = pa.array(np.zeros(count, np.int64))
        yield pa.RecordBatch.from_pydict(
            {
                "prefix": _lists(prefixes[rows.node[part]].ravel(), np.full(count, prefixes.shape[1])),
                "utility": pa.nulls(count, pa.int64()),
                "n": pa.array(rows.n[part]),
                "rows": zeros,
                "kept": zeros,
                "items": _lists(rows.items[cells], lengths),
                "sfx": _lists(rows.sfx[cells], lengths),
                "prefix_util": pa.array(rows.prefix_util[part]),
            }
        )


def _search(
    rows: _Rows, prefix: tuple, min_util: int, merging: bool, subtree_pruning: bool, work: int
) -> Iterator[pa.RecordBatch]:
    """Depth-first below one node; returns every candidate it scores.

    Small siblings, and cousins, are opened together, up to ``TOGETHER`` cells.
    Only the rows on the current path are held.  All children of a node are
    scored when it is opened, and only those with rows are opened themselves;
    children with a single short row are finished at once.
    A call that has gone through ``work`` cells opens no further nodes and
    returns the rows of those it has left; the first one is always opened.
    """
    out = _Output()
    path: list[tuple] = []
    left = work
    span = int(rows.items.max(initial=0)) + 1

    def named(prefixes, keys):
        return np.column_stack([prefixes[keys // span], keys % span]).astype(np.int32)

    def enter(prefixes, rows: _Rows) -> Iterator[pa.RecordBatch]:
        nonlocal left
        left -= len(rows.items) + NODE_COST * len(prefixes)
        keys, lu, su, slot = rows.bounds(span)
        primary = (su if subtree_pruning else lu) >= min_util
        opened = np.zeros(len(prefixes), bool)
        opened[keys[primary] // span] = True
        if not opened.any():
            return
        mask = (lu >= min_util)[slot] & opened[rows.node[rows.owner]]
        if not mask.all():
            rows = rows.keep(mask).filled()
        kept = np.zeros(len(prefixes), np.int64)
        np.add.at(kept, rows.node, rows.n)
        rows = rows.merge() if merging else rows
        keys = keys[primary]
        utility, n, cells, alone, at = rows.scores(span, keys)
        if left <= 0:
            alone, at = np.zeros(len(keys), bool), at[:0]
        counts = np.bincount(rows.node, minlength=len(prefixes))[opened], kept[opened]
        out.opened(prefixes[opened], counts, named(prefixes, keys[~alone]), utility[~alone], n[~alone])
        if len(at):
            for done in _below_lone(rows, prefixes[rows.node], at, min_util, subtree_pruning):
                left -= done.num_rows
                yield done
        going = ~alone & (cells > 0)
        keys, place = keys[going], np.cumsum(cells[going]) // TOGETHER
        path.append((prefixes, rows, iter(np.split(keys, np.flatnonzero(np.diff(place)) + 1) if len(keys) else ())))

    yield from enter(np.array([prefix], np.int32), rows)
    while path:
        prefixes, rows, to_explore = path[-1]
        keys = next(to_explore, None)
        if keys is None:
            path.pop()
            continue
        children = named(prefixes, keys), rows.project(span, keys).filled()
        yield from enter(*children) if left > 0 else _unfinished(*children)
        if out.count >= BATCH:
            yield out.batch()
    if out.count:
        yield out.batch()


def finish_subtrees(
    rows: DataFrame, min_util: int, *, merging: bool, subtree_pruning: bool, work: int = MAX_TASK_WORK
) -> DataFrame:
    """Score what is below the nodes that own ``rows``, one task call per node.

    The caller has measured the nodes.  A call goes through about ``work``
    cells; the rows of nodes that it does not come to are returned among the
    candidates (see ``FINISHED``), for a further call each.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        prefix = tuple(table["prefix"][0].as_py())
        yield from _search(_Rows.of(table), prefix, min_util, merging, subtree_pruning, work)

    return rows.where("size(items) > 0").select(*ROW).groupBy("prefix").applyInArrow(finish, FINISHED)
