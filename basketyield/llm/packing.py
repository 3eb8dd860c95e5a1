"""Packing documents into sequences of a fixed length by bin completion.

How a piece of a length is placed does not depend on which document it is, so
the search works on the histogram of lengths: at most ``capacity`` numbers,
whatever the corpus.  It yields runs: "the next ``n`` pieces of length ``s``
go ``per`` to a sequence, from sequence ``q`` on, at this offset".  Pieces
find their run by their number among the pieces of equal length.

Bin completion: take the largest length that is left, go through the undominated
ways to fill the rest of its sequence, the fullest first, as often as the
histogram allows.  Best fit decreasing on what is left gives an incumbent at
every node; a branch ends when its waste exceeds what the incumbent leaves to
gain.  If best fit meets the lower bound at the root, nothing is searched.
The incumbent is always a whole packing.  ``max_nodes`` bounds the time of the
search, after so many sub-problems, in which a filling is used as often as it can be
at once.  With None fillings are used one at a time until nothing is left to
try, which gives the fewest sequences that there are, in time that no bound holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stage
from .common import batches, never_broadcast
from .word_ids import word_encoder

CAPACITY = 4096
#: Sub-problems that a search looks at; None for all of them.
MAX_NODES = 100

#: A filling: ((length, how many), ...), with how many sequences have it.
Filling = tuple[tuple[int, int], ...]


# --- the search, on a histogram ------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by volume, and by what fits beside the long pieces."""
    sizes = np.flatnonzero(counts)
    if not len(sizes):
        return 0
    number = counts[sizes]
    volume = int(sizes @ number)
    best = -(-volume // capacity)
    n_above = np.cumsum(counts[::-1])[::-1]
    v_up_to = np.cumsum(counts * np.arange(len(counts)))
    half = capacity // 2
    more_than_half = int(n_above[half + 1]) if half + 1 < len(counts) else 0
    for t in [0, *sizes[sizes <= half].tolist()]:
        # over capacity - t: nothing of t or more fits beside; over half: one to a sequence
        alone = int(n_above[capacity - t + 1]) if capacity - t + 1 < len(counts) else 0
        large_volume = int(v_up_to[capacity - t] - v_up_to[half])
        small_volume = int(v_up_to[half] - (v_up_to[t - 1] if t else 0))
        beside = (more_than_half - alone) * capacity - large_volume
        best = max(best, more_than_half + max(0, -(-(small_volume - beside) // capacity)))
    return best


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best fit decreasing: each piece goes to the sequence that it leaves least room in."""
    open_bins: list[dict[Filling, int]] = [{} for _ in range(capacity + 1)]  # by room left
    n_open = np.zeros(capacity + 1, dtype=np.int64)

    def put(room: int, filling: Filling, n: int) -> None:
        open_bins[room][filling] = open_bins[room].get(filling, 0) + n
        n_open[room] += n

    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        for room in (np.flatnonzero(n_open[size:]) + size).tolist():
            most = room // size
            for filling in list(open_bins[room]):
                n = open_bins[room][filling]
                whole = min(n, left // most)
                rest = left - whole * most if whole < n else 0
                rest = min(rest, most - 1)
                used = whole + (rest > 0)
                if not used:
                    break
                open_bins[room][filling] -= used
                n_open[room] -= used
                if open_bins[room][filling] == 0:
                    del open_bins[room][filling]
                if whole:
                    put(room - most * size, (*filling, (size, most)), whole)
                if rest:
                    put(room - rest * size, (*filling, (size, rest)), 1)
                left -= whole * most + rest
                if not left:
                    break
            if not left:
                break
        most = capacity // size
        if left // most:
            put(capacity - most * size, ((size, most),), left // most)
        if left % most:
            put(capacity - left % most * size, ((size, left % most),), 1)
    return [(filling, n) for held in open_bins for filling, n in held.items()]


def _raised(bits: int, low: int, high: int) -> int:
    """The bits moved up by ``low`` to ``high`` places."""
    width, out = 1, bits
    while width <= high - low:
        step = min(width, high - low - width + 1)
        out |= out << step
        width += step
    return out << low if high >= low else 0


def _dominated(pieces: list[tuple[int, int]], counts: np.ndarray, room: int, capacity: int) -> bool:
    """Whether one piece that is left can take the place of a shorter one, or of several, or fits into the room as well."""
    used = dict(pieces)
    left = 0
    for size in np.flatnonzero(counts[: capacity + 1]).tolist():
        if counts[size] > used.get(size, 0):
            left |= 1 << size
    if not left:
        return False
    single = several = 0  # sums of one piece, and of more
    for size, n in pieces:
        for _ in range(n):
            several |= (several | single) << size
            single |= 1 << size
    return bool(left & (_raised(1, 1, room) | _raised(single, 1, room) | _raised(several, 0, room)))


def fillings(counts: np.ndarray, largest: int, capacity: int) -> Iterator[Filling]:
    """The undominated fillings around one piece of the largest length, one after the other, the fullest first.

    A filling is left out if one piece of those that are left could take the
    place of several of its pieces, or of a shorter one, or still fits: whatever
    a packing does with the worse one it can do with the better one.  Sums that
    the shorter lengths can reach tell which lengths lead to a waste.
    """
    left = counts.copy()
    left[largest] -= 1
    space = capacity - largest
    sizes = [s for s in np.flatnonzero(left)[::-1].tolist() if s <= space]
    reach = [1]
    for size in reversed(sizes):  # sums of this length and the shorter ones
        mask, bits, n, k = (1 << (space + 1)) - 1, reach[-1], min(int(left[size]), space // size), 1
        while n > 0:
            k = min(k, n)
            bits |= bits << (k * size) & mask
            n, k = n - k, 2 * k
        reach.append(bits)
    reach.reverse()
    for room in range(space + 1):
        if not reach[0] >> (space - room) & 1:
            continue
        # (place of the length, still to fill, pieces chosen); the most of the longest first
        todo: list[tuple[int, int, tuple]] = [(0, space - room, ())]
        while todo:
            i, rest, chosen = todo.pop()
            if rest == 0:
                own = dict(chosen)
                own[largest] = own.get(largest, 0) + 1
                pieces = sorted(own.items(), reverse=True)
                if not _dominated([(s, n) for s, n in chosen], left, room, capacity):
                    yield tuple(pieces)
                continue
            while i < len(sizes) and (sizes[i] > rest or not reach[i] >> rest & 1):
                i += 1
            if i == len(sizes):
                continue
            for k in range(min(int(left[sizes[i]]), rest // sizes[i]) + 1):
                if reach[i + 1] >> (rest - k * sizes[i]) & 1:
                    todo.append((i + 1, rest - k * sizes[i], (*chosen, (sizes[i], k)) if k else chosen))


class _Search:
    """Depth first over fillings of the largest piece that is left, without recursion."""

    def __init__(self, counts: np.ndarray, capacity: int, max_nodes: int | None):
        self.capacity, self.max_nodes, self.nodes = capacity, max_nodes, 0
        self.volume = int(counts @ np.arange(len(counts)))
        self.bound = lower_bound(counts, capacity)
        self.best = best_fit(counts, capacity)
        self.best_n = sum(n for _, n in self.best)
        if self.best_n > self.bound:
            self._run(counts)

    def _spare(self) -> int:
        """Room that a better packing may leave in all."""
        return (self.best_n - 1) * self.capacity - self.volume

    def _open(self, counts: np.ndarray, done: list, n_done: int, waste: int) -> tuple | None:
        """A node, with what is still to try below it; None if it needs no search."""
        self.nodes += 1
        sizes = np.flatnonzero(counts)
        rest = best_fit(counts, self.capacity)
        total = n_done + sum(n for _, n in rest)
        if total < self.best_n:
            self.best, self.best_n = done + rest, total
        if not len(sizes) or n_done + lower_bound(counts, self.capacity) >= self.best_n:
            return None
        return counts, done, n_done, waste, fillings(counts, int(sizes[-1]), self.capacity)

    def _run(self, counts: np.ndarray) -> None:
        path = [self._open(counts, [], 0, 0)]
        while path and path[-1] is not None and self.best_n > self.bound:
            counts, done, n_done, waste, untried = path[-1]
            filling = next(untried, None)
            room = None if filling is None else self.capacity - sum(s * k for s, k in filling)
            if filling is None or waste + room > self._spare():  # the fullest come first
                path.pop()
                continue
            if self.max_nodes is not None and self.nodes >= self.max_nodes:
                return
            times = min(int(counts[s]) // k for s, k in filling) if self.max_nodes is not None else 1
            if room:  # as often as the waste of a better packing allows
                times = min(times, (self._spare() - waste) // room)
            less = counts.copy()
            for s, k in filling:
                less[s] -= k * times
            below = self._open(less, [*done, (filling, times)], n_done + times, waste + room * times)
            if below is not None:
                path.append(below)


def pack_histogram(counts: np.ndarray, capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES) -> list[tuple[Filling, int]]:
    """Fillings and how many sequences have each; ``counts[s]`` pieces of length ``s``."""
    return _Search(np.asarray(counts, dtype=np.int64), capacity, max_nodes).best


def runs_of(fillings: list[tuple[Filling, int]]) -> np.ndarray:
    """Columns length, first, n, per, sequence, offset: where the pieces of each length go, in order of their number."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, n in fillings:
        offset = 0
        for size, per in filling:
            rows.append((size, taken.get(size, 0), n * per, per, sequence, offset))
            taken[size] = taken.get(size, 0) + n * per
            offset += size * per
        sequence += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


# --- pieces and their places -----------------------------------------------------

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("task", pa.int32()), ("number", pa.int64()),
    ]
)
_PIECES_SQL = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, number long"


def token_pieces(docs: DataFrame, path: str, end_id: int | None = 1, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``, with ``task`` and ``number``: the how-manieth of its length in the task."""

    def run(parts):
        encoder, task = word_encoder(path, added_tokens=True), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()
        seen = [0] * (capacity + 1)

        def rows():
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = np.frombuffer(encoder.encode(text.as_py()) + end, dtype=encoder.dtype).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        yield doc_id, piece, start, len(own), zlib.crc32(own.tobytes()), task, seen[len(own)]
                        seen[len(own)] += 1

        yield from batches(_PIECES, rows())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES_SQL)


def place(pieces: DataFrame, capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table with ``length``, ``task`` and ``number``.

    ``number`` counts the pieces of a length in a task from 0, and lengths are
    from 1 to ``capacity``.  The driver gets one number for each length.
    """
    held = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in held.groupBy("length").agg(F.sum("n")).collect():
        counts[length] = n
    runs = runs_of(pack_histogram(counts, capacity, max_nodes))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = held.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    columns = [c for c in pieces.columns if c not in ("task", "number")]
    numbered = pieces.join(never_broadcast(bases), ["task", "length"]).select(*columns, (F.col("base") + F.col("number")).alias("number"))
    span = int(counts.max(initial=0)) + 1
    keys = runs[:, 0] * span + runs[:, 1]
    # an exact key needs lengths times the largest count to fit 63 bits
    if capacity * span >= 1 << 62:
        raise ValueError("too many pieces of one length")
    fields = [f for f in numbered.schema.fields if f.name != "number"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def run(parts):
        for part in parts:
            length = part.column("length").to_numpy()
            number = part.column("number").to_numpy()
            row = runs[np.searchsorted(keys, length * span + number, side="right") - 1]
            at = number - row[:, 1]
            sequence = row[:, 4] + at // row[:, 3]
            offset = row[:, 5] + at % row[:, 3] * length
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in names), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*names, "sequence_id", "offset"],
            )

    return numbered.mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, capacity: int = CAPACITY, max_nodes: int | None = MAX_NODES
) -> DataFrame:
    """Tokenise ``doc_id, text``, cut what is longer than a sequence, and place every piece.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.
    Null texts count as empty (the end id alone; nothing without an end id);
    repeated rows are placed one by one; an empty table gives no rows.  Other
    columns are not read.
    """
    pieces = Stage(docs.sparkSession).write(token_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    return place(pieces, capacity, max_nodes)
