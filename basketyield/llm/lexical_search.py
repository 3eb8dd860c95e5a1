"""Ranked lexical search over a tree of documents, by branch and bound.

Only terms of the items matter, so a document is reduced to those, ordered by
the number of documents that hold them, the most frequent first.  A block of
documents in the order of these lists is a tree: documents with equal first
terms share a path, a path without a fork is one node, and a leaf holds a
handful of documents, or any number of copies.  Every subtree knows the largest
count of each of its terms and its smallest length norm ``m``; a document's score
grows with the counts and falls with ``m``, so these bound all scores below.

Each item walks the tree depth first, the most promising subtree first, and
leaves out what cannot reach the worst of the results it holds.  Held results
go from block to block of a task; a window takes the best of all tasks.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from ..stage import Stage
from .common import batches, broadcast_if_small

#: Items that are searched for in one pass over the documents.
ITEM_BLOCK = 4096
#: Documents and (document, term) cells of a tree.
BLOCK_DOCS = 8192
BLOCK_CELLS = 1 << 21
LEAF = 16
#: ASCII letters and digits stay, A-Z in lower case; other ASCII parts terms; the rest is part of them.
_CLASSES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_NO_ID = 1 << 63  # after any id


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLASSES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def norm(n, n_docs: int, n_terms: int):
    """``m`` of documents of ``n`` terms."""
    return 75 + 25 * n * n_docs // n_terms


def gain(tf, m):
    """What a term's weight is multiplied by; grows with ``tf``, falls with ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


# --- the tree ---------------------------------------------------------------------


def _maxima(terms: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different term with its largest count."""
    order = np.argsort(terms, kind="stable")
    terms, tf = terms[order], tf[order]
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    return terms[first], np.maximum.reduceat(tf, first)


class Node:
    """A subtree: its documents ``[low, high)``, its maxima, and those of its children end to end."""

    __slots__ = ("children", "gains", "high", "low", "m", "starts", "terms", "tf")

    def __init__(self, low: int, high: int):
        self.low, self.high, self.children = low, high, []

    def gather(self) -> None:
        """Take the maxima of the children, which then need not keep them."""
        terms, tf = (np.concatenate([getattr(c, x) for c in self.children]) for x in ("terms", "tf"))
        sizes = [len(c.terms) for c in self.children]
        self.m = min(c.m for c in self.children)
        own = _maxima(terms, tf)
        for child in self.children:
            child.tf = None
            if child.children:
                child.terms, child.gains = child.gains
            else:
                child.terms = None
        self.starts = np.cumsum([0, *sizes[:-1]])
        # what bounds the children waits in ``gains`` until the parent has taken this node's own maxima
        self.gains = terms, gain(tf, np.repeat(np.array([c.m for c in self.children]), sizes))
        self.terms, self.tf = own

    def bounds(self, weights: np.ndarray) -> np.ndarray:
        """What no document below each child can exceed."""
        return np.add.reduceat(weights[self.terms] * self.gains, self.starts)


class Tree:
    """Documents of one block, in the order of their term lists.

    ``ids`` are objects, ``m`` their length norms; the cells of document i are
    ``terms[ends[i]:ends[i + 1]]`` (places in the order of frequency, ascending)
    with their counts ``tf``.
    """

    def __init__(self, ids: list, m: np.ndarray, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, leaf: int = LEAF):
        flat = terms.astype(">u4").tobytes()
        keys = [flat[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        order = sorted(range(len(ids)), key=keys.__getitem__)
        self.keys = [keys[i] for i in order]
        lengths = np.diff(ends)[order]
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        cells = np.repeat(ends[:-1][order] - self.ends[:-1], lengths) + np.arange(len(terms))
        self.ids, self.m = [ids[i] for i in order], m[order]
        self.terms, self.tf = terms[cells], tf[cells]
        self.gains = gain(self.tf, np.repeat(self.m, lengths))
        self.leaf = leaf
        self.root = self._grow()

    def _shared(self, low: int, high: int, depth: int) -> int:
        """Terms that all documents of a range have first; they agree in ``depth`` of them."""
        a, b = self.keys[low], self.keys[high - 1]
        most = min(len(a), len(b)) // 4
        while depth < most and a[4 * depth : 4 * depth + 4] == b[4 * depth : 4 * depth + 4]:
            depth += 1
        return depth

    def _grow(self) -> Node:
        root = Node(0, len(self.ids))
        todo, made = [(root, 0)], []
        while todo:
            node, depth = todo.pop()
            made.append(node)
            if node.high - node.low <= self.leaf:
                continue
            depth = self._shared(node.low, node.high, depth)
            if 4 * depth == len(self.keys[node.high - 1]):
                continue  # copies of one list
            low = node.low
            while low < node.high:  # one child for each next term, one for the lists that end here
                own, high = self.keys[low][4 * depth : 4 * depth + 4], low + 1
                while high < node.high and self.keys[high][4 * depth : 4 * depth + 4] == own:
                    high += 1
                child = Node(low, high)
                node.children.append(child)
                todo.append((child, depth + bool(own)))
                low = high
        for node in reversed(made):  # children come after their parent
            if node.children:
                node.gather()
            else:
                a, b = self.ends[node.low], self.ends[node.high]
                node.terms, node.tf = _maxima(self.terms[a:b], self.tf[a:b])
                node.m = int(self.m[node.low : node.high].min())
        if root.children:
            root.terms, root.gains = root.gains
        return root

    def scores(self, node: Node, weights: np.ndarray) -> np.ndarray:
        """The scores of the documents of a leaf."""
        a, b = self.ends[node.low], self.ends[node.high]
        return np.add.reduceat(weights[self.terms[a:b]] * self.gains[a:b], self.ends[node.low : node.high] - a)

    def search(self, weights: np.ndarray, held: list[tuple[int, int]], k: int) -> int:
        """Add the best documents for one item to its heap of ``(score, -id)``; returns how many were scored.

        Scores of 0 do not count.  ``weights`` has a number for each place in the order of terms.
        """
        scored, todo = 0, [(math.inf, self.root)]
        while todo:
            bound, node = todo.pop()
            least = held[0][0] if len(held) == k else 1
            if bound < least:
                continue
            if node.children:
                bounds = node.bounds(weights)
                for i in np.argsort(bounds, kind="stable"):  # the best one is taken next
                    if bounds[i] >= least:
                        todo.append((int(bounds[i]), node.children[i]))
                continue
            found = self.scores(node, weights)
            scored += len(found)
            for i in np.flatnonzero(found >= least):
                own = (int(found[i]), -self.ids[node.low + int(i)])
                if len(held) < k:
                    heapq.heappush(held, own)
                elif own > held[0]:
                    heapq.heapreplace(held, own)
        return scored


# --- the documents --------------------------------------------------------------------

_VECTOR = "doc_id long, n long, terms array<int>, tf array<int>"


def restricted_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Every row's id, its number of terms, and those of the vocabulary with their counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for part in parts:
            for start in range(0, part.num_rows, 512):
                own = part.slice(start, 512)
                n, ends, terms, tf = [], [0], [], []
                for text in own.column(1):
                    found = terms_of(text.as_py())
                    counts = Counter(map(get, found))
                    counts.pop(None, None)
                    n.append(len(found))
                    terms.extend(counts.keys())
                    tf.extend(counts.values())
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _VECTOR)


def _blocks(parts: Iterator[pa.RecordBatch], place: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Tree]:
    """Trees of bounded size from rows of :func:`restricted_vectors`; ``place`` is the place of each term in the order."""
    held, docs, cells = [], 0, 0

    def tree() -> Tree:
        ids = [_NO_ID if i is None else i for b in held for i in b.column(0).to_pylist()]
        n = np.concatenate([b.column(1).to_numpy() for b in held])
        terms, tf = (np.concatenate([b.column(c).flatten().to_numpy() for b in held]) for c in (2, 3))
        sizes = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held])
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        terms = place[terms]
        order = np.lexsort((terms, np.repeat(np.arange(len(ids)), np.diff(ends))))
        return Tree(ids, norm(n, n_docs, n_terms), ends, terms[order], tf[order].astype(np.int64))

    for part in parts:
        for start in range(0, part.num_rows, 512):
            own = part.slice(start, 512)
            held.append(own)
            docs, cells = docs + own.num_rows, cells + len(own.column(2).flatten())
            if docs >= BLOCK_DOCS or cells >= BLOCK_CELLS:
                yield tree()
                held, docs, cells = [], 0, 0
    if held:
        yield tree()


_FOUND = pa.schema([("no", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search_block(vectors: DataFrame, items: list[tuple[int, Counter]], df: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The ``k`` best documents of each task for each ``(number, counts of terms)``."""
    order = np.lexsort((np.arange(len(df)), -df))
    place = np.empty(len(df), dtype=np.int64)
    place[order] = np.arange(len(df))
    weighted = []
    for no, counts in items:
        used = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
        w = np.array([c * weight(n_docs, int(df[t])) for t, c in counts.items()], dtype=np.int64)
        weighted.append((no, place[used], w))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in weighted]
        weights = np.zeros(len(place), dtype=np.int64)
        for tree in _blocks(parts, place, n_docs, n_terms):
            for (_, at, w), held in zip(weighted, best, strict=True):
                weights[at] = w
                tree.search(weights, held, k)
                weights[at] = 0
        rows = ((no, None if -i == _NO_ID else -i, score) for (no, _, _), held in zip(weighted, best, strict=True) for score, i in held)
        yield from batches(_FOUND, rows)

    return vectors.where("size(terms) > 0").mapInArrow(run, "no long, doc_id long, score long")


# --- the operator -----------------------------------------------------------------------


def search(docs: DataFrame, items: DataFrame, k: int = 20, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents for each item, equal scores by ascending id.

    Every row of ``docs`` with a term counts as a document, repeated ones too;
    null and empty texts have no term.  An item's repeated rows count once, and
    different texts under one id are ranked one by one.  Items and documents
    with a null id take part; a null id comes last among equal scores.  Scores
    of 0 are left out, so an item without known terms has no rows.  Other
    columns are not read.

    Items are taken ``item_block`` at a time, each with one pass over the documents.
    """
    stage = Stage(docs.sparkSession)
    asked = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    asked = stage.write(global_row_number(asked, ["item_id", "text"], "no", stage), "items")
    found = []
    for block, first in enumerate(range(0, asked.count(), item_block)):
        rows = asked.where((F.col("no") > first) & (F.col("no") <= first + item_block)).select("no", "text").collect()
        vocabulary: dict[bytes, int] = {}
        counted = [(no, Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text))) for no, text in rows]
        vectors, seen = stage.write_observed(
            restricted_vectors(docs, vocabulary), f"vectors_{block}", docs="count_if(n > 0)", terms="coalesce(sum(n), 0)"
        )
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the items
            df[term] = n
        best = _search_block(vectors, counted, df, seen["docs"], max(seen["terms"], 1), k)
        found.append(stage.write(best, f"found_{block}"))
        stage.drop(f"vectors_{block}")
    schema = "no long, doc_id long, score long"
    best = stage.read(schema, *(f"found_{b}" for b in range(len(found)))) if found else stage.spark.createDataFrame([], schema)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())))
    names = broadcast_if_small(asked.select("no", "item_id"))
    return ranked.where(F.col("rank") <= k).join(names, "no").select("item_id", "rank", "doc_id", "score")


def oracle_sql(k: int = 20) -> str:
    """The query in DuckDB, which scores every document that shares a term with an item."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{term}')"
    return f"""with d as (select row_number() over () row, doc_id, {split} t from documents),
        i as (select item_id, text, unnest({split}) t from (select distinct item_id, text from benchmark)),
        q as (select item_id, text, t, count(*) c from i group by 1, 2, 3),
        n as (select count(*) filter (len(t) > 0) n, cast(sum(len(t)) as bigint) l from d),
        c as (select row, t, count(*) tf from (select row, unnest(t) t from d) where t in (select t from q) group by 1, 2),
        w as (select t, cast(floor(1000 * ln((2.0 * n + 2) / (2 * count(*) + 1))) as bigint) w from c, n group by t, n),
        s as (select item_id, text, row, doc_id, cast(sum(q.c * w * ((1000000000 * tf)
              // (1000 * tf + 12 * (75 + (25 * len(d.t) * n) // l)))) as bigint) score
              from q join w using (t) join c using (t) join d using (row), n group by 1, 2, 3, 4),
        r as (select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) r from s where score > 0)
        select item_id, cast(r as integer) "rank", doc_id, score from r where r <= {k}"""
