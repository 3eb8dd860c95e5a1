"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the largest inner product.  A coordinate that fills each vector up
to the largest norm turns it into nearness of directions, for which the trees
are built: every node splits at the median along the line between two random
points of its part.  The forest is fitted on about ``SAMPLE_ROWS`` rows, those
whose ids hash lowest; every row is then sent down every tree.

A query opens the nodes of all trees from one priority queue, the least
violated boundary first, until it has visited ``probes`` leaves that hold rows,
and at least ``k`` other rows.  A small table has shallower trees, so that a
leaf holds about ``LEAF_ROWS``.  Each different query vector is asked once.
It meets the rows of its leaves in a join on (tree, leaf, blocks): a leaf with
many rows is cut into blocks of about ``BLOCK_ROWS``, and one that many ask into
blocks of about ``ASKED_ROWS`` query vectors.  Each pair of blocks gives the
nearest rows by exact inner product in double precision.

Vectors that are null, zero or hold null or non-finite components take no part,
nor do those of another than the most frequent length (the smaller of equally
frequent ones), nor rows with a null id.  Ties go to the smaller id.  Repeated
rows count once.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stage
from .common import hash_sample

TREES = 8
DEPTH = 7
PROBES = 144
SAMPLE_ROWS = 8192
LEAF_ROWS = 16
BLOCK_ROWS = 4096
ASKED_ROWS = 2048


def depth_for(rows: int, most: int = DEPTH) -> int:
    """Levels of a tree over so many rows: no leaf is meant to hold less than ``LEAF_ROWS``."""
    return max(0, min(most, (rows // LEAF_ROWS).bit_length() - 1))


@dataclass
class Forest:
    """Nodes of a complete binary tree in heap order: children of i are 2i + 1 and 2i + 2."""

    direction: np.ndarray  # trees, nodes, dimensions
    split: np.ndarray  # trees, nodes
    depth: int
    norm: float

    @classmethod
    def fit(cls, sample: np.ndarray, norm: float, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        points = filled(sample, norm)
        nodes = (1 << depth) - 1
        direction = np.zeros((trees, nodes, points.shape[1]))
        split = np.zeros((trees, nodes))
        for tree in range(trees):
            parts = {0: np.arange(len(points))}
            for node in range(nodes):
                part = parts.pop(node)
                line = rng.normal(size=points.shape[1])
                if len(part) > 1:
                    a, b = points[rng.choice(part, 2, replace=False)]
                    line = a - b if np.abs(a - b).max() > 1e-12 else line
                line /= np.linalg.norm(line)
                height = points[part] @ line
                at = float(np.median(height)) if len(part) else 0.0
                direction[tree, node], split[tree, node] = line, at
                parts[2 * node + 1], parts[2 * node + 2] = part[height <= at], part[height > at]
        return cls(direction, split, depth, norm)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of every vector in every tree (rows, trees)."""
        points = filled(vectors, self.norm)
        out = np.zeros((len(points), len(self.split)), dtype=np.int32)
        for tree in range(len(self.split)):
            margin = points @ self.direction[tree].T - self.split[tree]
            node, row = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
            for _ in range(self.depth):
                node = 2 * node + 1 + (margin[row, node] > 0)
            out[:, tree] = node - ((1 << self.depth) - 1)
        return out

    def search(self, query: np.ndarray, probes: int, held: np.ndarray | None = None, need: int = 0) -> list[tuple[int, int]]:
        """(tree, leaf) in the order in which the queue shared by all trees reaches them.

        With the number of rows ``held`` by each leaf of each tree, empty ones
        are passed over, and the search goes on until one tree has met ``need`` rows.
        """
        point = np.append(query / np.linalg.norm(query) * self.norm, 0.0)
        margins = (self.direction @ point - self.split).tolist()
        inner, found = (1 << self.depth) - 1, []
        queue = [(-math.inf, tree, 0) for tree in range(len(margins))]
        heapq.heapify(queue)
        met = [0] * len(margins)
        while queue and (len(found) < probes or held is not None and max(met) < need):
            crossed, tree, node = heapq.heappop(queue)
            if node >= inner:
                if held is not None:
                    if not held[tree, node - inner]:
                        continue
                    met[tree] += int(held[tree, node - inner])
                found.append((tree, node - inner))
                continue
            margin = margins[tree][node]
            heapq.heappush(queue, (max(crossed, margin), tree, 2 * node + 1))
            heapq.heappush(queue, (max(crossed, -margin), tree, 2 * node + 2))
        return found


def filled(vectors: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    return np.column_stack([vectors, rest])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(table: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
        " and exists(v, x -> x <> 0)"
    )
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["d"] if sizes else 0)).dropDuplicates(["vec_id", "v"])


def nearest(
    table: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, trees: int = TREES, depth: int = DEPTH, probes: int = PROBES
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each query row, itself left out.

    ``queries`` is a condition on ``vec_id``.  All candidates, if there are fewer
    than ``k``; a query without others gives no rows, nor does an empty table.
    """
    stage = Stage(table.sparkSession)
    rows = stage.write(usable(table), "vectors")
    sample = hash_sample(rows, "vec_id", SAMPLE_ROWS).toPandas().sort_values("vec_id", kind="stable")
    if sample.empty:
        return rows.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "double(0) as score").where("false")
    norm, n_rows = rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count(F.lit(1))).first()
    most = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0]  # different vectors of one id
    depth = depth_for(n_rows, depth)
    forest = Forest.fit(np.array(sample["v"].tolist(), dtype=np.float64), norm, trees, depth)

    def route(parts):
        for part in parts:
            leaves = forest.leaves(_matrix(part.column(1)))
            keys = (leaves + (np.arange(trees) << depth)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * trees, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*part.columns, listed], names=["vec_id", "v", "leaves"])

    def per_leaf(table: DataFrame) -> np.ndarray:
        counts = np.zeros(trees << depth, dtype=np.int64)
        for leaf, n in table.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():  # one row for each leaf of the forest
            counts[leaf] = n
        return counts

    index = stage.write(rows.mapInArrow(route, "vec_id long, v array<double>, leaves array<int>"), "index")
    held = per_leaf(index)
    held_by_tree = held.reshape(trees, -1)

    def visit(parts):
        for part in parts:
            vectors = _matrix(part.column(1))
            found = [[(t << depth) + leaf for t, leaf in forest.search(q, probes, held_by_tree, (k + 1) * most)] for q in vectors]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["query", "q", "leaves"]
            )

    asking = rows.where(queries).select(F.col("vec_id").alias("query_id"), "v")
    vectors = stage.write(asking.select("v").distinct().select(F.monotonically_increasing_id().alias("query"), "v"), "asked_vectors")
    names = asking.join(vectors, "v").select("query_id", "query")
    asked = stage.write(vectors.mapInArrow(visit, "query long, q array<double>, leaves array<int>"), "asked")
    blocks = lambda counts, size: F.get(F.lit(np.maximum(1, -(-counts // size)).tolist()).cast("array<int>"), F.col("leaf"))
    n_blocks, n_parts = blocks(held, BLOCK_ROWS), blocks(per_leaf(asked), ASKED_ROWS)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    entries = (
        index.select("vec_id", "v", F.explode("leaves").alias("leaf"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), n_blocks).cast("int"))
        .withColumn("part", every(n_parts))
    )
    asked = (
        asked.select("query", "q", F.explode("leaves").alias("leaf"))
        .withColumn("part", F.pmod(F.xxhash64("query"), n_parts).cast("int"))
        .withColumn("block", every(n_blocks))
    )
    best = (
        asked.groupBy("leaf", "block", "part")
        .cogroup(entries.groupBy("leaf", "block", "part"))
        .applyInArrow(_rerank((k + 1) * most), "query long, vec_id long, score double")
    )
    # trees find the same rows; one more than k, as a query may find itself
    order = lambda name: Window.partitionBy(name).orderBy(F.desc("score"), "vec_id")
    first = lambda table, name, n: (
        table.groupBy(name, "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order(name))).where(F.col("rank") <= n)
    )
    others = first(best, "query", k + 1).join(names, "query").where("query_id <> vec_id")
    return first(others, "query_id", k).select("query_id", "rank", "vec_id", "score")


def _rerank(k: int):
    schema = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(asked: pa.Table, entries: pa.Table) -> pa.Table:
        if not asked.num_rows or not entries.num_rows:
            return schema.empty_table()
        ids = entries.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], _matrix(entries.column("v"))[order]
        names, queries = asked.column("query").to_numpy(), _matrix(asked.column("q"))
        out = [[], [], []]
        for start in range(0, len(names), 256):
            rough = queries[start : start + 256] @ vectors.T
            kth = np.partition(rough, -min(k, rough.shape[1]), axis=1)[:, -min(k, rough.shape[1])]
            for i, name in enumerate(names[start : start + 256]):
                near = np.flatnonzero(rough[i] >= kth[i] - 1e-9 * max(1.0, abs(kth[i])))
                # one way to add, so that a pair has one score in every tree
                score = (vectors[near] * queries[start + i]).sum(axis=1)
                top = np.lexsort((ids[near], -score))[:k]
                out[0].append(np.full(len(top), name))
                out[1].append(ids[near][top])
                out[2].append(score[top])
        return pa.table([np.concatenate(o) for o in out], schema=schema)

    return run
