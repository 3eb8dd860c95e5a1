"""Pairs of sets that can be alike, of those that earlier steps have left unlinked."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stage
from .common import never_broadcast


#: Nodes of a key that meet around one of them in a round.
WHEEL = 4
#: Rounds go on while more than one in so many pairs is a link.
PRODUCTIVE = 20


#: Bins of a set's parity.
PARITY_BITS = 512


def can_be_alike(x: str, y: str, least: float) -> F.Column:
    """Whether sets with the ``size`` and ``parity`` (see ``simhash_dedup.parity``) of two aliases can have a similarity of ``least``.

    Sets so alike have at most ``(1 - least) / (1 + least)`` of the sum of their
    sizes in only one of them, and each of these changes one bit.
    """
    bits = [f"bit_count(get({x}.parity, {i}) ^ get({y}.parity, {i}))" for i in range(PARITY_BITS // 64)]
    return F.expr(f"({' + '.join(bits)}) * {1 + least}D <= ({x}.size + {y}.size) * {1 - least}D + 1e-6")


def worth_another(links: int, pairs: int) -> bool:
    """Whether a round that found so many links among so many pairs calls for another one."""
    return links * PRODUCTIVE > pairs


def spokes(labelled: DataFrame, key: str, step: int, least: float) -> DataFrame:
    """``a, b``: each node of a key with the hub of its wheel, if sizes allow and labels differ.

    ``labelled`` has ``key, node, size, label, n``, with the number of nodes of
    the key.  At step 0 a key is one wheel around its least node; later it falls
    into wheels of about ``WHEEL`` nodes, other ones each time.
    """
    turn = F.xxhash64("node", F.lit(step))
    wheel = F.pmod(turn, F.ceil(F.col("n") / F.lit(WHEEL)).cast("long")) if step else F.lit(0).cast("long")
    held = labelled.withColumns({"wheel": wheel, "turn": turn if step else F.col("node")})
    hubs = held.groupBy(key, "wheel").agg(F.min(F.struct("turn", "node", "size", "label")).alias("hub"))
    fits = F.least(F.col("size"), F.col("hub.size")) >= F.greatest(F.col("size"), F.col("hub.size")) * least - 1e-9
    met = held.join(never_broadcast(hubs), [key, "wheel"]).where((F.col("label") != F.col("hub.label")) & fits)
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))


def pairs_of(entries: DataFrame, least: float) -> DataFrame:
    """``a, b`` that share a shingle of ``shingle, node, size, label, place``, have unlike labels and can be alike.

    ``place`` is that of the shingle in its set, in an order that all sets keep;
    a pair counts if, from this shingle on, either has as much left as the
    wanted overlap, which holds for the first shingle of any two sets so alike.
    With a ``parity``, pairs for which :func:`can_be_alike` is false make no row.
    """
    x, y = entries.alias("x"), entries.alias("y")
    behind = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    meet = (
        (F.col("x.shingle") == F.col("y.shingle"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.label") != F.col("y.label"))
        & (F.least("x.size", "y.size") >= F.greatest("x.size", "y.size") * least - 1e-9)
        & (behind * (1 + least) >= (F.col("x.size") + F.col("y.size")) * least - 1e-9)
    )
    if "parity" in entries.columns:
        meet = meet & can_be_alike("x", "y", least)
    return x.join(never_broadcast(y), meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def across_labels(
    texts: DataFrame,
    nodes: DataFrame,
    hashes: Callable[[str | None], np.ndarray],
    least: float,
    stage: Stage,
    parities: DataFrame | None = None,
) -> DataFrame:
    """``a, b`` of ``nodes(node, size, label)``: all pairs with unlike labels whose sets can have a similarity of ``least``.

    ``texts`` has the ``node, text`` of each, ``hashes`` the different shingle
    hashes of a text and ``size`` their number.  In one order of all shingles,
    those of the fewest nodes first, two sets so alike share one of their first
    shingles, and from the first one that they share, either has as much left
    as the wanted overlap.  A pair may come several times.  ``parities`` has the
    ``node, parity`` of each, if known.
    Writes ``open_shingles`` and ``open_first``, which the caller drops.
    """

    def run(parts):
        for part in parts:
            for node, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = hashes(text.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], names=["node", "shingle"])

    shingles = stage.write(texts.select("node", "text").mapInArrow(run, "node long, shingle long"), "open_shingles")
    counts = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("node").orderBy("n", "shingle")  # as many rows as a text has shingles
    placed = shingles.join(never_broadcast(counts), "shingle").join(never_broadcast(nodes), "node")
    placed = placed.withColumn("place", F.row_number().over(order) - 1)
    first = placed.where((F.col("size") - F.col("place") >= F.col("size") * least - 1e-9) & (F.col("n") > 1))
    first = stage.write(first.select("shingle", "node", "size", "label", "place"), "open_first")
    return pairs_of(first if parities is None else first.join(never_broadcast(parities), "node"), least)
