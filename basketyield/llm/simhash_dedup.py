"""Near-duplicates by SimHash, found through segment popcounts.

A fingerprint is cut into segments, and each segment is replaced by its
number of one bits.  Changing one bit changes one count by one, so the
Manhattan distance of two count vectors never exceeds the Hamming distance of
the fingerprints.  Vectors at a distance of ``r`` or less have a grid point
in common that is at most ``ceil(r / 2)`` steps from either; each different
fingerprint is entered at the grid points so near to it, and the join on
equal points, with the exact Hamming distance as its condition, returns every
link.  A fingerprint takes 1 + 2 * segments points for a radius of 1 or 2.

Only different fingerprints are joined: copies share one and are linked by it.
"""

from __future__ import annotations

import math
import struct
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import Stage
from .alike import PARITY_BITS, across_labels, can_be_alike, pairs_of, spokes, worth_another
from .common import batches, broadcast_if_small, free_names, hash_sample, never_broadcast
from .components import components

BITS = 64
SEGMENTS = 16
_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle of a text, A-Z in lower case; of the whole sequence if it has fewer words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(found)
    end = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    begin = np.concatenate([[0], end[:-1] + 1])
    spans = zip(begin[: max(1, len(found) - words + 1)].tolist(), end[min(words, len(found)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[i:j], seed) for i, j in spans], dtype=np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 15):  # bounded memory for very long texts
        part = hashes[start : start + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 5, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint`` (as a signed 64-bit number) of ``doc_id, text``."""

    def run(parts):
        def rows():
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    f = simhash(shingle_hashes(text.as_py(), words, seed))
                    yield doc_id, f - (1 << 64) if f >> 63 else f

        yield from batches(_FINGERPRINTS, rows())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, fingerprint long"
    )


def _moves(segments: int, steps: int) -> list[list[int]]:
    """All integer vectors at a Manhattan distance of at most ``steps`` from zero."""
    found = set()
    for places in combinations_with_replacement(range(-1, segments), steps):
        for signs in product((-1, 1), repeat=steps):
            move = [0] * segments
            for place, sign in zip(places, signs, strict=True):
                if place >= 0:
                    move[place] += sign
            found.add(tuple(move))
    return [list(m) for m in sorted(found)]


def links(distinct: DataFrame, radius: int = 2, segments: int = SEGMENTS) -> DataFrame:
    """``a, b`` (``node`` numbers, a < b) of all fingerprints at a Hamming distance of ``radius`` or less.

    ``distinct`` has ``node, fingerprint``, each fingerprint once.
    """
    width = BITS // segments
    base = width + 2 * ((radius + 1) // 2) + 1  # counts after a move, shifted to start at 0
    mask = (1 << width) - 1
    weights = [base**i for i in range(segments)]
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)  # noqa: E731  the key is mixed modulo 2^64
    centre = " + ".join(
        f"bit_count(shiftrightunsigned(fingerprint, {width * i}) & {mask}L) * ({wrap(weights[i])}L)" for i in range(segments)
    )
    steps = sorted({wrap(sum(m * w for m, w in zip(move, weights, strict=True))) for move in _moves(segments, (radius + 1) // 2)})
    points = distinct.selectExpr("node", "fingerprint", f"{centre} as point")
    points = points.select("node", "fingerprint", F.explode(F.array(*[F.expr(f"point + ({s}L)") for s in steps])).alias("point"))
    left, right = points.alias("l"), points.alias("r")
    near = (F.col("l.point") == F.col("r.point")) & (F.col("l.node") < F.col("r.node")) & (
        F.bit_count(F.col("l.fingerprint").bitwiseXOR(F.col("r.fingerprint"))) <= radius
    )
    return left.join(never_broadcast(right), near).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, radius: int = 2, segments: int = SEGMENTS, seed: int = 42) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) and ``component_id``, the smallest id reachable over links.

    Null and empty texts have no shingle and the fingerprint zero, linked like
    any other.  Repeated rows are kept; rows with a null id get the component
    of their fingerprint.  An empty table gives no rows, and other columns are
    not read.
    """
    stage = Stage(docs.sparkSession)
    prints = stage.write(fingerprints(docs, words, seed), "prints")
    distinct = stage.write(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "distinct")
    found = components(links(distinct.where("node is not null"), radius, segments), stage)
    named = (
        distinct.join(never_broadcast(found), "node", "left")
        .select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    )
    return prints.join(never_broadcast(named), "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- keeping one document of each group ---------------------------------------------

_SETS = pa.schema(
    [("id", pa.int64()), ("no_id", pa.bool_()), ("row_key", pa.int64()), ("node", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("fingerprint", pa.int64()), ("size", pa.int32()), ("parity", pa.list_(pa.int64()))]
)
#: Texts, and of their shingles the most frequent ones, that set the order of shingles; a matter of speed, not of results.
ORDER_TEXTS = 8192
ORDER_SHINGLES = 65_536
#: Unlinked texts of a shingle that are compared in pairs at once.
FEW = 256


def similarity(a: str | None, b: str | None, words: int, seed: int = 42) -> float:
    """Jaccard similarity of the word shingles of two texts; 1 if neither has any."""
    x, y = (np.unique(shingle_hashes(t, words, seed)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def parity(hashes: np.ndarray) -> np.ndarray:
    """Of each of ``PARITY_BITS`` bins, whether an odd number of the different hashes falls into it, as 64-bit numbers.

    Each hash that only one of two sets holds changes one bit, so two sets differ in
    at least as many hashes as their parities do in bits.
    """
    odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int, least: float, seed: int = 42) -> DataFrame:
    """The ``a, b`` of ``pairs`` whose texts (``node, text``) are alike enough, compared exactly."""

    def run(parts):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for part in parts:
            texts_of = zip(part.column(2), part.column(3), strict=True)  # one pair at a time, as texts may be long
            kept = pa.array([similarity(x.as_py(), y.as_py(), words, seed) >= least for x, y in texts_of], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(i).filter(kept) for i in (0, 1)], schema=schema)

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("s"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("t"))
    return pairs.join(never_broadcast(left), "a").join(never_broadcast(right), "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def prefix_length(size: int, least: float) -> int:
    """So many of the first shingles of a set hold one that any set as similar as ``least`` has among its own first ones."""
    return size - math.ceil(least * size - 1e-9) + 1 if size else 0


def _frequent_shingles(texts: DataFrame, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that many of a sample of ``node, text`` hold, and how many."""

    def run(parts):
        schema = pa.schema([("shingle", pa.int64())])
        for part in parts:
            for value in part.column(0):
                found = np.unique(shingle_hashes(value.as_py(), words, seed))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], schema=schema)

    sample = hash_sample(texts, "node", ORDER_TEXTS).dropDuplicates(["node"]).select("text")
    counted = sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 2")
    rows = counted.orderBy(F.desc("count"), "shingle").limit(ORDER_SHINGLES).toPandas()
    shingles = rows["shingle"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], rows["count"].to_numpy(dtype=np.int64)[order]


def prefix_entries(texts: DataFrame, words: int, least: float, frequent: tuple[np.ndarray, np.ndarray], seed: int) -> DataFrame:
    """``shingle, node, size, place`` of the first shingles of each of ``node, text``, the rare ones first.

    One order holds for all texts: how frequent a shingle is in the sample, then its hash.
    """
    shingles, counts = frequent

    def run(parts):
        schema = pa.schema([("shingle", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])
        for part in parts:
            for node, value in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                found = np.unique(shingle_hashes(value.as_py(), words, seed))
                if not len(found):
                    continue
                if len(shingles):
                    at = np.minimum(np.searchsorted(shingles, found), len(shingles) - 1)
                    found = found[np.lexsort((found, np.where(shingles[at] == found, counts[at], 0)))]
                n = prefix_length(len(found), least)
                columns = [found[:n].view(np.int64), np.full(n, node), np.full(n, len(found), np.int32), np.arange(n, dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    return texts.select("node", "text").mapInArrow(run, "shingle long, node long, size int, place int")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest id (a null id is larger than any).

    Two texts are linked if the similarity of their ``words``-word shingles is
    ``least`` or more, and a group is what links reach.  Fingerprints within
    ``radius`` (:func:`links`) find most of them.  All links count: with the
    shingles of every text in one order, two sets so similar share one of their
    first ``prefix_length``, so the texts of each such shingle are compared with
    the smallest of them, and then with each other unless links found so far
    join them already.  Pairs whose parities (:func:`parity`) differ in more bits
    than two sets so alike can in shingles are not.  Null texts, empty ones and those without words are
    alike, and repeated rows are copies.  All columns are kept.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    stage = Stage(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    id_name, key_name, node_name = free_names(docs, "_id", "_row_key", "_node")
    keyed = docs.withColumns(
        {
            id_name: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)),
            key_name: F.xxhash64(text, F.col("doc_id").isNull(), F.col("doc_id")),
            node_name: F.xxhash64(text),
        }
    )
    key = [id_name, key_name]

    def run(parts):
        def rows():
            for part in parts:
                ids, empty, keys, nodes = (part.column(i).to_pylist() for i in range(4))
                for i, value in enumerate(part.column(4)):
                    hashes = shingle_hashes(value.as_py(), words, seed)
                    different = np.unique(hashes)
                    digest = xxhash.xxh3_128_digest(different.tobytes())
                    f = simhash(hashes)
                    own = len(different), parity(different).tolist()
                    yield ids[i], empty[i], keys[i], nodes[i], *struct.unpack("<2q", digest), f - (1 << 64) if f >> 63 else f, *own

        yield from batches(_SETS, rows())

    entering = keyed.select(id_name, F.col("doc_id").isNull(), key_name, node_name, text)
    columns = "id long, no_id boolean, row_key long, node long, set_a long, set_b long, fingerprint long, size int, parity array<long>"
    prints = stage.write(entering.mapInArrow(run, columns), "prints")

    def only(chosen: DataFrame, name: str) -> DataFrame:
        """The rows of ``keyed`` with the chosen ``id, row_key``, each once."""
        rows = prints.groupBy("id", "row_key").agg((F.count(F.lit(1)) > 1).alias("repeated"))
        chosen = never_broadcast(chosen.withColumn("kept", F.lit(True)))
        rows = stage.write(rows.join(chosen, ["id", "row_key"], "left"), f"{name}_keys")
        as_key = lambda df: df.select(F.col("id").alias(id_name), F.col("row_key").alias(key_name))
        # the rows that go, and those kept that are there more than once, are the smaller part
        others = stage.write(as_key(rows.where("kept is null or repeated")), f"{name}_others")
        repeated = stage.write(as_key(rows.where("kept and repeated")), f"{name}_repeated")
        stage.drop(f"{name}_keys")
        once = keyed.join(broadcast_if_small(others), key, "left_anti")
        more = keyed.join(broadcast_if_small(repeated), key, "left_semi").dropDuplicates(key)
        return once.unionAll(more)

    def connected(edges: DataFrame, name: str) -> DataFrame:
        rounds = Stage(docs.sparkSession)
        found = stage.write(components(edges, rounds), name)
        rounds.drop()
        return found

    # texts with one set of shingles are alike, and one of them stands for all
    same = ["set_a", "set_b"]
    firsts = prints.groupBy(*same).agg(F.min(F.struct("node", "id", "row_key", "fingerprint", "size", "parity")).alias("k"))
    firsts = stage.write(firsts.select(*same, "k.*"), "firsts")
    equal = prints.select("node", *same).distinct().join(never_broadcast(firsts.select(F.col("node").alias("b"), *same)), same)
    found = stage.write(equal.select(F.col("node").alias("a"), "b").where("a <> b"), "equal")
    parities = firsts.select("node", "parity")
    as_text = lambda df: df.select(F.col(node_name).alias("node"), text.alias("text"))

    # candidates by fingerprint: the first of each with the others, and with the firsts of fingerprints close by
    marked = stage.write(firsts.groupBy("fingerprint").agg(F.min("node").alias("node")), "marked")
    close = firsts.join(never_broadcast(marked.withColumnRenamed("node", "a")), "fingerprint")
    close = close.where("node <> a").select("a", F.col("node").alias("b"))
    close = close.unionAll(links(marked, radius))
    # candidates by shingle: the first text of each with the others
    entries = prefix_entries(
        as_text(only(firsts.select("id", "row_key"), "set")), words, least, _frequent_shingles(as_text(keyed), words, seed), seed
    )
    entries = stage.write(entries, "entries")
    heads = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "size", "place")).alias("first"))
    shared = entries.join(never_broadcast(heads.where("n > 1").select("shingle", "first")), "shingle")
    shared = stage.write(shared.select("shingle", "node", "size", "place", "first"), "shared")
    stage.drop("entries")

    def linked(pairs: DataFrame, step: int) -> tuple[DataFrame, int]:
        """The pairs that are alike, and how many there were; texts move only if parities leave it open."""
        pairs = stage.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"pairs_{step}")
        side = lambda n: never_broadcast(firsts.select(F.col("node").alias(n), F.struct("size", "parity").alias(f"of_{n}")))
        fitting = pairs.join(side("a"), "a").join(side("b"), "b").where(can_be_alike("of_a", "of_b", least)).select("a", "b")
        fitting = stage.write(fitting, f"fitting_{step}")
        needed = stage.write(fitting.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"needed_{step}")
        alike = stage.write(similar_pairs(fitting, stage.write(texts_of(needed), f"texts_{step}"), words, least, seed), f"links_{step}")
        n = pairs.count()
        for name in ("pairs", "fitting", "needed", "texts"):
            stage.drop(f"{name}_{step}")
        return alike, n

    def texts_of(nodes: DataFrame) -> DataFrame:
        texts = as_text(keyed).join(broadcast_if_small(nodes), "node", "left_semi")
        return texts.groupBy("node").agg(F.first("text").alias("text"))

    size, first_size = F.col("size"), F.col("first.size")
    left = F.least(size - F.col("place"), first_size - F.col("first.place"))  # most that both can share from here on
    hung = shared.where(
        (F.col("node") > F.col("first.node"))
        & (F.least(size, first_size) >= F.greatest(size, first_size) * least - 1e-9)
        & (left * (1 + least) >= (size + first_size) * least - 1e-9)
    )
    alike, _ = linked(close.unionAll(hung.select(F.col("first.node").alias("a"), F.col("node").alias("b"))), 0)
    found, step, go_on, entered = found.unionAll(alike), 0, True, shared.drop("first")
    while True:
        joined = connected(found, f"joined_{step}")
        labelled = entered.join(never_broadcast(joined), "node", "left")
        labelled = labelled.select("shingle", "node", "size", "place", F.coalesce("component", "node").alias("label"))
        labelled = stage.write(labelled, f"labelled_{step}")
        still_open = labelled.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"))
        labelled = labelled.join(never_broadcast(still_open.where("low < high").select("shingle", "n")), "shingle")
        labelled = stage.write(labelled, f"open_{step}")
        for name in ("shared", f"joined_{step}", f"labelled_{step}", f"open_{step - 1}"):
            stage.drop(name)
        if not go_on:
            break
        # in rounds around hubs, as long as that joins what it compares
        step += 1
        alike, n = linked(spokes(labelled, "shingle", step, least), step)
        found, go_on, entered = found.unionAll(alike), worth_another(alike.count(), n), labelled.drop("label", "n")
    # a shingle of few texts: those in pairs; of many: their texts by the order of all their shingles
    pairs = pairs_of(labelled.where(F.col("n") <= FEW).join(never_broadcast(parities), "node"), least)
    nodes = stage.write(labelled.where(F.col("n") > FEW).select("node", "size", "label").distinct(), "open_nodes")
    hashes = lambda value: np.unique(shingle_hashes(value, words, seed))
    across = across_labels(texts_of(nodes.select("node")), nodes, hashes, least, stage, parities)
    found = connected(found.unionAll(linked(pairs.unionAll(across), step + 1)[0]), "groups")
    for name in ("open_nodes", "open_shingles", "open_first", f"open_{step}", "equal", "marked", "firsts", *(f"links_{k}" for k in range(step + 2))):
        stage.drop(name)
    grouped = prints.join(never_broadcast(found), "node", "left").select(F.coalesce("component", "node").alias("group"), "no_id", "id", "row_key")
    kept = grouped.groupBy("group").agg(F.min(F.struct("no_id", "id", "row_key")).alias("k")).select("k.id", "k.row_key")
    return only(kept, "row").select(*docs.columns)
