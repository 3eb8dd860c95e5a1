"""Near-duplicates by b-bit MinHash signatures and a multi-index join in Hamming space.

The signature of a set of word shingles has ``CHUNKS * CHUNK`` symbols of 16
bits, each from the least shingle under one hash function, so that two symbols
are equal with about the Jaccard similarity of the sets.  The distance of two
signatures is the number of unequal symbols.

A signature is cut into ``CHUNKS`` chunks.  By the pigeonhole principle two
signatures at a distance below ``CHUNKS * (ERRORS + 1)`` have a chunk with no
more than ``ERRORS`` errors; every chunk is entered once for each choice of
``ERRORS`` symbols left out, and two such chunks have an entry in common.  So
the join on equal entries returns all pairs within that distance, and of those
beyond it all that have such a chunk: of two sets with a similarity of 0.8 it
misses one pair in nine million (:func:`missed`).  Links are confirmed on the full
sets of both texts.

Texts with one set of shingles are one class, and classes are compared.  The
classes of an entry are first compared with the least of them.  Where links
found so far leave an entry with several components, its classes are compared
across these.  Classes that are linked already are never paired, so a large
group of copies costs as many pairs as it has members.
"""

from __future__ import annotations

import functools
import itertools
import math
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import Stage
from .alike import across_labels, spokes, worth_another
from .common import broadcast_if_small, in_parts
from .components import components

CHUNKS = 12
CHUNK = 5
ERRORS = 1
#: Pairs with a signature distance that so few pairs of the wanted similarity exceed are not confirmed.
BEYOND = 1e-7
HELD_WORDS = 200_000
SEED = 42
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


def chunk_found(similarity: float) -> float:
    """The probability that a chunk has no more than ``ERRORS`` errors."""
    return sum(math.comb(CHUNK, e) * (1 - similarity) ** e * similarity ** (CHUNK - e) for e in range(ERRORS + 1))


def missed(similarity: float) -> float:
    """The probability that a pair of sets of this similarity has no entry in common."""
    return (1 - chunk_found(similarity)) ** CHUNKS


def distance_limit(similarity: float, beyond: float = BEYOND) -> int:
    """The least distance that signatures of this similarity exceed with a probability of at most ``beyond``."""
    n, tail = CHUNKS * CHUNK, 1.0
    for d in range(n + 1):
        tail -= math.comb(n, d) * (1 - similarity) ** d * similarity ** (n - d)
        if tail <= beyond:
            return d
    return n


# --- sets and signatures of texts --------------------------------------------------


class _Words(dict):
    """Word -> its hash."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word, SEED)
        if len(self) >= HELD_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_HELD = _Words()


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, words: int) -> set[tuple[bytes, ...]]:
    """The different shingles of a text; of fewer words, the whole sequence; of none, nothing."""
    found = split_words(text)
    if not found:
        return set()
    return set(zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else {tuple(found)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLY
    x = (x ^ (x >> np.uint64(29))) * _TURN
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The different hashes of the shingles, in order."""
    found = split_words(text)
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(list(map(_HELD.__getitem__, found)), dtype=np.uint64)
    span = min(words, len(h))
    total = np.full(len(h) - span + 1, span, dtype=np.uint64)
    for i in range(span):
        total = _mix(total + h[i : len(h) - span + 1 + i])
    return np.unique(total)


class Hashes:
    """The hash functions of a signature."""

    def __init__(self, n: int = CHUNKS * CHUNK, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.turn = draw.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]
        self.multiply = (draw.integers(0, 1 << 63, n, dtype=np.uint64) | np.uint64(1))[:, None]

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """One symbol for each function; zeros for an empty set."""
        if not len(hashes):
            return np.zeros(len(self.turn), dtype=np.uint16)
        least = np.full(len(self.turn), np.iinfo(np.uint64).max, dtype=np.uint64)
        for start in range(0, len(hashes), 4096):
            part = (hashes[None, start : start + 4096] ^ self.turn) * self.multiply
            least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(axis=1))
        return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def entries_of(signatures: np.ndarray) -> np.ndarray:
    """The entries of each row of signatures: for each chunk, one for each choice of symbols left out."""
    chunks = signatures.reshape(len(signatures), CHUNKS, CHUNK).astype(np.uint64)
    out = []
    for j in range(CHUNKS):
        for k, left_out in enumerate(itertools.combinations(range(CHUNK), ERRORS)):
            entry = np.full(len(signatures), j << 16 | k, dtype=np.uint64)
            for i in range(CHUNK):
                if i not in left_out:
                    entry = _mix(entry + chunks[:, j, i] + _TURN)
            out.append(entry)
    return np.stack(out, axis=1)


_PRINT = "doc_id long, text_a long, text_b long, set_a long, set_b long, n_shingles long, signature array<short>"


def signed_texts(docs: DataFrame, words: int) -> DataFrame:
    """Every row's id, keys of its text and of its shingle set, and the signature of the set."""
    hashes = Hashes()
    names = [column.split(" ")[0] for column in _PRINT.split(", ")]

    def run(parts):
        for part in parts:
            for start, texts in in_parts(list(part.column(3)), size=lambda t: len(t.as_buffer() or b"") if t.is_valid else 0, most=1 << 20):
                digests, sizes, symbols = [], [], []
                for text in texts:
                    found = shingle_hashes(text.as_py(), words)
                    digests.append(struct.unpack("<2q", xxhash.xxh3_128_digest(found.tobytes())))
                    sizes.append(len(found))
                    symbols.append(hashes.signature(found))
                a, b = np.array(digests, dtype=np.int64).T
                flat = np.concatenate(symbols).view(np.int16)
                ends = np.arange(len(texts) + 1, dtype=np.int32) * len(hashes.turn)
                own = part.slice(start, len(texts))
                columns = [pa.array(a), pa.array(b), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                yield pa.RecordBatch.from_arrays([*own.columns[:3], *columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), *_text_key(), _text()).mapInArrow(run, _PRINT)


def _text() -> F.Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _text_key() -> list[F.Column]:
    """128 bits that tell texts apart."""
    return [F.xxhash64(_text()).alias("text_a"), F.xxhash64(F.lit(SEED), _text()).alias("text_b")]


# --- links ------------------------------------------------------------------------------


def entries(classes: DataFrame) -> DataFrame:
    """``entry, node, size``: all entries of the signatures of ``node, n_shingles, signature``."""

    def run(parts):
        for part in parts:
            for start in range(0, part.num_rows, 2048):
                own = part.slice(start, 2048)
                flat = own.column(2).flatten().to_numpy().view(np.uint16)
                found = entries_of(flat.reshape(own.num_rows, CHUNKS * CHUNK))
                per = found.shape[1]
                columns = [
                    pa.array(found.reshape(-1).view(np.int64)),
                    pa.array(np.repeat(own.column(0).to_numpy(), per)),
                    pa.array(np.repeat(own.column(1).to_numpy().astype(np.int32), per)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["entry", "node", "size"])

    return classes.select("node", "n_shingles", "signature").mapInArrow(run, "entry long, node long, size int")


class _Confirm:
    """Confirms pairs of classes on the full sets of their texts."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, percent: int, stage: Stage):
        self.docs, self.classes, self.words, self.percent, self.stage = docs, classes, words, percent, stage

    def texts(self, needed: DataFrame) -> DataFrame:
        """``needed``, with different ``text_a, text_b``, and the ``text`` of each."""
        keys = needed.select("text_a", "text_b")
        rows = self.docs.select(*_text_key(), _text().alias("text")).join(broadcast_if_small(keys), ["text_a", "text_b"], "left_semi")
        return rows.dropDuplicates(["text_a", "text_b"]).join(needed, ["text_a", "text_b"])

    def links(self, pairs: DataFrame, step: int) -> DataFrame:
        """The ``a, b`` of ``pairs`` that are alike, each once."""
        stage, classes = self.stage, self.classes
        side = lambda n: classes.select(
            F.col("node").alias(n), F.col("signature").alias(f"signature_{n}"), F.col("text_a").alias(f"{n}_a"), F.col("text_b").alias(f"{n}_b")
        )
        unequal = "size(filter(zip_with(signature_a, signature_b, (x, y) -> x <> y), x -> x))"
        near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.expr(f"{unequal} <= {distance_limit(self.percent / 100)}"))
        near = stage.write(near.select("a", "b", "a_a", "a_b", "b_a", "b_b"), f"near_{step}")
        keys = "array(struct(a_a as text_a, a_b as text_b), struct(b_a as text_a, b_b as text_b))"
        needed = near.select(F.explode(F.expr(keys)).alias("t")).select("t.*").distinct()
        texts = stage.write(self.texts(stage.write(needed, f"needed_{step}")), f"texts_{step}")
        of = lambda n: texts.select(F.col("text_a").alias(f"{n}_a"), F.col("text_b").alias(f"{n}_b"), F.col("text").alias(f"text_of_{n}"))
        both = near.join(of("a"), ["a_a", "a_b"]).join(of("b"), ["b_a", "b_b"]).select("a", "b", "text_of_a", "text_of_b")
        words, percent = self.words, self.percent

        def run(parts):
            last, held = None, set()
            for part in parts:
                a, b = (part.column(i).to_numpy() for i in range(2))
                alike = np.zeros(part.num_rows, dtype=bool)
                for i in range(part.num_rows):
                    if a[i] != last:
                        last, held = a[i], shingle_set(part.column(2)[i].as_py(), words)
                    other = shingle_set(part.column(3)[i].as_py(), words)
                    common = len(held & other)
                    alike[i] = 100 * common >= percent * (len(held) + len(other) - common)
                yield pa.RecordBatch.from_arrays([pa.array(a[alike]), pa.array(b[alike])], names=["a", "b"])

        found = stage.write(both.mapInArrow(run, "a long, b long"), f"links_{step}")
        for name in (f"near_{step}", f"needed_{step}", f"texts_{step}"):
            stage.drop(name)
        return found


def class_links(docs: DataFrame, classes: DataFrame, words: int, percent: int, stage: Stage) -> DataFrame:
    """``a, b``: links that connect all classes (``node, n_shingles, signature, text_a, text_b``) as all of their links do."""
    confirm = _Confirm(docs, classes, words, percent, stage)
    entered = entries(classes)
    several = entered.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage.write(entered.join(several.select("entry"), "entry"), "shared")
    labelled = stage.write(shared.withColumn("label", F.col("node")), "open_0")
    links, step, go_on = [], 0, True
    while True:
        open_entries = labelled.groupBy("entry").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")
        ).where("low < high")
        labelled = stage.write(labelled.join(open_entries.select("entry", "n"), "entry"), f"open_{step}_all")
        if not go_on:
            break
        pairs = stage.write(spokes(labelled, "entry", step, percent / 100).distinct(), f"spokes_{step}")
        links.append(confirm.links(pairs, step))
        # on with rounds as long as they join what they compare; whatever they leave is compared in full
        go_on = worth_another(links[-1].count(), pairs.count())
        rounds = Stage(stage.spark)
        joined = components(functools.reduce(DataFrame.unionAll, links), rounds)
        labelled = labelled.select("entry", "node", "size").join(joined, "node", "left")
        labelled = labelled.select("entry", "node", "size", F.coalesce("component", "node").alias("label"))
        step += 1
        labelled = stage.write(labelled, f"open_{step}")
        rounds.drop()
        for name in (f"spokes_{step - 1}", f"open_{step - 1}", f"open_{step - 1}_all", "shared"):
            stage.drop(name)
    nodes = stage.write(labelled.select("node", "size", "label").distinct(), "open_nodes")
    texts = confirm.texts(classes.join(nodes.select("node"), "node", "left_semi").select("node", "text_a", "text_b"))
    across = across_labels(texts.select("node", "text"), nodes, lambda text: shingle_hashes(text, words), percent / 100, stage)
    links.append(confirm.links(across.distinct(), step))
    for name in ("open_nodes", "open_shingles", "open_first", f"open_{step}", f"open_{step}_all"):
        stage.drop(name)
    return functools.reduce(DataFrame.unionAll, links)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Documents are linked if their sets of ``words``-word shingles have at least
    ``percent`` hundredths of their union in common.  ``component_id`` is the
    smallest id that links reach, and ``kept`` says that it is the row's own.

    Texts of fewer words have one shingle, their whole sequence.  Null texts and
    those without words have none; they are linked with nothing and keep their
    own id.  Repeated rows are copies.  Rows with a null id get the component of
    their links (null if nothing in it has an id) and are not kept.  An empty
    table gives no rows, and other columns are not read.
    """
    stage = Stage(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    prints = stage.write(signed_texts(docs, words), "prints")
    same = ["set_a", "set_b"]
    classes = prints.where("n_shingles > 0").groupBy(*same).agg(
        F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"),
        F.min(F.struct("text_a", "text_b")).alias("t"),
    )
    classes = classes.select(*same, "first_id", "n_shingles", "signature", "t.*", F.monotonically_increasing_id().alias("node"))
    classes = stage.write(classes, "classes")
    links = class_links(docs, classes, words, percent, stage)
    rounds = Stage(stage.spark)
    grouped = classes.join(components(links, rounds), "node", "left").select(*same, "first_id", F.coalesce("component", "node").alias("label"))
    named = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = stage.write(grouped.join(named, "label").select(*same, "component_id"), "named")
    rounds.drop()
    stage.drop("classes")
    out = prints.select("doc_id", "n_shingles", *same).join(named, same, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def oracle_sql(percent: int = 80) -> str:
    """The query with word pairs in DuckDB, where all pairs with a common shingle are counted."""
    white = r"[^\x20\x09-\x0D]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{white}') w
        from documents),
        s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w
              else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end s from w),
        c as (select s, min(doc_id) node, len(s) n from (select doc_id, list_sort(s) s from s) where len(s) > 0 group by 1),
        e as (select node, n, hash(unnest(s)) x from c),
        p as (select a.node a, b.node b from e a join e b on a.x = b.x and a.node < b.node
              and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * {percent}
              group by a.node, b.node, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        l as (select a, b from p union all select b, a from p),
        r(node, reached) as (select node, node from c union select r.node, l.b from r join l on r.reached = l.a),
        m as (select node, min(reached) component from r group by 1),
        d as (select s.doc_id, len(s.s) n, coalesce(m.component, s.doc_id) component_id
              from s left join c on list_sort(s.s) = c.s left join m using (node))
        select doc_id, n n_shingles, component_id, doc_id = component_id kept from d"""
