"""SimHash fingerprints of documents, in DataFrame operations only.

A term is a word with the word after it (the last one alone), as often as it
occurs; its 64-bit hash votes on every bit, for it or against it.  Votes of
two bits are counted in the halves of one number, which is exact below 2^31
terms.  A bit of the fingerprint is one where more than half of the votes are.

Fingerprints within a Hamming radius are found by permuted block tables: cut
into ``blocks`` blocks, two fingerprints that differ in at most ``radius``
bits agree in at least ``blocks - radius`` blocks, so in one of the tables
keyed by that many blocks they meet.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from ..stage import Stage

_HALVES = 0x0000000100000001
_SPACE = r"[\\x20\\x09-\\x0D]+"


def fingerprint_of(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fingerprint`` (signed 64-bit) of texts; rows of equal keys are one text.

    A null text, or one without words, has the fingerprint 0.
    """
    words = texts.select(*keys, F.expr(f"filter(split({text}, '{_SPACE}'), w -> w <> '')").alias("_words"))
    hashes = words.select(*keys, F.explode_outer(F.expr("transform(_words, (w, i) -> xxhash64(w, get(_words, i + 1)))")).alias("_term"))
    votes = hashes.groupBy(*keys).agg(
        F.count("_term").alias("_n"),
        *[F.sum(F.expr(f"shiftrightunsigned(_term, {i}) & {_HALVES}L")).alias(f"_v{i}") for i in range(32)],
    )
    low = [f"if(2 * (_v{i} & 4294967295L) > _n, {1 << i}L, 0L)" for i in range(32)]
    high = [f"if(2 * shiftrightunsigned(_v{i}, 32) > _n, shiftleft(1L, {32 + i}), 0L)" for i in range(32)]
    return votes.select(*keys, F.expr(f"coalesce({' | '.join(low + high)}, 0L)").alias("fingerprint"))


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``a, b`` with a < b: all pairs of different ``fingerprint`` values within the radius, each once."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [
        f"(shiftrightunsigned(fingerprint, {lo}) & {(1 << (hi - lo)) - 1}L)" for lo, hi in zip(edges[:-1], edges[1:], strict=True)
    ]
    keys = [f"xxhash64({', '.join([str(t), *(part[i] for i in chosen)])})" for t, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    entries = prints.select("fingerprint").distinct().selectExpr("fingerprint", f"explode(array({', '.join(keys)})) as k")
    left, right = entries.alias("l"), entries.alias("r")
    near = (F.col("l.k") == F.col("r.k")) & (F.col("l.fingerprint") < F.col("r.fingerprint")) & (
        F.bit_count(F.col("l.fingerprint").bitwiseXOR(F.col("r.fingerprint"))) <= radius
    )
    return left.join(right, near).select(F.col("l.fingerprint").alias("a"), F.col("r.fingerprint").alias("b")).distinct()


def likeness(a: str, b: str) -> F.Column:
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def _hex(name: str) -> F.Column:
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def edit_study(docs: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has the start of the next document (descending id, after
    the last the first) in place of its last third.  Returns ``doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``
    and ``n_within``, the number of other fingerprints within the radius.

    Null texts are empty; rows that share an id follow each other by a hash of
    their text, a null id comes last, and rows with equal id and text count
    once.  A single document is its own next one.  Other columns are not read.
    """
    stage = Stage(docs.sparkSession)
    # a row is known by its id (0 for null) and a hash of its text and whether the id is null
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text, F.col("doc_id").isNull()).alias("h"),
        F.col("doc_id").isNull().alias("no_id"),
        text.alias("text"),
    )
    key = ["id", "h"]
    # dealt by the key once: both joins and the votes find their rows in place
    texts = base.select(*key, "text").repartition(*key).groupBy(*key).agg(F.first("text").alias("text"))
    sizes = base.select(*key, "no_id", F.char_length("text").alias("n_chars")).distinct()
    order = [F.col("no_id"), F.col("id").desc(), F.col("h")]
    ranked = stage.write(global_row_number(sizes, order, "place", stage), "ranked")
    n = ranked.count()
    following = ranked.select(
        F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.when(F.col("place") == 1, n).otherwise(F.col("place") - 1).alias("place")
    )
    pairs = stage.write(ranked.join(following, "place").drop("place"), "pairs")

    asked = pairs.select(F.col("next_id").alias("id"), F.col("next_h").alias("h"), F.col("id").alias("for_id"), F.col("h").alias("for_h"), "n_chars")
    given = texts.join(asked, key).select(
        F.col("for_id").alias("id"), F.col("for_h").alias("h"), "n_chars", F.expr("left(text, n_chars div 3)").alias("given")
    )
    edited = texts.join(given, key).select(
        *key, "text", F.expr("concat(left(text, n_chars - n_chars div 3), given)").alias("edited")
    )
    both = edited.select(
        *key,
        F.explode(
            F.array(
                F.struct(F.lit(False).alias("edited"), F.col("text").alias("text")),
                F.struct(F.lit(True).alias("edited"), F.col("edited").alias("text")),
            )
        ).alias("v"),
    )
    # the sum of a text goes on with its votes, so that texts are moved only once
    kinds = both.select(*key, "v.edited", "v.text")
    kinds = kinds.withColumn("sha", F.when(F.col("edited"), F.sha2(F.col("text").cast("binary"), 256)))
    prints = stage.write(fingerprint_of(kinds, [*key, "edited", "sha"]), "prints")
    own = prints.where("not edited").select(*key, "fingerprint")
    changed = prints.where("edited").select(
        *key, F.col("fingerprint").alias("edited_fingerprint"), F.col("sha").alias("edited_sha256")
    )
    after = own.select(F.col("id").alias("next_id"), F.col("h").alias("next_h"), F.col("fingerprint").alias("next_fingerprint"))
    near = near_fingerprints(own, radius, blocks)
    within = near.select(F.explode(F.array("a", "b")).alias("fingerprint")).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_within"))
    rows = pairs.join(own, key).join(changed, key).join(after, ["next_id", "next_h"])
    return rows.join(within, "fingerprint", "left").select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        _hex("fingerprint").alias("fingerprint"),
        _hex("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
        F.coalesce("n_within", F.lit(0)).cast("long").alias("n_within"),
    )
