"""Quality by importance resampling.

Two generative models of hashed n-grams, one of target text (documents
labelled good) and one of all raw text, are counted into ``BUCKETS`` buckets
each.  A document's log weight is the sum of log(target / raw) over its
n-grams.  N-grams are words, word pairs, and pairs of word shapes (case,
punctuation, digits) with a mark on a repeated word.

``resample`` draws documents without replacement in proportion to their
weights: the ``k`` largest of log weight + Gumbel noise, where the noise
comes from a hash of the id, so that a repeated task draws the same.  As a
classifier, a logistic curve through labelled documents turns the mean log
ratio into the probability of good text; those below ``THRESHOLD`` are rejected.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from ..stage import Stage
from .common import TRAIN_ROWS, distinct_texts, in_parts, labelled_sample, logistic_1d, schema_with, with_labels

BUCKETS = 1 << 16
THRESHOLD = 0.5
#: Weight of the raw model in the target model, in n-grams.
PRIOR = 50_000.0
#: Mean ratios of short texts are drawn to zero by so many n-grams.
SHRINK = 20.0
HELD_WORDS = 200_000
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_COUNTS = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])


def shape(word: str) -> str:
    """Upper, capital or lower letters, digits, and other characters as they are (three at most)."""
    letters = "A" if word.isupper() and len(word) > 1 else "C" if word[:1].isupper() else "a"
    stem = word.rstrip(string.punctuation)
    if stem.isalpha():  # most words: one run of letters, which needs no pattern
        return (letters + word[len(stem) :])[:4]
    return _DIGITS.sub("9", _LETTERS.sub(letters, word))[:4]


class _Words(dict):
    """Word -> its hash (32 bits) and the hash of its shape (16 bits) in one number."""

    def __missing__(self, word: str) -> int:
        w = xxhash.xxh32_intdigest(word.lower().encode())
        value = w << 16 | xxhash.xxh32_intdigest(shape(word).encode()) & 0xFFFF
        if len(self) >= HELD_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_HELD = _Words()


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, and where each text's end."""
    values, ends = [], []
    for text in texts:
        values.extend(map(_HELD.__getitem__, (text or "").split()))
        ends.append(len(values))
    v = np.array(values, dtype=np.uint64)
    ends = np.array(ends, dtype=np.int64)
    word, form = v >> np.uint64(16), v & np.uint64(0xFFFF)
    first = np.zeros(len(v) + 1, dtype=bool)
    first[0] = True
    first[ends] = True
    before = np.where(first[:-1], np.uint64(1 << 40), np.roll(word, 1))
    form_before = np.where(first[:-1], np.uint64(1 << 17), np.roll(form, 1))
    again = (before == word).astype(np.uint64)
    grams = np.stack(
        [
            _mix(word, 1),
            _mix(word * np.uint64(0x9E3779B97F4A7C15) ^ before, 2),
            _mix((form << np.uint64(20)) ^ (form_before << np.uint64(1)) ^ again, 3),
        ],
        axis=1,
    )
    return grams.reshape(-1), 3 * ends


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A bucket for every number (multiply and shift, twice)."""
    x = (x + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


@dataclass
class Model:
    log_ratio: np.ndarray
    slope: float
    intercept: float

    def weights(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log weight of every text, and its mean log ratio."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for start, part in in_parts(texts, size=lambda t: len(t or ""), most=1 << 20):
            grams, ends = ngram_buckets(part)
            sums = np.concatenate([[0.0], np.cumsum(self.log_ratio[grams])])
            edge = np.concatenate([[0], ends])
            total[start : start + len(part)] = sums[edge[1:]] - sums[edge[:-1]]
            n[start : start + len(part)] = np.diff(edge)
        return total, total / (n + SHRINK)

    def probability(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * mean + self.intercept, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, where: str = "true", max_rows: int = TRAIN_ROWS) -> Model:
    """Count the raw model over all documents and the target model over those labelled good.

    The target and the curve use about ``max_rows`` labelled rows at most, one
    of each different text.  Without labels every document is accepted.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sample = distinct_texts(docs, labelled_sample(labels, "quality", max_rows, where)).cache()
    try:
        marked = with_labels(docs, sample, "left").select("text", F.col("label").eqNullSafe(1).alias("target"))
        counted = _bucket_counts(marked).toPandas()  # at most BUCKETS rows
        target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
        target[counted["bucket"]], raw[counted["bucket"]] = counted["target"], counted["raw"]
        if not target.any():
            return Model(np.zeros(BUCKETS), 0.0, 20.0)
        p_raw = (raw + 0.5) / (raw.sum() + 0.5 * BUCKETS)
        p_target = (target + PRIOR * p_raw) / (target.sum() + PRIOR)
        model = Model(np.log(p_target / p_raw), 0.0, 0.0)
        model.slope, model.intercept = _calibrate(with_labels(docs, sample, "inner"), model)
        return model
    finally:
        sample.unpersist()


def _bucket_counts(marked: DataFrame) -> DataFrame:
    def run(parts):
        target, raw = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for part in parts:
            texts, is_target = part.column(0).to_pylist(), part.column(1).to_numpy(zero_copy_only=False)
            for start, held in in_parts(texts, size=lambda t: len(t or ""), most=1 << 20):
                grams, ends = ngram_buckets(held)
                raw += np.bincount(grams, minlength=BUCKETS)
                own = np.repeat(is_target[start : start + len(held)].astype(bool), np.diff(ends, prepend=0))
                target += np.bincount(grams[own], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(target[used], pa.int64()), pa.array(raw[used], pa.int64())], schema=_COUNTS
        )

    partial = marked.mapInArrow(run, "bucket int, target long, raw long")
    return partial.groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def _calibrate(labelled: DataFrame, model: Model) -> tuple[float, float]:
    schema = pa.schema([("label", pa.int32()), ("x", pa.float64())])

    def run(parts):
        for part in parts:
            _, mean = model.weights(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(np.clip(mean, -20, 20), 2))], schema=schema)

    bins = labelled.select("label", "text").mapInArrow(run, "label int, x double").groupBy("x", "label").count().toPandas()
    return logistic_1d(bins["x"].to_numpy(dtype=float), bins["label"].to_numpy(dtype=float), bins["count"].to_numpy(dtype=float), ridge=1e-2)


def score(docs: DataFrame, model: Model, names: tuple[str, str] = ("log_weight", "quality_score")) -> DataFrame:
    """All columns of ``docs``, with ``log_weight`` and ``quality_score`` (0 to 1).

    Columns of these names are replaced; ``names`` gives others.
    A null or empty text has the weight 0 and the score of an even ratio.
    """
    docs = docs.drop(*names)
    at = docs.columns.index("text")

    def run(parts):
        for part in parts:
            weight, mean = model.weights(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(weight), pa.array(model.probability(mean))], names=[*part.schema.names, *names]
            )

    return docs.mapInArrow(run, schema_with(docs, **{names[0]: "double", names[1]: "double"}))


def resample(scored: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Add ``gumbel_key`` and ``selected``: the largest ``fraction`` of the rows by log weight + Gumbel noise.

    ``scored`` has ``doc_id`` and ``log_weight``.  Equal keys are taken in order
    of id; repeated rows draw the same noise.  The rows are written before the
    range sort, which reads them twice, so that ``scored`` is worked out once.
    """
    stage = Stage(scored.sparkSession)
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = scored.withColumn("gumbel_key", F.col("log_weight") - F.ln(-F.ln(uniform)))
    placed = global_row_number(stage.write(keyed, "keyed"), [F.col("gumbel_key").desc(), F.col("doc_id")], "_place", stage)
    stage.drop("keyed")
    ranked = stage.write(placed, "ranked")
    stage.drop("ranged__place")
    k = math.ceil(fraction * ranked.count())
    return ranked.withColumn("selected", F.col("_place") <= k).drop("_place")
