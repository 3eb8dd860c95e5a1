"""Small helpers that the operators share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that a classifier is fitted on, about; beyond it a hash of the id picks them.
TRAIN_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches(schema: pa.Schema, rows: Iterable[tuple], max_rows: int = 4096, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from tuples; a bytes or str value counts with its length."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= max_rows or size >= max_bytes:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def schema_with(df: DataFrame, **columns: str) -> T.StructType:
    """The schema of a frame with further columns, given as DDL types."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, T.DataType.fromDDL(kind))
    return schema


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that a column of the frame has (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def in_parts(values: list, size=len, most: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """Slices of a list, with their start, that hold about ``most`` units each (one value may exceed it)."""
    start, held = 0, 0
    for i, value in enumerate(values):
        held += size(value)
        if held >= most:
            yield start, values[start : i + 1]
            start, held = i + 1, 0
    if start < len(values):
        yield start, values[start:]


def hash_sample(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """About ``rows`` rows, those whose keys hash lowest; all of them if there are no more.

    Rows are counted first and then taken by a threshold, so that nothing but
    the sample leaves the executors, however many tasks there are.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * rows / n))


#: Whole texts pass through Python in batches of at most so many rows, and of about so many bytes.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20
_UNITS = {unit: 1 << 10 * k for k, unit in enumerate("bkmgtp")}


def _bytes(value: str) -> int:
    """A size as Spark's settings give it, such as ``64m``."""
    number, unit = re.fullmatch(r"(-?[0-9]+)([bkmgtp]?)(?:i?b)?", value.strip().lower()).groups()
    return int(number) * _UNITS[unit or "b"]


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``, if they are larger.

    A batch is held several times, by the executor and by its Python worker. One
    row may exceed the bytes.
    """
    rows, size = (f"spark.sql.execution.arrow.{name}" for name in ("maxRecordsPerBatch", "maxBytesPerBatch"))
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if not 0 < _bytes(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, BATCH_BYTES)


#: Key rows (of one or two numbers) that every task may hold.
SMALL_KEYS = 200_000


def broadcast_if_small(keys: DataFrame) -> DataFrame:
    """A written table of keys with a broadcast hint if it has been counted to be small; else the join shuffles."""
    return F.broadcast(keys) if keys.count() <= SMALL_KEYS else never_broadcast(keys)


def never_broadcast(side: DataFrame) -> DataFrame:
    """A side whose join shuffles and sorts, however small Spark takes it to be.

    Spark sizes a table by its files, which hold ids and hashes packed, takes an
    array for one element, and counts a row that is exploded once.  A broadcast
    goes through the driver in full.
    """
    return side.hint("merge")


def labelled_sample(labels: DataFrame, column: str, max_rows: int = TRAIN_ROWS, where: str = "true") -> DataFrame:
    """``doc_id`` and the 0/1 label of about ``max_rows`` rows at most, chosen by a hash of the id.

    Rows without id or label are left out; an id with both labels keeps the larger one.
    """
    kept = (
        labels.where(where)
        .where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(F.col(column)).cast("int").alias("label"))
    )
    return hash_sample(kept, "doc_id", max_rows)


def with_labels(docs: DataFrame, sample: DataFrame, how: str) -> DataFrame:
    """Join a bounded label sample; it is small enough for every task to hold."""
    return docs.join(F.broadcast(sample), "doc_id", how)


def logistic_1d(x: np.ndarray, label: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic regression on one feature (Newton steps, slope >= 0)."""
    if weight.sum() <= 0:
        return 0.0, -20.0
    at = np.array([0.0, float(np.log((weight @ label + 0.5) / (weight @ (1 - label) + 0.5)))])

    def loss(p: np.ndarray) -> float:
        z = p[0] * x + p[1]
        return float(weight @ (np.logaddexp(0, z) - label * z) + ridge * p[0] ** 2 / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -500, 500)))
        r, v = weight * (label - p), weight * p * (1 - p)
        grad = np.array([r @ x - ridge * at[0], r.sum()])
        hess = np.array([[v @ (x * x) + ridge, v @ x], [v @ x, v.sum() + 1e-9]])
        step, now = np.linalg.solve(hess, grad), loss(at)
        while loss(at + step) > now and np.abs(step).max() > 1e-10:
            step = step / 2
        at = at + step
        if np.abs(step).max() < 1e-9:
            break
    a, b = float(at[0]), float(at[1])
    return max(a, 0.0), b


def distinct_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The part of a label sample with one document of each different text, each id once.

    Equal texts with unequal labels keep one document of each label.
    """
    hashed = with_labels(docs.select("doc_id", F.xxhash64("text").alias("h")), sample, "inner")
    one = hashed.groupBy("h", "label").agg(F.min("doc_id").alias("doc_id"))
    return one.groupBy("doc_id").agg(F.max("label").alias("label"))
