"""Token ids of documents in Huffman-coded files.

A token file is a folder with two Parquet tables, so that any store Spark
can reach may hold it and a repeated task leaves no half-written part:

``code``    ``id, bits``: the code length of every id that occurs.  The canonical
            code follows from the lengths.
``blocks``  ``shard, block, first_token, n_tokens, doc_ids, doc_tokens,
            checkpoints, payload``: whole documents in ascending order, packed
            bits, and the bit offset of every 256th token of the block.

Shards follow each other in ascending document order, and blocks in a shard.
``first_token`` counts from the start of the shard.

Order of the work: one job encodes every text and counts its ids; the
lengths are computed from the global counts (one number per id of the
vocabulary, the only thing the driver sees); a second job brings the ids in
order of ``doc_id`` and writes the blocks.  A block holds about
``BLOCK_TOKENS`` tokens; a longer document is a block of its own.

Null texts count as empty; a document without tokens holds the end id alone.
Rows with equal ids stay separate rows, in order of their content; a null id
comes first.  An empty table gives an empty file.  Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stage import Stage
from .common import batches
from .huffman import Codec, code_lengths
from .word_ids import word_encoder

BLOCK_TOKENS = 1 << 18
MAX_BITS = 20

_TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())])
_BLOCKS = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
        ("checkpoints", pa.binary()), ("payload", pa.binary()),
    ]
)
_BLOCKS_SQL = (
    "shard int, block int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
    "checkpoints binary, payload binary"
)
_DIGEST = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
_IDS = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def tokenise(docs: DataFrame, path: str, end_id: int | None) -> DataFrame:
    """``doc_id, n_tokens, ids`` of every document, and a row with ``counts`` of all its ids for every task."""

    def run(parts):
        encoder = word_encoder(path, added_tokens=True)
        n_ids = max(encoder.n_ids, (end_id or 0) + 1)
        counts = np.zeros(n_ids, dtype=np.int64)
        end = b"" if end_id is None else np.array([end_id], dtype=encoder.dtype).tobytes()

        def rows():
            for part in parts:
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = encoder.encode(text.as_py()) + end
                    array = np.frombuffer(ids, dtype=encoder.dtype)
                    pending.append(array)
                    if len(pending) >= 512:
                        settle()
                    yield doc_id, len(array), ids, None
            settle()
            yield None, None, None, counts.astype("<i8").tobytes()

        def settle():
            if pending:
                counts[:] += np.bincount(np.concatenate(pending), minlength=n_ids)
                pending.clear()

        pending: list[np.ndarray] = []
        yield from batches(_TOKENS, rows())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids binary, counts binary"
    )


def id_counts(tokens: DataFrame) -> DataFrame:
    """``id, n``: how often each id occurs, from the counts of the tasks."""

    def run(parts):
        schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])
        total = None
        for part in parts:
            for counts in part.column(0):
                array = np.frombuffer(counts.as_py(), dtype="<i8")
                total = array.copy() if total is None else total + array
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], schema=schema)

    partial = tokens.where("counts is not null").select("counts").mapInArrow(run, "id int, n long")
    return partial.groupBy("id").agg(F.sum("n").alias("n"))


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, max_bits: int = MAX_BITS) -> None:
    """Encode ``doc_id, text`` and write the token file to ``path``."""
    spark = docs.sparkSession
    stage = Stage(spark)
    tokens = stage.write(tokenise(docs, tokenizer_path, end_id), "tokens")
    counted = id_counts(tokens).toPandas()
    n_ids = int(counted["id"].max()) + 1 if len(counted) else 1
    counts = np.zeros(n_ids, dtype=np.int64)
    counts[counted["id"]] = counted["n"]
    lengths = code_lengths(counts, max(max_bits, (n_ids - 1).bit_length()))
    used = np.flatnonzero(lengths)
    spark.createDataFrame(
        pa.table({"id": pa.array(used, pa.int32()), "bits": pa.array(lengths[used], pa.int32())})
    ).coalesce(1).write.parquet(f"{path}/code")
    dtype = "<u2" if word_encoder(tokenizer_path).n_ids <= 1 << 16 else "<u4"
    ordered = (
        tokens.where("ids is not null")
        .select("doc_id", "ids")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "ids")
    )
    ordered.mapInArrow(_block_writer(lengths, dtype), _BLOCKS_SQL).write.parquet(f"{path}/blocks")
    stage.drop()


def _block_writer(lengths: np.ndarray, dtype: str):
    def run(parts):
        codec, shard = Codec(lengths), TaskContext.get().partitionId()

        def rows():
            block, first, held, ids = 0, 0, 0, []
            docs: list[tuple[int, int]] = []

            def close():
                payload, checkpoints = codec.encode(np.concatenate(ids))
                names, sizes = zip(*docs, strict=True)
                return shard, block, first, held, list(names), list(sizes), checkpoints.astype("<i8").tobytes(), payload

            for part in parts:
                for doc_id, packed in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    array = np.frombuffer(packed.as_py(), dtype=dtype)
                    if docs and held + len(array) > BLOCK_TOKENS:
                        yield close()
                        block, first, held, ids, docs = block + 1, first + held, 0, [], []
                    docs.append((doc_id, len(array)))
                    ids.append(array)
                    held += len(array)
            if docs:
                yield close()

        yield from batches(_BLOCKS, rows(), max_rows=8)

    return run


def read_token_file(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and the ``ids`` (little-endian unsigned 32-bit), or their ``ids_crc32``.

    ``start`` counts the ids of all documents before this one.
    """
    code = spark.read.parquet(f"{path}/code").toPandas()  # at most the vocabulary
    lengths = np.zeros(int(code["id"].max()) + 1 if len(code) else 1, dtype=np.uint8)
    lengths[code["id"]] = code["bits"]
    blocks = spark.read.parquet(f"{path}/blocks")
    schema = _DIGEST if digest else _IDS

    def run(parts):
        codec = Codec(lengths)

        def rows():
            for part in parts:
                for i in range(part.num_rows):
                    shard, first, n, names, sizes, checkpoints, payload = (c[i].as_py() for c in part.columns)
                    ids = codec.decode(payload, np.frombuffer(checkpoints, dtype="<i8"), n).astype("<u4")
                    at = 0
                    for doc_id, size in zip(names, sizes, strict=True):
                        own = ids[at : at + size].tobytes()
                        yield shard, first + at, doc_id, size, zlib.crc32(own) if digest else own
                        at += size

        yield from batches(schema, rows())

    decoded = blocks.select("shard", "first_token", "n_tokens", "doc_ids", "doc_tokens", "checkpoints", "payload").mapInArrow(
        run, f"shard int, first long, doc_id long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}"
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (  # one row for each part file
        blocks.groupBy("shard")
        .agg(F.sum("n_tokens").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    return decoded.join(F.broadcast(shards), "shard").selectExpr(
        "doc_id", "before + first as start", "n_tokens", "ids_crc32" if digest else "ids"
    )

