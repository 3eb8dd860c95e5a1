"""Shards of bounded size by extendible hashing, in DataFrame operations only.

The bits of a row's hash address a directory.  A bucket that holds more bytes
than a shard may splits on its next bit, others stay as they are, so shards
have prefixes of different lengths and only full parts of the key space get
longer ones.  Sizes are summed for ``STEP_BITS`` bits at a time: each round
aggregates the rows of the buckets that are still too full by their next bits
and picks, for each such cell, the shortest prefix whose bytes fit.

The first ``KEY_BITS`` bits come from the key, so rows of a key stay together
while they fit; further bits come from the row's number in a written table,
so that even rows of one key, or copies of one row, split.  A single row over
the limit is a shard of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..stage import Stage

SHARD_BYTES = 1 << 20
KEY_BITS = 60
STEP_BITS = 12
#: Key bits, then bits of the row number.
_WORDS = ("key_word", "row_word")


def _word(text) -> F.Column:
    """The first 60 bits of an MD5 sum as a number."""
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def assign_shards(df: DataFrame, key: str, n_bytes: F.Column, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``key, shard, depth, n_bytes, shard_bytes, shard_rows`` of every row.

    ``shard`` is the hash prefix as text of 0 and 1, ``depth`` its length.
    Null sizes count as 0 and a null key as one more key; rows are independent,
    so repeated rows are counted and placed one by one; no rows give no shards.
    """
    if shard_bytes < 1:
        raise ValueError("a shard holds at least one byte")
    stage = Stage(df.sparkSession)
    rows = df.select(
        F.col(key).alias("key"),
        F.coalesce(n_bytes.cast("long"), F.lit(0)).alias("n_bytes"),
        _word(F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("key_word"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = stage.write(rows, "rows").withColumn("row_word", _word(F.concat(F.lit("#"), F.col("row").cast("string"))))
    whole = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    if whole[0] <= shard_bytes or whole[1] == 1:
        return rows.select(
            F.col("key").alias(key), F.lit("").alias("shard"), F.lit(0).alias("depth"), "n_bytes",
            F.lit(whole[0]).alias("shard_bytes"), F.lit(whole[1]).alias("shard_rows"),
        )
    open_rows, placed, depth = rows.withColumn("bucket", F.lit("")), [], 0
    while True:
        word, used = _WORDS[depth // KEY_BITS], depth % KEY_BITS
        cell = F.expr(f"shiftrightunsigned({word}, {KEY_BITS - used - STEP_BITS}) & {(1 << STEP_BITS) - 1}").cast("int")
        open_rows = open_rows.withColumn("cell", cell)
        cells = stage.write(
            open_rows.groupBy("bucket", "cell").agg(F.sum("n_bytes").alias("s"), F.count(F.lit(1)).alias("n")), f"cells_{depth}"
        )
        at_depth = cells.select(
            "bucket", "cell", "s", "n", F.explode(F.sequence(F.lit(1), F.lit(STEP_BITS))).alias("bits")
        ).withColumn("prefix", F.expr(f"shiftright(cell, {STEP_BITS} - bits)"))
        sums = at_depth.groupBy("bucket", "bits", "prefix").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        fitting = sums.where((F.col("s") <= shard_bytes) | (F.col("n") == 1))
        leaf = (
            at_depth.drop("s", "n")
            .join(fitting, ["bucket", "bits", "prefix"])
            .groupBy("bucket", "cell")
            .agg(F.min(F.struct("bits", "prefix", "s", "n")).alias("leaf"))
        )
        directory, seen = stage.write_observed(
            cells.select("bucket", "cell").join(leaf, ["bucket", "cell"], "left"),
            f"directory_{depth}",
            still_full="count_if(leaf is null)",
        )
        found = open_rows.join(directory, ["bucket", "cell"])
        placed.append(
            found.where("leaf is not null").select(
                "key",
                F.concat("bucket", F.expr("lpad(bin(leaf.prefix), leaf.bits, '0')")).alias("shard"),
                (F.lit(depth) + F.col("leaf.bits")).alias("depth"),
                "n_bytes",
                F.col("leaf.s").alias("shard_bytes"),
                F.col("leaf.n").alias("shard_rows"),
            )
        )
        if not seen["still_full"]:
            break
        bucket = F.concat("bucket", F.expr(f"lpad(bin(cell), {STEP_BITS}, '0')"))
        depth += STEP_BITS
        if depth >= KEY_BITS * len(_WORDS):
            raise RuntimeError("rows that no bit tells apart")
        open_rows = stage.write(
            found.where("leaf is null").select("key", "n_bytes", "key_word", "row_word", bucket.alias("bucket")), f"open_{depth}"
        )
    result = placed[0]
    for more in placed[1:]:
        result = result.unionAll(more)
    return result.withColumnRenamed("key", key)


def write_shards(df: DataFrame, key: str, n_bytes: F.Column, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Write ``df`` to one folder ``shard=...`` for each shard; ``key`` must be unique and not null."""
    shards = assign_shards(df, key, n_bytes, shard_bytes).select(key, F.concat(F.lit("p"), F.col("shard")).alias("shard"))
    df.join(shards, key).repartition("shard").write.partitionBy("shard").parquet(path)


def oracle_sql(shard_bytes: int) -> str:
    return f"""with d as (select doc_id, strlen(coalesce(text, '')) n_bytes,
        ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint a from documents),
        g as (select j, a >> (60 - j) p, cast(sum(n_bytes) as bigint) s, count(*) n
              from d, (select unnest(range(0, 49)) j) group by 1, 2 having sum(n_bytes) <= {shard_bytes} or count(*) = 1),
        m as (select doc_id, min(j) j from d join g on d.a >> (60 - g.j) = g.p group by 1)
        select doc_id, lpad(bin(a >> (60 - m.j)), cast(m.j as integer), '0') shard, cast(m.j as integer) depth, n_bytes,
        s shard_bytes, n shard_rows from d join m using (doc_id) join g on m.j = g.j and g.p = d.a >> (60 - m.j)"""
