"""Row numbers over a global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..stage import Stage

# monotonically_increasing_id keeps the partition above these bits.
_ROW_BITS = 33


def global_row_number(df: DataFrame, order: list[str | Column], name: str, stage: Stage) -> DataFrame:
    """Add ``name`` = 1, 2, 3, ... in ``order``, without a single-partition sort.

    Rows are range-partitioned and sorted, written once so that both passes
    see the same partitions, and numbered by the row counts of the earlier
    partitions.  The offset table has one row per partition, so both its
    window and its broadcast are bounded.
    """
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    table = stage.write(ranged, f"ranged_{name}")
    table = table.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        table.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    row = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        table.join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + row + 1).cast("bigint"))
        .drop("_part", "_mid", "_offset")
    )
