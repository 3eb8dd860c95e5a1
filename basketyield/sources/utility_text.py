"""Reader for ``items:transactionUtility:utilities`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import array_sum, merge_duplicate_items, strict_int


def _kept_lines(spark: SparkSession, path: str | list[str], max_count: int) -> DataFrame:
    """Transaction lines as ``tid, value``, without blank, comment and metadata lines."""
    lines = (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .where(~F.col("value").rlike("^($|[#%@])"))
        .withColumn("tid", F.monotonically_increasing_id())
    )
    if max_count <= 0:
        return lines.select("tid", "value")
    # The rows of one file split have consecutive ids, so the place of a line
    # is the number of lines in earlier splits plus its distance from the first
    # id of its split.  One row per split: both the window and the broadcast
    # are bounded by the number of splits.
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        lines.groupBy("file", "block")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("tid").alias("first"))
        .withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))
        .where(F.col("before") < max_count)
        .select("file", "block", "first", "before")
    )
    place = F.col("before") + F.col("tid") - F.col("first")
    return lines.join(F.broadcast(splits), ["file", "block"]).where(place < max_count).select("tid", "value")


def _parsed(lines: DataFrame) -> DataFrame:
    """Add ``items, utils, header_tu`` and ``ok``; unusable lines have ``ok = false``."""

    def numbers(part: int) -> str:
        # Blanks at the end of a list do not count as an entry.
        tokens = f"split(rtrim(' ', get(split(value, ':'), {part})), ' ')"
        return f"transform({tokens}, t -> {strict_int('t', 'bigint')})"

    header = strict_int("get(split(value, ':'), 1)", "bigint")
    ok = """
        header_tu is not null
        and size(utils) = size(items)
        and forall(items, x -> x is not null)
        and forall(utils, x -> x is not null and x >= 0)
    """
    return (
        lines.selectExpr(
            "tid", "value", f"{numbers(0)} as items", f"{header} as header_tu", f"{numbers(2)} as listed",
        )
        .selectExpr("tid", "value", "items", "header_tu", "slice(listed, 1, size(items)) as utils")
        .selectExpr("*", f"coalesce({ok}, false) as ok")
    )


def _fail_unless(condition: str, message: str) -> str:
    return f"if({condition}, true, boolean(raise_error(concat('{message}: ', value))))"


def read_utility_transactions(
    spark: SparkSession,
    path: str | list[str],
    max_count: int = 0,
    mode: str = "FAILFAST",
    validate_tu: bool = False,
) -> DataFrame:
    """Array form of a utility-transaction text file.

    ``max_count`` keeps the first N transaction lines in file order (N <= 0:
    all).  A line that cannot be used, also one with a negative utility, fails
    the job under ``FAILFAST``; under ``PERMISSIVE`` it is left out and
    :func:`malformed_lines` returns it.  The transaction utility is recomputed;
    ``validate_tu`` fails the job where the header says otherwise.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode must be 'FAILFAST' or 'PERMISSIVE', not {mode!r}")
    parsed = _parsed(_kept_lines(spark, path, max_count))
    if mode == "PERMISSIVE":
        parsed = parsed.where("ok")
    else:
        parsed = parsed.where(_fail_unless("ok", "malformed transaction line"))
    if validate_tu:
        same = f"header_tu = {array_sum('utils')}"
        parsed = parsed.where(_fail_unless(same, "transaction utility differs from its header"))
    return parsed.selectExpr(
        "tid",
        "array_distinct(items) as items",
        f"{merge_duplicate_items('items', 'utils')} as utils",
        f"{array_sum('utils')} as tu",
    )


def malformed_lines(spark: SparkSession, path: str | list[str], max_count: int = 0) -> DataFrame:
    """The lines that ``PERMISSIVE`` leaves out, as ``tid, value``."""
    return _parsed(_kept_lines(spark, path, max_count)).where(~F.col("ok")).select("tid", "value")


def header_mismatches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Usable lines whose header utility is not the sum of their utilities."""
    parsed = _parsed(_kept_lines(spark, path, 0)).where("ok")
    return parsed.selectExpr("tid", "value", "header_tu", f"{array_sum('utils')} as tu").where("header_tu <> tu")
