"""Written tables that cut lineage between the steps of a run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def stage_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may go without one; it then gets a temporary folder,
    which is remembered for the rest of the session.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="basketyield-"))
    return context.getCheckpointDir()


class Stage:
    """A set of parquet tables of one run.

    A written table survives the loss of executors, reads back only the
    columns a step asks for, and gives the planner true sizes for its joins.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{stage_folder(spark).rstrip('/')}/basketyield-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.read(df.schema, name)

    def write_observed(self, df: DataFrame, name: str, **metrics: str) -> tuple[DataFrame, dict]:
        """Write, and aggregate the written rows on the way.

        The metrics are taken in the tasks that write, of which Spark counts
        each partition once.
        """
        seen = Observation()
        exprs = [F.expr(text).alias(metric) for metric, text in metrics.items()]
        return self.write(df.observe(seen, *exprs), name), seen.get

    def read(self, schema, *names: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[self.path(n) for n in names])

    def drop(self, name: str | None = None) -> None:
        """Delete a table that no later step reads, or all of them."""
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
