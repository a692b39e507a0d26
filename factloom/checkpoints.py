"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set, as in tests."""
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """A copy in the checkpoint folder without the size that the planner guessed for what made it.

    A join's guessed size is the product of its sides' sizes, and a plain
    checkpoint hands the guess on, so in a loop it grows to numbers of thousands
    of digits that take longer than the work.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    held = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)
