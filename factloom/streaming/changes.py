"""Change queues and publishing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_dir, cut
from .protocol import message_id

CHANGE = "epoch long, seq long, path string, op string, at timestamp"


def watch(spark: SparkSession, path: str, *, files: int = 100) -> DataFrame:
    """Change records as they arrive; a trigger takes so many files at most."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files).json(path)


def coalesced(changes: DataFrame) -> DataFrame:
    """The last operation on each path, and whether a sequence has holes, so that all has to be read again."""
    last = changes.groupBy("epoch", "path").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))
    cover = changes.groupBy("epoch").agg((F.max("seq") - F.min("seq") + 1 != F.count_distinct("seq")).alias("reconcile"))
    return last.join(cover, "epoch")


def bursts(changes: DataFrame, *, quiet: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """A burst ends with a quiet gap: its paths' number, first and last change."""
    timed = changes.withWatermark("at", late) if changes.isStreaming else changes
    return timed.groupBy("epoch", F.session_window("at", quiet).alias("w")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")).drop("w")


class Publisher:
    """Writes envelopes to a folder of JSON lines, each message once; for ``foreachBatch`` or whole frames.

    A batch's messages are one folder, which also says that they were sent: there is no
    second log that a failure could leave behind, and a repeated batch writes its folder again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        checkpoint_dir(spark)

    def sent(self) -> DataFrame:
        """``repo_id, context_id, msg_id, batch`` of all messages in the folder."""
        keys = "repo_id string, context_id string, run_id string, type string, seq int, batch long"
        try:
            out = self.spark.read.schema(keys).json(f"{self.path}/out")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            out = self.spark.createDataFrame([], keys)
        return out.select("repo_id", "context_id", message_id().alias("msg_id"), "batch")

    def publish(self, envelopes: DataFrame, batch: int | None = None) -> int:
        """The number of messages in the batch's folder; those that another batch sent are left out."""
        keys, sent = ["repo_id", "context_id", "msg_id"], self.sent()
        if batch is None:
            batch = (sent.agg(F.max("batch")).first()[0] or 0) + 1
        others = sent.filter(F.col("batch") != batch).select(*keys)
        fresh = cut(envelopes.withColumn("msg_id", message_id()).dropDuplicates(keys).join(others, keys, "left_anti").drop("msg_id"))
        n = fresh.count()
        if n:
            fresh.write.mode("overwrite").json(f"{self.path}/out/batch={batch}")
        return n
