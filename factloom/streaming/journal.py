"""A durable journal of messages between a producer and its consumer.

Entries are kept as Parquet, a folder for each segment; what is done with an entry
(acknowledged, or withdrawn by a tombstone) is kept beside them with the hash of its
payload.  A repeated entry is kept once, the same message with another payload is
refused, and a writer that has been fenced off can no longer append.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import cut
from .protocol import _Files

ENTRY = "msg_id string, subject string, payload string"
_KEPT, _DONE, _FENCE = ENTRY + ", hash string, segment long", "msg_id string, hash string, state string", "writer string, epoch long"


class Conflict(ValueError):
    """A message came again with another payload."""


class Fenced(RuntimeError):
    """The writer's epoch is over."""


class Full(RuntimeError):
    """The entries that are neither acknowledged nor withdrawn fill the journal."""


class Journal:
    def __init__(self, spark: SparkSession, path: str, *, writer: str = "", epoch: int = 0, most_bytes: int | None = None):
        self.spark, self.path, self.writer, self.epoch, self.most_bytes = spark, path, writer, epoch, most_bytes

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        return self._read("entries", _KEPT)

    def done(self) -> DataFrame:
        """``msg_id, hash, state``, one row for each settled message; a tombstone outweighs an acknowledgement."""
        return self._read("done", _DONE).groupBy("msg_id").agg(F.max("hash").alias("hash"), F.max("state").alias("state"))

    def pending(self) -> DataFrame:
        """Entries to deliver, in the order of their segments."""
        return self.entries().join(self.done().select("msg_id"), "msg_id", "left_anti").select("segment", "msg_id", "subject", "payload").orderBy("segment", "msg_id")

    def retained_bytes(self) -> int:
        return self.pending().agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]

    def fence(self, writer: str, epoch: int) -> None:
        """From now on only this or a later epoch of a writer may append."""
        self.spark.createDataFrame([(writer, epoch)], _FENCE).write.mode("append").parquet(f"{self.path}/fences")

    def append(self, messages: DataFrame, segment: int) -> int:
        """Keep messages(msg_id, subject, payload) as one segment; the number of new ones.  Repeating a segment changes nothing."""
        at = self._read("fences", _FENCE).filter(F.col("writer") == self.writer).agg(F.max("epoch")).first()[0]
        if at is not None and self.epoch < at:
            raise Fenced(f"writer {self.writer!r} is at epoch {at}")
        hashed = cut(messages.select("msg_id", "subject", "payload", F.sha2(F.concat_ws("\0", "subject", "payload").cast("binary"), 256).alias("hash")).distinct())
        others = self.entries().filter(F.col("segment") != segment).select("msg_id", F.col("hash").alias("_h")).unionByName(self.done().select("msg_id", F.col("hash").alias("_h"))).distinct()
        twice = hashed.groupBy("msg_id").agg(F.count("*").alias("n")).filter("n > 1").select("msg_id")
        clash = hashed.join(others, "msg_id").filter("hash <> _h").select("msg_id").union(twice).first()
        if clash:
            raise Conflict(clash["msg_id"])
        fresh = cut(hashed.join(others, "msg_id", "left_anti"))
        if self.most_bytes is not None:
            more = fresh.agg(F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()[0]
            if self.retained_bytes() + more > self.most_bytes:
                raise Full(f"{more} bytes more than fit")
        fresh.write.mode("overwrite").parquet(f"{self.path}/entries/segment={segment}")
        return fresh.count()

    def _settle(self, ids: DataFrame, state: str) -> None:
        known = self.entries().join(ids.select("msg_id").distinct(), "msg_id", "left_semi").select("msg_id", "hash", F.lit(state).alias("state"))
        known.write.mode("append").parquet(f"{self.path}/done")

    def ack(self, ids: DataFrame) -> None:
        """ids(msg_id) have been delivered; unknown ones are passed over."""
        self._settle(ids, "acked")

    def tombstone(self, ids: DataFrame) -> None:
        """ids(msg_id) are withdrawn: they are never delivered, and their messages stay known."""
        self._settle(ids, "tombstone")

    def compact(self) -> int:
        """Rewrite the segments that hold settled entries without them; the number of segments that went."""
        files = _Files(self.spark, self.path)
        settled = self.entries().join(self.done().select("msg_id"), "msg_id", "left_semi").select("segment").distinct()
        gone = 0
        for row in settled.orderBy("segment").toLocalIterator():  # a few segments at a time
            name = f"entries/segment={row['segment']}"
            left = cut(self.entries().filter(F.col("segment") == row["segment"]).join(self.done().select("msg_id"), "msg_id", "left_anti").drop("segment"))
            if left.isEmpty():
                files.delete(name)
                gone += 1
            else:
                left.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return gone
