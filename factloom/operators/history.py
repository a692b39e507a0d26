"""Revision history: an append-only log in which each revision is a multiset patch of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def patches(revisions: DataFrame) -> DataFrame:
    """``revision_id, at, line, delta`` from full revisions(revision_id, at, line, n): counts against the revision before.

    A line that a revision lacks counts as zero there, so removals show.
    """
    order = revisions.select("revision_id", "at").distinct()
    ranked = order.withColumn("k", F.row_number().over(Window.orderBy("at", "revision_id")))  # one row for each revision
    held = revisions.join(ranked.select("revision_id", "k"), "revision_id").groupBy("k", "line").agg(F.sum("n").alias("n"))
    # a line's count matters at its own revisions and right after each of them
    last = ranked.agg(F.max("k").alias("last"))
    after = held.select((F.col("k") + 1).alias("k"), "line", F.lit(0).alias("n")).join(F.broadcast(last)).filter("k <= last").drop("last")
    points = held.unionByName(after).groupBy("k", "line").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.lag("n").over(Window.partitionBy("line").orderBy("k")), F.lit(0))
    out = points.withColumn("delta", F.col("n") - before).filter("delta <> 0")
    return out.join(ranked, "k").select("revision_id", "at", "line", "delta")


def restore(patched: DataFrame, revision: str) -> DataFrame:
    """The lines of a revision: all deltas up to it summed up."""
    at = patched.filter(F.col("revision_id") == revision).agg(F.max("at").alias("_at"))
    upto = patched.join(F.broadcast(at)).filter((F.col("at") < F.col("_at")) | ((F.col("at") == F.col("_at")) & (F.col("revision_id") <= revision)))
    return upto.groupBy("line").agg(F.sum("delta").alias("n")).filter("n > 0")


def blame(patched: DataFrame, term: str) -> DataFrame:
    """Lines that mention a term: the revision of their first appearance, additions, removals and whether they are still there."""
    hit = patched.filter(F.contains("line", F.lit(term)))
    return hit.groupBy("line").agg(
        F.min_by("revision_id", F.struct("at", "revision_id")).alias("introduced"),
        F.sum(F.greatest("delta", F.lit(0))).alias("added"),
        F.sum(F.greatest(-F.col("delta"), F.lit(0))).alias("removed"),
        (F.sum("delta") > 0).alias("present"),
    )


def thinned(log: DataFrame, before: str) -> DataFrame:
    """Old revisions thinned to the last of each day; later ones stay: log(revision_id, at)."""
    old = F.col("at") < F.to_timestamp(F.lit(before))
    day = log.filter(old).groupBy(F.to_date("at").alias("day")).agg(F.max_by("revision_id", F.struct("at", "revision_id")).alias("revision_id"))
    return log.filter(~old).unionByName(log.join(day.select("revision_id"), "revision_id", "left_semi").filter(old))


def orphan_segments(segments: DataFrame, log: DataFrame) -> DataFrame:
    return segments.join(log.select("segment").distinct(), "segment", "left_anti")


def log_graph(log: DataFrame) -> DataFrame:
    """Revisions with their lane (one for each branch in order of first use) and epoch (a gap of a day begins one)."""
    first = log.groupBy("branch").agg(F.min("at").alias("_first"))
    lanes = first.withColumn("lane", F.row_number().over(Window.orderBy("_first", "branch")) - 1)  # one row for each branch
    gap = F.coalesce((F.unix_timestamp("at") - F.unix_timestamp(F.lag("at").over(Window.partitionBy("branch").orderBy("at", "revision_id")))) > 86400, F.lit(False))
    marked = log.withColumn("_gap", gap)
    return marked.withColumn("epoch", F.sum(F.col("_gap").cast("int")).over(Window.partitionBy("branch").orderBy("at", "revision_id"))).drop("_gap").join(lanes.drop("_first"), "branch")


def at_date(log: DataFrame, when: str) -> DataFrame:
    """The last revision not after a moment: an as-of lookup."""
    return log.filter(F.col("at") <= F.to_timestamp(F.lit(when))).orderBy(F.desc("at"), F.desc("revision_id")).limit(1)
