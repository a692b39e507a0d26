"""Reading and writing facts: JSON lines, snapshots, repository files and report formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import fact_id, glob_regex
from ..schema import FACT_KINDS, FACTS, FINDINGS


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines by the fixed schema; a line that isn't a fact keeps all columns null and is left to :func:`validated`."""
    return spark.read.schema(FACTS).json(path)


def validated(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of a known or plug-in kind with a name, and the others with the reason."""
    reason = F.when(F.col("kind").isNull(), "no kind").when(~F.col("kind").isin(*FACT_KINDS) & ~F.startswith(F.col("kind"), F.lit("plugin:")), "unknown kind").when(F.coalesce("name", F.lit("")) == "", "no name")
    marked = facts.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def with_ids(facts: DataFrame) -> DataFrame:
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    return facts.withColumn("id", fact_id(c("repo"), c("kind"), c("name"), c("file")))


def write_facts(facts: DataFrame, path: str) -> None:
    """Canonical JSON lines: sorted in ranges, so any number of files is in order one after the other."""
    order = [c for c in ("repo", "kind", "name", "file", "line") if c in facts.columns]
    with_ids(facts).orderBy(*order).write.mode("overwrite").json(path)


def write_snapshot(facts: DataFrame, findings: DataFrame | None, meta: dict, path: str) -> None:
    """A snapshot's folder: facts and findings as Parquet by kind, and one row of metadata."""
    facts.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/facts")
    if findings is not None:
        findings.write.mode("overwrite").parquet(f"{path}/findings")
    facts.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return spark.read.parquet(f"{path}/facts"), meta


def pin_baseline(spark: SparkSession, snapshot: str, baseline: str) -> None:
    """Copy a snapshot to the baseline's place."""
    for part in ("facts", "findings"):
        try:
            df = spark.read.parquet(f"{snapshot}/{part}")
        except Exception as e:  # a snapshot without findings
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        writer = df.write.mode("overwrite")
        (writer.partitionBy("kind") if part == "facts" else writer).parquet(f"{baseline}/{part}")
    spark.read.text(f"{snapshot}/meta").write.mode("overwrite").text(f"{baseline}/meta")


def walk_repository(spark: SparkSession, root: str, *, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Files below a folder with size, sha256 and whether a glob ignores them; contents are read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    place = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^" + glob_regex(root.rstrip("/") + "/").removeprefix("^").removesuffix("(?:/.*)?$"), "")
    ignored = F.lit(False)
    for g in ignore:
        ignored = ignored | F.col("file").rlike(glob_regex(g))
    return files.select(place.alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), F.col("content").cast("string").alias("content")).withColumn("ignored", ignored)


def changed_share(old: DataFrame, new: DataFrame) -> DataFrame:
    """Share of files(file, hash) that are new, gone or different."""
    both = old.select("file", F.col("hash").alias("a")).join(new.select("file", F.col("hash").alias("b")), "file", "full_outer")
    same = F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0))
    return both.agg(F.count("*").alias("files"), (F.count("*") - same).alias("changed"), F.round(F.when(F.count("*") > 0, (F.count("*") - same) / F.count("*")).otherwise(0.0), 6).alias("share"))


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDINGS).json(path)


def sarif(findings: DataFrame, tool: str = "factloom") -> DataFrame:
    """One SARIF result object for each finding, as JSON."""
    level = F.when(F.col("confidence") >= 1.0, "error").when(F.col("confidence") >= 0.6, "warning").otherwise("note")
    where = F.array(F.struct(F.struct(F.struct(F.element_at("evidence", 1)["file"].alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    return findings.select(F.to_json(F.struct(F.col("source").alias("ruleId"), level.alias("level"), F.struct(F.col("title").alias("text")).alias("message"), F.when(F.size("evidence") > 0, where).alias("locations"))).alias("result"))


def annotations(findings: DataFrame) -> DataFrame:
    """Workflow annotation lines."""
    kind = F.when(F.col("confidence") >= 1.0, "error").otherwise("warning")
    e = F.element_at("evidence", 1)
    return findings.filter(F.size("evidence") > 0).select(F.concat(F.lit("::"), kind, F.lit(" file="), e["file"], F.lit(",line="), F.coalesce(e["line"], F.lit(1)), F.lit("::"), F.col("title")).alias("line"))


def text_report(findings: DataFrame) -> DataFrame:
    return findings.select(F.format_string("[%s] %s (%.2f)", "source", "title", "confidence").alias("line"))


def context_page(facts: DataFrame, findings: DataFrame, *, most: int = 20) -> str:
    """A short Markdown page: facts by kind, and the first findings."""
    lines = ["# Overview", ""]
    lines += [f"- {r['kind']}: {r['n']}" for r in facts.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()]
    lines += ["", "## Findings", ""]
    lines += [f"- {r['title']} ({r['source']}, {r['confidence']:.2f})" for r in findings.orderBy(F.desc("confidence"), "source", "title").limit(most).collect()]
    return "\n".join(lines) + "\n"
