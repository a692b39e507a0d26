"""Aggregates, statistics, digests, rankings and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def statistics(df: DataFrame, value: str, *keys: str, digits: int = 6) -> DataFrame:
    """``keys, mean, deviation``: the mean and the population deviation of a value by group, rounded so that the order of summing makes no difference."""
    return df.groupBy(*keys).agg(F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_pop(value), digits).alias("deviation"))


def outliers(df: DataFrame, value: str, *, k: float = 2.0, strict: bool = True, floor: float | None = None) -> DataFrame:
    """Rows above mean + k population standard deviations of all rows, with ``threshold`` rounded to nine places."""
    limits = df.agg(F.round(F.avg(value) + k * F.stddev_pop(value), 9).alias("threshold"))
    over = df.join(F.broadcast(limits)).filter(F.col(value) > F.col("threshold") if strict else F.col(value) >= F.col("threshold"))
    return over.filter(F.col(value) >= floor) if floor is not None else over


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def coupling(edges: DataFrame) -> DataFrame:
    """Afferent and efferent couplings of ``edges(src, dst)``: distinct neighbours, blanks and self edges ignored."""
    used = edges.filter("src <> dst and src <> '' and dst <> ''").select("src", "dst").distinct()
    ca = used.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("ca"))
    ce = used.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("ce"))
    return ca.join(ce, "name", "full_outer").select("name", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))


def set_digest(df: DataFrame, keys: list[str], member: Column) -> DataFrame:
    """sha256 over each group's sorted distinct members, one a line."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(member)), "\n").cast("binary"), 256).alias("digest"))


def multiset_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines added and removed with their counts: multisets of equal columns."""
    cols = old.columns
    n = old.groupBy(*cols).agg(F.count("*").alias("a"))
    m = new.groupBy(*cols).agg(F.count("*").alias("b"))
    both = n.join(m, cols, "full_outer").select(*cols, (F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))).alias("delta"))
    return both.filter("delta <> 0")


def other_source(refs: DataFrame) -> DataFrame:
    """For each (target, source): whether some other source refers to the target; exact, from the least and greatest source alone."""
    ends = refs.groupBy("target").agg(F.min("source").alias("lo"), F.max("source").alias("hi"))
    return refs.select("target", "source").distinct().join(ends, "target").select("target", "source", ((F.col("lo") != F.col("source")) | (F.col("hi") != F.col("source"))).alias("by_other"))


def coverage_tallies(links: DataFrame) -> DataFrame:
    """Detected, resolved, unresolved and external links by repository and edge type."""
    of = lambda s: F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(s)
    return links.groupBy("repo", "edge_type").agg(F.count("*").alias("detected"), of("resolved"), of("unresolved"), of("external"))


def sampled_lists(df: DataFrame, keys: list[str], member: str, *, most: int = 25) -> DataFrame:
    """The first ``most`` distinct members in order and how many more there are; no group is gathered whole."""
    distinct = df.select(*keys, member).distinct()
    ranked = distinct.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(member)))
    return ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_k") <= most, F.col(member)))).alias("sample"), F.greatest(F.count("*") - most, F.lit(0)).alias("more"))


def counts_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added and removed by kind from row hashes alone: facts(kind, hash)."""
    a = old.groupBy("kind", "hash").agg(F.count("*").alias("a"))
    b = new.groupBy("kind", "hash").agg(F.count("*").alias("b"))
    both = a.join(b, ["kind", "hash"], "full_outer").withColumn("d", F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0)))
    return both.groupBy("kind").agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("removed"))


def author_shares(commits: DataFrame, *, minor: float = 0.05, owned: float = 0.5, sparse: int = 5) -> DataFrame:
    """Each author's share of a module's commits and its standing: ``sparse`` modules have too few to say."""
    by = commits.groupBy("module", "author").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("module"))
    total = F.sum("n").over(Window.partitionBy("module"))
    standing = F.when(F.col("total") < sparse, "sparse").when(F.col("share") >= owned, "owner").when(F.col("share") < minor, "minor").otherwise("major")
    return by.withColumn("total", total).withColumn("share", F.round(share, 6)).withColumn("standing", standing)


def receipt(facts: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row of totals; facts by kind add up to all facts."""
    f = facts.agg(F.count("*").alias("facts"), *(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"{k}_facts") for k in ("module", "symbol", "service")))
    e = resolved.agg(F.count("*").alias("edges"), F.sum(F.when(F.col("resolution") != "resolved", 1).otherwise(0)).alias("unresolved_edges"))
    return f.join(F.broadcast(e))


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """How far two providers' facts overlap: both, only the first, only the second."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(1))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, keys, "full_outer")
    return both.agg(
        F.sum(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0)).alias("both"),
        F.sum(F.when(F.col("_b").isNull(), 1).otherwise(0)).alias("only_first"),
        F.sum(F.when(F.col("_a").isNull(), 1).otherwise(0)).alias("only_second"),
    )


def capped_evidence(findings: DataFrame, evidence: DataFrame, key: str, member: str, *, most: int = 8) -> DataFrame:
    """Each finding with its first ``most`` pieces of evidence in order and the number of those left out; findings without any have none."""
    return findings.join(sampled_lists(evidence, [key], member, most=most), key, "left").withColumn("more", F.coalesce("more", F.lit(0)))


def top(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of a total order."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, keys: list[str], n: int, *order) -> DataFrame:
    """The first n rows of each group, and on each how many of the group were left out."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("omitted", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return ranked.filter(F.col("rank") <= n)


def paired(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def consecutive(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Each row with the value before it in its group."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(order)))


def debounced(changes: DataFrame, keys: list[str], at: str, *, gap: str = "2 minutes") -> DataFrame:
    """Bursts of changes: a quiet gap ends a burst; its start, its last change and its size."""
    session = F.session_window(at, gap)
    return changes.groupBy(*keys, session.alias("w")).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last")).drop("w")


def remove_where(store: DataFrame, condition: Column) -> DataFrame:
    """The facts that don't meet a condition; one that is unknown isn't met."""
    return store.filter(~F.coalesce(condition, F.lit(False)))


def replace_repo(store: DataFrame, repo: str, fresh: DataFrame) -> DataFrame:
    """Append mode: the repository's facts are replaced, the others stay."""
    return store.filter(~F.col("repo").eqNullSafe(F.lit(repo))).unionByName(fresh)


def without_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def only_common(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Rows of both frames whose ``column`` occurs on both sides, tagged by side."""
    common = a.select(column).intersect(b.select(column))
    return a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b"))).join(common, column, "left_semi")


def spillover(predicted: DataFrame, actual: DataFrame) -> DataFrame:
    """``name, bucket``: matched, unrealised (predicted only) or spillover (actual only)."""
    p = predicted.select("name").distinct().withColumn("_p", F.lit(1))
    a = actual.select("name").distinct().withColumn("_a", F.lit(1))
    return p.join(a, "name", "full_outer").select("name", F.when(F.col("_a").isNull(), "unrealised").when(F.col("_p").isNull(), "spillover").otherwise("matched").alias("bucket"))


def merged_history(local: DataFrame, shared: DataFrame) -> DataFrame:
    """Revisions of both logs once, with where they came from."""
    both = local.withColumn("origin", F.lit("local")).unionByName(shared.withColumn("origin", F.lit("shared")))
    return both.groupBy("revision_id").agg(F.min("at").alias("at"), F.array_sort(F.collect_set("origin")).alias("origins"))


def set_prop(facts: DataFrame, condition: Column, key: str, value: Column) -> DataFrame:
    """Facts that meet a condition get the property, over an older value."""
    return facts.withColumn("props", F.when(condition, F.map_concat(F.map_filter("props", lambda k, _: k != key), F.create_map(F.lit(key), value))).otherwise(F.col("props")))
