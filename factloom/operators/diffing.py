"""Snapshot diffs, finding buckets, the gate, and rule mining."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import title_key
from . import aggregates, joins, traversal

EXIT = {"clean": 0, "regression": 1, "usage": 2, "incomparable": 3}


def diff_facts(old: DataFrame, new: DataFrame, values: list[str]) -> DataFrame:
    """Facts added, removed or changed by kind, repository, file and name; repeated keys are paired in order."""
    out = joins.keyed_diff(old, new, ["kind", "repo", "file", "name"], values, ["line", *values])
    return out.filter("status <> 'same'")


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    keys = ["repo", "src", "rel", "dst"]
    gone = aggregates.without_keys(old.select(*keys).distinct(), new, keys).withColumn("status", F.lit("removed"))
    return aggregates.without_keys(new.select(*keys).distinct(), old, keys).withColumn("status", F.lit("added")).unionByName(gone)


def diff_findings(old: DataFrame, new: DataFrame, touched: DataFrame) -> DataFrame:
    """Findings by source and number-free title: new, resolved, or changed; incidental where no touched name is in the title."""
    key = ["source", "key"]
    a = old.withColumn("key", title_key(F.col("title"))).groupBy(*key).agg(F.max("title").alias("old_title"), F.max("confidence").alias("old_confidence"))
    b = new.withColumn("key", title_key(F.col("title"))).groupBy(*key).agg(F.max("title").alias("new_title"), F.max("confidence").alias("confidence"))
    both = a.join(b, key, "full_outer").withColumn("title", F.coalesce("new_title", "old_title"))
    words = both.select("source", "key", F.explode(F.split("title", r"[\s,:()]+")).alias("name"))
    hit = words.join(touched.select("name").distinct(), "name", "left_semi").select(*key).distinct().withColumn("_hit", F.lit(True))
    bucket = (
        F.when(F.col("old_title").isNull(), F.when(F.col("_hit"), "new").otherwise("new_incidental"))
        .when(F.col("new_title").isNull(), F.when(F.col("_hit"), "resolved").otherwise("resolved_incidental"))
        .when(F.col("old_title") != F.col("new_title"), "changed")
        .otherwise("same")
    )
    return both.join(hit, key, "left").select("source", "title", F.coalesce("confidence", "old_confidence").alias("confidence"), bucket.alias("bucket"))


def comparability(old: dict, new: dict) -> list[tuple[str, bool]]:
    """Warnings between two snapshots' metadata: (kind, whether it invalidates the comparison)."""
    out = []
    for key, hard in (("schema_version", True), ("extractors", True), ("explainers", False), ("version", False), ("config_hash", False), ("root", True), ("file_set_hash", False), ("providers", False)):
        if old.get(key) != new.get(key):
            out.append((key, hard))
    if new.get("parse_errors", 0) > old.get("parse_errors", 0):
        out.append(("parse_errors", False))
    if new.get("partial"):
        out.append(("partial", True))
    return out


def focus(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows of which any column mentions a term."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(term.lower()))
    return df.filter(hit)


def compare_receipts(old: DataFrame, new: DataFrame, *, worse_up: tuple[str, ...] = ()) -> DataFrame:
    """``metric, old, new, delta, regression`` of two receipts(metric, value)."""
    both = old.withColumnRenamed("value", "old").join(new.withColumnRenamed("value", "new"), "metric", "full_outer")
    delta = F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))
    return both.select("metric", "old", "new", delta.alias("delta"), (F.col("metric").isin(*worse_up) & (delta > 0)).alias("regression"))


@dataclass(frozen=True)
class Policy:
    fail_sources: tuple[str, ...] = ("cycles", "layers", "constraints")
    least_confidence: float = 1.0
    suppressed: tuple[str, ...] = ()
    exempt: tuple[str, ...] = ()
    thresholds: dict[str, int] = field(default_factory=dict)
    strict: bool = False


def grade(findings: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Each new finding as failing, warning, suppressed, exempt or informational."""
    key = title_key(F.col("title"))
    none = F.lit(False)
    fails = F.col("source").isin(*policy.fail_sources) & (F.col("confidence") >= policy.least_confidence) | F.lit(policy.strict)
    verdict = (
        F.when(F.col("informational"), "informational")
        .when(key.isin(*policy.suppressed) if policy.suppressed else none, "suppressed")
        .when(F.col("source").isin(*policy.exempt) if policy.exempt else none, "exempt")
        .when(fails, "fail")
        .otherwise("warn")
    )
    return findings.withColumn("verdict", verdict)


def gate(findings: DataFrame, policy: Policy = Policy(), *, warnings: list[tuple[str, bool]] = ()) -> tuple[str, int]:
    """The gate's status and exit code: incomparable before regression before clean; thresholds cap each source's warnings."""
    if any(hard for _, hard in warnings):
        return "incomparable", EXIT["incomparable"]
    rows = grade(findings, policy).filter("verdict in ('fail', 'warn')").groupBy("source", "verdict").agg(F.count("*").alias("n")).collect()
    failed = any(r["verdict"] == "fail" or r["n"] > policy.thresholds.get(r["source"], 1 << 60) for r in rows)
    status = "regression" if failed else "clean"
    return status, EXIT[status]


def ledger(findings: DataFrame, waivers: DataFrame, at: str) -> DataFrame:
    """Findings with their waiver, valid until its day: waivers(source, key, until)."""
    keyed = findings.withColumn("key", title_key(F.col("title")))
    return keyed.join(waivers, ["source", "key"], "left").withColumn("waived", F.col("until").isNotNull() & (F.to_date("until") >= F.to_date(F.lit(at)))).drop("key")


def reviewers(touched: DataFrame, shares: DataFrame, *, most: int = 2) -> DataFrame:
    """The authors with the largest share of each touched module."""
    return aggregates.top_per(shares.join(touched.select("module").distinct(), "module", "left_semi"), ["module"], most, F.desc("n"), "author").select("module", "author", "n", "rank")


def conformance(edges: DataFrame, seeds: DataFrame, changed: DataFrame, *, depth: int = 3) -> DataFrame:
    """What the baseline graph predicts a change to touch, against what it touched: ``name, bucket``."""
    predicted = traversal.walk(edges, seeds, direction="reverse", depth=depth, limit=10).filter("depth > 0").select("name")
    return aggregates.spillover(predicted, changed)


def match_ratio(buckets: DataFrame) -> DataFrame:
    n = lambda b: F.sum(F.when(F.col("bucket") == b, 1).otherwise(0))
    return buckets.agg(n("matched").alias("matched"), n("unrealised").alias("unrealised"), n("spillover").alias("spillover")).withColumn("match_ratio", F.round(F.when(F.col("matched") + F.col("spillover") > 0, F.col("matched") / (F.col("matched") + F.col("spillover"))).otherwise(1.0), 6))


def mine_props(facts: DataFrame, props: list[str], *, support: int = 10, confidence: float = 0.9, exceptions: int = 20) -> DataFrame:
    """Rules ``if a = x then b = y`` between a few named properties: ``antecedent, consequent, support, matched, confidence, score``.

    A rule needs ten cases, nine in ten of them right and at most twenty
    exceptions, and must beat the consequent's base rate; equal properties or
    equal values say nothing.
    """
    total = facts.count()
    pairs = facts.select(F.monotonically_increasing_id().alias("_id"), *props).select("_id", F.explode(F.array(*(F.struct(F.lit(p).alias("prop"), F.col(p).cast("string").alias("value")) for p in props))).alias("x")).select("_id", "x.*").filter("value is not null")
    one = pairs.groupBy("prop", "value").agg(F.count("*").alias("n"))
    wide = facts.select(*(F.col(p).cast("string").alias(p) for p in props))
    out = None
    for a in props:  # a named few, never the data
        for b in props:
            if a != b:
                both = wide.filter(f"`{a}` is not null and `{b}` is not null").groupBy(F.col(a).alias("av"), F.col(b).alias("bv")).agg(F.count("*").alias("matched")).select(F.lit(a).alias("ap"), "av", F.lit(b).alias("bp"), "bv", "matched")
                out = both if out is None else out.unionByName(both)
    ants = one.select(F.col("prop").alias("ap"), F.col("value").alias("av"), F.col("n").alias("support"))
    base = one.select(F.col("prop").alias("bp"), F.col("value").alias("bv"), (F.col("n") / total).alias("rate"))
    rules = out.filter("av <> bv").join(ants, ["ap", "av"]).join(base, ["bp", "bv"]).withColumn("confidence", F.col("matched") / F.col("support"))
    kept = rules.filter((F.col("support") >= support) & (F.col("confidence") >= confidence) & (F.col("support") - F.col("matched") <= exceptions) & (F.col("rate") < confidence) & (F.col("confidence") > F.col("rate")))
    text = lambda p, v: F.concat(F.col(p), F.lit("="), F.col(v))
    return kept.select(text("ap", "av").alias("antecedent"), text("bp", "bv").alias("consequent"), "support", "matched", F.round("confidence", 6).alias("confidence"), F.round(F.col("confidence") * F.col("support"), 4).alias("score"))


def mine_edges(edges: DataFrame, clusters: DataFrame, *, support: int = 10, confidence: float = 0.9) -> DataFrame:
    """Clusters whose edges of one kind almost never (or almost only) land in another: ``via, from, to, total, landed, form``.

    ``clusters(name, cluster)``; only edges between known, different clusters count, once each.
    """
    a, b = clusters.select(F.col("name").alias("src"), F.col("cluster").alias("from")), clusters.select(F.col("name").alias("dst"), F.col("cluster").alias("to"))
    crossing = edges.select("rel", "src", "dst").distinct().join(a, "src").join(b, "dst").filter("`from` <> `to`")
    landed = crossing.groupBy(F.col("rel").alias("via"), "from", "to").agg(F.count("*").alias("landed"))
    total = crossing.groupBy(F.col("rel").alias("via"), "from").agg(F.count("*").alias("total"))
    share = F.col("landed") / F.col("total")
    out = landed.join(total, ["via", "from"]).filter(F.col("total") >= support)
    form = F.when(share >= confidence, "allow").when(share <= 1 - confidence, "forbid")
    return out.withColumn("form", form).filter("form is not null").select("via", "from", "to", "total", "landed", "form")


def mine_names(facts: DataFrame, groups: str, *, support: int = 10, confidence: float = 0.9) -> DataFrame:
    """The suffix word that most short names of a group share."""
    from ..functions.names import camel_parts, short_name

    words = facts.select(F.col(groups).alias("grp"), F.element_at(camel_parts(short_name(F.col("name"))), -1).alias("word")).filter("word is not null")
    by = words.groupBy("grp", "word").agg(F.count("*").alias("n"))
    total = words.groupBy("grp").agg(F.count("*").alias("total"))
    return by.join(total, "grp").filter((F.col("total") >= support) & (F.col("n") / F.col("total") >= confidence))


def plan_check(facts: DataFrame, patch: DataFrame, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a patch to the facts would change in an evaluation: patch(op, + fact columns); violations gained and lost."""
    cols = facts.columns
    removed = patch.filter("op = '-'").select("name", "file").distinct()
    after = facts.join(removed, ["name", "file"], "left_anti").select(*cols).unionByName(patch.filter("op = '+'").select(*cols))
    before, now = evaluate(facts), evaluate(after)
    gained = now.exceptAll(before).withColumn("change", F.lit("gained"))
    return gained.unionByName(before.exceptAll(now).withColumn("change", F.lit("lost")))
