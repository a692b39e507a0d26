"""Declared rules over components: each form gives violation rows ``rule, subject, object``.

A component is a where-predicate and/or name and path patterns over facts.
A rule that can't be judged gives one notice row instead of a silent pass.
Where facts have a number ``id``, the ends of the edges are such numbers, and so are
the subjects and objects that stand for ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import cut
from ..functions.names import ancestors, glob_regex, short_name
from . import components, traversal
from .filters import where

VIAS = ("calls", "depends_on", "implements", "imports")


@dataclass(frozen=True)
class Component:
    where: dict[str, str] = field(default_factory=dict)
    paths: tuple[str, ...] = ()
    names: tuple[str, ...] = ()

    def members(self, facts: DataFrame) -> DataFrame:
        out = facts.filter(where(self.where)) if self.where else facts
        for column, patterns in (("file", self.paths), ("name", self.names)):
            if patterns:
                out = out.filter(F.col(column).rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)))
        return out


@dataclass(frozen=True)
class Rule:
    id: str
    form: str
    subject: Component
    to: Component | None = None
    via: str = "calls"
    only: tuple[Component, ...] = ()
    owners: tuple[Component, ...] = ()
    steps: tuple[Component, ...] = ()
    pattern: str = ""
    most: int = 0
    prop: str = ""
    value: str = ""
    when_prop: str = ""
    when_value: str = ""
    inbound: bool = False
    exempt: tuple[str, ...] = ()
    mode: str = "strict"


def _rows(df: DataFrame, rule: Rule, subject: str = "name", target: str | None = None) -> DataFrame:
    out = df.select(F.lit(rule.id).alias("rule"), F.col(subject).alias("subject"), (F.col(target) if target else F.lit("")).alias("object")).distinct()
    return out.filter(~F.col("subject").isin(*rule.exempt)) if rule.exempt else out


def _names(df: DataFrame, alias: str) -> DataFrame:
    return df.select(F.col("id" if "id" in df.columns else "name").alias(alias)).distinct()


def _edges(rule: Rule, edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("rel") == rule.via).select("src", "dst").distinct()


def forbid(rule, facts, edges):
    """An edge from the subject to the target."""
    a, b = _names(rule.subject.members(facts), "src"), _names(rule.to.members(facts), "dst")
    return _rows(_edges(rule, edges).join(a, "src", "left_semi").join(b, "dst", "left_semi"), rule, "src", "dst")


def forbid_reach(rule, facts, edges):
    """Any path from the subject to the target, of any length and from any number of members.

    Only steps that can still lead to the target are walked: what reaches it is found
    first, in one walk backward.
    """
    members, target = rule.subject.members(facts), rule.to.members(facts)
    leading = cut(traversal.walk(edges, target, direction="reverse", rels=[rule.via], depth=None).select("name"))
    led = edges.join(leading.withColumnRenamed("name", "src"), "src", "left_semi").join(leading.withColumnRenamed("name", "dst"), "dst", "left_semi")
    reached = traversal.closures(led, members.join(leading, "name", "left_semi"), rels=[rule.via]).filter("depth > 0")
    return _rows(reached.join(_names(rule.to.members(facts), "name"), "name", "left_semi"), rule, "root", "name")


def allow(rule, facts, edges):
    """An edge from the subject to a known name outside the subject and the allowed components."""
    known = _names(facts, "dst")
    out = edges.filter(F.col("rel") == rule.via).select("src", "dst").join(_names(rule.subject.members(facts), "src"), "src", "left_semi").join(known, "dst", "left_semi")
    for c in (rule.subject, *rule.only):
        out = out.join(_names(c.members(facts), "dst"), "dst", "left_anti")
    return _rows(out, rule, "src", "dst")


def protect(rule, facts, edges):
    """An edge into the subject from outside it and its owners."""
    out = _edges(rule, edges).join(_names(rule.subject.members(facts), "dst"), "dst", "left_semi")
    for c in (rule.subject, *rule.owners):
        out = out.join(_names(c.members(facts), "src"), "src", "left_anti")
    return _rows(out, rule, "src", "dst")


def private(rule, facts, edges):
    """A member that isn't exported is reached from outside."""
    hidden = _names(rule.subject.members(facts).filter("not exported"), "dst")
    used = edges.filter(F.col("rel").isin(*VIAS)).select("src", "dst").join(hidden, "dst", "left_semi")  # _rows drops repeats of what is left
    for c in (rule.subject, *rule.only):
        used = used.join(_names(c.members(facts), "src"), "src", "left_anti")
    return _rows(used, rule, "src", "dst")


def forbid_fact(rule, facts, edges):
    return _rows(rule.subject.members(facts), rule)


def cap(rule, facts, edges):
    """Members beyond the cap, in the order of their names."""
    members = rule.subject.members(facts).select("name").distinct()
    kept = members.orderBy("name").limit(rule.most)
    return _rows(members.join(kept, "name", "left_anti"), rule)


def require(rule, facts, edges):
    """A member (to which ``when`` applies) lacks a property's value."""
    out = rule.subject.members(facts)
    if rule.when_prop:
        out = out.filter(where({rule.when_prop: rule.when_value or "<any>"}))
    return _rows(out.filter(~where({rule.prop: rule.value or "<any>"})), rule)


def require_edge(rule, facts, edges):
    """A member without an edge to (or from) the target."""
    near, far = ("dst", "src") if rule.inbound else ("src", "dst")
    having = _edges(rule, edges).join(_names(rule.to.members(facts), far), far, "left_semi").select(F.col(near).alias("name")).distinct()
    return _rows(rule.subject.members(facts).join(having, "name", "left_anti"), rule)


def require_defines(rule, facts, edges):
    """A class without a method of the short name ``value``."""
    having = edges.filter("rel = 'has_method'").filter(short_name(F.col("dst")) == rule.value).select(F.col("src").alias("name")).distinct()
    return _rows(rule.subject.members(facts).join(having, "name", "left_anti"), rule)


def forbid_cycles(rule, facts, edges):
    """Members on a cycle of the subject's own edges."""
    a, b = _names(rule.subject.members(facts), "src"), _names(rule.subject.members(facts), "dst")
    inner = _edges(rule, edges).join(a, "src", "left_semi").join(b, "dst", "left_semi")
    member = cut(components.strongly_connected(inner))
    several = member.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    found = member.join(several, "component", "left_semi")  # no component is gathered whole
    return _rows(found, rule, "name", "component")


def independent(rule, facts, edges):
    """A member that reaches a class of the target which includes (implements) it."""
    included = edges.filter("rel = 'implements'").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    if included.isEmpty():
        return notice(rule, facts, "no ancestry")
    a = _names(rule.subject.members(facts), "src")
    return _rows(_edges(rule, edges).join(a, "src", "left_semi").join(included, ["src", "dst"], "left_semi"), rule, "src", "dst")


def require_name(rule, facts, edges):
    return _rows(rule.subject.members(facts).filter(~short_name(F.col("name")).rlike(rule.pattern)), rule)


def forbid_name(rule, facts, edges):
    return _rows(rule.subject.members(facts).filter(short_name(F.col("name")).rlike(rule.pattern)), rule)


def protocol(rule, facts, edges):
    """A member that reaches a step without every earlier one; the object is the furthest step."""
    members = _names(rule.subject.members(facts), "src")
    out = None
    for k, step in enumerate(rule.steps, 1):
        hit = _edges(rule, edges).join(members, "src", "left_semi").join(_names(step.members(facts), "dst"), "dst", "left_semi").select("src", F.lit(k).alias("step"))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        return notice(rule, facts, "no steps")
    bad = out.groupBy("src").agg(F.count_distinct("step").alias("n"), F.max("step").alias("last")).filter("n < last")
    return _rows(bad.withColumn("last", F.col("last").cast("string")), rule, "src", "last")


def guide(rule, facts, edges):
    """No violation: one advisory row with whether an exemplar is present."""
    n = rule.subject.members(facts).agg(F.when(F.count("*") > 0, "present").otherwise("absent").alias("name"))
    return _rows(n, rule)


def storage_stays_home(rule, facts, edges):
    """A member calls or depends on a target (storage) that isn't in the subject."""
    a = _names(rule.subject.members(facts), "src")
    b = rule.to.members(facts).select("name").distinct().join(rule.subject.members(facts).select("name"), "name", "left_anti").withColumnRenamed("name", "dst")
    used = edges.filter(F.col("rel").isin("calls", "depends_on")).select("src", "dst").distinct()
    return _rows(used.join(a, "src", "left_semi").join(b, "dst", "left_semi"), rule, "src", "dst")


def cap_runtime(rule, facts, edges):
    """Members whose measure ``prop`` exceeds the cap; a notice where nothing was captured."""
    members = rule.subject.members(facts)
    if rule.prop not in facts.columns:
        return notice(rule, facts, "no capture")
    return _rows(members.filter(F.col(rule.prop) > rule.most), rule)


def require_consumer(rule, facts, edges):
    """A member that nothing in another repository uses; a notice with fewer than two repositories."""
    if facts.select("repo").distinct().limit(2).count() < 2:
        return notice(rule, facts, "one repository")
    # whether a user lives elsewhere shows in the least and the greatest of their repositories
    key = "id" if "id" in facts.columns else "name"
    users = edges.filter(F.col("rel") == rule.via).select(F.col("dst").alias(key), "repo").distinct().groupBy(key).agg(F.min("repo").alias("_lo"), F.max("repo").alias("_hi"))
    members = rule.subject.members(facts).join(users, key, "left")
    used = F.coalesce((F.col("_lo") != F.col("repo")) | (F.col("_hi") != F.col("repo")), F.lit(False))
    return _rows(members.filter(~used), rule)


def unique_across(rule, facts, edges):
    """A property's value that members of more than one repository declare."""
    by = rule.subject.members(facts).filter(F.col(rule.prop).isNotNull()).groupBy(F.col(rule.prop).cast("string").alias("name")).agg(F.count_distinct("repo").alias("n"))
    return _rows(by.filter("n > 1"), rule)


def require_governed(rule, facts, edges, anchors: DataFrame | None = None):
    """A member file that no anchor covers; a notice without anchors."""
    if anchors is None:
        return notice(rule, facts, "no pages")
    files = rule.subject.members(facts).select("file").distinct()
    covered = files.select("file", F.explode(ancestors(F.col("file"))).alias("path")).join(anchors.select("path").distinct(), "path", "left_semi").select("file").distinct()
    return _rows(files.join(covered, "file", "left_anti"), rule, "file")


def notice(rule, facts, why: str):
    spark = facts.sparkSession
    return spark.createDataFrame([(rule.id, "<unevaluable>", why)], "rule string, subject string, object string")


FORMS: dict[str, Callable] = {
    f.__name__: f
    for f in (
        forbid, forbid_reach, allow, protect, private, forbid_fact, cap, require, require_edge, require_defines, forbid_cycles, independent,
        require_name, forbid_name, protocol, guide, storage_stays_home, cap_runtime, require_consumer, unique_across, require_governed,
    )
}


def evaluate(rules: list[Rule], facts: DataFrame, edges: DataFrame, **more) -> DataFrame:
    """All rules' violations once each, with mode and confidence (advisory .6, notices .4)."""
    out = None
    for rule in rules:
        extra = {k: v for k, v in more.items() if k == "anchors"} if rule.form == "require_governed" else {}
        found = FORMS[rule.form](rule, facts, edges, **extra).withColumn("mode", F.lit(rule.mode))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return facts.sparkSession.createDataFrame([], "rule string, subject string, object string, mode string, confidence double")
    return out.distinct().withColumn("confidence", F.when(F.col("subject") == "<unevaluable>", 0.4).when(F.col("mode") == "advisory", 0.6).otherwise(1.0))


def contract_for(rules: list[Rule], facts: DataFrame, file: str) -> DataFrame:
    """The rules whose subject holds a fact of a file, with the subject's member count: ``rule, form, members``."""
    out = facts.sparkSession.createDataFrame([], "rule string, form string, members long")
    for rule in rules:
        members = rule.subject.members(facts)
        here = members.agg(F.count("*").alias("members"), F.max((F.col("file") == file).cast("int")).alias("_h")).filter("_h = 1")
        out = out.unionByName(here.select(F.lit(rule.id).alias("rule"), F.lit(rule.form).alias("form"), "members"))
    return out


def ranked_overflow(members: DataFrame, most: int) -> DataFrame:
    """Each repository's members beyond a cap."""
    return members.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy("name"))).filter(F.col("k") > most)
