"""The tools and the plug-in registry end to end on a hand-sized snapshot."""

import pytest
from factloom.api import Session
from factloom.operators.constraints import Component, Rule
from factloom.plugins import Registry, finding
from factloom.schema import FACTS
from pyspark.sql import functions as F


def fact(name, kind="symbol", symbol_kind="class", file="a/x.py", exported=True, relations=()):
    return ("r", kind, name, file, 1, 2, symbol_kind, exported, "python", {"k": "v"}, [(k, t, "symbol", None) for k, t in relations])


@pytest.fixture(scope="module")
def session(spark):
    rows = [
        fact("a", kind="module", symbol_kind=None, file="a"), fact("a.Big", relations=[("calls", "a.Small")]), fact("a.Big.run", symbol_kind="method", relations=[("calls", "b.Far")]),
        fact("a.Small", relations=[("calls", "a.Big")]), fact("b.Far", file="b/y.py"), fact("b.Alone", file="b/y.py", exported=False), fact("c.NewBig"),
    ]
    return Session(spark.createDataFrame(rows, FACTS), rules=[Rule("no_far", "forbid", Component(names=("a.*",)), Component(names=("b.*",)))])


def test_queries(session, spark):
    assert session.query_facts(kinds=["symbol"], name="BIG").first()["total"] == 3
    assert session.query_facts(prop="k", value="v").count() == 7
    assert {r["name"] for r in session.traverse("a.Big").collect()} == {"a.Big", "a.Small", "a.Big.run", "b.Far"}
    assert [r["name"] for r in session.find_path("a.Small", "b.Far").orderBy("step").collect()] == ["a.Small", "a.Big", "a.Big.run", "b.Far"]
    assert {r["depth"]: r["n"] for r in session.impact_analysis("b.Far").collect()} == {1: 1, 2: 1, 3: 1}
    assert [(r["subject"], r["object"]) for r in session.constraints().collect()] == [("a.Big.run", "b.Far")]
    assert session.constraints_for("a/x.py").first()["rule"] == "no_far"
    assert {r["name"] for r in session.find_orphans().filter("category = 'isolated'").collect()} == {"b.Alone", "c.NewBig"}
    assert session.snapshot_receipt().first()["facts"] == 7
    assert session.show_symbol("Alone").count() == 1
    session.set_baseline()
    assert session.diff_snapshot(["exported"]).count() == 0
    session.views("t_")
    assert spark.sql("select count(*) from t_facts").first()[0] == 7


def test_ambiguous_names_are_not_guessed(spark):
    s = Session(spark.createDataFrame([fact("a.Same"), fact("b.Same")], FACTS))
    with pytest.raises(LookupError):
        s.traverse("Same")


def test_plugins(spark):
    registry = Registry()
    registry.add("extractors", "lines", lambda file, content: [{"repo": "r", "kind": "symbol", "name": w, "file": file, "line": 1} for w in content.split()])
    registry.add("annotators", "mark", lambda f: f.withColumn("props", F.create_map(F.lit("seen"), F.lit("yes"))))
    registry.add("explainers", "all", lambda f, e: f.select(*finding(F.col("name"), confidence=0.7, file=F.col("file"))))
    registry.add("binders", "upper", lambda f: f.withColumn("name", F.upper("name")), stage="pre")
    with pytest.raises(ValueError):
        registry.add("explainers", "all", lambda f, e: f)
    files = spark.createDataFrame([("a.txt", "x y"), ("b.txt", "")], "file string, content string")
    facts = registry.annotate(registry.bind("pre", registry.extract(files)))
    assert sorted(r["name"] for r in facts.collect()) == ["X", "Y"] and facts.first()["props"] == {"seen": "yes"}
    found = registry.explain(facts, facts)
    assert sorted((r["source"], r["title"]) for r in found.collect()) == [("all", "X"), ("all", "Y")]
