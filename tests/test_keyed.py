"""The graph by whole numbers: the same edges as by name, in tasks of bounded size."""

from factloom.operators import constraints
from factloom.plans import catalog
from factloom.sources import driver_tables

SF = "/root/testdata/sf0.001"


def test_named_numbers_are_the_edges(spark):
    t = driver_tables.Tables(spark, SF)
    keyed = t.keyed_edges(repos=True)
    assert {dict(keyed.dtypes)[c] for c in ("src", "dst")} == {"bigint"}
    got = t.named(keyed, "src", "dst").select("rel", "src_kind", "src", "dst", "repo")
    assert sorted(got.collect()) == sorted(t.edges().select("rel", "src_kind", "src", "dst", "repo").collect())


def test_no_name_is_shuffled_to_count_edges(spark):
    lines = catalog.QUERIES["g1_edges"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    calls = next(i for i, x in enumerate(lines) if "calls AS rel" in x)
    assert not any("concat" in x for x in lines[calls : calls + 12])


def test_a_task_holds_a_bounded_share(spark, monkeypatch):
    monkeypatch.setattr(driver_tables, "LINES_A_TASK", 100)
    keyed = driver_tables.Tables(spark, SF).keyed_edges("calls")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert keyed.rdd.getNumPartitions() >= lines // 100
    assert keyed.count() == keyed.distinct().count() == catalog.QUERIES["g5_dedup"](spark, SF).first()["n"]


def test_consumers_of_unknown_home(spark):
    facts = spark.createDataFrame([("s", "class", r, n) for r, n in (("A", "used"), ("A", "at home"), ("A", "alone"), (None, "homeless"))], "kind string, symbol_kind string, repo string, name string")
    edges = spark.createDataFrame([("calls", "x", d, r) for d, r in (("used", "A"), ("used", "B"), ("at home", "A"), ("homeless", "B"), ("at home", None))], "rel string, src string, dst string, repo string")
    facts = facts.unionByName(spark.createDataFrame([("s", "other", "B", "b")], facts.schema))
    rule = constraints.Rule("r", "require_consumer", constraints.Component(where={"symbol_kind": "class"}))
    assert sorted(r["subject"] for r in constraints.require_consumer(rule, facts, edges).collect()) == ["alone", "at home", "homeless"]
