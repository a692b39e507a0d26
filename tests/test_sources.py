"""Scans, sinks, history, gate and set operations on small frames."""

import json

from factloom.operators import aggregates, diffing, history, linking
from factloom.schema import FACTS
from factloom.sources import facts_io
from pyspark.sql import functions as F


def test_facts_round_trip(spark, tmp_path):
    rows = [{"repo": "r", "kind": "symbol", "name": f"n{i}", "file": "a.py", "line": i, "props": {"k": "v"}, "relations": [{"kind": "calls", "target": "t"}]} for i in range(5)]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)) + '\nnot json\n{"kind": "nonsense", "name": "x"}\n{"kind": "symbol"}\n')
    good, bad = facts_io.validated(facts_io.read_facts(spark, str(tmp_path / "in.jsonl")))
    assert good.count() == 5
    assert sorted(r["reason"] for r in bad.collect()) == ["no kind", "no name", "unknown kind"]
    facts_io.write_facts(good, str(tmp_path / "out"))
    again = facts_io.read_facts(spark, str(tmp_path / "out"))
    assert again.select("name", "line", "relations").exceptAll(good.select("name", "line", "relations")).count() == 0
    facts_io.write_snapshot(good, None, {"version": 1}, str(tmp_path / "snap"))
    facts_io.pin_baseline(spark, str(tmp_path / "snap"), str(tmp_path / "base"))
    back, meta = facts_io.read_snapshot(spark, str(tmp_path / "base"))
    assert back.count() == 5 and meta == {"version": 1}


def test_walk_repository(spark, tmp_path):
    (tmp_path / "src/vendor").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/vendor/b.py").write_text("y")
    got = {r["file"]: r["ignored"] for r in facts_io.walk_repository(spark, str(tmp_path), ignore=("**/vendor/**",)).collect()}
    assert got == {"src/a.py": False, "src/vendor/b.py": True}


def findings(spark, rows):
    ev = "array<struct<file:string,line:int,symbol:string,fact:string,detail:string>>"
    return spark.createDataFrame([(s, t, c, i, [("a/f.py", 3, "s", "", "")]) for s, t, c, i in rows], f"source string, title string, confidence double, informational boolean, evidence {ev}")


def test_gate_and_reports(spark):
    f = findings(spark, [("cycles", "Cycle of 3 modules", 1.0, False), ("hotspots", "Hot x", 0.7, False), ("cycles", "Known 5", 1.0, False), ("surface", "note", 1.0, True)])
    policy = diffing.Policy(suppressed=("Known #",))
    assert {r["title"]: r["verdict"] for r in diffing.grade(f, policy).collect()} == {"Cycle of 3 modules": "fail", "Hot x": "warn", "Known 5": "suppressed", "note": "informational"}
    assert diffing.gate(f, policy) == ("regression", 1)
    assert diffing.gate(f.filter("source = 'hotspots'"), policy) == ("clean", 0)
    assert diffing.gate(f.filter("source = 'hotspots'"), diffing.Policy(thresholds={"hotspots": 0})) == ("regression", 1)
    assert diffing.gate(f, policy, warnings=[("root", True)]) == ("incomparable", 3)
    assert diffing.comparability({"version": 1}, {"version": 2}) == [("version", False)]
    assert all("ruleId" in r["result"] for r in facts_io.sarif(f).collect())
    assert "::error file=a/f.py,line=3::Cycle of 3 modules" in [r["line"] for r in facts_io.annotations(f).collect()]
    assert facts_io.text_report(f).count() == 4
    page = facts_io.context_page(spark.createDataFrame([("symbol",)], "kind string"), f)
    assert "- symbol: 1" in page and "Cycle of 3" in page


def test_finding_buckets(spark):
    old = findings(spark, [("a", "x has 3 users", 1.0, False), ("a", "gone", 1.0, False)])
    new = findings(spark, [("a", "x has 4 users", 1.0, False), ("b", "fresh y", 1.0, False)])
    touched = spark.createDataFrame([("y",)], "name string")
    got = {r["title"]: r["bucket"] for r in diffing.diff_findings(old, new, touched).collect()}
    assert got == {"x has 4 users": "changed", "gone": "resolved_incidental", "fresh y": "new"}


def test_history(spark):
    rows = [("r1", "2024-01-01", "a", 2), ("r1", "2024-01-01", "b", 1), ("r2", "2024-01-02", "a", 1), ("r3", "2024-01-03", "b", 1), ("r3", "2024-01-03", "a", 1)]
    revisions = spark.createDataFrame(rows, "revision_id string, at string, line string, n int").withColumn("at", F.to_timestamp("at"))
    patched = history.patches(revisions)
    got = sorted((r["revision_id"], r["line"], r["delta"]) for r in patched.collect())
    assert got == [("r1", "a", 2), ("r1", "b", 1), ("r2", "a", -1), ("r2", "b", -1), ("r3", "b", 1)]
    for rev in ("r1", "r2", "r3"):
        want = sorted((line, n) for r, _, line, n in rows if r == rev)
        assert sorted((r["line"], r["n"]) for r in history.restore(patched, rev).collect()) == want
    assert {r["line"]: (r["introduced"], r["added"], r["removed"], r["present"]) for r in history.blame(patched, "b").collect()} == {"b": ("r1", 2, 1, True)}
    log = spark.createDataFrame([("1", "main", "2024-01-01 01:00:00"), ("2", "main", "2024-01-01 02:00:00"), ("3", "dev", "2024-02-01 00:00:00")], "revision_id string, branch string, at string").withColumn("at", F.to_timestamp("at"))
    assert sorted(r["revision_id"] for r in history.thinned(log, "2024-01-15").collect()) == ["2", "3"]
    assert history.at_date(log, "2024-01-01 01:30:00").first()["revision_id"] == "1"
    assert {r["branch"]: r["lane"] for r in history.log_graph(log).collect()} == {"main": 0, "dev": 1}


def test_plan_check_and_binders(spark):
    facts = spark.createDataFrame([("a", "f"), ("b", "f")], "name string, file string")
    patch = spark.createDataFrame([("-", "a", "f"), ("+", "bad", "g")], "op string, name string, file string")
    got = {(r["name"], r["change"]) for r in diffing.plan_check(facts, patch, lambda df: df.filter("name in ('a', 'bad')").select("name")).collect()}
    assert got == {("bad", "gained"), ("a", "lost")}
    routes = spark.createDataFrame([("r", "show"), ("s", "gone")], "route string, handler string")
    symbols = spark.createDataFrame([("X.show",), ("Y.other",)], "name string")
    assert {r["route"]: r["symbol"] for r in linking.handlers(routes, symbols).collect()} == {"r": "X.show", "s": None}
    props = spark.createDataFrame([("a", {"k": "old"})], "name string, props map<string,string>")
    assert aggregates.set_prop(props, F.col("name") == "a", "k", F.lit("new")).first()["props"] == {"k": "new"}


def test_schema_parses(spark):
    assert spark.createDataFrame([], FACTS).columns[0] == "repo"
