"""What counts as unreferenced, and what recursion costs."""

from factloom.operators import explainers


def test_unreferenced(spark):
    rows = [
        ("a.f", "function", "a/f.go"), ("a.used", "function", "a/u.go"), ("a.self", "function", "a/s.go"), ("a.by_test", "method", "a/b.go"), ("a.v", "variable", "a/v.go"),
        ("t.help", "function", "a/f_test.go"), ("m.Up", "class", "db/migrate/1.rb"), ("a.T", "struct", "a/t.go"), ("a.none", None, "a/n.go"),
    ]
    facts = spark.createDataFrame([("symbol", *r) for r in rows], "kind string, name string, symbol_kind string, file string")
    edges = spark.createDataFrame(
        [("a.f", "calls", "a.used", "a/f.go"), ("a.self", "calls", "a.self", "a/s.go"), ("t.help", "calls", "a.by_test", "a/f_test.go"), ("a", "declares", "a.T", "a/t.go")],
        "src string, rel string, dst string, src_file string",
    )
    got = {r["name"]: (r["category"], r["confidence"]) for r in explainers.unreferenced(facts, edges).collect()}
    assert got == {"a.f": ("unreferenced", "high"), "a.self": ("unreferenced", "high"), "a.by_test": ("test_only", "low"), "a.T": ("isolated", "medium"), "a.none": ("isolated", "low")}


def test_risk_follows_the_order_of_growth(spark):
    methods = spark.createDataFrame([("one", 1), ("four", 4), ("six", 6), ("again", 0)], "name string, loop_depth int")
    calls = spark.createDataFrame([("one", "four")], "src string, dst string")
    got = {(r["name"], r["finding"]): (r["confidence"], r["risk"]) for r in explainers.performance(methods, calls, recursive=methods.filter("name = 'again'"), handlers=methods.filter("name = 'four'")).collect()}
    assert got[("four", "nested-loop")] == (0.5, 2.6) and got[("six", "nested-loop")] == (0.35, 2.1)
    assert got[("one", "compounded")] == (0.5, 2.0) and got[("again", "recursion")] == (0.5, 1.25)
