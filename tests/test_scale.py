"""Work that must not grow faster than its input."""

from factloom.operators import components, joins


def plan(df):
    """The lines of the optimised plan, from its root."""
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_operations_of_many_repeats_meet_once(spark):
    clients = spark.range(3000).selectExpr("'op' || id % 1 as operation", "'a' || id % 2 as repo")
    servers = spark.range(3000).selectExpr("'op' || id % 1 as operation", "'a' || id % 3 as repo")
    df = joins.operations(clients, servers)
    assert sorted((r["client_repo"], r["server_repo"]) for r in df.collect()) == [("a0", "a1"), ("a0", "a2"), ("a1", "a0"), ("a1", "a2")]
    lines = plan(df)
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert sum("Aggregate" in x for x in lines[join:]) == 2 and not any("Aggregate" in x for x in lines[:join])


def test_graphs_of_many_edges_are_solved_without_rounds(spark, monkeypatch):
    """400,000 edges of rings with tails, more than one task once took: no round is begun, in components or in chains."""
    n = 400_000
    edges = spark.range(n).selectExpr("'n' || id as src", "'n' || case when id % 4 = 2 then id - 2 else id + 1 end as dst")
    monkeypatch.setattr(components, "_least", None)
    found = components.strongly_connected(edges).selectExpr("cast(substring(name, 2) as long) as k", "cast(substring(component, 2) as long) as c")
    assert found.filter(f"k % 4 < 3 and k < {n}").groupBy("c").count().groupBy("count").count().collect() == [(3, n // 4)]
    assert found.filter(f"(k % 4 = 3 or k = {n}) and c <> k").isEmpty() and found.count() == n + 1
    path = spark.range(n).selectExpr("'n' || id as src", "'n' || (id + 1) as dst")
    assert components.longest_chains(path).agg({"depth": "max", "weight": "sum"}).first() == (n + 1, n + 1)
