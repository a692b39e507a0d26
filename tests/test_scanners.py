"""GraphQL heads and folded literals."""

from factloom.functions import scanners


def test_operation_heads(spark):
    text = '''# query Commented { no }
query Users($id: ID!, $f: F = {a: "x"}) @live(if: true) {
  user: account(id: $id) { name }
}
  mutation { save(x: 1) }
"""
query Described { inside }
"""
subscription Feed, { }
not query Here { x }
queryish { y }
'''
    df = spark.createDataFrame([(text,), (None,), ("",)], "text string")
    got = [r["h"] for r in df.select(scanners.operation_heads(df["text"]).alias("h")).collect()]
    assert [tuple(x) for x in got[0]] == [("query", "Users", "account"), ("mutation", "", "save"), ("subscription", "Feed", "")]
    assert got[1] == got[2] == []


def test_folded_literals(spark):
    assigned = spark.createDataFrame([("a", "BASE", "/api"), ("a", "TWICE", "/x"), ("a", "TWICE", "/y"), ("a", "CALL", ""), ("b", "BASE", "/other")], "file string, name string, literal string")
    wanted = {"BASE": "/api", "TWICE": None, "CALL": None, 'build_url("/pageview")': "/pageview", "find!('name')": None, "`${host}/users/${id}/x`": "/users/{}/x", "`/plain`": None, "NONE": None}
    df = spark.createDataFrame([("a", e) for e in wanted], "file string, expression string")
    assert {r["expression"]: r["literal"] for r in scanners.folded(df, assigned).collect()} == wanted
