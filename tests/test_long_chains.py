"""Closures run to an empty frontier: a chain of 30 hops with a cycle at its end."""

from factloom.operators import explainers, traversal
from factloom.streaming.protocol import invalidated

NAMES = [f"m{i:02}" for i in range(31)]
PAIRS = [*zip(NAMES, NAMES[1:], strict=False), (NAMES[-1], NAMES[-2])]


def test_closures_and_reach_of_30_hops(spark):
    edges = spark.createDataFrame([(a, b, "imports") for a, b in PAIRS], "src string, dst string, rel string")
    names = spark.createDataFrame([(n,) for n in [*NAMES, "lone"]], "name string")
    root = names.filter("name = 'm00'")
    row = explainers.import_closures(edges, root).first()
    assert (row["root"], row["size"], row["depth"]) == ("m00", 30, 30)
    assert {r["name"] for r in traversal.reached_from_roots(edges, names, root).filter("reached").collect()} == set(NAMES)
    assert {r["name"] for r in traversal.dominated(edges, "m00", "m01").collect()} == set(NAMES[2:])
    stale = invalidated(spark.createDataFrame([("m30",)], "file string"), edges.select("src", "dst"))
    assert {r["file"]: r["depth"] for r in stale.collect()} == {"m30": 0, "m29": 1} | {n: 30 - i for i, n in enumerate(NAMES[:29])}
