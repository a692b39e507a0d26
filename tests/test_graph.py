"""Walks, components and chains against plain Python on random graphs; order of input rows makes no difference."""

import random
from collections import deque

import pytest
from factloom.operators import components, traversal


def graph(seed, n=14, m=24):
    rnd = random.Random(seed)
    return sorted({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)})


def frame(spark, pairs):
    return spark.createDataFrame([(a, "symbol", "calls", b, "symbol") for a, b in pairs], "src string, src_kind string, rel string, dst string, dst_kind string")


def reach(pairs, start):
    seen, queue = {start: 0}, deque([start])
    while queue:
        a = queue.popleft()
        for x, b in pairs:
            if x == a and b not in seen:
                seen[b] = seen[a] + 1
                queue.append(b)
    return seen


def sccs(pairs):
    nodes = {x for p in pairs for x in p}
    at = {n: reach(pairs, n) for n in nodes}
    return {n: min(m for m in nodes if m in at[n] and n in at[m]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_and_path(spark, seed):
    pairs = graph(seed)
    start = pairs[0][0]
    want = reach(pairs, start)
    random.Random(seed).shuffle(pairs)
    edges = frame(spark, pairs)
    got = {r["name"]: r["depth"] for r in traversal.walk(edges, spark.createDataFrame([(start,)], "name string"), depth=20).collect()}
    assert got == want
    goal = max(want, key=lambda n: (want[n], n))
    path = [r["name"] for r in traversal.find_path(edges, start, goal, depth=20).orderBy("step").collect()]
    assert len(path) == want[goal] + 1 and path[0] == start and path[-1] == goal
    assert all((a, b) in set(pairs) for a, b in zip(path, path[1:]))
    assert traversal.find_path(edges, start, "missing").count() == 0
    assert traversal.find_path(edges, start, start).count() == 1


@pytest.mark.parametrize(("seed", "small"), [(3, 10**6), (4, 10**6), (5, 0)])
def test_components_and_chains(spark, seed, small):
    pairs = graph(seed) if small else graph(seed, 5, 6)
    edges = frame(spark, pairs)
    want = sccs(pairs)
    assert {r["name"]: r["component"] for r in components.strongly_connected(edges, small=small).collect()} == want
    size = {c: sum(v == c for v in want.values()) for c in want.values()}
    weight = {c: 0 if s > components.LARGE else s for c, s in size.items()}

    def depth(c):
        if size[c] > components.LARGE:
            return 0
        after = {want[b] for a, b in pairs if want[a] == c and want[b] != c}
        return weight[c] + max(map(depth, after), default=0)

    assert {r["component"]: r["depth"] for r in components.longest_chains(edges, small=small).collect()} == {c: depth(c) for c in size}


def test_caps_hide_but_do_not_stop(spark):
    edges = frame(spark, [("hub", f"leaf{i:03}") for i in range(150)] + [("leaf149", "far")])
    facts = edges.selectExpr("dst as name", "'symbol' as kind").unionByName(spark.createDataFrame([("hub", "symbol")], "name string, kind string"))
    seeds = spark.createDataFrame([("hub",), ("nowhere",)], "name string")
    shown = traversal.traverse(edges, facts, seeds, nodes=100).collect()
    assert len(shown) == 100 and all(r["truncated"] for r in shown)
    assert {r["name"]: r["kind"] for r in shown}["nowhere"] == "unresolved"
    assert traversal.walk(edges, seeds).filter("name = 'far'").count() == 1
    assert {r["depth"]: r["n"] for r in traversal.impact(edges, spark.createDataFrame([("far",)], "name string")).collect()} == {1: 1, 2: 1}


def depths(own, calls):
    """Own depth and the deepest callee's; calls within a cycle count the callee's own depth."""
    same, memo = sccs(calls), {}

    def of(n):
        if n not in memo:
            inner = [own[b] if same[a] == same[b] else of(b) for a, b in calls if a == n and b in own] if own[n] else []
            memo[n] = own[n] + max(inner, default=0)
        return memo[n]

    return {n: of(n) for n in own}


def test_effective_depth(spark):
    cases = [({"a": 1, "b": 2, "c": 0, "d": 1, "x": 1, "y": 1}, [("a", "b"), ("c", "b"), ("d", "d"), ("x", "y"), ("y", "x"), ("a", "gone")])]
    cases.append(({f"m{i}": 1 for i in range(9)}, [(f"m{i}", f"m{i + 1}") for i in range(8)]))
    rnd = random.Random(5)
    cases.append(({f"n{i:02}": rnd.randrange(3) for i in range(14)}, [p for p in graph(6)]))
    for own, calls in cases:
        got = components.effective_depth(spark.createDataFrame(list(own.items()), "name string, depth int"), spark.createDataFrame(calls, "src string, dst string"), small=0)
        assert {r["name"]: r["effective"] for r in got.collect()} == depths(own, [c for c in calls if own.get(c[0])])
    assert depths(cases[0][0], cases[0][1]) == {"a": 3, "b": 2, "c": 0, "d": 2, "x": 2, "y": 2} and depths(*cases[1])["m0"] == 9


def test_distributed_components_of_long_paths_and_rings(spark):
    """No round limit leaves nodes out: a path, a ring, rings on a path, and single nodes, without the one-task shortcut until few edges are left."""
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(150)]
    ring = [(f"r{i:03}", f"r{(i + 1) % 80:03}") for i in range(80)]
    mixed = [("p140", "p130"), ("p020", "r000"), ("s", "s"), ("t", "p000")]
    pairs = path + ring + mixed
    random.Random(1).shuffle(pairs)
    got = {r["name"]: r["component"] for r in components.strongly_connected(frame(spark, pairs), small=20).collect()}
    want = {x: x for p in pairs for x in p} | {f"r{i:03}": "r000" for i in range(80)} | {f"p{i}": "p130" for i in range(130, 141)}
    assert got == want
