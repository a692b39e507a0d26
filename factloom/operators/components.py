"""Strongly connected components, longest chains and effective depths."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import cut

LARGE = 8
#: A graph, or what is left of it, is solved in one task once it has at most so many edges between distinct nodes, which come as 16 bytes each.
SMALL_EDGES = 8_000_000


def _least(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node the least label among the nodes that reach it: edges(a, b), nodes(name, label).

    Every node also keeps a pointer to some node that reaches it, and pointers
    are followed twice as far each round, so that on chains and rings the number of rounds grows
    with the logarithm of their length.  Runs until nothing changes.
    """
    labels = nodes.select(F.col("name").alias("a"), F.col("label").alias("_l"))
    before = edges.join(labels, "a").groupBy(F.col("b").alias("name")).agg(F.min(F.struct("_l", "a")).alias("m")).select("name", F.col("m.a").alias("at"))
    state = cut(nodes.join(before, "name", "left").select("name", "label", F.coalesce("at", "name").alias("at")))
    while True:
        offered = edges.join(state.select(F.col("name").alias("a"), F.col("label").alias("_l")), "a").groupBy(F.col("b").alias("name")).agg(F.min("_l").alias("offered"))
        ahead = state.select(F.col("name").alias("at"), F.col("label").alias("_far"), F.col("at").alias("_at"))
        now = state.join(offered, "name", "left").join(ahead, "at")
        now = cut(now.select("name", F.least("label", "offered", "_far").alias("label"), F.col("_at").alias("at"), (F.least("label", "offered", "_far") < F.col("label")).alias("moved")))
        state = now.drop("moved")
        if now.filter("moved").isEmpty():
            return state.select("name", "label")


def _places(arrays: list):
    """The distinct numbers of some arrays in order, and each array as places among them."""
    import numpy as np

    some, at = np.unique(np.concatenate(arrays), return_inverse=True)
    return some, np.split(at.astype(np.int32), np.cumsum([len(x) for x in arrays])[:-1])


def _rows_of(keys, others, n: int):
    """Where the rows of each of n keys begin (and the last end), and the others in the order of the keys."""
    from array import array

    import numpy as np

    starts = np.append(0, np.cumsum(np.bincount(keys, minlength=n))).astype(np.int32)
    return array("i", starts.tobytes()), array("i", others[np.argsort(keys, kind="stable")].astype(np.int32).tobytes())


def _tarjan(a, b) -> tuple:
    """The nodes of components of several nodes, each with one node of its component; no recursion, so chains may be long."""
    from array import array

    import numpy as np

    some, (a, b) = _places([a, b])
    while len(a):  # no component passes through a node without a way in or out
        ins, outs = np.zeros(len(some), bool), np.zeros(len(some), bool)
        ins[b], outs[a] = True, True
        kept = ins[a] & outs[b]
        a, b, slow = a[kept], b[kept], 10 * np.count_nonzero(kept) > 9 * len(kept)
        if slow:
            break
    starts, to = _rows_of(a, b, len(some))
    index, low, at = (array("i", bytes(4 * len(some))) for _ in range(3))
    at[:] = starts[:-1]
    root = array("i", [-1]) * len(some)
    held, work, seen = [], [], 0
    for start in np.unique(a).tolist():
        if index[start]:
            continue
        seen += 1
        index[start] = low[start] = seen
        held.append(start), work.append(start)
        while work:
            node = work[-1]
            i = at[node]
            if i < starts[node + 1]:
                at[node], near = i + 1, to[i]
                if not index[near]:
                    seen += 1
                    index[near] = low[near] = seen
                    held.append(near), work.append(near)
                elif root[near] < 0 and index[near] < low[node]:
                    low[node] = index[near]
            else:
                work.pop()
                if work and low[node] < low[work[-1]]:
                    low[work[-1]] = low[node]
                if low[node] == index[node]:
                    while True:
                        near = held.pop()
                        root[near] = node
                        if near == node:
                            break
    root = np.array(root, np.int32)
    placed = np.flatnonzero(root >= 0)
    several = placed[np.bincount(root[placed], minlength=1)[root[placed]] > 1]
    return some[several], some[root[several]]


def _weigh(a, b, own, more) -> tuple:
    """The heaviest way from each node of an acyclic graph: a node ``a`` of a weight comes without ``b``, a step without weights."""
    from array import array

    import numpy as np

    step = b >= 0
    some, (node, x, y) = _places([a[~step], a[step], b[step]])
    best, added = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
    added[node], best[node] = own[~step], own[~step] + more[~step]
    starts, before = _rows_of(y, x, len(some))
    left = array("i", np.bincount(x, minlength=len(some)).astype(np.int32).tobytes())
    best, added = array("q", best.tobytes()), array("q", added.tobytes())
    ready = [i for i, n in enumerate(left) if not n]
    while ready:
        at = ready.pop()
        for i in range(starts[at], starts[at + 1]):
            prior = before[i]
            best[prior] = max(best[prior], added[prior] + best[at])
            left[prior] -= 1
            if not left[prior]:
                ready.append(prior)
    return some, np.array(best, np.int64)


def _in_one_task(rows: DataFrame, solve, schema: str) -> DataFrame:
    """Run a solver over the columns, all whole numbers, of a graph whose size was checked."""
    import numpy as np
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow, width = to_arrow_schema(_parse_datatype_string(schema)), len(rows.columns)

    def run(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches]
        found = solve(*(np.concatenate([p[i] for p in parts] or [np.zeros(0, np.int64)]) for i in range(width)))
        for at in range(0, len(found[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(f[at : at + 100_000], t.type) for f, t in zip(found, arrow, strict=True)], schema=arrow)

    return rows.coalesce(1).mapInArrow(run, schema)


def _distinct_pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).filter("a is not null and b is not null").distinct()


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``name, id`` of the nodes of ``edges(src, dst)``, and the distinct pairs ``a, b`` of different nodes as numbers."""
    graph = cut(_distinct_pairs(edges))
    named = graph.select(F.col("a").alias("name")).union(graph.select(F.col("b").alias("name"))).distinct()
    nodes = cut(named.select("name", F.monotonically_increasing_id().alias("id")))
    x, y = nodes.select(F.col("name").alias("a"), F.col("id").alias("_a")), nodes.select(F.col("name").alias("b"), F.col("id").alias("_b"))
    return nodes, cut(graph.filter("a <> b").join(x, "a").join(y, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def strongly_connected(edges: DataFrame, *, small: int = SMALL_EDGES) -> DataFrame:
    """``name, component``: each node of ``edges(src, dst)`` with the least name of its component.

    Nodes are numbered, and a graph of up to ``small`` edges is solved in one task.  In a
    larger one each round gives the nodes labels in a fresh random order and finds, for every
    node, the least label that reaches it and the least that it reaches.  Where
    both are one, the node is in that label's component; otherwise only edges between
    nodes with the same two labels can lie within a component.  Every part loses at
    least its least node, and parts halve as in a quicksort.  What remains is
    solved in one task as soon as ``small`` edges can hold it.
    """
    nodes, inner = _numbered(edges)
    found = None
    for turn in count():
        left = inner.limit(small + 1).count()
        if left > small:
            # no component passes through a node without a way in or out
            core = inner.select(F.col("a").alias("name")).intersect(inner.select(F.col("b").alias("name")))
            inner = cut(inner.join(core.withColumnRenamed("name", "a"), "a", "left_semi").join(core.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b"))
            left = inner.limit(small + 1).count()
        if left <= small:
            if left:
                solved = _in_one_task(inner, _tarjan, "id long, root long")
                found = solved if found is None else found.unionByName(solved)
            break
        ends = inner.select(F.col("a").alias("name")).union(inner.select(F.col("b").alias("name"))).distinct()
        labelled = cut(ends.select("name", F.struct(F.xxhash64("name", F.lit(turn)).alias("h"), "name").alias("label")))
        ahead = _least(inner, labelled).withColumnRenamed("label", "ahead")
        back = _least(inner.select(F.col("b").alias("a"), F.col("a").alias("b")), labelled).withColumnRenamed("label", "back")
        both = cut(ahead.join(back, "name"))
        done = both.filter("ahead = back").select(F.col("name").alias("id"), F.col("ahead.name").alias("root"))
        found = done if found is None else found.unionByName(done)
        part = both.filter("ahead <> back").select("name", F.struct("ahead", "back").alias("part"))
        x, y = part.select(F.col("name").alias("a"), F.col("part").alias("pa")), part.select(F.col("name").alias("b"), F.col("part").alias("pb"))
        inner = cut(inner.join(x, "a").join(y, "b").filter("pa = pb").select("a", "b"))
    if found is None:
        return nodes.select("name", F.col("name").alias("component"))
    placed = cut(nodes.join(found, "id"))  # those of other nodes are components of their own
    least = placed.groupBy("root").agg(F.min("name").alias("component"))
    member = placed.join(least, "root").select("id", "component")
    return nodes.join(member, "id", "left").select("name", F.coalesce("component", "name").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """Components of more than one node: ``component, size, members``; more than eight make a coupled cluster."""
    found = strongly_connected(edges).groupBy("component").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("name")).alias("members"))
    return found.filter("size > 1").withColumn("clustered", F.col("size") > LARGE)


def _heaviest(nodes: DataFrame, steps: DataFrame, small: int) -> DataFrame:
    """The heaviest way from each node of an acyclic graph: nodes(name, own, more), steps(a, b) to ``name, best``.

    A way's weight is ``own`` of all its nodes and ``more`` of its last.  Up to ``small`` steps
    are solved in one task; of more, only what changed is passed on, until nothing does.
    """
    best = nodes.select("name", "own", (F.col("own") + F.col("more")).alias("best"))
    known, pairs = _numbered(steps.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    if pairs.limit(small + 1).count() <= small:
        zero, none = F.lit(0).cast("long"), F.lit(-1).cast("long")
        weights = nodes.join(known, "name").select(F.col("id").alias("a"), none.alias("b"), F.col("own").cast("long").alias("own"), F.col("more").cast("long").alias("more"))
        solved = _in_one_task(weights.unionByName(pairs.select("a", "b", zero.alias("own"), zero.alias("more"))), _weigh, "id long, _best long")
        return best.join(known.join(solved, "id").select("name", "_best"), "name", "left").select("name", F.coalesce(F.col("_best").cast("int"), "best").alias("best"))
    best = cut(best)
    moved = best
    for turn in count(1):
        offered = steps.join(moved.select(F.col("name").alias("b"), F.col("best").alias("_b")), "b").groupBy(F.col("a").alias("name")).agg(F.max("_b").alias("_o"))
        moved = cut(best.join(offered, "name").filter(F.col("own") + F.col("_o") > F.col("best")).select("name", "own", (F.col("own") + F.col("_o")).alias("best")))
        if moved.isEmpty():
            return best.select("name", "best")
        best = best.join(moved.select("name"), "name", "left_anti").unionByName(moved)
        best = best if turn % 4 else cut(best)


def longest_chains(edges: DataFrame, *, small: int = SMALL_EDGES) -> DataFrame:
    """``component, weight, depth``: the heaviest chain that starts at each component of the condensation.

    A component weighs as much as it has members; more than eight weigh
    nothing and end the chain.
    """
    edges = cut(_distinct_pairs(edges).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    member = cut(strongly_connected(edges, small=small))
    size = member.groupBy("component").agg(F.count("*").alias("size"))
    weight = cut(size.select(F.col("component").alias("name"), F.when(F.col("size") > LARGE, 0).otherwise(F.col("size")).cast("int").alias("own"), F.lit(0).alias("more"), (F.col("size") > LARGE).alias("large")))
    a = member.select(F.col("name").alias("src"), F.col("component").alias("a"))
    b = member.select(F.col("name").alias("dst"), F.col("component").alias("b"))
    ending = weight.filter("large").select(F.col("name").alias("a"))
    steps = cut(edges.select("src", "dst").join(a, "src").join(b, "dst").filter("a <> b").select("a", "b").distinct().join(ending, "a", "left_anti"))
    return weight.join(_heaviest(weight, steps, small), "name").select(F.col("name").alias("component"), F.col("own").alias("weight"), F.col("best").alias("depth"))


def effective_depth(own: DataFrame, calls: DataFrame, *, small: int = SMALL_EDGES) -> DataFrame:
    """``name, own, effective``: a method's loop depth with that of what it calls inside loops.

    ``own(name, depth)``; ``calls(src, dst)`` are calls made in a loop.  The
    deepest chain counts, however long.  A call within a cycle of calls
    counts the callee's own depth alone, so a cycle is cut where it is entered and recursion once
    adds the method's own depth; calls of unknown names count nothing.
    """
    held = cut(own.groupBy("name").agg(F.max("depth").alias("own")))
    known = held.select("name")
    inner = calls.select("src", "dst").distinct().join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
    inner = cut(inner.join(held.filter("own > 0").select(F.col("name").alias("src")), "src", "left_semi").select("src", "dst"))
    member = cut(strongly_connected(inner, small=small))
    a, b = member.select(F.col("name").alias("src"), F.col("component").alias("ca")), member.select(F.col("name").alias("dst"), F.col("component").alias("cb"))
    placed = cut(inner.join(a, "src").join(b, "dst"))
    within = placed.filter("ca = cb").join(held.select(F.col("name").alias("dst"), F.col("own").alias("_d")), "dst").groupBy(F.col("src").alias("name")).agg(F.max("_d").alias("more"))
    nodes = held.join(within, "name", "left").select("name", "own", F.coalesce("more", F.lit(0)).alias("more"))
    best = _heaviest(nodes, placed.filter("ca <> cb").select(F.col("src").alias("a"), F.col("dst").alias("b")), small)
    return held.join(best, "name").select("name", "own", F.col("best").alias("effective"))
