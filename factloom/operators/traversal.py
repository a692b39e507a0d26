"""Breadth-first walks: traversal, shortest paths, impact and closures.

A walk is a driver loop with one join for each hop; the frontier and the visited set are
DataFrames cut by a reliable checkpoint, so a lost executor costs one hop at
most.  Caps hide nodes after the walk and never stop it.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..checkpoints import cut

DEPTH, MOST_DEPTH, NODES, MOST_NODES = 5, 20, 100, 500


def steps(edges: DataFrame, direction: str = "forward", rels: list[str] | None = None) -> DataFrame:
    """``a, b`` steps of a walk; repeats stay, as every hop drops them from what it finds."""
    used = edges.filter(F.col("rel").isin(rels)) if rels else edges
    a, b = ("src", "dst") if direction == "forward" else ("dst", "src")
    return used.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")


def dealt(moves: DataFrame) -> DataFrame:
    """Steps dealt by where they begin, once for all hops, so that a hop moves its frontier alone; what an executor loses is computed again."""
    parts = int(moves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return moves.repartition(parts, "a").persist()


def walk(edges: DataFrame, seeds: DataFrame, *, direction: str = "forward", rels: list[str] | None = None, depth: int | None = DEPTH, limit: int = MOST_DEPTH) -> DataFrame:
    """``name, depth`` of all that is reached from ``seeds(name)`` within ``depth`` hops (``None``: to the end), seeds at 0."""
    moves = dealt(steps(edges, direction, rels))
    visited = cut(seeds.select("name").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for hop in count(1) if depth is None else range(1, min(depth, limit) + 1):
        found = moves.join(frontier.select(F.col("name").alias("a")), "a").select(F.col("b").alias("name")).distinct()
        frontier = cut(found.join(visited.select("name"), "name", "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        visited = visited if hop % 16 else cut(visited)  # a long walk would scan one part for each hop
    moves.unpersist()
    return visited


def traverse(edges: DataFrame, facts: DataFrame, seeds: DataFrame, *, direction: str = "forward", rels: list[str] | None = None, kinds: list[str] | None = None, depth: int = DEPTH, nodes: int = NODES) -> DataFrame:
    """The walk's nodes in breadth-first order (depth, then name): ``name, depth, kind, truncated``.

    Kinds only hide nodes.  A name without a fact is ``unresolved``.  At most ``nodes`` (500 at most) are shown.
    """
    reached = walk(edges, seeds, direction=direction, rels=rels, depth=depth)
    known = facts.groupBy("name").agg(F.min("kind").alias("kind"))
    shown = reached.join(known, "name", "left").withColumn("kind", F.coalesce("kind", F.lit("unresolved")))
    if kinds:
        shown = shown.filter(F.col("kind").isin(kinds))
    most = min(nodes, MOST_NODES)
    total = shown.agg(F.count("*").alias("_n"))
    return shown.orderBy("depth", "name").limit(most).join(F.broadcast(total)).withColumn("truncated", F.col("_n") > most).drop("_n")


def find_path(edges: DataFrame, start: str, end: str, *, depth: int = 10) -> DataFrame:
    """The shortest forward path by hops as ``step, name``; empty if there is none within ``depth`` (20 at most); of equal ones, each parent is the least by name."""
    spark = edges.sparkSession
    moves = dealt(steps(edges))
    visited = cut(spark.createDataFrame([(start, None, 0)], "name string, parent string, depth int"))
    frontier = visited
    found = start == end
    for hop in range(1, min(depth, MOST_DEPTH) + 1):
        if found:
            break
        step = moves.join(frontier.select(F.col("name").alias("a")), "a").groupBy(F.col("b").alias("name")).agg(F.min("a").alias("parent"))
        frontier = cut(step.join(visited.select("name"), "name", "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        found = not frontier.filter(F.col("name") == end).isEmpty()
    moves.unpersist()
    out, at = [], end if found else None
    while at is not None:  # one row for each hop: MOST_DEPTH at most
        row = visited.filter(F.col("name") == at).first()
        out.append((row["depth"], at))
        at = row["parent"]
    return spark.createDataFrame(sorted(out), "step int, name string")


def impact(edges: DataFrame, seeds: DataFrame, *, depth: int = 3, nodes: int = 200) -> DataFrame:
    """Who depends on the seeds: ``depth, n, total, sample`` by distance; the counts are true, only the samples are capped."""
    reached = walk(edges, seeds, direction="reverse", depth=min(depth, 10)).filter("depth > 0")
    ranked = reached.withColumn("_k", F.row_number().over(Window.partitionBy("depth").orderBy("name")))
    return ranked.groupBy("depth").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("_k") <= min(nodes, MOST_NODES), F.col("name")))).alias("sample"))


def seed_rollup(facts: DataFrame, edges: DataFrame, seed: str) -> DataFrame:
    """A type stands for itself, its methods and its ``New<Type>`` constructor."""
    methods = edges.filter((F.col("rel") == "has_method") & (F.col("src") == seed)).select(F.col("dst").alias("name"))
    short = seed.rsplit(".", 1)[-1]
    maker = facts.filter(F.col("name") == seed[: len(seed) - len(short)] + "New" + short).select("name")
    return facts.filter(F.col("name") == seed).select("name").union(methods).union(maker).distinct()


def closures(edges: DataFrame, roots: DataFrame, *, rels: list[str] | None = None, depth: int | None = None, without: str | None = None) -> DataFrame:
    """``root, name, depth`` for every root at once, to the end unless ``depth`` is given, optionally as if one node weren't there."""
    moves = steps(edges, "forward", rels)
    if without is not None:
        moves = moves.filter((F.col("a") != without) & (F.col("b") != without))
    moves = dealt(moves)
    visited = cut(roots.select(F.col("name").alias("root"), F.col("name")).distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for hop in count(1) if depth is None else range(1, depth + 1):
        found = frontier.join(moves, frontier["name"] == moves["a"]).select("root", F.col("b").alias("name")).distinct()
        frontier = cut(found.join(visited.select("root", "name"), ["root", "name"], "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        visited = visited if hop % 16 else cut(visited)  # a long walk would scan one part for each hop
    moves.unpersist()
    return visited


def dominated(edges: DataFrame, root: str, candidate: str, *, rels: list[str] | None = None) -> DataFrame:
    """What a root no longer reaches once a candidate is gone, the candidate itself left out."""
    start = edges.sparkSession.createDataFrame([(root,)], "name string")
    whole = closures(edges, start, rels=rels).select("name")
    left = closures(edges, start, rels=rels, without=candidate).select("name")
    return whole.join(left, "name", "left_anti").filter(F.col("name") != candidate)


def reached_from_roots(edges: DataFrame, facts: DataFrame, roots: DataFrame, *, rels: list[str] | None = None) -> DataFrame:
    """Each fact's name with whether any root reaches it."""
    reached = walk(edges, roots, rels=rels, depth=None).select("name").withColumn("_r", F.lit(True))
    return facts.select("name").distinct().join(reached, "name", "left").select("name", F.coalesce("_r", F.lit(False)).alias("reached"))


def governing(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """``anchors(page, path)`` that name a file or a directory above it: ``file, page``; with or without the repository's prefix."""
    parts = F.split("file", "/")
    ups = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    forms = files.select("file", F.explode(F.array_distinct(F.concat(ups, F.transform(ups, lambda u: F.concat("repo", F.lit("/"), u))))).alias("path")) if "repo" in files.columns else files.select("file", F.explode(ups).alias("path"))
    return forms.join(anchors.select("page", "path"), "path").select("file", "page").distinct()


def endpoint_chain(routes: DataFrame, handlers: DataFrame, edges: DataFrame, models: DataFrame, tables: DataFrame) -> DataFrame:
    """For each route: its handler, the models within three hops, their tables, and the hop at which the chain ran out."""
    handled = routes.join(handlers, "handler_key", "left").select("route", F.col("name").alias("handler"))
    seeds = handled.filter("handler is not null").select(F.col("handler").alias("name")).distinct()
    near = closures(edges, seeds, depth=3).join(models.select("name"), "name", "left_semi").select(F.col("root").alias("handler"), F.col("name").alias("model"))
    chain = handled.join(near, "handler", "left").join(tables.select(F.col("model"), F.col("table")), "model", "left")
    out = chain.groupBy("route", "handler").agg(F.slice(F.array_sort(F.collect_set("model")), 1, 25).alias("models"), F.array_sort(F.collect_set("table")).alias("tables"))
    stop = F.when(F.col("handler").isNull(), "handler").when(F.size("models") == 0, "models").when(F.size("tables") == 0, "tables")
    return out.withColumn("stopped_at", stop)
