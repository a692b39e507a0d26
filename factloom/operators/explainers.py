"""The explainers: each gives its findings as rows of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import dirname, half_up, is_test_path, short_name
from . import aggregates, components, graph, traversal


def god_classes(facts: DataFrame, edges: DataFrame, *, least: int = 8, k: float = 2.0, most: int = 25) -> DataFrame:
    """Symbols with at least eight users and more than mean + 2 deviations: ``name, fan_in, confidence``."""
    symbols = facts.filter("kind = 'symbol'").filter(~is_test_path(F.col("file"))).select("name").distinct()
    measured = symbols.join(graph.fan_in(edges), "name")
    found = aggregates.outliers(measured, "fan_in", k=k, floor=least)
    share = F.col("fan_in") / F.col("threshold")
    sure = F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.5), 0.5 + 0.5 * (share - 1))), 6)
    return found.withColumn("confidence", sure).orderBy(F.desc("fan_in"), "name").limit(most).select("name", "fan_in", "confidence")


def hotspots(edges: DataFrame, *, least: int = 3, k: float = 2.0, most: int = 20, named: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Names with at least three ways in and out whose product is an outlier; ``named`` puts names in the place of numbers before they are put in order."""
    both = graph.fan_in(edges).join(graph.fan_out(edges), "name").withColumn("score", F.col("fan_in") * F.col("fan_out"))
    found = aggregates.outliers(both, "score", k=k).filter((F.col("fan_in") >= least) & (F.col("fan_out") >= least))
    found = named(found) if named else found
    return found.orderBy(F.desc("score"), "name").limit(most).select("name", "fan_in", "fan_out", "score")


def import_cycles(module_edges: DataFrame) -> DataFrame:
    return components.cycles(module_edges)


def dependency_depth(module_edges: DataFrame, *, least: int = 5, most: int = 10) -> DataFrame:
    """Chains of at least five modules, deepest first."""
    return components.longest_chains(module_edges).filter(F.col("depth") >= least).orderBy(F.desc("depth"), "component").limit(most).select("component", "depth")


def exported_surface(facts: DataFrame, *, least: int = 15, share: float = 0.85, most: int = 20) -> DataFrame:
    """Modules of at least fifteen symbols, 85 in 100 of them exported."""
    by = facts.filter("kind = 'symbol'").groupBy(dirname(F.col("file")).alias("module")).agg(F.count("*").alias("symbols"), F.sum(F.col("exported").cast("int")).alias("exported"))
    found = by.filter((F.col("symbols") >= least) & (F.col("exported") / F.col("symbols") >= share))
    return found.withColumn("ratio", F.round(F.col("exported") / F.col("symbols"), 6)).orderBy(F.desc("symbols"), "module").limit(most)


def complexity_outliers(facts: DataFrame, *, least: int = 10, k: float = 2.0, most: int = 15) -> DataFrame:
    callable_ = facts.filter(F.col("symbol_kind").isin("function", "method"))
    found = aggregates.outliers(callable_, "cyclomatic", k=k, floor=least)
    return found.orderBy(F.desc("cyclomatic"), "name").limit(most).select("name", "cyclomatic")


#: Data members, whose uses are no edges, and folders whose code is loaded by path.
DATA_MEMBERS = ("variable", "constant")
LOADED_FOLDERS = ("migrate", "post_migrate", "script", "scripts", "vendor")


def unreferenced(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that nothing else refers to: ``isolated`` without edges out, else ``unreferenced``; ``test_only`` where tests alone do.  Confidence by kind.

    Data members, and code in tests or in folders that are loaded by path, say nothing and are left out.
    Edges whose ends are the numbers ``id`` of the facts say by ``src_test`` whether their source is a test.
    """
    keyed = "id" in facts.columns
    key = "id" if keyed else "name"
    loaded = F.arrays_overlap(F.split("file", "/"), F.array(*map(F.lit, LOADED_FOLDERS)))
    symbols = facts.filter("kind = 'symbol'").filter(~F.coalesce(F.col("symbol_kind").isin(*DATA_MEMBERS), F.lit(False)) & ~is_test_path(F.col("file")) & ~loaded).select("name", *(["id"] if keyed else []), "symbol_kind").distinct()
    other, test = F.col("src") != F.col("dst"), F.col("src_test") if keyed else F.coalesce(is_test_path(F.col("src_file")), F.lit(False)) if "src_file" in edges.columns else F.lit(False)
    linked = edges.filter("rel <> 'declares'")
    into = linked.groupBy(F.col("dst").alias(key)).agg(F.max((other & ~test).cast("int")).alias("used"), F.max((other & test).cast("int")).alias("tested"))
    seen = into.join(linked.select(F.col("src").alias(key), F.lit(1).alias("out")).distinct(), key, "full_outer")
    left = symbols.join(seen, key, "left").filter(F.coalesce("used", F.lit(0)) == 0)
    tier = F.when(F.col("symbol_kind") == "function", "high").when(F.col("symbol_kind").isin("struct", "class", "interface"), "medium").otherwise("low")
    category = F.when(F.col("tested") == 1, "test_only").when(F.coalesce("out", F.lit(0)) == 0, "isolated").otherwise("unreferenced")
    return left.select("name", category.alias("category"), tier.alias("confidence"))


def dead_methods(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Methods whose bare name no call mentions."""
    called = edges.filter("rel = 'calls'").select(short_name(F.col("dst")).alias("bare")).distinct()
    return facts.filter("symbol_kind = 'method'").withColumn("bare", short_name(F.col("name"))).join(called, "bare", "left_anti").select("name", "bare")


def package_metrics(facts: DataFrame, module_edges: DataFrame) -> DataFrame:
    """Martin's metrics of production modules: couplings, classes, abstractness, instability, distance and zone."""
    modules = facts.filter("kind = 'module' and role = 'production'").select("name").distinct()
    types = facts.filter(F.col("symbol_kind").isin("struct", "class", "interface")).groupBy(dirname(F.col("file")).alias("name"))
    types = types.agg(F.count("*").alias("classes"), F.sum(F.when(F.col("symbol_kind") == "interface", 1).otherwise(0)).alias("abstract"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = modules.join(types, "name", "left").join(aggregates.coupling(module_edges), "name", "left").select("name", *map(zero, ("classes", "abstract", "ca", "ce")))
    i = F.when(F.col("ca") + F.col("ce") > 0, F.col("ce") / (F.col("ca") + F.col("ce"))).otherwise(F.lit(0.0))
    a = F.when(F.col("classes") > 0, F.col("abstract") / F.col("classes")).otherwise(F.lit(0.0))
    out = joined.withColumn("instability", F.round(i, 3)).withColumn("abstractness", F.round(a, 3)).withColumn("distance", F.round(F.abs(a + i - 1), 3))
    zone = F.when(F.col("distance") <= 0.2, "main").when((F.col("distance") > 0.7) & (F.col("instability") < 0.5), "pain").when(F.col("distance") > 0.7, "useless").otherwise("neutral")
    return out.withColumn("zone", zone)


def layer_violations(module_edges: DataFrame, layers: dict[str, int]) -> DataFrame:
    """Declared layers by directory word, higher is outer: edges from an inner to an outer layer, once for each pair; and the direction of all others.

    ``layers`` is one declared taxonomy: a handful of words.
    """
    level = F.lit(None).cast("int")
    for word, n in layers.items():
        level = F.when(F.col("_m").rlike(rf"(^|/){word}(/|$)"), n).otherwise(level)
    of = lambda df, c, out: df.withColumn("_m", F.col(c)).withColumn(out, level).drop("_m")
    pairs = of(of(module_edges.select("src", "dst").distinct(), "src", "src_level"), "dst", "dst_level").filter("src_level is not null and dst_level is not null and src <> dst")
    return pairs.withColumn("direction", F.when(F.col("src_level") < F.col("dst_level"), "against").when(F.col("src_level") > F.col("dst_level"), "inward").otherwise("same"))


def layer_conformance(directions: DataFrame) -> DataFrame:
    n = lambda d: F.sum(F.when(F.col("direction") == d, 1).otherwise(0))
    return directions.agg(n("inward").alias("inward"), n("against").alias("against"), n("same").alias("same")).withColumn("conformance", F.round(F.when(F.col("inward") + F.col("against") > 0, F.col("inward") / (F.col("inward") + F.col("against"))).otherwise(1.0), 6))


def coverage_gaps(tallies: DataFrame) -> DataFrame:
    """A service with unresolved calls: a gap if none is resolved, else partial."""
    by = tallies.groupBy("repo").agg(F.sum("resolved").alias("resolved"), F.sum("unresolved").alias("unresolved")).filter("unresolved > 0")
    return by.withColumn("state", F.when(F.col("resolved") == 0, "gap").otherwise("partial")).withColumn("confidence", F.when(F.col("resolved") == 0, 0.9).otherwise(0.75))


def unused_routes(servers: DataFrame, matches: DataFrame, *, share: float = 0.8, cap: int = 200) -> DataFrame:
    """By repository, served routes and those without a client; too many mean that clients are missing from the picture."""
    hit = matches.select(F.col("server_id").alias("route_id")).distinct().withColumn("_hit", F.lit(1))
    by = servers.join(hit, "route_id", "left").groupBy("repo").agg(F.count("*").alias("served"), F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).alias("unmatched"))
    wide = (F.col("unmatched") / F.col("served") >= share) | (F.col("unmatched") > cap)
    return by.withColumn("finding", F.when(wide, "clients incomplete").when(F.col("unmatched") > 0, "unused routes").otherwise("none"))


def domain_hubs(models: DataFrame, edges: DataFrame, *, least: int = 10, k: float = 2.0) -> DataFrame:
    """Models with at least ten users and no fewer than mean + 2 deviations."""
    inbound = models.select("name").distinct().join(edges.filter("src <> dst").groupBy(F.col("dst").alias("name")).agg(F.count_distinct("src").alias("inbound")), "name")
    return aggregates.outliers(inbound, "inbound", k=k, strict=False, floor=least).select("name", "inbound")


def shared_tables(uses: DataFrame) -> DataFrame:
    """Tables that models of more than one namespace use: uses(table, namespace)."""
    return uses.groupBy("table").agg(F.count_distinct("namespace").alias("namespaces")).filter("namespaces > 1")


def query_loops(loop_calls: DataFrame, queries: DataFrame) -> DataFrame:
    """Calls inside data-sized loops that lead to a model's query: loop_calls(src, dst), queries(name)."""
    return loop_calls.join(queries.select(F.col("name").alias("dst")), "dst", "left_semi").groupBy("src").agg(F.count_distinct("dst").alias("queries"))


def entry_points(roots: DataFrame, reached: DataFrame) -> DataFrame:
    """Roots by mechanism and the share of facts that they reach."""
    share = reached.agg(F.round(F.avg(F.col("reached").cast("int")), 6).alias("reached_share"))
    return roots.groupBy("mechanism").agg(F.count("*").alias("n")).join(F.broadcast(share))


def messaging_coverage(declared: DataFrame, implemented: DataFrame) -> DataFrame:
    """Operations by repository: undeclared, unimplemented, or conflicting in direction."""
    d = declared.groupBy("repo", "operation").agg(F.min("direction").alias("d"))
    i = implemented.groupBy("repo", "operation").agg(F.min("direction").alias("i"))
    both = d.join(i, ["repo", "operation"], "full_outer")
    state = F.when(F.col("d").isNull(), "undeclared").when(F.col("i").isNull(), "unimplemented").when(F.col("d") != F.col("i"), "conflicting").otherwise("covered")
    return both.withColumn("state", state).groupBy("repo", "state").agg(F.count("*").alias("n"))


def performance(methods: DataFrame, loop_calls: DataFrame, *, expensive: DataFrame | None = None, handlers: DataFrame | None = None, recursive: DataFrame | None = None) -> DataFrame:
    """Nested loops, compounded loops, calls in loops and recursion: ``name, finding, severity, depth, confidence, risk``.

    ``methods(name, loop_depth)``; ``loop_calls(src, dst)``; ``recursive(name)`` are methods flagged as calling themselves.  The depth is the own or
    effective loop depth; confidence is .8 and .55, .9 for confirmed calls,
    capped at .5 from depth four and .35 from six, and .5 for recursion; risk is the
    confidence times the order of growth (recursion: 2.5), 1.3 times as much for route handlers, to two places.
    """
    depth = components.effective_depth(methods.select("name", F.col("loop_depth").alias("depth")), loop_calls)
    nested = depth.filter("own >= 2").select("name", F.lit("nested-loop").alias("finding"), F.when(F.col("own") >= 3, "high").otherwise("medium").alias("severity"), F.col("own").alias("depth"), F.lit(0.8).alias("base"))
    more = depth.filter("effective >= 2 and effective > own").select("name", F.lit("compounded").alias("finding"), F.when(F.col("effective") >= 4, "medium").when(F.col("effective") >= 3, "high").otherwise("medium").alias("severity"), F.col("effective").alias("depth"), F.lit(0.55).alias("base"))
    out = nested.unionByName(more)
    if expensive is not None:
        costly = loop_calls.join(expensive.select(F.col("name").alias("dst")), "dst", "left_semi").select(F.col("src").alias("name")).distinct().join(depth, "name")
        out = out.unionByName(costly.select("name", F.lit("call-in-loop").alias("finding"), F.lit("high").alias("severity"), F.greatest(F.lit(1), F.col("own")).alias("depth"), F.lit(0.9).alias("base")))
    if recursive is not None:
        again = depth.join(recursive.select("name").distinct(), "name", "left_semi")
        out = out.unionByName(again.select("name", F.lit("recursion").alias("finding"), F.lit("medium").alias("severity"), F.col("own").alias("depth"), F.lit(0.5).alias("base")))
    deep = F.when(F.col("finding") != "recursion", F.col("depth")).otherwise(0)
    out = out.withColumn("confidence", F.when(deep >= 6, F.least("base", F.lit(0.35))).when(deep >= 4, F.least("base", F.lit(0.5))).otherwise(F.col("base"))).drop("base")
    order = F.when(F.col("finding") == "nested-loop", F.col("depth")).otherwise(F.least("depth", F.lit(4))).cast("double")  # estimates beyond the third power are no exponents
    weight = F.when(F.col("finding") == "recursion", 2.5).when(order < 1, 0.5).otherwise(order)
    if handlers is not None:
        out = out.join(handlers.select("name", F.lit(1.3).alias("_h")).distinct(), "name", "left")
        weight = weight * F.coalesce("_h", F.lit(1.0))
    return out.withColumn("risk", half_up(weight * F.col("confidence"), 2)).drop("_h")


def vendored(files: DataFrame, *, least: int = 3) -> DataFrame:
    """Directories within two levels below a dependency directory that hold a licence file and at least three files."""
    under = r"^(.*(?:^|/)(?:vendor|third_party|third-party|node_modules|external|deps)(?:/[^/]+){1,2})/[^/]+$"
    placed = files.withColumn("dir", F.regexp_extract("file", under, 1)).filter("dir <> ''")
    licence = F.lower(F.regexp_extract("file", "([^/]+)$", 1)).rlike(r"^(licen[cs]e|copying|notice)(\.[a-z]+)?$")
    return placed.groupBy("dir").agg(F.count("*").alias("files"), F.max(licence.cast("int")).alias("_l")).filter((F.col("_l") == 1) & (F.col("files") >= least)).drop("_l")


def import_closures(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Size and depth of what each root imports, directly or not."""
    return traversal.closures(edges, roots).groupBy("root").agg((F.count("*") - 1).alias("size"), F.max("depth").alias("depth"))


def seam_check(declared: DataFrame, measured: DataFrame) -> DataFrame:
    """Declared against measured edges between components: unexpected, mis-via, missing or kept."""
    d = declared.groupBy("src", "dst").agg(F.min("via").alias("d"))
    m = measured.groupBy("src", "dst").agg(F.min("via").alias("m"))
    both = d.join(m, ["src", "dst"], "full_outer")
    state = F.when(F.col("d").isNull(), "unexpected").when(F.col("m").isNull(), "missing").when(F.col("d") != F.col("m"), "mis-via").otherwise("kept")
    return both.select("src", "dst", state.alias("state"))


def cross_repo_summary(links: DataFrame) -> DataFrame:
    """Directed links between repositories by edge type."""
    return links.filter("from_repo <> to_repo").groupBy("from_repo", "to_repo").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("edge_type")).alias("types"))


def capped_findings(findings: DataFrame, *, most: int = 50) -> DataFrame:
    return aggregates.top_per(findings, ["repo"], most, F.desc("confidence"), "title")
