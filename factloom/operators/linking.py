"""Linking repositories: evidence signals, binders and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import controller_key, http_method, route_path, short_name
from . import aggregates, joins, traversal


@dataclass(frozen=True)
class Vocabulary:
    """Thresholds of linking; fixed values unless overlaid by configuration."""

    least_shared_segments: int = 2
    least_shared_symbols: int = 3
    most_repo_share: float = 0.5
    least_repos_for_filter: int = 4
    least_similarity: float = 0.5
    samples: int = 25


def http_links(routes: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Client repositories linked to the servers of their routes: ``from_repo, to_repo, edge_type, route_id, server_id``."""
    clients, servers = routes.filter("role = 'client'"), routes.filter("role = 'server'")
    hit = joins.match_routes(clients, servers, least_segments=vocabulary.least_shared_segments)
    c = clients.select(F.col("route_id").alias("client_id"), F.col("repo").alias("from_repo"))
    s = servers.select(F.col("route_id").alias("server_id"), F.col("repo").alias("to_repo"))
    return hit.join(c, "client_id").join(s, "server_id").select("from_repo", "to_repo", F.lit("http").alias("edge_type"), F.col("client_id").alias("route_id"), "server_id")


def http_states(routes: DataFrame) -> DataFrame:
    """Each client route as resolved, external (its own repository answers) or unresolved."""
    links = http_links(routes).select("route_id", "to_repo")
    clients = routes.filter("role = 'client'")
    state = F.when(F.col("to_repo").isNull(), "unresolved").when(F.col("to_repo") == F.col("repo"), "external").otherwise("resolved")
    return clients.join(links, "route_id", "left").select("repo", F.lit("http").alias("edge_type"), "route_id", state.alias("state"))


def normalised_routes(routes: DataFrame) -> DataFrame:
    """Normalised paths and methods; paths without a fixed segment are generic and left out."""
    out = routes.withColumn("path", route_path(F.col("path"))).withColumn("method", http_method(F.col("method")))
    return out.filter(F.regexp_replace("path", r"[{}/]", "") != "")


def service_facts(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One service fact for each linked repository, one dependency fact for each directed pair with capped samples."""
    ends = links.select(F.col("from_repo").alias("repo")).union(links.select(F.col("to_repo").alias("repo"))).distinct()
    services = ends.select("repo", F.lit("service").alias("kind"), F.concat(F.lit("service:"), "repo").alias("name"))
    crossing = links.filter("from_repo <> to_repo").withColumn("sample_id", F.col("route_id").cast("string"))
    pairs = aggregates.sampled_lists(crossing, ["from_repo", "to_repo"], "sample_id")
    return services, pairs.select("from_repo", "to_repo", F.lit("depends_on").alias("rel"), "sample", "more")


def shared_identities(symbols: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Type names that several repositories declare, without those that most of them declare: ``identity, repos``."""
    by = symbols.groupBy("identity").agg(F.count_distinct("repo").alias("repos"))
    every = symbols.agg(F.count_distinct("repo").alias("all"))
    common = (F.col("all") >= vocabulary.least_repos_for_filter) & (F.col("repos") / F.col("all") > vocabulary.most_repo_share)
    return by.join(F.broadcast(every)).filter((F.col("repos") > 1) & ~common).select("identity", "repos")


def shared_pairs(symbols: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Pairs of repositories with at least three shared identities."""
    kept = symbols.select("repo", "identity").distinct().join(shared_identities(symbols, vocabulary), "identity", "left_semi")
    a, b = kept.withColumnRenamed("repo", "repo_a"), kept.withColumnRenamed("repo", "repo_b")
    return a.join(b, "identity").filter("repo_a < repo_b").groupBy("repo_a", "repo_b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= vocabulary.least_shared_symbols)


def evidence(*signals: DataFrame) -> DataFrame:
    """All directed evidence summed up by pair and type, in any order of the signals."""
    out = signals[0].select("from_repo", "to_repo", "edge_type")
    for s in signals[1:]:
        out = out.unionByName(s.select("from_repo", "to_repo", "edge_type"))
    return out.filter("from_repo <> to_repo").groupBy("from_repo", "to_repo", "edge_type").agg(F.count("*").alias("n"))


def client_seams(calls: DataFrame, specs: DataFrame) -> DataFrame:
    """Calls of a specified client function become client routes: calls(src, dst, argument), specs(function, method)."""
    return calls.join(specs, calls["dst"] == specs["function"]).select(F.col("src").alias("name"), "method", F.col("argument").alias("path"), F.lit("client").alias("role"))


def grpc_names(clients: DataFrame, services: DataFrame) -> DataFrame:
    """Full names of client stubs by the service's short name, where only one service has it."""
    only = services.withColumn("short", short_name(F.col("name"))).groupBy("short").agg(F.count_distinct("name").alias("n"), F.min("name").alias("full")).filter("n = 1")
    return clients.join(only.select("short", "full"), clients["service"] == F.col("short"), "left").withColumn("service", F.coalesce("full", "service")).drop("short", "full")


def vendored_specs(routes: DataFrame) -> DataFrame:
    """Server routes in vendored specifications are other people's: their role becomes client."""
    return routes.withColumn("role", F.when((F.col("role") == "server") & F.col("file").rlike(r"(^|/)(vendor|third_party|clients?)/"), "client").otherwise(F.col("role")))


def handlers(routes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each route's handler symbol by the short name of its handler; ambiguous names stay open."""
    only = symbols.withColumn("handler", short_name(F.col("name"))).groupBy("handler").agg(F.count_distinct("name").alias("n"), F.min("name").alias("symbol")).filter("n = 1")
    return routes.join(only.select("handler", "symbol"), "handler", "left")


def grpc_implementations(services: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes named as a service, its base or its server."""
    key = lambda c: F.regexp_replace(controller_key(short_name(F.col(c))), "(server|servicer|impl|base)$", "")
    return services.withColumn("_k", key("name")).select("_k", F.col("name").alias("service")).join(classes.withColumn("_k", key("name")).select("_k", F.col("name").alias("class")), "_k").drop("_k")


def mixin_owners(calls: DataFrame, includes: DataFrame, methods: DataFrame) -> DataFrame:
    """Bare calls inside a class resolved to a method of a mixin that it includes."""
    owned = methods.select(F.col("owner").alias("mixin"), F.col("bare"), F.col("name").alias("target"))
    return calls.join(includes, calls["owner"] == includes["class"]).join(owned, ["mixin", "bare"]).select("src", "target").distinct()


def module_rollup(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """Symbol edges counted between the modules of their ends: homes(name, module)."""
    a, b = homes.select(F.col("name").alias("src"), F.col("module").alias("from_module")), homes.select(F.col("name").alias("dst"), F.col("module").alias("to_module"))
    return edges.join(a, "src").join(b, "dst").filter("from_module <> to_module").groupBy("from_module", "to_module").agg(F.count("*").alias("n"))


def literal_bindings(literals: DataFrame, targets: DataFrame) -> DataFrame:
    """String stimuli (events, components by name) bound to the one target that declares them; a literal with several targets stays open."""
    only = targets.groupBy("literal").agg(F.count_distinct("target").alias("_n"), F.min("target").alias("target")).filter("_n = 1").drop("_n")
    return literals.join(only, "literal", "left").select("src", "literal", "target")


def framework_roots(facts: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``name, reached, mechanisms``: what the entry points roots(name, mechanism) reach, and the mechanisms through which a fact is a root itself."""
    own = roots.groupBy("name").agg(F.array_sort(F.collect_set("mechanism")).alias("mechanisms"))
    out = traversal.reached_from_roots(edges, facts, roots).join(own, "name", "left")
    return out.withColumn("mechanisms", F.coalesce("mechanisms", F.array().cast("array<string>")))


def unmatched(routes: DataFrame) -> DataFrame:
    """Server routes flagged where no client route reaches them."""
    servers = routes.filter("role = 'server'")
    hit = joins.match_routes(routes.filter("role = 'client'"), servers).select(F.col("server_id").alias("route_id")).distinct().withColumn("_hit", F.lit(True))
    return servers.join(hit, "route_id", "left").withColumn("unmatched_by_clients", F.col("_hit").isNull()).drop("_hit")


def coverage_report(services: DataFrame, tallies: DataFrame) -> DataFrame:
    """Each service as connected, coverage_gap (calls, none resolved) or isolated."""
    by = tallies.groupBy("repo").agg(F.sum("detected").alias("detected"), F.sum("resolved").alias("resolved"))
    out = services.select("repo").distinct().join(by, "repo", "left")
    state = F.when(F.coalesce("detected", F.lit(0)) == 0, "isolated").when(F.col("resolved") == 0, "coverage_gap").otherwise("connected")
    return out.select("repo", F.coalesce("detected", F.lit(0)).alias("detected"), F.coalesce("resolved", F.lit(0)).alias("resolved"), state.alias("state"))
