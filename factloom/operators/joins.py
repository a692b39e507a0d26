"""The join shapes of the fact library; every one is an equi-join or an explode followed by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import ancestors, controller_key, http_method, route_path


def resolve_targets(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """``target_id`` and ``resolution`` of each edge: unique in the edge's repository, else unique everywhere, else ambiguous or unresolved.

    The target's kind counts where the edge names one.
    """
    ids = facts.select("repo", "name", "kind", "id").distinct()
    by_kind = ids.unionByName(ids.withColumn("kind", F.lit(""))).distinct()
    local = by_kind.groupBy("repo", "name", "kind").agg(F.count_distinct("id").alias("local_n"), F.min("id").alias("local_id"))
    every = by_kind.groupBy("name", "kind").agg(F.count_distinct("id").alias("all_n"), F.min("id").alias("all_id"))
    keyed = edges.withColumn("_kind", F.coalesce("dst_kind", F.lit("")))
    out = keyed.join(local.select(F.col("repo"), F.col("name").alias("dst"), F.col("kind").alias("_kind"), "local_n", "local_id"), ["repo", "dst", "_kind"], "left")
    out = out.join(every.select(F.col("name").alias("dst"), F.col("kind").alias("_kind"), "all_n", "all_id"), ["dst", "_kind"], "left")
    target = F.when(F.col("local_n") == 1, F.col("local_id")).when(F.col("local_n").isNull() & (F.col("all_n") == 1), F.col("all_id"))
    state = F.when(target.isNotNull(), "resolved").when(F.col("all_n") > 1, "ambiguous").otherwise("unresolved")
    return out.withColumn("target_id", target).withColumn("resolution", state).drop("_kind", "local_n", "local_id", "all_n", "all_id")


def declaring_module(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Each symbol's module by the longest dotted prefix of its name that is one."""
    parts = F.split("name", r"\.")
    prefixes = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    tried = symbols.select("name", F.posexplode(prefixes).alias("_up", "_prefix")).distinct()
    found = tried.join(modules.select(F.col("name").alias("_prefix")).distinct(), "_prefix").groupBy("name").agg(F.min_by("_prefix", "_up").alias("module"))
    return symbols.join(found, "name", "left")


def _suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts) - k + 1), "/"))


def match_routes(clients: DataFrame, servers: DataFrame, *, least_segments: int = 2) -> DataFrame:
    """Client routes and the server routes that they reach: ``client_id, server_id, segments``.

    Paths are normalised; the longest common suffix of at least
    ``least_segments`` segments wins; methods are equal or one is ``*``; ties
    go to the least server id.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        path = route_path(F.col("path"))
        out = df.select(F.col("route_id").alias(name), http_method(F.col("method")).alias(f"{name}_method"), F.explode(_suffixes(path)).alias("suffix"))
        return out.withColumn("segments", F.size(F.split("suffix", "/"))).filter(F.col("segments") >= least_segments)

    # of the servers with one suffix and method only the least can win, so a common suffix is a few rows
    served = keyed(servers, "server_id").groupBy("suffix", "segments", "server_id_method").agg(F.min("server_id").alias("server_id"))
    both = keyed(clients, "client_id").join(served, ["suffix", "segments"])
    fits = both.filter((F.col("client_id_method") == F.col("server_id_method")) | (F.col("client_id_method") == "*") | (F.col("server_id_method") == "*"))
    best = fits.groupBy("client_id").agg(F.min(F.struct((-F.col("segments")).alias("s"), "server_id")).alias("b"))
    return best.select("client_id", F.col("b.server_id").alias("server_id"), (-F.col("b.s")).cast("int").alias("segments"))


def route_handlers(routes: DataFrame, classes: DataFrame) -> DataFrame:
    """Routes whose ``handler`` is ``controller#action`` joined with classes by the controller's normalised key."""
    key = controller_key(F.substring_index("handler", "#", 1))
    return routes.withColumn("_key", key).join(classes.select(F.col("name").alias("controller"), controller_key(F.col("name")).alias("_key")), "_key", "left").drop("_key")


def unmatched_servers(servers: DataFrame, matches: DataFrame) -> DataFrame:
    return servers.join(matches.select(F.col("server_id").alias("route_id")).distinct(), "route_id", "left_anti")


def referenced_by_other(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Symbols that some other name refers to."""
    used = edges.filter("src <> dst").select(F.col("dst").alias("name")).distinct()
    return symbols.join(used, "name", "left_semi")


def unresolved_by_component(outbound: DataFrame, inbound: DataFrame, *, top: int = 8) -> DataFrame:
    """Outbound calls without a partner on (method, path), counted by component; the first eight."""
    missing = outbound.join(inbound.select("method", "path").distinct(), ["method", "path"], "left_anti")
    return missing.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(top)


def prefix_join(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """Files under each anchored path: ancestors are exploded, so the join is an equality."""
    return files.select("file", F.explode(ancestors(F.col("file"))).alias("path")).join(anchors, "path")


def shared_code(tokens: DataFrame, *, least: float = 0.5, most_repo_share: float = 0.5, least_repos_for_filter: int = 4) -> DataFrame:
    """Pairs of equal identities in different repositories whose token sets are alike: ``identity, repo_a, repo_b, similarity``.

    ``tokens(repo, identity, tokens)`` has one row for each repository and identity.
    Identities that more than a share of all repositories declare say nothing and
    are left out, once there are enough repositories to tell.
    """
    from ..functions.names import jaccard
    from .linking import Vocabulary, shared_identities

    telling = shared_identities(tokens, Vocabulary(most_repo_share=most_repo_share, least_repos_for_filter=least_repos_for_filter))
    tokens = tokens.join(telling.select("identity"), "identity", "left_semi")
    a = tokens.select("identity", F.col("repo").alias("repo_a"), F.col("tokens").alias("ta"))
    b = tokens.select("identity", F.col("repo").alias("repo_b"), F.col("tokens").alias("tb"))
    return a.join(b, "identity").filter("repo_a < repo_b").withColumn("similarity", jaccard(F.col("ta"), F.col("tb"))).filter(F.col("similarity") >= least).select("identity", "repo_a", "repo_b", "similarity")


def topic_owners(consumers: DataFrame, repos: DataFrame) -> DataFrame:
    """Topics named ``<owner>.<rest>`` read by a repository other than the owner."""
    return consumers.withColumn("owner", F.regexp_extract("topic", r"^([^.]+)\.", 1)).join(repos.select(F.col("repo").alias("owner")), "owner").filter("owner <> repo")


def import_owner(imports: DataFrame, repos: DataFrame) -> DataFrame:
    """The first segment of an import's target that is another repository's label."""
    parts = imports.select("repo", "target", F.posexplode(F.split("target", "/")).alias("pos", "label"))
    hit = parts.join(repos.select(F.col("repo").alias("label")), "label").filter("label <> repo")
    return hit.groupBy("repo", "target").agg(F.min_by("label", "pos").alias("owner"))


def operations(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """Client and server ends of one operation name in different repositories; each end is one row before they meet, so repeats don't multiply."""
    c = clients.select("operation", F.col("repo").alias("client_repo")).distinct()
    s = servers.select("operation", F.col("repo").alias("server_repo")).distinct()
    return c.join(s, "operation").filter("client_repo <> server_repo")


def keyed_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Full outer join of two multisets; rows of one key are paired by their order: ``keys, pos, status``."""

    def numbered(df: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        value = F.sha2(F.concat_ws("\1", *(F.coalesce(F.col(v).cast("string"), F.lit("\2")) for v in values)), 256)
        return df.withColumn("pos", F.row_number().over(w)).select(*keys, "pos", value.alias(side))

    both = numbered(old, "_old").join(numbered(new, "_new"), [*keys, "pos"], "full_outer")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return both.select(*keys, "pos", status.alias("status"))


def path_candidates(starts: DataFrame, ends: DataFrame, *, most: int = 5) -> DataFrame:
    """All pairs of the few best candidates at both ends of a path question (at most ``most`` each, by rank)."""
    a = starts.orderBy("rank").limit(most).select(F.col("name").alias("start"), F.col("rank").alias("ra"))
    b = ends.orderBy("rank").limit(most).select(F.col("name").alias("end"), F.col("rank").alias("rb"))
    return a.join(F.broadcast(b), F.lit(True)).orderBy(F.col("ra") + F.col("rb"), "start", "end")
