"""Building the edge graph from facts, and its one-hop measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import ancestors, owner_name
from ..schema import NOT_FAN_IN_RELATIONS, NOT_FAN_IN_SOURCES, NOT_FAN_OUT_RELATIONS

IDENTITY = ["src", "src_kind", "rel", "dst", "dst_kind"]


def explode_relations(facts: DataFrame) -> DataFrame:
    """Embedded relations as edges between names; unresolved targets stay."""
    return facts.select("repo", "name", "kind", "file", F.explode("relations").alias("r")).select(
        "repo", F.col("name").alias("src"), F.col("kind").alias("src_kind"), F.col("r.kind").alias("rel"), F.col("r.target").alias("dst"),
        F.coalesce("r.target_kind", F.lit("")).alias("dst_kind"), F.col("file").alias("src_file"), F.col("r.target_file").alias("dst_file"),
    )


def strip_module_path(edges: DataFrame, names: DataFrame, modules: DataFrame) -> DataFrame:
    """Call targets that start with their repository's module path lose it if what remains is declared."""
    known = names.select(F.col("name").alias("_short")).distinct()
    cut = edges.join(modules.select("repo", "module_path").distinct(), "repo", "left").withColumn(
        "_try", F.when((F.col("rel") == "calls") & F.startswith(F.col("dst"), F.concat("module_path", F.lit("/"))), F.expr("substring(dst, length(module_path) + 2)"))
    )
    return cut.join(known, F.col("_try") == F.col("_short"), "left").withColumn("dst", F.coalesce("_short", "dst")).drop("_try", "_short", "module_path")


def nearest_module(df: DataFrame, column: str, modules: DataFrame, out: str = "module") -> DataFrame:
    """The longest module name that is the path or a directory above it; null if none is."""
    paths = df.select(column).distinct()
    tried = paths.select(column, F.posexplode(ancestors(F.col(column))).alias("_up", "_name"))
    found = tried.join(modules.select(F.col("name").alias("_name")).distinct(), "_name").groupBy(column).agg(F.min_by("_name", "_up").alias(out))
    return df.join(found, column, "left")


def module_imports(dependencies: DataFrame, modules: DataFrame) -> DataFrame:
    """Module-to-module edges of dependency facts(repo, importer, target): both ends at their nearest module, no self edges, repeats kept."""
    ends = nearest_module(nearest_module(dependencies, "importer", modules, "src"), "target", modules, "dst")
    return ends.filter("src is not null and dst is not null and src <> dst")


def has_method_edges(facts: DataFrame) -> DataFrame:
    """Synthetic edges from a type to each symbol that its name owns."""
    symbols = facts.filter("kind = 'symbol'")
    types = symbols.filter(F.col("symbol_kind").isin("class", "struct", "interface", "type", "enum")).select(F.col("name").alias("src")).distinct()
    owned = symbols.withColumn("src", owner_name(F.col("name"))).filter("src is not null")
    return owned.join(types, "src").select("repo", "src", F.lit("symbol").alias("src_kind"), F.lit("has_method").alias("rel"), F.col("name").alias("dst"), F.lit("symbol").alias("dst_kind"), F.col("file").alias("src_file"), F.col("file").alias("dst_file"))


def dedup(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(IDENTITY)


def fan_in(edges: DataFrame) -> DataFrame:
    """Architectural fan-in of each target: distinct edges, without instantiation and implementation links and without tests, files and routes as sources."""
    counted = edges.filter(~F.col("rel").isin(*NOT_FAN_IN_RELATIONS) & ~F.col("src_kind").isin(*NOT_FAN_IN_SOURCES))
    return counted.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("fan_in"))


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("rel").isin(*NOT_FAN_OUT_RELATIONS)).groupBy(F.col("src").alias("name")).agg(F.count("*").alias("fan_out"))


def forward(edges: DataFrame, names: DataFrame | list[str], rels: list[str] | None = None) -> DataFrame:
    """Edges out of the named ends: a few names, or any number as ``names(name)``."""
    return _at(edges, "src", names, rels)


def reverse(edges: DataFrame, names: DataFrame | list[str], rels: list[str] | None = None) -> DataFrame:
    """Edges into the named ends: a few names, or any number as ``names(name)``."""
    return _at(edges, "dst", names, rels)


def _at(edges: DataFrame, end: str, names: DataFrame | list[str], rels: list[str] | None) -> DataFrame:
    out = edges.filter(F.col("rel").isin(rels)) if rels else edges
    return out.filter(F.col(end).isin(names)) if isinstance(names, list) else out.join(names.select(F.col("name").alias(end)).distinct(), end, "left_semi")


def module_graph(dependencies: DataFrame, modules: DataFrame, *, without: tuple[str, ...] = ()) -> DataFrame:
    """Edges between production modules, repeats and self edges kept; chosen coupling kinds and edges out of tests are left out."""
    production = modules.filter("role = 'production'").select("name").distinct()
    kept = dependencies.filter(~F.col("coupling").isin(*without)) if without else dependencies
    return (
        kept.join(production.withColumnRenamed("name", "importer"), "importer", "left_semi")
        .join(production.withColumnRenamed("name", "target"), "target", "left_semi")
        .select(F.col("importer").alias("src"), F.col("target").alias("dst"))
    )
