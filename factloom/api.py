"""The tools that users call, over one snapshot's facts and edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.names import fact_id
from .operators import aggregates, constraints, diffing, explainers, filters, graph, history, joins, linking, traversal
from .operators.constraints import Rule
from .sources import facts_io


@dataclass
class Session:
    """A snapshot under query.  ``edges`` default to the facts' embedded relations."""

    facts: DataFrame
    edges: DataFrame | None = None
    findings: DataFrame | None = None
    rules: list[Rule] = field(default_factory=list)
    baseline: DataFrame | None = None
    least_confidence: float = 0.6

    def __post_init__(self):
        if self.edges is None:
            self.edges = graph.dedup(graph.explode_relations(self.facts).unionByName(graph.has_method_edges(self.facts)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Session:
        facts, _ = facts_io.read_snapshot(spark, path)
        return cls(facts)

    def views(self, prefix: str = "") -> None:
        """Temp views, so that ``spark.sql`` is the query language."""
        self.facts.createOrReplaceTempView(f"{prefix}facts")
        self.edges.createOrReplaceTempView(f"{prefix}edges")

    def _resolved(self, name: str) -> str:
        """The best candidate's name; too unsure ones raise with the candidates instead of a guess."""
        found = filters.resolve_name(self.facts, name).orderBy("rank").collect()
        if not found:
            return name
        if found[0]["confidence"] < self.least_confidence:
            raise LookupError(f"{name}: {', '.join(r['name'] for r in found)}")
        return found[0]["name"]

    def _seed(self, name: str, rollup: bool = False) -> DataFrame:
        name = self._resolved(name)
        if rollup:
            return traversal.seed_rollup(self.facts, self.edges, name)
        return self.facts.sparkSession.createDataFrame([(name,)], "name string")

    def query_facts(self, *, offset: int = 0, limit: int = 100, **conditions) -> DataFrame:
        return filters.page(filters.query_advanced(self.facts, edges=self.edges, **conditions), ["repo", "kind", "name", "file"], offset=offset, limit=limit)

    def show_symbol(self, name: str) -> DataFrame:
        return filters.show_symbol(self.facts, name)

    def explore(self, module: str) -> DataFrame:
        return filters.explore(self.facts, self.edges, module)

    def traverse(self, name: str, **options) -> DataFrame:
        return traversal.traverse(self.edges, self.facts, self._seed(name, options.get("direction") == "reverse"), **options)

    def find_path(self, start: str, end: str, *, depth: int = 10) -> DataFrame:
        return traversal.find_path(self.edges, self._resolved(start), self._resolved(end), depth=depth)

    def impact_analysis(self, name: str, *, depth: int = 3) -> DataFrame:
        return traversal.impact(self.edges, self._seed(name, rollup=True), depth=depth)

    def endpoint_impact(self, routes: DataFrame, handlers: DataFrame, models: DataFrame, tables: DataFrame) -> DataFrame:
        return traversal.endpoint_chain(routes, handlers, self.edges, models, tables)

    def governing_intent(self, anchors: DataFrame) -> DataFrame:
        return traversal.governing(anchors, self.facts.select("repo", "file").distinct())

    def constraints(self, **more) -> DataFrame:
        return constraints.evaluate(self.rules, self.facts, self.edges, **more)

    def constraints_for(self, file: str) -> DataFrame:
        return constraints.contract_for(self.rules, self.facts, file)

    def plan_check(self, patch: DataFrame) -> DataFrame:
        return diffing.plan_check(self.facts, patch, lambda f: constraints.evaluate(self.rules, f, self.edges))

    def coverage_report(self, routes: DataFrame) -> DataFrame:
        return linking.coverage_report(routes, aggregates.coverage_tallies(linking.http_states(routes)))

    def query_insights(self, **conditions) -> DataFrame:
        return filters.insights_where(self.findings, **conditions)

    def set_baseline(self) -> None:
        self.baseline = self.facts

    def diff_snapshot(self, values: list[str]) -> DataFrame:
        return diffing.diff_facts(self.baseline, self.facts, values)

    def snapshot_receipt(self) -> DataFrame:
        c = lambda n: F.coalesce(F.col(n), F.lit(""))
        with_id = self.facts.withColumn("id", fact_id(c("repo"), c("kind"), c("name"), c("file")))
        return aggregates.receipt(self.facts, joins.resolve_targets(self.edges, with_id))

    def compare_receipts(self, old: DataFrame, new: DataFrame, worse_up: tuple[str, ...] = ()) -> DataFrame:
        return diffing.compare_receipts(old, new, worse_up=worse_up)

    def architecture_history(self, revisions: DataFrame) -> DataFrame:
        return history.patches(revisions)

    def architecture_blame(self, revisions: DataFrame, term: str) -> DataFrame:
        return history.blame(history.patches(revisions), term)

    def package_metrics(self, module_edges: DataFrame) -> DataFrame:
        return explainers.package_metrics(self.facts, module_edges)

    def find_orphans(self) -> DataFrame:
        return explainers.unreferenced(self.facts, self.edges)

    def analyze_performance(self, methods: DataFrame, loop_calls: DataFrame, **more) -> DataFrame:
        return explainers.performance(methods, loop_calls, **more)
