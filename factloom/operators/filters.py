"""Projections, filters, predicates and ranked name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import dirname, glob_regex, has_suffix, short_name

DEFAULT_LIMIT, MOST_LIMIT = 100, 500


def query(facts: DataFrame, *, kind: str | None = None, file: str | None = None, name: str | None = None, relation: str | None = None, edges: DataFrame | None = None) -> DataFrame:
    """All given conditions at once; ``name`` is a substring in any case; ``relation`` keeps facts with such an outgoing edge."""
    out = facts
    if kind is not None:
        out = out.filter(F.col("kind") == kind)
    if file is not None:
        out = out.filter(F.col("file") == file)
    if name is not None:
        out = out.filter(F.contains(F.lower("name"), F.lit(name.lower())))
    if relation is not None:
        out = _with_relation(out, relation, edges)
    return out


def _with_relation(facts: DataFrame, relation: str, edges: DataFrame | None) -> DataFrame:
    if edges is None:
        return facts.filter(F.exists("relations", lambda r: r["kind"] == relation))
    sources = edges.filter(F.col("rel") == relation).select(F.col("src").alias("name"), F.col("src_kind").alias("kind")).distinct()
    return facts.join(sources, ["name", "kind"], "left_semi")


def query_advanced(
    facts: DataFrame, *, kinds: list[str] | None = None, repo: str | None = None, files: list[str] | None = None, prefix: str | None = None, name: str | None = None,
    names: list[str] | None = None, relation: str | None = None, prop: str | None = None, value: str | None = None, edges: DataFrame | None = None,
) -> DataFrame:
    """Kind among, repository, (file among or file prefix), (name substring or name among), outgoing relation, property present or equal."""
    out = facts
    if kinds:
        out = out.filter(F.col("kind").isin(kinds))
    if repo is not None:
        out = out.filter(F.col("repo") == repo)
    places = ([F.col("file").isin(files)] if files else []) + ([F.startswith(F.col("file"), F.lit(prefix))] if prefix else [])
    called = ([F.contains(F.lower("name"), F.lit(name.lower()))] if name else []) + ([F.col("name").isin(names)] if names else [])
    for among in (places, called):
        if among:
            out = out.filter(among[0] if len(among) == 1 else among[0] | among[1])
    if relation:
        out = _with_relation(out, relation, edges)
    if prop is not None:
        held = F.col(prop).cast("string") if prop in facts.columns else F.element_at("props", F.lit(prop))
        out = out.filter(held.isNotNull() if value is None else held == value)
    return out


def lookup(facts: DataFrame, *, kind: str | None = None, file: str | None = None, name: str | None = None, repo: str | None = None, relation: str | None = None) -> DataFrame:
    """Facts by exact value of one indexed column, or of several; ``relation``: with such an embedded relation."""
    out = facts
    for column, value in (("kind", kind), ("file", file), ("name", name), ("repo", repo)):
        if value is not None:
            out = out.filter(F.col(column) == value)
    return _with_relation(out, relation, None) if relation is not None else out


def page(facts: DataFrame, order: list[str], *, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Rows from ``offset`` in a total order, at most ``limit`` (500 at most), each with the count before paging."""
    limit = min(max(limit, 1), MOST_LIMIT)
    total = facts.agg(F.count("*").alias("total"))
    return facts.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))


def summary(facts: DataFrame) -> DataFrame:
    """The summary output: counts by kind and symbol kind."""
    return facts.groupBy("kind", F.coalesce("symbol_kind", F.lit("")).alias("symbol_kind")).agg(F.count("*").alias("n"))


def with_related(facts: DataFrame, edges: DataFrame, every: DataFrame) -> DataFrame:
    """The distinct facts that the given ones point to, by name and, where known, kind."""
    ends = edges.join(facts.select(F.col("name").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("name"), F.col("dst_kind").alias("kind")).distinct()
    return every.join(ends, ["name", "kind"], "left_semi")


def where(pairs: dict[str, str]) -> Column:
    """A where-predicate: every pair must hold.

    ``<any>`` asks for presence; ``>= n``, ``<= n``, ``> n`` and ``< n`` compare numbers
    (what isn't a number never holds); anything else is equality of tokens.
    """
    out = F.lit(True)
    for column, want in pairs.items():
        text = F.col(column).cast("string")
        sign = next((s for s in (">=", "<=", ">", "<") if want.startswith(s)), None)
        if want == "<any>":
            one = text.isNotNull() & (text != "")
        elif sign:
            number, bound = F.expr(f"try_cast(`{column}` as double)"), float(want[len(sign) :])
            one = {">=": number >= bound, "<=": number <= bound, ">": number > bound, "<": number < bound}[sign]
        else:
            one = text == want
        out = out & F.coalesce(one, F.lit(False))
    return out


def first_glob(df: DataFrame, column: str, patterns: list[str], out: str = "pattern") -> DataFrame:
    """The first pattern that matches a path; null if none does."""
    found = F.lit(None).cast("string")
    for p in reversed(patterns):
        found = F.when(F.col(column).rlike(glob_regex(p)), p).otherwise(found)
    return df.withColumn(out, found)


def insights_where(findings: DataFrame, *, source: str | None = None, repo: str | None = None, least: float = 0.0) -> DataFrame:
    """Findings by explainer, by repository of any evidence path, and by confidence."""
    out = findings.filter(F.col("confidence") >= least)
    if source is not None:
        out = out.filter(F.col("source") == source)
    if repo is not None:
        out = out.filter(F.exists("evidence", lambda e: F.startswith(e["file"], F.lit(f"{repo}/"))))
    return out


def parse_scoped(term: str) -> dict[str, str]:
    """``repo:``, ``kind:`` and ``file:`` tokens, and the rest as the term."""
    out, rest = {}, []
    for token in term.split():
        head, mark, tail = token.partition(":")
        if mark and head in ("repo", "kind", "file") and tail:
            out[head] = tail
        else:
            rest.append(token)
    return out | {"term": " ".join(rest)}


def resolve_name(facts: DataFrame, query_text: str, *, limit: int = 10) -> DataFrame:
    """Ranked candidates for a scoped query: ``name, kind, tier, score, rank, confidence``.

    An exact name is tier 2; an equal short name or a qualified suffix is tier 1.  A matching
    kind adds .15 and a matching file .1 to the score, a mismatch takes as much away.  The
    best one's confidence is 1 if it alone is exact, .9 if it is the only
    candidate, else its share of the two best scores.
    """
    asked = parse_scoped(query_text)
    term = F.lit(asked["term"])
    name = F.col("name")
    tier = F.when(F.lower(name) == F.lower(term), 2).when((F.lower(short_name(name)) == F.lower(term)) | has_suffix(name, term), 1)
    out = facts.filter(F.col("repo") == asked["repo"]) if "repo" in asked else facts
    score = tier.cast("double")
    if "kind" in asked:
        score = score + F.when((F.col("kind") == asked["kind"]) | (F.col("symbol_kind") == asked["kind"]), 0.15).otherwise(-0.15)
    if "file" in asked:
        score = score + F.when(F.contains(F.col("file"), F.lit(asked["file"])), 0.1).otherwise(-0.1)
    ranked = out.withColumn("tier", tier).filter("tier is not null").withColumn("score", score).groupBy("name", "kind").agg(F.max("tier").alias("tier"), F.max("score").alias("score"))
    best = ranked.orderBy(F.desc("score"), "name", "kind").limit(max(2, limit))
    w = Window.orderBy(F.desc("score"), "name", "kind")
    numbered = best.withColumn("rank", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    sure = F.when(F.col("rank") == 1, F.when(F.col("second").isNull(), F.when(F.col("tier") == 2, 1.0).otherwise(0.9)).when((F.col("tier") == 2) & (F.col("second") < 2), 1.0).otherwise(F.col("score") / (F.col("score") + F.col("second"))))
    return numbered.withColumn("confidence", sure).drop("second").filter(F.col("rank") <= limit)


def explore(facts: DataFrame, edges: DataFrame, module: str) -> DataFrame:
    """Counts around a module: its symbols by kind, what its symbols use, and who uses them."""
    own = facts.filter((F.col("kind") == "symbol") & (dirname(F.col("file")) == module))
    names = own.select("name").distinct()
    kinds = own.groupBy(F.lit("symbols").alias("part"), F.col("symbol_kind").alias("what")).agg(F.count("*").alias("n"))
    used = edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi").groupBy(F.lit("uses").alias("part"), F.col("rel").alias("what")).agg(F.countDistinct("dst").alias("n"))
    users = edges.join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").groupBy(F.lit("used_by").alias("part"), F.col("rel").alias("what")).agg(F.countDistinct("src").alias("n"))
    return kinds.unionByName(used).unionByName(users)


def show_symbol(facts: DataFrame, name: str, *, most: int = 5) -> DataFrame:
    """Facts of the exact name; only if there are none, of names that contain it; at most five."""
    symbols = facts.filter("kind = 'symbol'")
    tier = F.when(F.col("name") == name, 0).when(F.contains(F.lower("name"), F.lit(name.lower())), 1)
    found = symbols.withColumn("tier", tier).filter("tier is not null")
    least = found.agg(F.min("tier").alias("tier"))
    return found.join(F.broadcast(least), "tier").drop("tier").orderBy("name", "file", "line").limit(most)


def source_window(files: DataFrame, at: DataFrame, *, around: int = 3) -> DataFrame:
    """Lines around a symbol: files(file, content) joined with at(name, file, line)."""
    lines = F.split("content", "\n")
    start = F.greatest(F.col("line") - around, F.lit(1))
    return at.join(files, "file").select("name", "file", start.alias("from_line"), F.array_join(F.slice(lines, start, F.col("line") + around - start + 1), "\n").alias("source"))
