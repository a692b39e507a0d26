"""One query for each operator family over the driver tables, beside equivalent DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpoint_dir, cut
from ..functions import names as fn
from ..functions import scanners
from ..operators import aggregates as ag
from ..operators import components, constraints, diffing, explainers, filters, graph, history, joins, linking, traversal
from ..operators.constraints import Component, Rule
from ..schema import RELATION
from ..sources import facts_io
from ..sources.driver_tables import PRELUDE, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Small fixed starting points, present at every scale.
SEED_PART = 7


def query(name: str, sql: str | None = None, *, recursive: bool = False):
    """Register ``f(tables)`` under a name, with SQL over the shared common tables."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            more = ("," if sql.startswith("#") else "") + " " + sql.removeprefix("#")
            ORACLE_SQL[name] = f"with {'recursive ' * recursive}{PRELUDE.strip()}{more}"
        return f

    return put


# -- filters, projections, resolution


@query("f1_query", "select repo, kind, name, file from facts where kind = 'symbol' and contains(lower(name), 'customer1') and symbol_kind = 'class'")
def f1(t):
    return filters.query(t.facts().filter("symbol_kind = 'class'"), kind="symbol", name="CUSTOMER1").select("repo", "kind", "name", "file")


@query(
    "f2_query_advanced",
    "select name, kind, symbol_kind from facts where kind in ('symbol', 'module') and repo = 'LIB' and (starts_with(file, 'lib/Brand#1') or file = 'lib/Brand#2') and (name, kind) in (select (dst, dst_kind) from edges union select (src, src_kind) from edges where rel in ('depends_on', 'declares')) and (name, kind) in (select (src, src_kind) from edges where rel = 'declares')",
)
def f2(t):
    return filters.query_advanced(t.facts(), kinds=["symbol", "module"], repo="LIB", files=["lib/Brand#2"], prefix="lib/Brand#1", relation="declares", edges=t.edges("declares")).select("name", "kind", "symbol_kind")


@query("f2_prop_value", "select name, role from facts where kind = 'symbol' and role = 'BUILDING'")
def f2b(t):
    return filters.query_advanced(t.facts(), kinds=["symbol"], prop="role", value="BUILDING").select("name", "role")


@query("f3_page", "select name, file, (select count(*) from facts where kind = 'symbol' and symbol_kind = 'struct') as total from facts where kind = 'symbol' and symbol_kind = 'struct' order by name, file limit 50 offset 20")
def f3(t):
    return filters.page(t.facts().filter("kind = 'symbol' and symbol_kind = 'struct'").select("name", "file"), ["name", "file"], offset=20, limit=50)


@query("f4_summary", "select kind, coalesce(symbol_kind, '') as symbol_kind, count(*) as n from facts group by 1, 2")
def f4(t):
    return filters.summary(t.facts())


@query("f4_related", "select distinct f.name, f.kind from facts f join edges e on f.name = e.dst and f.kind = e.dst_kind join facts o on o.name = e.src where o.symbol_kind = 'interface'")
def f4b(t):
    f = t.facts()
    return filters.with_related(f.filter("symbol_kind = 'interface'"), t.edges(), f).select("name", "kind").distinct()


@query("f5_lookup", "select name, kind, repo, file from facts where kind = 'symbol' and repo = 'ASIA' union all select name, kind, repo, file from facts where file = 'lib/Brand#1' union all select name, kind, repo, file from facts where name = 'service:EUROPE'")
def f5(t):
    f = t.facts().select("name", "kind", "repo", "file")
    return filters.lookup(f, kind="symbol", repo="ASIA").unionByName(filters.lookup(f, file="lib/Brand#1")).unionByName(filters.lookup(f, name="service:EUROPE"))


@query("f5_by_relation", "select distinct src as name from part_links")
def f5b(t):
    embedded = t.part_links().groupBy(F.col("src").alias("name")).agg(F.collect_set(F.struct(F.lit("depends_on").alias("kind"), F.col("dst").alias("target"))).alias("relations"))
    return filters.lookup(embedded, relation="depends_on").select("name")


@query("f6_where", "select name, cyclomatic from facts where symbol_kind = 'method' and cyclomatic >= 6 and coalesce(role, '') <> '' and loop_depth < 2")
def f6(t):
    return t.facts().filter(filters.where({"symbol_kind": "method", "cyclomatic": ">= 6", "role": "<any>", "loop_depth": "< 2"})).select("name", "cyclomatic")


@query(
    "f7_glob",
    "select file, case when regexp_matches(file, '^src/(?:[^/]+/)*customer[^/]*\\.py$') then 'src/**/customer*.py' when regexp_matches(file, '^lib/[^/]*/part1[^/]\\.go$') then 'lib/*/part1?.go' when regexp_matches(file, '^lib(?:/.*)?$') then 'lib' end as pattern from (select distinct file from facts)",
)
def f7(t):
    return filters.first_glob(t.facts().select("file").distinct(), "file", ["src/**/customer*.py", "lib/*/part1?.go", "lib"])


@query("f8_paths", "select file, regexp_matches(file, '(^|/)(tests?|spec)(/|$)') or regexp_matches(file, '_test\\.[a-z]+$') as test from (select distinct 'x/' || lower(role) || '/' || name || case when length(name) % 2 = 0 then '_test.go' else '.go' end as file from facts where kind = 'module')")
def f8(t):
    paths = t.facts().filter("kind = 'module'").select(F.concat(F.lit("x/"), F.lower("role"), F.lit("/"), "name", F.when(F.length("name") % 2 == 0, "_test.go").otherwise(".go")).alias("file")).distinct()
    return paths.select("file", fn.is_test_path(F.col("file")).alias("test"))


@query(
    "f10_resolve",
    """#m as (select name, kind, case when lower(name) = 'customer1' then 2 when lower(regexp_extract(name, '([^./]*)$', 1)) = 'customer1' or ends_with(lower(name), '.customer1') or ends_with(lower(name), '/customer1') then 1 end as tier, symbol_kind, file from facts),
s as (select name, kind, max(tier) as tier, max(tier + case when kind = 'class' or symbol_kind = 'class' then 0.15 else -0.15 end) as score from m where tier is not null group by 1, 2),
r as (select *, row_number() over (order by score desc, name, kind) as rank, lead(score) over (order by score desc, name, kind) as second from s)
select name, kind, tier, cast(score as double) as score, cast(rank as integer) as rank, cast(case when rank = 1 then case when second is null then case when tier = 2 then 1.0 else 0.9 end when tier = 2 and second < 2 then 1.0 else score / (score + second) end end as double) as confidence from r where rank <= 10""",
)
def f10(t):
    return filters.resolve_name(t.facts(), "kind:class Customer1")


@query(
    "f10_resolve_many",
    """#s as (select name, kind, 1 as tier, max(1 + case when contains(file, 'Brand#1') then 0.1 else -0.1 end) as score from facts where repo = 'LIB' and lower(regexp_extract(name, '([^./]*)$', 1)) in ('brand#1') group by 1, 2),
r as (select *, row_number() over (order by score desc, name, kind) as rank, lead(score) over (order by score desc, name, kind) as second from s)
select name, kind, tier, cast(score as double) as score, cast(rank as integer) as rank, cast(case when rank = 1 then case when second is null then 0.9 else score / (score + second) end end as double) as confidence from r where rank <= 10""",
)
def f10b(t):
    return filters.resolve_name(t.facts(), "repo:LIB file:Brand#1 Brand#1")


@query("f9_insights", "select 'part ' || p_partkey as title, case when p_partkey % 3 = 0 then 'cycles' else 'surface' end as source from part where p_partkey % 3 = 0 and case when p_size > 25 then 1.0 else 0.5 end >= 0.6 and p_brand = 'Brand#1'")
def f9(t):
    p = t.raw("part")
    found = p.select(F.when(F.col("p_partkey") % 3 == 0, "cycles").otherwise("surface").alias("source"), F.concat(F.lit("part "), "p_partkey").alias("title"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.5).alias("confidence"), F.array(F.struct(F.concat("p_brand", F.lit("/x.go")).alias("file"))).alias("evidence"))
    return filters.insights_where(found, source="cycles", repo="Brand#1", least=0.6).select("title", "source")


@query(
    "f11_explore",
    """#own as (select name, symbol_kind from facts where kind = 'symbol' and regexp_replace(file, '/[^/]*$', '') = 'lib/Brand#1')
select 'symbols' as part, symbol_kind as what, count(*) as n from own group by 2
union all select 'uses', rel, count(distinct dst) from edges where src in (select name from own) group by 2
union all select 'used_by', rel, count(distinct src) from edges where dst in (select name from own) group by 2""",
)
def f11(t):
    return filters.explore(t.facts(), t.edges(), "lib/Brand#1")


@query("f12_show_symbol", "select name, file, line from facts where kind = 'symbol' and contains(lower(name), 'supplier') order by name, file, line limit 5")
def f12(t):
    return filters.show_symbol(t.facts(), "supplier").select("name", "file", "line")


# -- graph


@query("g1_edges", "select rel, count(*) as n, count(distinct src) as sources, count(distinct dst) as targets from edges group by rel")
def g1(t):
    return t.keyed_edges().groupBy("rel").agg(F.count("*").alias("n"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("g1_explode", "select src, rel, dst, count(*) as n from part_links group by 1, 2, 3")
def g1b(t):
    embedded = t.part_links().groupBy("repo", F.col("src").alias("name"), F.lit("symbol").alias("kind"), F.col("src_file").alias("file")).agg(
        F.collect_list(F.struct(F.lit("depends_on").alias("kind"), F.col("dst").alias("target"), F.lit("symbol").alias("target_kind"), F.col("dst_file").alias("target_file"))).alias("relations")
    )
    return graph.explode_relations(embedded).groupBy("src", "rel", "dst").agg(F.count("*").alias("n"))


@query("g3_module_imports", "select importer as src, target as dst, count(*) as n from dependencies where importer <> target group by 1, 2")
def g3(t):
    d = t.dependencies().select("repo", F.col("importer_file").alias("importer"), F.col("target_file").alias("target"))
    return graph.module_imports(d, t.facts().filter("kind = 'module'")).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("g4_has_method", "select c.name as src, o.name as dst from ord o join cust c on o.owner = c.name")
def g4(t):
    return graph.has_method_edges(t.facts()).select("src", "dst")


@query("g5_dedup", "select rel, count(*) as n, (select count(*) from calls) as rows from (select distinct src, src_kind, rel, dst, dst_kind from calls) group by rel")
def g5(t):
    calls = t.calls()
    rows = calls.agg(F.count("*").alias("rows"))
    return graph.dedup(calls).groupBy("rel").agg(F.count("*").alias("n")).join(F.broadcast(rows))


@query("g2_strip_module_path", "select p.name as src, case when q.p_partkey % 2 = 0 then q.name else 'mod/' || q.name end as dst from part_links e join prt p on p.name = e.src join prt q on q.name = e.dst")
def g2(t):
    links = t.part_links()
    calls = links.select("repo", "src", F.lit("calls").alias("rel"), F.concat(F.lit("mod/"), "dst").alias("dst"))
    declared = t.parts().filter("p_partkey % 2 = 0")
    return graph.strip_module_path(calls, declared, t.parts().select("repo", F.lit("mod").alias("module_path")).distinct()).select("src", "dst")


@query("g6_fan_in_top", "select dst as name, count(*) as fan_in from edges where rel not in ('instantiates', 'implemented_by') group by 1 order by 2 desc, 1 limit 10")
def g6(t):
    return ag.top(graph.fan_in(t.edges()), 10, F.desc("fan_in"), "name")


@query("g6_fan_out", "select src as name, count(*) as fan_out from edges where rel <> 'has_method' group by 1 having count(*) > 8")
def g6b(t):
    return t.named(graph.fan_out(t.keyed_edges()).filter("fan_out > 8"), "name")


@query("g7_reverse", "select src, rel, dst from edges where rel in ('declares', 'implements') and dst in (select name from prt)")
def g7(t):
    return graph.reverse(t.edges("declares", "implements"), t.parts(), ["declares", "implements"]).select("src", "rel", "dst")


@query("g7_forward", "select src, rel, dst from edges where rel = 'implements' and src in (select name from supp where s_acctbal > 0)")
def g7b(t):
    return graph.forward(t.edges("implements"), t.suppliers().filter("s_acctbal > 0"), ["implements"]).select("src", "rel", "dst")


@query("g8_module_graph", "select importer as src, target as dst, count(*) as n from dependencies where coupling not in ('association', 'reference') and importer in (select dir from nat where nk % 5 <> 4) and target in (select dir from nat where nk % 5 <> 4) group by 1, 2")
def g8(t):
    return graph.module_graph(t.dependencies(), t.facts().filter("kind = 'module'"), without=("association", "reference")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def _seeds(t: Tables, below: int) -> DataFrame:
    return t.parts().filter(F.col("p_partkey") < below).select("name")


_WALK = """#steps as (select distinct src as a, dst as b from part_links where src <> dst),
walk(name, depth) as (select name, 0 from prt where p_partkey < {n} union select b, depth + 1 from walk join steps on a = name where depth < {d})"""


@query("g9_traverse", _WALK.format(n=5, d=4) + " select name, min(depth) as depth from walk group by name", recursive=True)
def g9(t):
    return traversal.walk(t.part_links(), _seeds(t, 5), depth=4)


@query("g9_traverse_shown", _WALK.format(n=40, d=3) + ", found as (select name, min(depth) as depth from walk group by name) select name, depth, 'symbol' as kind, (select count(*) > 60 from found) as truncated from found order by depth, name limit 60", recursive=True)
def g9b(t):
    return traversal.traverse(t.part_links(), t.facts(), _seeds(t, 40), depth=3, nodes=60)


@query(
    "g10_path_length",
    "#steps as (select distinct src as a, dst as b from part_links where src <> dst), walk(name, depth) as (select min(src), 0 from part_links union select b, depth + 1 from walk join steps on a = name where depth < 6), goal as (select max(name) as name from walk where depth = (select max(depth) from walk w where not exists (select 1 from walk v where v.name = w.name and v.depth < w.depth)) and not exists (select 1 from walk v where v.name = walk.name and v.depth < walk.depth)) select (select min(src) from part_links) as start, g.name as goal, min(w.depth) as hops from goal g join walk w on w.name = g.name group by 1, 2",
    recursive=True,
)
def g10(t):
    links = t.part_links()
    start = links.agg(F.min("src")).first()[0]
    spark = t.spark
    reached = traversal.walk(links, spark.createDataFrame([(start,)], "name string"), depth=6)
    goal = reached.orderBy(F.desc("depth"), F.desc("name")).first()["name"]
    return traversal.find_path(links, start, goal, depth=6).agg(F.lit(start).alias("start"), F.lit(goal).alias("goal"), F.max("step").alias("hops"))


@query(
    "g10_path",
    """#steps as (select distinct src as a, dst as b from part_links where src <> dst), walk(name, depth) as (select min(src), 0 from part_links union select b, depth + 1 from walk join steps on a = name where depth < 6),
near as (select name, min(depth) as depth from walk group by name), goal as (select name, depth from near order by depth desc, name desc limit 1),
parent as (select b as name, min(a) as up from steps join near x on x.name = a join near y on y.name = b where y.depth = x.depth + 1 group by b),
back(step, name) as (select depth, name from goal union all select step - 1, up from back join parent using (name) where step > 0) select cast(step as integer) as step, name from back""",
    recursive=True,
)
def g10b(t):
    links = t.part_links()
    start = links.agg(F.min("src")).first()[0]
    reached = traversal.walk(links, t.spark.createDataFrame([(start,)], "name string"), depth=6)
    goal = reached.orderBy(F.desc("depth"), F.desc("name")).first()["name"]
    return traversal.find_path(links, start, goal, depth=6)


@query(
    "g11_impact",
    "#steps as (select distinct dst as a, src as b from edges where src <> dst), walk(name, depth) as (select name, 0 from prt where p_partkey < 3 union select b, depth + 1 from walk join steps on a = name where depth < 3), found as (select name, min(depth) as depth from walk group by name) select depth, count(*) as n from found where depth > 0 group by depth",
    recursive=True,
)
def g11(t):
    return traversal.impact(t.edges(), _seeds(t, 3)).select("depth", "n")


@query("g12_seed_rollup", "select name from (select name from cust where c_custkey = 1 union select o.name from ord o join cust c on o.owner = c.name where c_custkey = 1)")
def g12(t):
    f = t.facts()
    seed = t.customers().filter("c_custkey = 1").first()["name"]
    return traversal.seed_rollup(f, graph.has_method_edges(f), seed)


@query(
    "g13_endpoint_chain",
    """#rt as (select page_id, 'page' || page_id as route, case when page_id % 7 = 0 then null else page_id end as handler_key from pages),
h as (select r.route, o.name as handler from rt r left join ord o on r.handler_key = o.o_orderkey),
steps as (select distinct src as a, dst as b from (select * from calls union all select * from part_links) where src <> dst),
walk(root, name, depth) as (select distinct handler, handler, 0 from h where handler is not null union select root, b, depth + 1 from walk join steps on a = name where depth < 3),
m as (select distinct root, name as model from walk where name in (select name from prt)),
x as (select h.route, h.handler, m.model, case when p.p_size > 25 then p.p_type end as tab from h left join m on h.handler = m.root left join prt p on p.name = m.model)
select route, handler, least(count(distinct model), 25) as models, count(distinct tab) as tables, case when handler is null then 'handler' when count(distinct model) = 0 then 'models' when count(distinct tab) = 0 then 'tables' end as stopped_at from x group by route, handler""",
    recursive=True,
)
def g13(t):
    pages = t.raw("pages").select(F.concat(F.lit("page"), "page_id").alias("route"), F.when(F.col("page_id") % 7 != 0, F.col("page_id")).alias("handler_key"))
    f = t.keyed_facts()
    handlers = f.filter("symbol_kind = 'method'").select(F.shiftright("id", 3).alias("handler_key"), F.col("id").alias("name"))
    models = t.parts().select((F.col("p_partkey") * 8).alias("name"), "p_size", F.col("p_type").alias("table"))
    out = traversal.endpoint_chain(pages, handlers, t.keyed_edges("calls", "depends_on", once=False), models.select("name"), models.filter("p_size > 25").select(F.col("name").alias("model"), "table"))
    known = out.filter("handler is not null")
    out = t.named(known, "handler").unionByName(out.filter("handler is null").withColumn("handler", F.lit(None).cast("string")))
    return out.select("route", "handler", F.size("models").cast("long").alias("models"), F.size("tables").cast("long").alias("tables"), "stopped_at")


@query("g14_governing", "select distinct f.file, a.page from (select distinct file from prt) f join (select 'brand' as page, 'lib/Brand#1' as path union all select 'all', 'lib' union all select 'one', min(file) from prt) a on f.file = a.path or starts_with(f.file, a.path || '/')")
def g14(t):
    one = t.parts().agg(F.lit("one").alias("page"), F.min("file").alias("path"))
    anchors = t.spark.createDataFrame([("brand", "lib/Brand#1"), ("all", "lib")], "page string, path string").unionByName(one)
    return traversal.governing(anchors, t.parts().select("file").distinct())


_REACH = """#links as (select distinct src, dst from part_links), nodes as (select src as name from links union select dst from links),
reach(a, b) as (select src, dst from links where src <> dst union select r.a, l.dst from reach r join links l on r.b = l.src where l.src <> l.dst)"""


@query("g15_scc", _REACH + " select n.name, coalesce((select min(x.b) from reach x join reach y on x.b = y.a and y.b = x.a where x.a = n.name and x.b <= n.name), n.name) as component from nodes n", recursive=True)
def g15(t):
    return components.strongly_connected(t.part_links())


@query("g16_cycles", _REACH + ", c as (select n.name, coalesce((select min(x.b) from reach x join reach y on x.b = y.a and y.b = x.a where x.a = n.name and x.b <= n.name), n.name) as component from nodes n) select component, count(*) as size, count(*) > 8 as clustered from c group by component having count(*) > 1", recursive=True)
def g16(t):
    return components.cycles(t.part_links()).select("component", "size", "clustered")


@query(
    "g17_longest_chain",
    _REACH
    + """, comp as (select n.name, coalesce((select min(x.b) from reach x join reach y on x.b = y.a and y.b = x.a where x.a = n.name and x.b <= n.name), n.name) as component from nodes n),
w as (select component, cast(case when count(*) > 8 then 0 else count(*) end as integer) as weight, count(*) > 8 as large from comp group by 1),
dag as (select distinct a.component as a, b.component as b from links l join comp a on a.name = l.src join comp b on b.name = l.dst where a.component <> b.component and a.component in (select component from w where not large)),
chain(root, at_, s) as (select component, component, weight from w union select root, dag.b, s + w.weight from chain join dag on dag.a = at_ join w on w.component = dag.b)
select w.component, w.weight, max(s) as depth from w join chain on chain.root = w.component group by 1, 2""",
    recursive=True,
)
def g17(t):
    return components.longest_chains(t.part_links())


@query(
    "g18_closures",
    "#steps as (select distinct src as a, dst as b from part_links where src <> dst), walk(root, name, depth) as (select name, name, 0 from prt where p_partkey < 8 union select root, b, depth + 1 from walk join steps on a = name where depth < 8), f as (select root, name, min(depth) as depth from walk group by 1, 2) select root, count(*) - 1 as size, max(depth) as depth from f group by root",
    recursive=True,
)
def g18(t):
    return traversal.closures(t.part_links(), _seeds(t, 8), depth=8).groupBy("root").agg((F.count("*") - 1).alias("size"), F.max("depth").alias("depth"))


@query(
    "g19_effective_depth",
    _REACH
    + """, own as (select name, cast(p_size % 3 as integer) as d from prt),
live as (select l.src, l.dst from links l join own on own.name = l.src and own.d > 0),
lreach(a, b) as (select src, dst from live where src <> dst union select r.a, l.dst from lreach r join live l on r.b = l.src where l.src <> l.dst),
same as (select x.a, x.b from lreach x join lreach y on x.a = y.b and x.b = y.a union select distinct src, src from live),
inner_ as (select l.src, max(o.d) as more from live l join same s on s.a = l.src and s.b = l.dst join own o on o.name = l.dst group by 1),
steps as (select l.src, l.dst from live l where (l.src, l.dst) not in (select (a, b) from same)),
way(root, node, s) as (select name, name, d from own union select root, o.name, s + o.d from way join steps on steps.src = node join own o on o.name = steps.dst)
select own.name, own.d as own, cast(max(s + coalesce(more, 0)) as integer) as effective from own join way on root = own.name left join inner_ on inner_.src = node group by 1, 2""",
    recursive=True,
)
def g19(t):
    own = t.parts().select("name", (F.col("p_size") % 3).cast("int").alias("depth"))
    return components.effective_depth(own, t.part_links())


@query(
    "g20_reached_from_roots",
    "#steps as (select distinct src as a, dst as b from part_links where src <> dst), walk(name) as (select name from prt where p_partkey < 10 union select b from walk join steps on a = name) select name, name in (select name from walk) as reached from prt",
    recursive=True,
)
def g20(t):
    symbols = t.parts().select("name")
    return traversal.reached_from_roots(t.part_links(), symbols, _seeds(t, 10))


@query(
    "g20_reached_deep",
    "#steps as (select p_partkey as a, p_partkey + 1 as b from part where p_partkey % 64 <> 63), walk(k) as (select p_partkey from part where p_partkey % 128 = 0 union select b from walk join steps on a = k) select name, p_partkey in (select k from walk) as reached from prt",
    recursive=True,
)
def g20b(t):
    name = lambda k: F.concat(F.lit("k"), F.col(k).cast("string"))
    p = t.parts()
    chain = p.filter("p_partkey % 64 <> 63").select(name("p_partkey").alias("src"), F.concat(F.lit("k"), (F.col("p_partkey") + 1).cast("string")).alias("dst"), F.lit("calls").alias("rel"))
    keyed = p.select(name("p_partkey").alias("name"), F.col("name").alias("part"))
    reached = traversal.reached_from_roots(chain, keyed.select("name"), p.filter("p_partkey % 128 = 0").select(name("p_partkey").alias("name")))
    return reached.join(keyed, "name").select(F.col("part").alias("name"), "reached")


# -- joins


@query(
    "j1_resolve_targets",
    "#ids as (select distinct repo, name, kind, substr(sha256(concat_ws(chr(0), repo, kind, name, file)), 1, 32) as id from facts), l as (select repo, name, kind, count(distinct id) as n, min(id) as id from ids group by 1, 2, 3), g as (select name, kind, count(distinct id) as n, min(id) as id from ids group by 1, 2) select e.src, e.dst, case when l.n = 1 then l.id when l.n is null and g.n = 1 then g.id end as target_id, case when l.n = 1 or (l.n is null and g.n = 1) then 'resolved' when g.n > 1 then 'ambiguous' else 'unresolved' end as resolution from implementations e left join l on e.repo = l.repo and e.dst = l.name and l.kind = e.dst_kind left join g on e.dst = g.name and g.kind = e.dst_kind",
)
def j1(t):
    facts = t.facts().withColumn("id", fn.fact_id(F.col("repo"), F.col("kind"), F.col("name"), F.col("file")))
    return joins.resolve_targets(t.implementations(), facts).select("src", "dst", "target_id", "resolution")


@query("j2_nearest_module", "select file, regexp_replace(file, '/[^/]*$', '') as module from (select distinct file from facts where kind = 'symbol')")
def j2(t):
    f = t.facts()
    return graph.nearest_module(f.filter("kind = 'symbol'").select("file").distinct(), "file", f.filter("kind = 'module'"))


@query("j3_declaring_module", "select name, dir as module from ord")
def j3(t):
    f = t.facts()
    return joins.declaring_module(f.filter("symbol_kind = 'method'").select("name"), f.filter("kind = 'module'").select("name")).select("name", "module")


_ROUTES = """#norm as (select page_id as route_id, repo, role, method, split(array_to_string(list_transform(split(regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'), '\\.(json|xml|html)$', ''), '/'), lambda s: case when regexp_matches(s, '^[0-9]+$') then '{}' else s end), '/'), '/') as segs from routes),
suf as (select route_id, repo, role, method, array_to_string(segs[i:], '/') as suffix, len(segs) - i + 1 as segments from (select *, unnest(range(1, len(segs) + 1)) as i from norm) where len(segs) - i + 1 >= 2),
hits as (select c.route_id as client_id, s.route_id as server_id, c.segments from suf c join suf s using (suffix, segments) where c.role = 'client' and s.role = 'server' and (c.method = s.method or c.method = '*' or s.method = '*')),
best as (select client_id, server_id, cast(segments as integer) as segments from (select *, row_number() over (partition by client_id order by segments desc, server_id) as k from hits) where k = 1)"""


def _routes(t: Tables) -> DataFrame:
    """The routes with their numbers as parameters."""
    return t.routes().withColumnRenamed("page_id", "route_id").withColumn("path", F.regexp_replace("path", r"/[0-9]+(\.(json|xml|html))?(?=/|$)", "/:id"))


@query("j4_match_routes", _ROUTES + " select client_id, server_id, segments from best")
def j4(t):
    r = _routes(t)
    return joins.match_routes(r.filter("role = 'client'"), r.filter("role = 'server'"))


@query("j5_route_handlers", "select n_name || '_Controller#show' as handler, r_name as repo, 'Admin::' || n_name || 'Controller' as controller from nation join region on n_regionkey = r_regionkey where n_nationkey < 0 union all select n_name || 'Controller#index', r_name, n_name || 'Controller' from nation join region on n_regionkey = r_regionkey")
def j5(t):
    n = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    routes = n.select(F.concat("n_name", F.lit("Controller#index")).alias("handler"), F.col("r_name").alias("repo"))
    classes = n.select(F.concat("n_name", F.lit("Controller")).alias("name"))
    return joins.route_handlers(routes, classes)


@query("j6_unmatched_routes", _ROUTES + " select page_id as route_id, repo from routes where role = 'server' and page_id not in (select server_id from best)")
def j6(t):
    r = _routes(t)
    servers = r.filter("role = 'server'")
    return joins.unmatched_servers(servers, joins.match_routes(r.filter("role = 'client'"), servers)).select("route_id", "repo")


@query("j7_referenced", "select p.name from prt p where exists (select 1 from part_links e where e.dst = p.name and e.src <> p.name)")
def j7(t):
    return joins.referenced_by_other(t.parts().select("name"), t.part_links())


@query("j8_unresolved_top", "select c.repo as component, count(*) as n from routes c where role = 'client' and not exists (select 1 from routes s where s.role = 'server' and s.method = c.method and s.path = c.path) group by 1 order by 2 desc, 1 limit 8")
def j8(t):
    r = t.routes()
    return joins.unresolved_by_component(r.filter("role = 'client'").withColumnRenamed("repo", "component"), r.filter("role = 'server'"))


@query("j9_component_globs", "select name from facts where kind = 'symbol' and symbol_kind = 'class' and (regexp_matches(file, '^src/AFRICA/[^/]*/customer[^/]*\\.py$') or regexp_matches(file, '^src/(?:[^/]+/)*supplier1[^/]*\\.py$'))")
def j9(t):
    return Component(where={"kind": "symbol", "symbol_kind": "class"}, paths=("src/AFRICA/*/customer*.py", "src/**/supplier1*.py")).members(t.facts()).select("name")


@query("j10_prefix", "select f.file, a.page from (select distinct file from supp) f join (select dir as path, 'p' || nk as page from nat) a on starts_with(f.file, a.path || '/')")
def j10(t):
    return joins.prefix_join(t.suppliers().select("file").distinct(), t.nations().select(F.col("dir").alias("path"), F.concat(F.lit("p"), "nk").alias("page"))).select("file", "page")


@query(
    "j11_shared_code",
    "#every as (select distinct p_name || '/' || p_size % 10 as identity, p_brand as repo, w from (select p_name, p_size, p_brand, unnest(split(p_type || ' ' || p_name, ' ')) as w from part)), kept as (select identity from every group by 1 having count(distinct repo) > 1 and not ((select count(distinct repo) from every) >= 4 and count(distinct repo) / (select count(distinct repo) from every) > 0.5)), tok as (select * from every where identity in (select identity from kept)), sets as (select identity, repo, count(*) as n from tok group by 1, 2), both_ as (select a.identity, a.repo as repo_a, b.repo as repo_b, count(*) as c from tok a join tok b on a.identity = b.identity and a.w = b.w and a.repo < b.repo group by 1, 2, 3) select x.identity, repo_a, repo_b, round(c / (sa.n + sb.n - c), 9) as similarity from both_ x join sets sa on sa.identity = x.identity and sa.repo = repo_a join sets sb on sb.identity = x.identity and sb.repo = repo_b where c / (sa.n + sb.n - c) >= 0.8",
)
def j11(t):
    identity, words = F.concat("p_name", F.lit("/"), F.col("p_size") % 10), F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    tokens = t.raw("part").select(identity.alias("identity"), F.col("p_brand").alias("repo"), F.explode(words).alias("w")).groupBy("identity", "repo").agg(F.collect_set("w").alias("tokens"))
    return joins.shared_code(tokens, least=0.8).withColumn("similarity", F.round("similarity", 9))


@query("j12_topic_owner", "select c.repo, 'AFRICA.' || n_name as topic, 'AFRICA' as owner from nation n join nat c on c.nk = n.n_nationkey where c.repo <> 'AFRICA'")
def j12(t):
    consumers = t.nations().join(t.raw("nation"), F.col("nk") == F.col("n_nationkey")).select("repo", F.concat(F.lit("AFRICA."), "n_name").alias("topic"))
    return joins.topic_owners(consumers, t.raw("region").select(F.col("r_name").alias("repo"))).select("repo", "topic", "owner")


@query("j13_import_owner", "select repo, 'x/' || repo || '/ASIA/EUROPE/y' as target, case when repo = 'ASIA' then 'EUROPE' else 'ASIA' end as owner from (select r_name as repo from region)")
def j13(t):
    repos = t.raw("region").select(F.col("r_name").alias("repo"))
    return joins.import_owner(repos.select("repo", F.concat(F.lit("x/"), "repo", F.lit("/ASIA/EUROPE/y")).alias("target")), repos)


@query("j14_operations", "#p as (select distinct p_name || '/' || p_type as operation, p_brand as repo, p_size > 25 as serves from part) select distinct a.operation, a.repo as client_repo, b.repo as server_repo from p a join p b on a.operation = b.operation and a.repo <> b.repo where not a.serves and b.serves")
def j14(t):
    p = t.raw("part").select(F.concat_ws("/", "p_name", "p_type").alias("operation"), F.col("p_brand").alias("repo"), (F.col("p_size") > 25).alias("serves"))
    return joins.operations(p.filter("not serves"), p.filter("serves"))


_OLD_NEW = """#old as (select kind, repo, file, name, line, cyclomatic from facts where symbol_kind = 'method' and line % 10 <> 0),
new as (select kind, repo, file, name, line, case when line % 7 = 0 then cyclomatic + 1 else cyclomatic end as cyclomatic from facts where symbol_kind = 'method' and line % 11 <> 0)"""


def _old_new(t: Tables) -> tuple[DataFrame, DataFrame]:
    m = t.facts().filter("symbol_kind = 'method'").select("kind", "repo", "file", "name", "line", "cyclomatic")
    return m.filter("line % 10 <> 0"), m.filter("line % 11 <> 0").withColumn("cyclomatic", F.expr("case when line % 7 = 0 then cyclomatic + 1 else cyclomatic end"))


@query("j15_diff", _OLD_NEW + " select coalesce(o.name, n.name) as name, 1 as pos, case when o.name is null then 'added' when n.name is null then 'removed' when o.cyclomatic <> n.cyclomatic then 'changed' else 'same' end as status from old o full outer join new n using (kind, repo, file, name)")
def j15(t):
    old, new = _old_new(t)
    return joins.keyed_diff(old, new, ["kind", "repo", "file", "name"], ["cyclomatic"], ["line"]).select("name", "pos", "status")


@query("j16_path_candidates", "select a.name as start, a.k as ra, b.name as \"end\", b.k as rb from (select name, row_number() over (order by name) as k from supp order by name limit 3) a cross join (select name, row_number() over (order by name) as k from prt order by name limit 3) b")
def j16(t):
    def ranked(df: DataFrame) -> DataFrame:
        first = df.orderBy("name").limit(3)
        from pyspark.sql.window import Window

        return first.withColumn("rank", F.row_number().over(Window.orderBy("name")))

    return joins.path_candidates(ranked(t.suppliers().select("name")), ranked(t.parts().select("name")), most=3)


# -- aggregates, rankings, sets


@query("a1_statistics", "select symbol_kind, round(avg(cyclomatic), 6) as mean, round(stddev_pop(cyclomatic), 6) as deviation from facts where symbol_kind is not null group by 1")
def a1(t):
    return ag.statistics(t.facts().filter("symbol_kind is not null"), "cyclomatic", "symbol_kind")


@query("a6_half_up", "select p_partkey, cast(sign(p_size - 25) * floor(abs((p_size - 25) / 8.0) * 100 + 0.5) / 100 as double) as rounded from part")
def a6(t):
    return t.raw("part").select("p_partkey", fn.half_up((F.col("p_size") - 25) / F.lit(8.0), 2).alias("rounded"))


@query("a2_outliers", "#m as (select name, cyclomatic from facts where symbol_kind = 'method'), l as (select round(avg(cyclomatic) + 2 * stddev_pop(cyclomatic), 9) as threshold from m) select name, cyclomatic from m, l where cyclomatic > threshold")
def a2(t):
    return ag.outliers(t.facts().filter("symbol_kind = 'method'"), "cyclomatic").select("name", "cyclomatic")


@query("a3_counts", "select repo, kind, count(*) as n from facts group by 1, 2")
def a3(t):
    return ag.counts(t.facts(), "repo", "kind")


_IMPORTS = "#imp as (select distinct importer as src, target as dst from dependencies where importer <> target)"


@query("a4_coupling", _IMPORTS + " select name, cast(sum(ca) as bigint) as ca, cast(sum(ce) as bigint) as ce from (select dst as name, 1 as ca, 0 as ce from imp union all select src, 0, 1 from imp) group by name")
def a4(t):
    return ag.coupling(t.imports())


@query("a5_ratio", "select repo, case when count(*) filter (kind = 'symbol') > 0 then round(count(*) filter (kind = 'symbol' and exported) / count(*) filter (kind = 'symbol'), 6) else 0 end as exported_share from facts group by repo")
def a5(t):
    n = lambda c: F.sum(F.when(F.expr(c), 1).otherwise(0))
    return t.facts().groupBy("repo").agg(F.round(fn.ratio(n("kind = 'symbol' and exported"), n("kind = 'symbol'")), 6).alias("exported_share"))


@query("a7_multiset_delta", "#a as (select loop_depth, cyclomatic, count(*) as n from ord where o_orderkey % 3 = 0 group by 1, 2), b as (select loop_depth, cyclomatic, count(*) as n from ord where o_orderkey % 3 = 1 group by 1, 2) select loop_depth, cyclomatic, coalesce(b.n, 0) - coalesce(a.n, 0) as delta from a full outer join b using (loop_depth, cyclomatic) where coalesce(b.n, 0) <> coalesce(a.n, 0)")
def a7(t):
    o = t.orders()
    return ag.multiset_delta(o.filter("o_orderkey % 3 = 0").select("loop_depth", "cyclomatic"), o.filter("o_orderkey % 3 = 1").select("loop_depth", "cyclomatic"))


@query("a8_set_digest", "select repo, sha256(string_agg(name, chr(10) order by name)) as digest from (select distinct repo, name from facts where kind = 'module') group by repo")
def a8(t):
    return ag.set_digest(t.facts().filter("kind = 'module'"), ["repo"], F.col("name"))


@query("a9_other_source", "#r as (select distinct l_partkey as target, l_suppkey as source from lineitem) select target, source, exists (select 1 from r q where q.target = r.target and q.source <> r.source) as by_other from r")
def a9(t):
    return ag.other_source(t.raw("lineitem").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("source")))


@query("a10_tallies", _ROUTES + ", st as (select c.repo, case when b.client_id is null then 'unresolved' when s.repo = c.repo then 'external' else 'resolved' end as state from routes c left join best b on b.client_id = c.page_id left join routes s on s.page_id = b.server_id where c.role = 'client') select repo, 'http' as edge_type, count(*) as detected, count(*) filter (state = 'resolved') as resolved, count(*) filter (state = 'unresolved') as unresolved, count(*) filter (state = 'external') as external from st group by repo")
def a10(t):
    return ag.coverage_tallies(linking.http_states(_routes(t)))


@query("a11_samples", "#d as (select distinct repo, name from facts where kind = 'symbol' and symbol_kind <> 'method'), r as (select *, row_number() over (partition by repo order by name) as k from d) select repo, array_to_string(list(name order by name) filter (k <= 25), ',') as sample, greatest(count(*) - 25, 0) as more from r group by repo")
def a11(t):
    out = ag.sampled_lists(t.facts().filter("kind = 'symbol' and symbol_kind <> 'method'"), ["repo"], "name")
    return out.select("repo", F.array_join("sample", ",").alias("sample"), "more")


@query("a12_counts_diff", _OLD_NEW + ", x as (select kind, name, cyclomatic, sum(s) as d from (select kind, name, cyclomatic, -1 as s from old union all select kind, name, cyclomatic, 1 from new) group by 1, 2, 3) select kind, cast(sum(greatest(d, 0)) as bigint) as added, cast(sum(greatest(-d, 0)) as bigint) as removed from x group by kind")
def a12(t):
    old, new = _old_new(t)
    hashed = lambda df: df.select("kind", F.xxhash64("name", "cyclomatic").alias("hash"))
    return ag.counts_diff(hashed(old), hashed(new))


@query("a13_authors", "#by_ as (select o_orderpriority as module, o_custkey % 12 as author, count(*) as n from orders group by 1, 2), t as (select *, sum(n) over (partition by module) as total from by_) select module, author, n, cast(total as bigint) as total, round(n / total, 6) as share, case when total < 5 then 'sparse' when n / total >= 0.5 then 'owner' when n / total < 0.05 then 'minor' else 'major' end as standing from t")
def a13(t):
    return ag.author_shares(t.raw("orders").select(F.col("o_orderpriority").alias("module"), (F.col("o_custkey") % 12).alias("author")))


@query("a14_receipt", "select count(*) as facts, count(*) filter (kind = 'module') as module_facts, count(*) filter (kind = 'symbol') as symbol_facts, count(*) filter (kind = 'service') as service_facts, (select count(*) from implementations) as edges, 0 as unresolved_edges from facts")
def a14(t):
    facts = t.facts().withColumn("id", fn.fact_id(F.col("repo"), F.col("kind"), F.col("name"), F.col("file")))
    return ag.receipt(facts, joins.resolve_targets(t.implementations(), facts))


@query("a15_agreement", "select count(*) filter (a and b) as both, count(*) filter (a and not b) as only_first, count(*) filter (b and not a) as only_second from (select p_partkey % 2 = 0 as a, p_partkey % 3 = 0 as b from part) where a or b")
def a15(t):
    p = t.parts()
    return ag.agreement(p.filter("p_partkey % 2 = 0"), p.filter("p_partkey % 3 = 0"), ["name"])


@query("t1_order", "select name, fan_in from (select dst as name, count(*) as fan_in from edges group by 1) order by fan_in desc, name limit 25")
def t1(t):
    return ag.top(t.edges().groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("fan_in")), 25, F.desc("fan_in"), "name")


@query("t3_top_per_repo", "#r as (select repo, name, cyclomatic, row_number() over (partition by repo order by cyclomatic desc, name) as rank, count(*) over (partition by repo) as c from facts where symbol_kind = 'method') select repo, name, cyclomatic, rank, greatest(c - 50, 0) as omitted from r where rank <= 50")
def t3(t):
    m = t.facts().filter("symbol_kind = 'method'").select("repo", "name", "cyclomatic")
    return ag.top_per(m, ["repo"], 50, F.desc("cyclomatic"), "name")


@query("t5_pairing", "select loop_depth, name, row_number() over (partition by loop_depth, cyclomatic order by name) as pos from ord")
def t5(t):
    return ag.paired(t.orders(), ["loop_depth", "cyclomatic"], ["name"]).select("loop_depth", "name", "pos")


@query("t6_debounce", "#e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, count(*) as n, min(ts) as first, max(ts) as last from s group by user_id, k")
def t6(t):
    return ag.debounced(t.raw("events").withColumn("ts", F.col("ts").cast("timestamp")), ["user_id"], "ts", gap="30 minutes")


@query("t7_previous", "select event_id, value, lag(value) over (partition by user_id order by event_id) as previous from events")
def t7(t):
    return ag.consecutive(t.raw("events"), ["user_id"], "event_id", "value").select("event_id", "value", "previous")


@query("u1_replace_repo", "select repo, count(*) as n from (select repo from facts where repo <> 'ASIA' union all select 'ASIA' from facts where repo = 'EUROPE') group by repo")
def u1(t):
    f = t.facts()
    return ag.counts(ag.replace_repo(f, "ASIA", f.filter("repo = 'EUROPE'").withColumn("repo", F.lit("ASIA"))), "repo")


@query("u2_difference", _OLD_NEW + " select name from old where name not in (select name from new)")
def u2(t):
    old, new = _old_new(t)
    return ag.without_keys(old, new, ["name"]).select("name")


@query("u3_common_only", "select side, count(*) as n from (select 'a' as side from facts where repo = 'ASIA' and role in (select role from facts where repo = 'EUROPE') union all select 'b' from facts where repo = 'EUROPE' and role in (select role from facts where repo = 'ASIA')) group by side")
def u3(t):
    f = t.facts()
    return ag.counts(ag.only_common(f.filter("repo = 'ASIA'"), f.filter("repo = 'EUROPE'"), "role").filter("role is not null"), "side")


@query("u4_spillover", "select name, case when p and a then 'matched' when p then 'unrealised' else 'spillover' end as bucket from (select name, p_partkey % 3 = 0 as p, p_partkey % 4 = 0 as a from prt) where p or a")
def u4(t):
    p = t.parts()
    return ag.spillover(p.filter("p_partkey % 3 = 0"), p.filter("p_partkey % 4 = 0"))


@query("u5_history_union", "select revision_id, min(w) as \"at\", array_to_string(list(distinct origin order by origin), ',') as origins from (select o_orderkey as revision_id, o_orderdate as w, 'local' as origin from orders where o_orderkey % 2 = 0 union all select o_orderkey, o_orderdate, 'shared' from orders where o_orderkey % 3 = 0) group by 1")
def u5(t):
    o = t.raw("orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").alias("at"))
    return ag.merged_history(o.filter("revision_id % 2 = 0"), o.filter("revision_id % 3 = 0")).withColumn("origins", F.array_join("origins", ","))


@query("u6_set_prop", "select name, case when exported then 'public' else 'internal' end as visibility from facts where symbol_kind = 'struct'")
def u6(t):
    f = t.facts().filter("symbol_kind = 'struct'").withColumn("props", F.create_map(F.lit("visibility"), F.lit("internal")))
    return ag.set_prop(f, F.col("exported"), "visibility", F.lit("public")).select("name", F.element_at("props", "visibility").alias("visibility"))


@query("t4_evidence", "#e as (select distinct src, dst from part_links where src <> dst), r as (select dst as name, src, row_number() over (partition by dst order by src) as k from e) select p.name, coalesce(array_to_string(list(src order by src) filter (k <= 8), ','), '') as evidence, greatest(count(src) - 8, 0) as more from prt p left join r using (name) group by p.name")
def t4(t):
    users = t.part_links().filter("src <> dst").select(F.col("dst").alias("name"), F.col("src").alias("user"))
    out = ag.capped_evidence(t.parts().select("name"), users, "name", "user")
    return out.select("name", F.coalesce(F.array_join("sample", ","), F.lit("")).alias("evidence"), "more")


# -- explainers


@query("e1_cycles", "#links as (select distinct importer as src, target as dst from dependencies where coupling = 'import'), reach(a, b) as (select src, dst from links where src <> dst union select r.a, l.dst from reach r join links l on r.b = l.src where l.src <> l.dst), c as (select name, coalesce((select min(x.b) from reach x join reach y on x.b = y.a and y.b = x.a where x.a = n.name and x.b <= n.name), n.name) as component from (select src as name from links union select dst from links) n) select component, count(*) as size, array_to_string(list(name order by name), ',') as members, count(*) > 8 as clustered from c group by component having count(*) > 1", recursive=True)
def e1(t):
    d = t.dependencies().filter("coupling = 'import'")
    return explainers.import_cycles(d.select(F.col("importer").alias("src"), F.col("target").alias("dst"))).withColumn("members", F.array_join("members", ","))


_LAYERS = {"AFRICA": 0, "AMERICA": 1, "ASIA": 1, "EUROPE": 2}


@query("e2_layers", _IMPORTS + ", l as (select src, dst, case when src like '%/AFRICA/%' then 0 when src like '%/AMERICA/%' or src like '%/ASIA/%' then 1 when src like '%/EUROPE/%' then 2 end as src_level, case when dst like '%/AFRICA/%' then 0 when dst like '%/AMERICA/%' or dst like '%/ASIA/%' then 1 when dst like '%/EUROPE/%' then 2 end as dst_level from imp) select src, dst, case when src_level < dst_level then 'against' when src_level > dst_level then 'inward' else 'same' end as direction from l where src_level is not null and dst_level is not null")
def e2(t):
    return explainers.layer_violations(t.imports(), _LAYERS).select("src", "dst", "direction")


@query("e3_cross_repo", _ROUTES + " select c.repo as from_repo, s.repo as to_repo, count(*) as n, 'http' as types from best b join routes c on c.page_id = b.client_id join routes s on s.page_id = b.server_id where c.repo <> s.repo group by 1, 2")
def e3(t):
    return explainers.cross_repo_summary(linking.http_links(_routes(t))).withColumn("types", F.array_join("types", ","))


@query("e4_coverage", _ROUTES.replace("from routes)", "from routes where role = 'client' or page_id % 40 = 0)") + ", st as (select c.repo, case when b.client_id is null then 1 else 0 end as u, case when s.repo <> c.repo then 1 else 0 end as r from routes c left join best b on b.client_id = c.page_id left join routes s on s.page_id = b.server_id where c.role = 'client') select repo, cast(sum(r) as bigint) as resolved, cast(sum(u) as bigint) as unresolved, case when sum(r) = 0 then 'gap' else 'partial' end as state, cast(case when sum(r) = 0 then 0.9 else 0.75 end as double) as confidence from st group by repo having sum(u) > 0")
def e4(t):
    return explainers.coverage_gaps(ag.coverage_tallies(linking.http_states(_routes(t).filter("role = 'client' or route_id % 40 = 0"))))


@query("e5_unused_routes", _ROUTES + ", x as (select repo, count(*) as served, count(*) filter (page_id not in (select server_id from best)) as unmatched from routes where role = 'server' group by repo) select *, case when unmatched / served >= 0.8 or unmatched > 200 then 'clients incomplete' when unmatched > 0 then 'unused routes' else 'none' end as finding from x")
def e5(t):
    r = _routes(t)
    servers = r.filter("role = 'server'")
    return explainers.unused_routes(servers, joins.match_routes(r.filter("role = 'client'"), servers))


@query("e6_domain_hubs", "#i as (select e.dst as name, count(distinct e.src) as inbound from edges e where e.src <> e.dst and e.dst in (select name from prt) group by 1), l as (select round(avg(inbound) + 2 * stddev_pop(inbound), 9) as threshold from i) select name, inbound from i, l where inbound >= threshold and inbound >= 10")
def e6(t):
    parts = t.keyed_facts().filter("symbol_kind = 'struct'").select(F.col("id").alias("name"))
    return t.named(explainers.domain_hubs(parts, t.keyed_edges().filter("dst % 8 = 0")), "name")  # numbers of parts


@query("e6_shared_tables", "select p_type as \"table\", count(distinct p_brand) as namespaces from part group by 1 having count(distinct p_brand) > 1")
def e6b(t):
    return explainers.shared_tables(t.raw("part").select(F.col("p_type").alias("table"), F.col("p_brand").alias("namespace")))


@query("e7_query_loops", "select src, count(distinct dst) as queries from calls where src in (select name from ord where loop_depth >= 2) and dst in (select name from prt where p_size > 40) group by src")
def e7(t):
    loops = t.calls().join(t.orders().filter("loop_depth >= 2").select(F.col("name").alias("src")), "src", "left_semi")
    return explainers.query_loops(loops, t.parts().filter("p_size > 40"))


@query("e8_dead_methods", "select name, 'order' || o_orderkey as bare from ord")
def e8(t):
    return explainers.dead_methods(t.facts(), t.linked("calls"))


@query("e9_entry_points", "#steps as (select distinct src as a, dst as b from part_links where src <> dst), walk(name) as (select name from prt where p_partkey < 10 union select b from walk join steps on a = name) select p_type as mechanism, count(*) as n, (select round(avg(case when name in (select name from walk) then 1 else 0 end), 6) from prt) as reached_share from prt where p_partkey < 10 group by 1", recursive=True)
def e9(t):
    reached = traversal.reached_from_roots(t.part_links(), t.parts().select("name"), _seeds(t, 10))
    return explainers.entry_points(t.parts().filter("p_partkey < 10").select(F.col("p_type").alias("mechanism")), reached)


@query("e10_messaging", "#d as (select p_brand as repo, p_name as operation, min(p_type) as d from part where p_partkey % 3 <> 0 group by 1, 2), i as (select p_brand as repo, p_name as operation, min(p_type) as i from part where p_partkey % 4 <> 0 group by 1, 2) select repo, case when d is null then 'undeclared' when i is null then 'unimplemented' when d <> i then 'conflicting' else 'covered' end as state, count(*) as n from d full outer join i using (repo, operation) group by 1, 2")
def e10(t):
    p = t.raw("part").select(F.col("p_brand").alias("repo"), F.col("p_name").alias("operation"), F.col("p_type").alias("direction"), "p_partkey")
    return explainers.messaging_coverage(p.filter("p_partkey % 3 <> 0"), p.filter("p_partkey % 4 <> 0"))


@query("e11_god_class", "#s as (select f.name, e.fan_in from (select distinct name from facts where kind = 'symbol') f join (select dst as name, count(*) as fan_in from edges where rel not in ('instantiates', 'implemented_by') group by 1) e using (name)), l as (select round(avg(fan_in) + 2 * stddev_pop(fan_in), 9) as threshold from s) select name, fan_in, round(least(0.95, greatest(0.5, 0.5 + 0.5 * (fan_in / threshold - 1))), 6) as confidence from s, l where fan_in > threshold and fan_in >= 8 order by fan_in desc, name limit 25")
def e11(t):
    return explainers.god_classes(t.facts(), t.edges())


@query("e12_hotspots", "#b as (select i.name, fan_in, fan_out, fan_in * fan_out as score from (select dst as name, count(*) as fan_in from edges group by 1) i join (select src as name, count(*) as fan_out from edges group by 1) o using (name)), l as (select round(avg(score) + 2 * stddev_pop(score), 9) as threshold from b) select name, fan_in, fan_out, score from b, l where score > threshold and fan_in >= 3 and fan_out >= 3 order by score desc, name limit 20")
def e12(t):
    return explainers.hotspots(t.keyed_edges(), named=lambda df: t.named(df, "name"))


@query(
    "e13_dependency_depth",
    "#links as (select distinct src, dst from part_links where src < dst), chain(root, at_, s) as (select name, name, 1 from (select src as name from links union select dst from links) union select root, dst, s + 1 from chain join links on src = at_), d as (select root as component, cast(max(s) as integer) as depth from chain group by 1) select component, depth from d where depth >= 3 order by depth desc, component limit 10",
    recursive=True,
)
def e13(t):
    return explainers.dependency_depth(t.part_links().filter("src < dst"), least=3)


@query("e14_surface", "select module, count(*) as symbols, count(*) filter (exported) as exported, round(count(*) filter (exported) / count(*), 6) as ratio from (select regexp_replace(file, '/[^/]*$', '') as module, exported from facts where kind = 'symbol' and symbol_kind <> 'method') group by 1 having count(*) >= 3 and count(*) filter (exported) / count(*) >= 0.8 order by symbols desc, module limit 20")
def e14(t):
    return explainers.exported_surface(t.facts().filter("symbol_kind <> 'method'"), least=3, share=0.8)


@query("e15_complexity", "#m as (select name, cyclomatic from facts where symbol_kind in ('function', 'method')), l as (select round(avg(cyclomatic) + 2 * stddev_pop(cyclomatic), 9) as threshold from m) select name, cyclomatic from m, l where cyclomatic > threshold and cyclomatic >= 8 order by cyclomatic desc, name limit 15")
def e15(t):
    return explainers.complexity_outliers(t.facts(), least=8)


@query("e16_seams", "#d as (select distinct r.r_name as src, q.r_name as dst, 'import' as via from region r, region q where r.r_regionkey < q.r_regionkey), m as (select c.repo as src, s.repo as dst, min(d.coupling) as via from dependencies d join nat c on d.importer = c.dir join nat s on d.target = s.dir where c.repo <> s.repo group by 1, 2) select src, dst, case when d.via is null then 'unexpected' when m.via is null then 'missing' when d.via <> m.via then 'mis-via' else 'kept' end as state from d full outer join m using (src, dst)")
def e16(t):
    r = t.raw("region")
    declared = r.select(F.col("r_name").alias("src"), F.col("r_regionkey").alias("a")).join(F.broadcast(r.select(F.col("r_name").alias("dst"), F.col("r_regionkey").alias("b"))), F.col("a") < F.col("b")).select("src", "dst", F.lit("import").alias("via"))
    n = t.nations()
    a, b = n.select(F.col("dir").alias("importer"), F.col("repo").alias("src")), n.select(F.col("dir").alias("target"), F.col("repo").alias("dst"))
    measured = t.dependencies().drop("repo").join(a, "importer").join(b, "target").filter("src <> dst").select("src", "dst", F.col("coupling").alias("via"))
    return explainers.seam_check(declared, measured)


@query("e18_vendored", "select 'app/vendor/' || p_brand as dir, count(*) as files from part group by 1 having count(*) >= 3 and max(case when p_partkey % 5 = 0 then 1 else 0 end) = 1")
def e18(t):
    name = F.when(F.col("p_partkey") % 5 == 0, "LICENSE.txt").otherwise(F.concat(F.lit("f"), "p_partkey", F.lit(".c")))
    return explainers.vendored(t.raw("part").select(F.concat(F.lit("app/vendor/"), "p_brand", F.lit("/"), name).alias("file")))


@query("e19_import_closure", "#steps as (select distinct importer as a, target as b from dependencies where importer <> target and coupling = 'import'), walk(root, name, depth) as (select dir, dir, 0 from nat union select root, b, depth + 1 from walk join steps on a = name where depth < (select count(*) from nat)), f as (select root, name, min(depth) as depth from walk group by 1, 2) select root, count(*) - 1 as size, max(depth) as depth from f group by root", recursive=True)
def e19(t):
    d = t.dependencies().filter("coupling = 'import'").select(F.lit("imports").alias("rel"), F.col("importer").alias("src"), F.col("target").alias("dst"))
    return explainers.import_closures(d, t.nations().select(F.col("dir").alias("name")))


_METRICS = """, types as (select regexp_replace(file, '/[^/]*$', '') as name, count(*) as classes, count(*) filter (symbol_kind = 'interface') as abstract from facts where symbol_kind in ('struct', 'class', 'interface') group by 1),
cpl as (select name, cast(sum(ca) as bigint) as ca, cast(sum(ce) as bigint) as ce from (select dst as name, 1 as ca, 0 as ce from imp union all select src, 0, 1 from imp) group by name),
j as (select m.name, coalesce(classes, 0) as classes, coalesce(abstract, 0) as abstract, coalesce(ca, 0) as ca, coalesce(ce, 0) as ce from (select distinct name from facts where kind = 'module' and role = 'production') m left join types using (name) left join cpl using (name)),
k as (select *, case when ca + ce > 0 then ce / (ca + ce) else 0.0 end as i, case when classes > 0 then abstract / classes else 0.0 end as a from j),
r as (select name, classes, abstract, ca, ce, round(i, 3) as instability, round(a, 3) as abstractness, round(abs(a + i - 1), 3) as distance from k)
select *, case when distance <= 0.2 then 'main' when distance > 0.7 and instability < 0.5 then 'pain' when distance > 0.7 then 'useless' else 'neutral' end as zone from r"""


@query("e20_package_metrics", _IMPORTS + _METRICS)
def e20(t):
    return explainers.package_metrics(t.facts(), t.imports())


@query("e21_unreferenced", "select s.name, case when s.name in (select src from edges where rel <> 'declares') then 'unreferenced' else 'isolated' end as category, case when symbol_kind = 'function' then 'high' when symbol_kind in ('struct', 'class', 'interface') then 'medium' else 'low' end as confidence from (select distinct name, symbol_kind from facts where kind = 'symbol') s where s.name not in (select dst from edges where src <> dst and rel <> 'declares')")
def e21(t):
    return explainers.unreferenced(t.keyed_facts(), t.keyed_edges("calls", "depends_on", "implements", "imports", once=False, tests=True))


@query("e22_performance", "#r as (select name, 'nested-loop' as finding, case when loop_depth >= 3 then 'high' else 'medium' end as severity, loop_depth as depth, case when loop_depth >= 4 then 0.5 else 0.8 end as confidence, cast(loop_depth as double) as w from ord where loop_depth >= 2 union all select distinct o.name, 'call-in-loop', 'high', greatest(1, loop_depth), case when loop_depth >= 4 then 0.5 else 0.9 end, cast(greatest(1, loop_depth) as double) from ord o join calls c on c.src = o.name join prt p on p.name = c.dst where loop_depth >= 1 and p_size > 45 union all select name, 'recursion', 'medium', loop_depth, 0.5, 2.5 from ord where o_orderkey % 11 = 0) select name, finding, severity, depth, cast(confidence as double) as confidence, floor(w * confidence * case when handler then 1.3 else 1 end * 100 + 0.5) / 100 as risk from (select r.*, o_orderkey % 13 = 0 as handler from r join ord using (name))")
def e22(t):
    # methods and what they call go by their numbers
    f = t.keyed_facts()
    o = f.filter("symbol_kind = 'method'").select(F.col("id").alias("name"), "loop_depth", F.shiftright("id", 3).alias("o_orderkey"))
    loops = t.keyed_edges("calls", once=False).join(o.filter("loop_depth >= 1").select(F.col("name").alias("src")), "src", "left_semi").select("src", "dst")
    expensive = t.parts().filter("p_size > 45").select((F.col("p_partkey") * 8).alias("name"))
    out = explainers.performance(o, loops, expensive=expensive, recursive=o.filter("o_orderkey % 11 = 0"), handlers=o.filter("o_orderkey % 13 = 0"))
    return t.named(out, "name").select("name", "finding", "severity", "depth", "confidence", "risk")


# -- constraint forms

_CUSTOMERS = Component(where={"kind": "symbol", "symbol_kind": "class"}, paths=("src/**/customer*.py",))
_METHODS = Component(where={"kind": "symbol", "symbol_kind": "method"})
_PARTS = Component(where={"symbol_kind": "struct"})
_BIG = Component(where={"symbol_kind": "struct", "exported": "true"})
_SUPPLIERS = Component(where={"kind": "symbol"}, paths=("src/**/supplier*.py",))
_AFRICA = Component(where={"kind": "symbol", "symbol_kind": "method", "repo": "AFRICA"})
_FIRST = Component(names=("lib/Brand#1.Part*",))

_RULES = {
    "forbid": Rule("r1", "forbid", _AFRICA, _FIRST),
    "forbid_reach": Rule("r2", "forbid_reach", _FIRST, Component(names=("lib/Brand#2.Part*",)), via="depends_on"),
    "allow": Rule("r3", "allow", _AFRICA, only=(_BIG, _SUPPLIERS)),
    "protect": Rule("r4", "protect", _FIRST, via="implements", owners=(Component(where={"symbol_kind": "class", "repo": "ASIA"}),)),
    "private": Rule("r5", "private", _FIRST, only=(_METHODS,)),
    "forbid_fact": Rule("r6", "forbid_fact", Component(where={"symbol_kind": "interface"})),
    "cap": Rule("r7", "cap", _PARTS, most=150),
    "require": Rule("r8", "require", _METHODS, prop="loop_depth", value="< 4", when_prop="cyclomatic", when_value=">= 5"),
    "require_edge": Rule("r9", "require_edge", _PARTS, _SUPPLIERS, via="implements", inbound=True),
    "require_defines": Rule("r10", "require_defines", _CUSTOMERS, value="order7"),
    "forbid_cycles": Rule("r11", "forbid_cycles", _PARTS, via="depends_on"),
    "independent": Rule("r12", "independent", _PARTS, via="depends_on"),
    "require_name": Rule("r13", "require_name", _PARTS, pattern="^Part[0-9]*[02468]$"),
    "forbid_name": Rule("r14", "forbid_name", _PARTS, pattern="7"),
    "protocol": Rule("r15", "protocol", _AFRICA, steps=(_FIRST, _PARTS, _SUPPLIERS)),
    "guide": Rule("r16", "guide", _PARTS, mode="advisory"),
    "storage_stays_home": Rule("r17", "storage_stays_home", _FIRST, _PARTS),
    "cap_runtime": Rule("r18", "cap_runtime", _METHODS, prop="cyclomatic", most=9),
    "require_consumer": Rule("r19", "require_consumer", Component(where={"kind": "symbol", "symbol_kind": "class"})),
    "unique_across": Rule("r20", "unique_across", Component(where={"kind": "symbol", "symbol_kind": "class"}), prop="role"),
    "require_governed": Rule("r21", "require_governed", _PARTS),
}

_VIOLATIONS = {
    "forbid": "select distinct 'r1' as rule, src as subject, dst as object from calls where src in (select name from ord where repo = 'AFRICA') and starts_with(dst, 'lib/Brand#1.Part')",
    "forbid_reach": "#steps as (select distinct src as a, dst as b from part_links where src <> dst), walk(root, name) as (select a, b from steps where starts_with(a, 'lib/Brand#1.Part') union select root, b from walk join steps on a = name) select 'r2' as rule, root as subject, name as object from walk where starts_with(name, 'lib/Brand#2.Part')",
    "allow": "select distinct 'r3' as rule, src as subject, dst as object from calls where src in (select name from ord where repo = 'AFRICA') and dst in (select name from prt where p_size <= 10)",
    "protect": "select distinct 'r4' as rule, src as subject, dst as object from implementations where starts_with(dst, 'lib/Brand#1.Part') and src not in (select name from facts where symbol_kind = 'class' and repo = 'ASIA')",
    "private": "select distinct 'r5' as rule, src as subject, dst as object from edges where rel in ('calls', 'depends_on', 'implements', 'imports') and dst in (select name from prt where starts_with(name, 'lib/Brand#1.Part') and p_size <= 10) and not starts_with(src, 'lib/Brand#1.Part') and src not in (select name from ord)",
    "forbid_fact": "select distinct 'r6' as rule, name as subject, '' as object from facts where symbol_kind = 'interface'",
    "cap": "select 'r7' as rule, name as subject, '' as object from (select name, row_number() over (order by name) as k from prt) where k > 150",
    "require": "select 'r8' as rule, name as subject, '' as object from ord where cyclomatic >= 5 and not loop_depth < 4",
    "require_edge": "select 'r9' as rule, name as subject, '' as object from prt where name not in (select dst from implementations)",
    "require_defines": "select 'r10' as rule, name as subject, '' as object from cust where name not in (select owner from ord where o_orderkey = 7)",
    "forbid_cycles": "#links as (select distinct src, dst from part_links), reach(a, b) as (select src, dst from links where src <> dst union select r.a, l.dst from reach r join links l on r.b = l.src where l.src <> l.dst) select distinct 'r11' as rule, x.a as subject, (select min(y.b) from reach y join reach z on y.b = z.a and z.b = y.a where y.a = x.a) as object from reach x where exists (select 1 from reach y where y.a = x.b and y.b = x.a and x.a <> x.b)",
    "independent": "select distinct 'r12' as rule, dst as subject, src as object from implementations where length(dst) % 3 = 0",
    "require_name": "select 'r13' as rule, name as subject, '' as object from prt where p_partkey % 2 = 1",
    "forbid_name": "select 'r14' as rule, name as subject, '' as object from prt where contains(cast(p_partkey as varchar), '7')",
    "protocol": "#h as (select distinct src, case when starts_with(dst, 'lib/Brand#1.Part') then 1 end as a, case when starts_with(dst, 'lib/') then 2 end as b, case when starts_with(dst, 'src/') then 3 end as c from calls where src in (select name from ord where repo = 'AFRICA')), s as (select src, count(distinct a) + count(distinct b) + count(distinct c) as n, greatest(coalesce(max(a), 0), coalesce(max(b), 0), coalesce(max(c), 0)) as last from h group by src) select 'r15' as rule, src as subject, cast(last as varchar) as object from s where n < last",
    "guide": "select 'r16' as rule, case when count(*) > 0 then 'present' else 'absent' end as subject, '' as object from prt",
    "storage_stays_home": "select distinct 'r17' as rule, src as subject, dst as object from part_links where starts_with(src, 'lib/Brand#1.Part') and not starts_with(dst, 'lib/Brand#1.Part')",
    "cap_runtime": "select 'r18' as rule, name as subject, '' as object from ord where cyclomatic > 9",
    "require_consumer": "select 'r19' as rule, s.name as subject, '' as object from facts s where s.symbol_kind = 'class' and not exists (select 1 from edges c where c.rel = 'calls' and c.dst = s.name and c.repo <> s.repo)",
    "unique_across": "select 'r20' as rule, role as subject, '' as object from facts where symbol_kind = 'class' and role is not null group by role having count(distinct repo) > 1",
    "require_governed": "select distinct 'r21' as rule, file as subject, '' as object from prt where not starts_with(file, 'lib/Brand#1/') and not starts_with(file, 'lib/Brand#2/')",
}

for _n, (_form, _rule) in enumerate(_RULES.items(), 1):

    def _run(t: Tables, rule: Rule = _rule) -> DataFrame:
        more = {"anchors": t.spark.createDataFrame([("a", "lib/Brand#1"), ("b", "lib/Brand#2")], "page string, path string")} if rule.form == "require_governed" else {}
        if rule.form in ("allow", "private", "require_consumer"):  # members and ends by number, names for what is found
            found = constraints.FORMS[rule.form](rule, t.keyed_facts(), t.keyed_edges(*(constraints.VIAS if rule.form == "private" else (rule.via,)), once=False, repos=rule.form == "require_consumer"))
            if rule.form == "require_consumer":
                return found
            return t.named(found, "subject", "object").select("rule", "subject", "object")
        edges = t.linked(rule.via) if rule.form in ("forbid", "protocol") else t.edges()
        if rule.form == "require_defines":
            edges = edges.unionByName(graph.has_method_edges(t.facts()))
        if rule.form == "independent":  # some parts depend on what implements them
            back = t.implementations().filter("length(dst) % 3 = 0")
            edges = edges.unionByName(back.select("repo", F.col("dst").alias("src"), "src_kind", F.lit("depends_on").alias("rel"), F.col("src").alias("dst"), "dst_kind", F.col("dst_file").alias("src_file"), F.col("src_file").alias("dst_file")))
        return constraints.FORMS[rule.form](rule, t.facts(), edges, **more)

    query(f"c{_n}_{_form}", _VIOLATIONS[_form], recursive=True)(_run)


@query("e17_constraints_all", "select *, 'strict' as mode, cast(1.0 as double) as confidence from (" + " union all ".join(_VIOLATIONS[k] for k in ("forbid", "cap", "require", "forbid_name")) + ")")
def e17(t):
    rules = [_RULES[k] for k in ("forbid", "cap", "require", "forbid_name")]
    return constraints.evaluate(rules, t.facts(), t.edges())


# -- linking, diff, history


@query("x2_normalise", "select page_id as route_id, array_to_string(list_transform(split(regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'), '\\.(json|xml|html)$', ''), '/'), lambda s: case when regexp_matches(s, '^[0-9]+$') then '{}' else s end), '/') as path, method from routes where regexp_replace(array_to_string(list_transform(split(regexp_replace(regexp_replace(path, '^/+|/+$', '', 'g'), '\\.(json|xml|html)$', ''), '/'), lambda s: case when regexp_matches(s, '^[0-9]+$') then '{}' else s end), '/'), '[{}/]', '', 'g') <> ''")
def x2(t):
    return linking.normalised_routes(_routes(t)).select("route_id", "path", "method")


@query("x1_http_links", _ROUTES + " select c.repo as from_repo, s.repo as to_repo, b.client_id as route_id, b.server_id from best b join routes c on c.page_id = b.client_id join routes s on s.page_id = b.server_id")
def x1(t):
    return linking.http_links(_routes(t)).select("from_repo", "to_repo", "route_id", "server_id")


@query("x6_shared_pairs", "#k as (select distinct p_brand as repo, p_name || '/' || p_size % 10 as identity from part), f as (select identity from k group by 1 having count(*) > 1 and not ((select count(distinct repo) from k) >= 4 and count(*) / (select count(distinct repo) from k) > 0.5)) select a.repo as repo_a, b.repo as repo_b, count(*) as shared from k a join k b on a.identity = b.identity and a.repo < b.repo where a.identity in (select identity from f) group by 1, 2 having count(*) >= 3")
def x6(t):
    return linking.shared_pairs(t.raw("part").select(F.col("p_brand").alias("repo"), F.concat("p_name", F.lit("/"), F.col("p_size") % 10).alias("identity")))


@query("x9_module_rollup", "select a.dir as from_module, b.dir as to_module, count(*) as n from (select distinct src, dst from part_links) e join prt a on a.name = e.src join prt b on b.name = e.dst where a.dir <> b.dir group by 1, 2")
def x9(t):
    return linking.module_rollup(t.part_links().select("src", "dst").distinct(), t.parts().select("name", F.col("dir").alias("module")))


@query("x9_unmatched", _ROUTES + " select page_id as route_id, page_id not in (select server_id from best) as unmatched_by_clients from routes where role = 'server'")
def x9b(t):
    return linking.unmatched(_routes(t)).select("route_id", "unmatched_by_clients")


@query("x10_coverage_report", _ROUTES + ", st as (select c.repo, case when s.repo <> c.repo then 1 else 0 end as r from routes c left join best b on b.client_id = c.page_id left join routes s on s.page_id = b.server_id where c.role = 'client'), x as (select repo, count(*) as detected, cast(sum(r) as bigint) as resolved from st group by repo) select s.repo, coalesce(detected, 0) as detected, coalesce(resolved, 0) as resolved, case when coalesce(detected, 0) = 0 then 'isolated' when resolved = 0 then 'coverage_gap' else 'connected' end as state from (select distinct repo from routes) s left join x using (repo)")
def x10(t):
    r = _routes(t)
    return linking.coverage_report(r, ag.coverage_tallies(linking.http_states(r)))


@query("d1_diff_facts", _OLD_NEW + " select * from (select coalesce(o.name, n.name) as name, case when o.name is null then 'added' when n.name is null then 'removed' when o.cyclomatic <> n.cyclomatic then 'changed' end as status from old o full outer join new n using (kind, repo, file, name)) where status is not null")
def d1(t):
    old, new = _old_new(t)
    return diffing.diff_facts(old, new, ["cyclomatic"]).select("name", "status")


@query("d1_diff_edges", "#o as (select distinct src, dst from part_links where length(src) % 3 <> 0), n as (select distinct src, dst from part_links where length(dst) % 3 <> 1) select src, dst, 'removed' as status from o where (src, dst) not in (select (src, dst) from n) union all select src, dst, 'added' from n where (src, dst) not in (select (src, dst) from o)")
def d1b(t):
    p = t.part_links()
    return diffing.diff_edges(p.filter("length(src) % 3 <> 0"), p.filter("length(dst) % 3 <> 1")).select("src", "dst", "status")


@query("d8_conformance", "#steps as (select distinct dst as a, src as b from part_links where src <> dst), walk(name, depth) as (select name, 0 from prt where p_partkey < 12 union select b, depth + 1 from walk join steps on a = name where depth < 3), p as (select distinct name from walk where name not in (select name from prt where p_partkey < 12)), c as (select name from prt where p_partkey % 4 = 0) select name, case when name in (select name from p) and name in (select name from c) then 'matched' when name in (select name from p) then 'unrealised' else 'spillover' end as bucket from (select name from p union select name from c)", recursive=True)
def d8(t):
    return diffing.conformance(t.part_links(), _seeds(t, 12), t.parts().filter("p_partkey % 4 = 0").select("name"))


@query("d10_mine_edges", "#cl as (select name, regexp_extract(dir, '^([^/]+/[^/]+)', 1) as c from prt union all select name, repo from supp union all select name, repo from cust union all select name, repo from ord), e as (select distinct rel, src, dst from all_edges where rel in ('calls', 'implements')), x as (select rel as via, a.c as f, b.c as t from e join cl a on a.name = src join cl b on b.name = dst where a.c <> b.c), l as (select via, f, t, count(*) as landed from x group by 1, 2, 3), s as (select via, f, count(*) as total from x group by 1, 2) select via, f as \"from\", t as \"to\", total, landed, case when landed / total >= 0.9 then 'allow' else 'forbid' end as form from l join s using (via, f) where total >= 10 and (landed / total >= 0.9 or landed / total <= 1 - 0.9)")
def d10(t):
    # names only lead to clusters, so their numbers do
    f = t.keyed_facts().filter("kind = 'symbol'")
    home = F.when(F.col("symbol_kind") == "struct", F.regexp_extract("file", "^([^/]+/[^/]+)", 1)).otherwise(F.col("repo"))
    return diffing.mine_edges(t.keyed_edges("calls", "implements", once=False), f.select(F.col("id").alias("name"), home.alias("cluster")))


@query("d10_mine_props", "#w as (select symbol_kind, language, repo from facts where kind = 'symbol'), r as (select 'symbol_kind=' || a as ant, 'language=' || b as con, m, s, q from (select symbol_kind as a, language as b, count(*) as m, any_value(s) as s, any_value(q) as q from (select *, count(*) over (partition by symbol_kind) as s, count(*) over (partition by language) / (select count(*) from w) as q from w) group by 1, 2) union all select 'symbol_kind=' || a, 'repo=' || b, m, s, q from (select symbol_kind as a, repo as b, count(*) as m, any_value(s) as s, any_value(q) as q from (select *, count(*) over (partition by symbol_kind) as s, count(*) over (partition by repo) / (select count(*) from w) as q from w) group by 1, 2) union all select 'language=' || a, 'symbol_kind=' || b, m, s, q from (select language as a, symbol_kind as b, count(*) as m, any_value(s) as s, any_value(q) as q from (select *, count(*) over (partition by language) as s, count(*) over (partition by symbol_kind) / (select count(*) from w) as q from w) group by 1, 2) union all select 'language=' || a, 'repo=' || b, m, s, q from (select language as a, repo as b, count(*) as m, any_value(s) as s, any_value(q) as q from (select *, count(*) over (partition by language) as s, count(*) over (partition by repo) / (select count(*) from w) as q from w) group by 1, 2) union all select 'repo=' || a, 'symbol_kind=' || b, m, s, q from (select repo as a, symbol_kind as b, count(*) as m, any_value(s) as s, any_value(q) as q from (select *, count(*) over (partition by repo) as s, count(*) over (partition by symbol_kind) / (select count(*) from w) as q from w) group by 1, 2) union all select 'repo=' || a, 'language=' || b, m, s, q from (select repo as a, language as b, count(*) as m, any_value(s) as s, any_value(q) as q from (select *, count(*) over (partition by repo) as s, count(*) over (partition by language) / (select count(*) from w) as q from w) group by 1, 2)) select ant as antecedent, con as consequent, s as support, m as matched, round(m / s, 6) as confidence from r where s >= 10 and m / s >= 0.9 and s - m <= 20 and q < 0.9 and m / s > q")
def d10b(t):
    out = diffing.mine_props(t.facts().filter("kind = 'symbol'"), ["symbol_kind", "language", "repo"])
    return out.select("antecedent", "consequent", "support", "matched", "confidence")


@query("d13_blame", "#rev as (select o_orderpriority as line, cast(o_orderkey % 6 as integer) as k, count(*) as n from orders where o_orderkey % 6 <> 3 or o_orderpriority <> '5-LOW' group by 1, 2), ks as (select distinct k from rev), full_ as (select l.line, ks.k, coalesce(n, 0) as n from (select distinct line from rev) l cross join ks left join rev on rev.line = l.line and rev.k = ks.k), d as (select line, k, n - coalesce(lag(n) over (partition by line order by k), 0) as delta from full_) select line, 'r' || min(k) filter (delta <> 0) as introduced, cast(sum(greatest(delta, 0)) as bigint) as added, cast(sum(greatest(-delta, 0)) as bigint) as removed, sum(delta) > 0 as present from d where contains(line, '-') group by line")
def d13(t):
    o = t.raw("orders").filter("o_orderkey % 6 <> 3 or o_orderpriority <> '5-LOW'")
    k = (F.col("o_orderkey") % 6).cast("int")
    revisions = o.groupBy(F.col("o_orderpriority").alias("line"), k.alias("k")).agg(F.count("*").alias("n")).select(F.concat(F.lit("r"), "k").alias("revision_id"), F.timestamp_seconds(F.col("k") * 86400).alias("at"), "line", "n")
    return history.blame(history.patches(revisions), "-")


@query("r_tumbling", "select cast(date_trunc('hour', ts) as timestamp) as start, event_type, count(*) as n, round(sum(value), 6) as value from events group by 1, 2")
def r_tumbling(t):
    from ..streaming import windows

    return windows.tumbling(t.raw("events"))


@query("r_sessions", "#e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as b from events), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, count(*) as n, min(ts) as first, max(ts) as last from s group by user_id, k")
def r_sessions(t):
    from ..streaming import windows

    return windows.sessions(t.raw("events"))


@query("r8_invalidated", "#steps as (select distinct dst_file as a, src_file as b from part_links where src_file <> dst_file), walk(file, depth) as (select file, 0 from prt where p_partkey < 6 union select b, depth + 1 from walk join steps on a = file where depth < 20) select file, min(depth) as depth from walk group by file", recursive=True)
def r8(t):
    from ..streaming.protocol import invalidated

    return invalidated(t.parts().filter("p_partkey < 6").select("file"), t.part_links().select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst")))


@query("rel_rollup", "select coalesce(repo, '<all>') as repo, coalesce(kind, '<all>') as kind, count(*) as n from facts group by rollup (repo, kind)")
def rel_rollup(t):
    return t.facts().rollup("repo", "kind").agg(F.count("*").alias("n")).select(F.coalesce("repo", F.lit("<all>")).alias("repo"), F.coalesce("kind", F.lit("<all>")).alias("kind"), "n")


@query("rel_cube", "select coalesce(language, '<all>') as language, coalesce(kind, '<all>') as kind, count(*) as n from facts group by cube (language, kind)")
def rel_cube(t):
    return t.facts().cube("language", "kind").agg(F.count("*").alias("n")).select(F.coalesce("language", F.lit("<all>")).alias("language"), F.coalesce("kind", F.lit("<all>")).alias("kind"), "n")


@query("fn_names", "select name, regexp_extract(name, '([^./]*)$', 1) as short, regexp_extract(name, case when contains(name, '#') then '^(.*)#[^#]*$' else '^(.*)\\.[^.]*$' end, 1) as owner, regexp_replace(regexp_replace(file, '/[^/]*$', ''), '^$', '.') as dir, substr(sha256(concat_ws(chr(0), repo, kind, name, file)), 1, 32) as id from facts where kind = 'symbol' and symbol_kind <> 'method'")
def fn_names(t):
    c = F.col
    return t.facts().filter("kind = 'symbol' and symbol_kind <> 'method'").select("name", fn.short_name(c("name")).alias("short"), fn.owner_name(c("name")).alias("owner"), fn.dirname(c("file")).alias("dir"), fn.fact_id(c("repo"), c("kind"), c("name"), c("file")).alias("id"))


# -- streaming: runs made of the events of each user, some of them broken


def _envelopes(t: Tables) -> DataFrame:
    """One run for each user, a node and an edge for each event: users 1, 2 and 3 of five lack the end, fail, or have a hole in their batches; 4 names its scope in a last batch."""
    from pyspark.sql.window import Window

    from ..schema import EDGE, ENVELOPE, NODE, OWNER

    e = t.raw("events").select("user_id", "event_id", "event_type")
    owner = F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id"))
    owners, grows = F.array(owner).cast(f"array<{OWNER}>"), F.col("user_id") % 5 == 4
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    seq = place + F.when((F.col("user_id") % 5 == 3) & (place > 1), 1).otherwise(0)
    head = [F.lit(2).alias("schema_version"), F.col("user_id").cast("string").alias("repo_id"), F.lit("c").alias("context_id"), F.lit("run").alias("run_id")]
    users = e.groupBy("user_id").agg(F.count("*").cast("int").alias("n"))
    begin = users.select(
        *head, F.lit("begin_replace").alias("type"), F.lit(0).cast("long").alias("base_generation"), F.lit(1).cast("long").alias("target_generation"), F.when(grows, "incremental").alias("scope_mode"),
        F.when(grows, F.array().cast(f"array<{OWNER}>")).otherwise(owners).alias("owner_scope"), F.when(grows, 0).otherwise(1).alias("owner_scope_len"),
    )
    key = F.col("event_id").cast("string")
    node = F.struct(owner.alias("owner"), key.alias("id"), F.col("event_type").alias("kind"), F.lit("").alias("name"), F.lit(0).alias("occurrence"))
    none = F.lit(None).cast("string")
    edge = F.struct(owner.alias("owner"), F.concat(F.lit("e"), key).alias("id"), key.alias("source_id"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("target"), none.alias("target_id"), F.lit("resolved").alias("resolution"), F.lit(0).alias("occurrence"))
    batch = e.select(*head, F.lit("batch").alias("type"), F.lit("resolved").alias("phase"), seq.cast("int").alias("seq"), F.array(node).cast(f"array<{NODE}>").alias("nodes"), F.array(edge).cast(f"array<{EDGE}>").alias("edges"))
    scope = users.filter(grows).select(*head, F.lit("batch").alias("type"), F.lit("scope").alias("phase"), (F.col("n") + 1).alias("seq"), owners.alias("owners"))
    end = users.filter("user_id % 5 <> 1").select(
        *head, F.lit("end_replace").alias("type"), (F.col("n") + grows.cast("int")).alias("batch_count"), F.when(F.col("user_id") % 5 == 2, "error").otherwise("success").alias("status"), F.lit(1).alias("owner_scope_len"),
        F.when(grows, F.sha2(F.concat(F.lit("user\0"), F.col("user_id").cast("string")).cast("binary"), 256)).alias("owner_scope_digest"),
    )
    out = t.spark.createDataFrame([], ENVELOPE)
    for part in (begin, batch, scope, end):
        out = out.unionByName(part, allowMissingColumns=True)
    return out.unionByName(batch, allowMissingColumns=True)  # every batch arrives twice


def _verdicts(t: Tables) -> DataFrame:
    from ..streaming import protocol

    return cut(protocol.judged(_envelopes(t), t.spark.createDataFrame([], protocol.Consumer.LOG)))


@query("r3_verdicts", "select cast(user_id as varchar) as repo_id, case when user_id % 5 = 1 then 'open' when user_id % 5 = 2 then 'failed' when user_id % 5 = 3 and count(*) > 1 then 'bad_sequence' else 'apply' end as verdict from events group by user_id")
def r3(t):
    return _verdicts(t).select("repo_id", "verdict")


_OLD_STATE = "repo_id string, context_id string, owner string, part string, id string, kind string, occurrence int, payload string, generation long"


@query("r2_replacement", "#n as (select user_id, count(*) as c from events group by 1), x as (select cast(e.user_id as varchar) as repo_id, event_id, event_type from events e join n using (user_id) where user_id % 5 in (0, 4) or (user_id % 5 = 3 and c = 1)) select repo_id, 'node' as part, cast(event_id as varchar) as id, event_type as kind, 1 as generation from x union all select repo_id, 'edge', 'e' || event_id, event_type, 1 from x union all select '-1', 'node', 'old', 'kept', 0 union all select cast(u as varchar), 'edge', 'old', 'other owner', 0 from (select min(user_id) as u from events where user_id % 5 = 0)")
def r2(t):
    from ..streaming import protocol

    first = t.raw("events").filter("user_id % 5 = 0").agg(F.min("user_id").cast("string").alias("u")).first()["u"]
    old = [("-1", "c", "user\0-1", "node", "old", "kept", 0, "{}", 0), (first, "c", f"user\0{first}", "edge", "gone", "replaced", 0, "{}", 0), (first, "c", "user\0other", "edge", "old", "other owner", 0, "{}", 0)]
    state = t.spark.createDataFrame(old, _OLD_STATE)
    return protocol.replaced(state, _envelopes(t), _verdicts(t)).select("repo_id", "part", "id", "kind", "generation")


@query("r5_same_state", "#n as (select user_id, count(*) as c from events group by 1) select 'user' || chr(0) || user_id as owner, count(*) as n from events join n using (user_id) where user_id % 5 in (0, 4) or (user_id % 5 = 3 and c = 1) group by 1")
def r5(t):
    from ..streaming import protocol

    state = protocol.replaced(t.spark.createDataFrame([], _OLD_STATE), _envelopes(t), _verdicts(t))
    return protocol.canonical(state).filter("part = 'edge'").groupBy("owner").agg(F.count("*").alias("n"))


@query("d2_graded", "select source, title, case when informational then 'informational' when source in ('cycles', 'layers', 'constraints') and confidence >= 1.0 then 'fail' else 'warn' end as verdict from (select case cast(p_partkey % 3 as integer) when 0 then 'cycles' when 1 then 'layers' else 'surface' end as source, 'part ' || p_partkey as title, case when p_size > 25 then 1.0 else 0.5 end as confidence, p_partkey % 7 = 0 as informational from part)")
def d2(t):
    source = F.when(F.col("p_partkey") % 3 == 0, "cycles").when(F.col("p_partkey") % 3 == 1, "layers").otherwise("surface")
    found = t.raw("part").select(source.alias("source"), F.concat(F.lit("part "), "p_partkey").alias("title"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.5).alias("confidence"), (F.col("p_partkey") % 7 == 0).alias("informational"))
    return diffing.grade(found).select("source", "title", "verdict")


@query("d5_receipts", "select coalesce(a.metric, b.metric) as metric, coalesce(b.n, 0) - coalesce(a.n, 0) as delta, coalesce(a.metric, b.metric) in ('1-URGENT', '2-HIGH') and coalesce(b.n, 0) - coalesce(a.n, 0) > 0 as regression from (select o_orderpriority as metric, count(*) as n from orders where o_orderkey % 2 = 0 group by 1) a full outer join (select o_orderpriority as metric, count(*) as n from orders where o_orderkey % 2 = 1 group by 1) b on a.metric = b.metric")
def d5(t):
    count = lambda c: t.raw("orders").filter(c).groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("value"))
    return diffing.compare_receipts(count("o_orderkey % 2 = 0"), count("o_orderkey % 2 = 1"), worse_up=("1-URGENT", "2-HIGH")).select("metric", "delta", "regression")


@query("d7_reviewers", "#n as (select o_orderpriority as module, o_custkey % 12 as author, count(*) as n from orders group by 1, 2), r as (select *, row_number() over (partition by module order by n desc, author) as rank from n) select * from r where rank <= 2 and module <> '3-MEDIUM'")
def d7(t):
    shares = ag.author_shares(t.raw("orders").select(F.col("o_orderpriority").alias("module"), (F.col("o_custkey") % 12).alias("author")))
    return diffing.reviewers(shares.filter("module <> '3-MEDIUM'").select("module"), shares)


@query(
    "d10_mine_names",
    "#w as (select p_type as grp, lower(list_extract(split(p_name, ' '), -1)) as word from part), n as (select grp, word, count(*) as n from w group by 1, 2), s as (select grp, count(*) as total from w group by 1) select grp, word, n, total from n join s using (grp) where total >= 10 and n / total >= 0.15",
)
def d10c(t):
    named = t.raw("part").select(F.col("p_type").alias("grp_of"), F.concat(F.lit("lib."), F.translate("p_name", " ", "_")).alias("name"))
    return diffing.mine_names(named, "grp_of", confidence=0.15).select("grp", "word", "n", "total")


@query("u6_remove_where", "select repo, count(*) as n from facts where not (kind = 'symbol' and not exported) group by repo")
def u6b(t):
    return ag.counts(ag.remove_where(t.facts(), (F.col("kind") == "symbol") & ~F.col("exported")), "repo")


@query("t2_capped_findings", "#f as (select repo, name as title, cast(cyclomatic as double) as confidence from facts where symbol_kind = 'method'), r as (select *, row_number() over (partition by repo order by confidence desc, title) as rank, greatest(count(*) over (partition by repo) - 50, 0) as omitted from f) select repo, title, rank, omitted from r where rank <= 50")
def t2(t):
    found = t.facts().filter("symbol_kind = 'method'").select("repo", F.col("name").alias("title"), F.col("cyclomatic").cast("double").alias("confidence"))
    return explainers.capped_findings(found).select("repo", "title", "rank", "omitted")


@query("d6_gate", "#g as (select case cast(p_partkey % 3 as integer) when 0 then 'cycles' when 1 then 'layers' else 'surface' end as source, case when p_partkey % 7 = 0 then 'informational' when p_partkey % 3 < 2 and p_size > 25 then 'fail' else 'warn' end as verdict from part), n as (select source, verdict, count(*) as n from g where verdict <> 'informational' group by 1, 2) select case when max(case when verdict = 'fail' or (source = 'surface' and n > 100000000) then 1 else 0 end) = 1 then 'regression' else 'clean' end as status, case when max(case when verdict = 'fail' then 1 else 0 end) = 1 then 1 else 0 end as code from n")
def d6(t):
    source = F.when(F.col("p_partkey") % 3 == 0, "cycles").when(F.col("p_partkey") % 3 == 1, "layers").otherwise("surface")
    found = t.raw("part").select(source.alias("source"), F.concat(F.lit("part "), "p_partkey").alias("title"), F.when(F.col("p_size") > 25, 1.0).otherwise(0.5).alias("confidence"), (F.col("p_partkey") % 7 == 0).alias("informational"))
    status, code = diffing.gate(found, diffing.Policy(thresholds={"surface": 100_000_000}))
    return t.spark.createDataFrame([(status, code)], "status string, code int")


def _findings(t: Tables, rest: int, more: float) -> DataFrame:
    p = t.raw("part").filter(F.col("p_partkey") % 5 != rest)
    return p.select(F.col("p_brand").alias("source"), F.concat(F.lit("Part "), F.col("p_name"), F.lit(": size "), (F.col("p_size") + more).cast("int").cast("string")).alias("title"), (F.col("p_size") / 50.0).alias("confidence"))


_FOUND = """select p_brand as source, 'Part ' || p_name || ': size #' as key, max('Part ' || p_name || ': size ' || cast(p_size + {more} as integer)) as title from part where p_partkey % 5 <> {rest} group by 1, 2"""


@query(
    "d2_buckets",
    "#a as (" + _FOUND.format(rest=1, more=0) + "), b as (" + _FOUND.format(rest=2, more=1) + "), j as (select coalesce(a.source, b.source) as source, a.title as old, b.title as new, coalesce(a.key, b.key) as key from a full outer join b on a.source = b.source and a.key = b.key) select source, coalesce(new, old) as title, case when old is null then case when hit then 'new' else 'new_incidental' end when new is null then case when hit then 'resolved' else 'resolved_incidental' end when old <> new then 'changed' else 'same' end as bucket from (select *, len(list_filter(regexp_split_to_array(coalesce(new, old), '[\\s,:()]+'), lambda w: w = 'red' or w = 'blue')) > 0 as hit from j)",
)
def d2b(t):
    touched = t.spark.createDataFrame([("red",), ("blue",)], "name string")
    return diffing.diff_findings(_findings(t, 1, 0), _findings(t, 2, 1), touched).select("source", "title", "bucket")


@query("d4_focus", "select name, kind from facts where contains(lower(coalesce(name, '')), 'asia') or contains(lower(coalesce(role, '')), 'asia')")
def d4(t):
    return diffing.focus(t.facts().select("name", "kind", "role"), "ASIA", ["name", "role"]).select("name", "kind")


@query("d9_plan_check", "#r as (select name, p_partkey % 4 = 0 as gone, p_size <= 10 as bad from prt) select name, 'lost' as change from r where bad and gone union all select 'lib/new.Part' || p_partkey, 'gained' from prt where p_partkey % 10 = 3")
def d9(t):
    cols = ["name", "file", "p_size"]
    p = t.parts()
    out = p.filter("p_partkey % 4 = 0").select(F.lit("-").alias("op"), *cols)
    new = p.filter("p_partkey % 10 = 3").select(F.lit("+").alias("op"), F.concat(F.lit("lib/new.Part"), "p_partkey").alias("name"), "file", F.lit(1).cast(dict(p.dtypes)["p_size"]).alias("p_size"))
    return diffing.plan_check(p.select(*cols), out.unionByName(new), lambda f: f.filter("p_size <= 10").select("name")).select("name", "change")


@query("d11_thinned", "#l as (select o_orderkey as revision_id, cast(o_orderdate as timestamp) as at_ from orders), c as (select cast(date '1995-01-01' as timestamp) as lim) select revision_id from l, c where at_ >= lim union all select max(revision_id) from l, c where at_ < lim group by cast(at_ as date)")
def d11(t):
    log = t.raw("orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return history.thinned(log, "1995-01-01").select("revision_id")


@query(
    "d12_log_graph",
    "#l as (select o_orderkey as revision_id, o_orderpriority as branch, cast(o_orderdate as timestamp) as at_ from orders), f as (select branch, row_number() over (order by min(at_), branch) - 1 as lane from l group by branch), g as (select *, case when epoch(at_) - epoch(lag(at_) over (partition by branch order by at_, revision_id)) > 86400 then 1 else 0 end as gap from l) select g.revision_id, g.branch, cast(f.lane as integer) as lane, cast(sum(gap) over (partition by g.branch order by at_, revision_id rows unbounded preceding) as bigint) as epoch from g join f using (branch)",
)
def d12(t):
    log = t.raw("orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_orderpriority").alias("branch"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return history.log_graph(log).select("revision_id", "branch", F.col("lane").cast("int").alias("lane"), "epoch")


@query("x8_client_seams", "select src as name, 'GET' as method, dst as path, 'client' as role from implementations where starts_with(dst, 'lib/Brand#1.')")
def x8(t):
    calls = t.implementations().select("src", F.regexp_extract("dst", "^([^.]+)", 1).alias("dst"), F.col("dst").alias("argument"))
    return linking.client_seams(calls, t.spark.createDataFrame([("lib/Brand#1", "GET")], "function string, method string"))


@query("x8_grpc_names", "select p.p_partkey, case when n.c = 1 then 'pkg.' || p.p_name else p.p_name end as service from part p join (select p_name, count(distinct p_name || '/' || k) as c from (select p_name, case when p_partkey % 9 = 0 then 'other' else 'pkg' end as k from part) group by 1) n using (p_name)")
def x8b(t):
    p = t.raw("part")
    package = F.when(F.col("p_partkey") % 9 == 0, "other.").otherwise("pkg.")
    return linking.grpc_names(p.select("p_partkey", F.col("p_name").alias("service")), p.select(F.concat(package, "p_name").alias("name"))).select("p_partkey", "service")


@query("x8_vendored_specs", "select p_partkey, case when p_partkey % 2 = 0 and p_partkey % 3 = 0 then 'client' when p_partkey % 2 = 0 then 'server' else 'client' end as role from part")
def x8c(t):
    routes = t.raw("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "server").otherwise("client").alias("role"), F.when(F.col("p_partkey") % 3 == 0, "app/vendor/api.yaml").otherwise("app/api.yaml").alias("file"))
    return linking.vendored_specs(routes).select("p_partkey", "role")


@query("x9_handlers", "#h as (select regexp_extract(name, '([^./]*)$', 1) as handler, count(distinct name) as n, min(name) as symbol from supp group by 1) select p_partkey, case when n = 1 then symbol end as symbol from part left join h on h.handler = 'Supplier' || p_partkey")
def x9c(t):
    routes = t.raw("part").select("p_partkey", F.concat(F.lit("Supplier"), "p_partkey").alias("handler"))
    return linking.handlers(routes, t.suppliers().select("name")).select("p_partkey", "symbol")


@query("x9_mixins", "select distinct o.name as src, s.name as target from (select distinct l_orderkey, l_suppkey from lineitem where l_linenumber = 1) l join ord o on o.o_orderkey = l.l_orderkey join supp s on s.s_suppkey = l.l_suppkey")
def x9d(t):
    first = t.raw("lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_suppkey").distinct()
    o = t.orders().select("o_orderkey", "name")
    calls = first.join(o, first["l_orderkey"] == o["o_orderkey"]).select(F.col("name").alias("src"), F.concat(F.lit("C"), "l_orderkey").alias("owner"), F.concat(F.lit("m"), "l_suppkey").alias("bare"))
    includes = t.raw("orders").select(F.concat(F.lit("C"), "o_orderkey").alias("class"), F.lit("Mixin").alias("mixin"))
    methods = t.suppliers().select(F.lit("Mixin").alias("owner"), F.concat(F.lit("m"), "s_suppkey").alias("bare"), "name")
    return linking.mixin_owners(calls, includes, methods)


# -- sources and sinks, through the shared folder


def _folder(t: Tables, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _stored(t: Tables) -> DataFrame:
    """Facts in the fixed schema."""
    wanted = t.facts().withColumn("props", F.create_map(F.lit("role"), F.coalesce("role", F.lit("")))).withColumn("end_line", F.col("line"))
    return wanted.select("repo", "kind", "name", "file", "line", "end_line", "symbol_kind", "exported", "language", "props", F.array().cast(f"array<{RELATION}>").alias("relations"))


@query("s4_json_lines", "select kind, count(*) as n, count(distinct name) as names, sum(line) as lines, count(*) filter (coalesce(role, '') = 'BUILDING') as building from facts group by kind")
def s4(t):
    path = _folder(t, "facts")
    facts_io.write_facts(_stored(t), path)
    back, _ = facts_io.validated(facts_io.read_facts(t.spark, path))
    return back.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.sum("line").alias("lines"), F.sum(F.when(F.element_at("props", "role") == "BUILDING", 1).otherwise(0)).alias("building"))


@query("s6_snapshot", "select repo, count(*) as n, min(name) as first, max(name) as last from facts group by repo")
def s6(t):
    path = _folder(t, "snapshot")
    facts_io.write_snapshot(_stored(t), None, {"schema_version": 1}, path)
    facts_io.pin_baseline(t.spark, path, f"{path}-baseline")
    back, meta = facts_io.read_snapshot(t.spark, f"{path}-baseline")
    return back.groupBy("repo").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("s9_changed_share", "#a as (select name, line from facts where symbol_kind = 'method' and line % 10 <> 0), b as (select name, case when line % 7 = 0 then line + 1 else line end as line from facts where symbol_kind = 'method' and line % 11 <> 0), j as (select a.line as x, b.line as y from a full outer join b using (name)) select round(count(*) filter (x is null or y is null or x <> y) / count(*), 6) as share from j")
def s9(t):
    m = t.facts().filter("symbol_kind = 'method'").select(F.col("name").alias("file"), "line")
    old, new = m.filter("line % 10 <> 0"), m.filter("line % 11 <> 0").withColumn("line", F.expr("case when line % 7 = 0 then line + 1 else line end"))
    hashed = lambda df: df.select("file", F.col("line").cast("string").alias("hash"))
    return facts_io.changed_share(hashed(old), hashed(new)).select(F.round("share", 6).alias("share"))


@query("r6_consumer", "#n as (select user_id, count(*) as c from events group by 1), x as (select cast(e.user_id as varchar) as repo_id, event_id from events e join n using (user_id) where user_id % 5 in (0, 4) or (user_id % 5 = 3 and c = 1)) select repo_id, part, count(*) as n from (select repo_id, 'node' as part from x union all select repo_id, 'edge' from x) group by 1, 2")
def r6(t):
    from ..streaming import protocol

    consumer = protocol.Consumer(t.spark, _folder(t, "consumer"))
    sent = _envelopes(t)
    consumer.run_batch(sent.filter("type <> 'end_replace'"), 0)  # nothing is settled yet
    consumer.run_batch(sent.filter("type = 'end_replace'"), 1)
    return consumer.state().groupBy("repo_id", "part").agg(F.count("*").alias("n"))


@query("r9_coalesced", "#l as (select user_id, event_type, max(event_id) as seq from events group by 1, 2), c as (select user_id, max(event_id) - min(event_id) + 1 <> count(distinct event_id) as reconcile from events group by 1) select l.user_id as epoch, l.event_type as path, case when e.value > 50 then 'edit' else 'delete' end as op, l.seq, c.reconcile from l join c using (user_id) join events e on e.event_id = l.seq")
def r9(t):
    from ..streaming import changes

    e = t.raw("events").select(F.col("user_id").alias("epoch"), F.col("event_id").alias("seq"), F.col("event_type").alias("path"), F.when(F.col("value") > 50, "edit").otherwise("delete").alias("op"))
    return changes.coalesced(e).select("epoch", "path", "op", "seq", "reconcile")


@query("fn_folded", "select p_partkey, case cast(p_partkey % 3 as integer) when 0 then case when p_partkey % 2 = 0 then '/api/' || p_brand end when 1 then '/part/' || p_partkey else '/parts/{}/' || p_partkey end as literal from part")
def fn_folded(t):
    p = t.raw("part").select("p_partkey", "p_brand")
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 3
    name = F.concat(F.lit("C"), key)
    call, template = F.concat(F.lit("url('/part/"), key, F.lit("')")), F.concat(F.lit("`${base}/parts/${id}/"), key, F.lit("`"))
    expressions = p.select("p_partkey", F.lit("a.ts").alias("file"), F.when(kind == 0, name).when(kind == 1, call).otherwise(template).alias("expression"))
    literal = F.concat(F.lit("/api/"), "p_brand")
    assigned = p.select(F.lit("a.ts").alias("file"), name.alias("name"), literal.alias("literal")).unionByName(p.filter("p_partkey % 2 = 1").select(F.lit("a.ts").alias("file"), name.alias("name"), F.lit("/again").alias("literal")))
    return scanners.folded(expressions, assigned).select("p_partkey", "literal")


@query("fn_operation_heads", "select p_partkey, case when p_partkey % 2 = 0 then 'query:Part' || p_partkey || ':part' else 'mutation::save' end as heads from part")
def fn_heads(t):
    key = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("# query No { x }\nquery Part"), key, F.lit("($id: ID!) {\n  one: part(id: $id) { name }\n}\n"))).otherwise(F.lit("mutation { save(x: 1) }"))
    heads = scanners.operation_heads(F.col("text"))
    return t.raw("part").select("p_partkey", text.alias("text")).select("p_partkey", F.array_join(F.transform(heads, lambda h: F.concat_ws(":", h["kind"], h["name"], h["field"])), ",").alias("heads"))


@query("x9_framework_roots", "#steps as (select distinct src as a, dst as b from part_links where src <> dst), walk(name) as (select name from prt where p_size > 48 union select b from walk join steps on a = name) select name, name in (select name from walk) as reached, case when p_size > 48 then p_type else '' end as mechanisms from prt", recursive=True)
def x9e(t):
    roots = t.parts().filter("p_size > 48").select("name", F.col("p_type").alias("mechanism"))
    out = linking.framework_roots(t.parts().select("name"), t.part_links(), roots)
    return out.withColumn("mechanisms", F.array_join("mechanisms", ","))


@query("x9_literals", "#d as (select p_name, count(distinct p_type) as n, min(p_type) as target from part where p_size > 45 group by 1) select p_partkey, case when n = 1 then target end as target from part left join d using (p_name)")
def x9f(t):
    p = t.raw("part")
    out = linking.literal_bindings(p.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("literal")), p.filter("p_size > 45").select(F.col("p_name").alias("literal"), F.col("p_type").alias("target")))
    return out.select(F.col("src").alias("p_partkey"), "target")
