"""Queries over the graph: components, cycles, reachability, detectors, views, and extraction from code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import extract as X
from ..operators import graph as G
from ..operators import history as H
from ..operators import resolve as J
from ..shared import materialise
from . import views as V
from .registry import Registry, Tables
from .scalar_queries import LANE, behavioral
from .table_queries import ROLLUP, findings

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

REACH = """with recursive r(a, b) as (select src, dst from {b_import_edges} union select r.a, e.dst from r join {b_import_edges} e on e.src = r.b),
 m as (select x.a, min(least(x.a, x.b)) as component from r x join r y on y.a = x.b and y.b = x.a group by 1),
 n as (select src as node from {b_import_edges} union select dst from {b_import_edges}),
 c as (select n.node, coalesce(m.component, n.node) as component, m.a is not null as in_cycle from n left join m on m.a = n.node),
 s as (select *, count(*) over (partition by component) as size from c) """


def cycles_sql(tag: str, edges: str) -> str:
    """Tables that say which cycles edges (src, dst) have: <tag>_cycles(component, cycle), a shortest one through the least
    node of each cyclic component, and of these the least; to be put behind WITH RECURSIVE."""
    return f"""{tag}_r(a, b) as (select src, dst from {edges} union select r.a, e.dst from {tag}_r r join {edges} e on e.src = r.b),
 {tag}_m as (select x.a as node, min(least(x.a, x.b)) as component from {tag}_r x join {tag}_r y on y.a = x.b and y.b = x.a group by 1),
 {tag}_i as (select distinct x.component, e.src, e.dst from {edges} e join {tag}_m x on x.node = e.src join {tag}_m y on y.node = e.dst and y.component = x.component),
 {tag}_w(component, node, path, closed) as (select distinct component, component, [component], false from {tag}_m union all
  select component, node, list_append(p, node), bool_or(node = component) over (partition by component) from
   (select w.component, i.dst as node, min(w.path) as p from {tag}_w w join {tag}_i i on i.component = w.component and i.src = w.node where not w.closed group by 1, 2) g),
 {tag}_cycles as (select component, path[:-2] as cycle from {tag}_w where node = component and len(path) > 1)"""


def titled_sql(tag: str, kind: str, names: str, node: str, confidence: str) -> str:
    """Findings of cycles; names: a table with the names of nodes."""
    return f"""select 'circular_dependency' as category, 'warning' as level, 'Circular {kind}: ' || string_agg(coalesce(n.name, h.node), ' → ' order by h.pos) || ' → ' || arg_min(coalesce(n.name, h.node), h.pos) as title,
 array_to_string(h.cycle, ',') as nodes, {confidence}::double as confidence
 from (select component, cycle, unnest(cycle) as node, generate_subscripts(cycle, 1) as pos from {tag}_cycles) h left join {names} n on n.{node} = h.node group by h.component, h.cycle"""


IMPORT_CYCLES = cycles_sql("f", "{b_import_edges}")
CALL_CYCLES = cycles_sql("c", "(select source_id as src, target_id as dst from {b_calls})")
FILE_FINDINGS = titled_sql("f", "dependency", "{b_files}", "file_id", "0.7")
CALL_FINDINGS = titled_sql("c", "call", "{b_functions}", "function_id", "0.6")
TYPED_FINDINGS = """select 'circular_dependency' as category, case when harmless then 'info' else 'warning' end as level, title, nodes, case when harmless then 0.6::double else 0.85::double end as confidence from
 (select 'Circular dependency: ' || string_agg(string_split(h.node, '/')[-1], ' → ' order by h.pos) || ' → ' || string_split(h.cycle[1], '/')[-1] as title, array_to_string(h.cycle, ',') as nodes, bool_or(e.is_type_only) as harmless
  from (select cycle, unnest(cycle) as node, generate_subscripts(cycle, 1) as pos from f_cycles) h join {b_import_edges} e on e.src = h.node and e.dst = h.cycle[h.pos % len(h.cycle) + 1] group by h.cycle)"""


def edges(t: Tables):
    return t.b_import_edges.select("scan_id", "src", "dst", "weight", "is_type_only")


def graph(t: Tables):
    """(edges, components), each written once."""
    e = materialise(edges(t), "edges")
    return e, materialise(G.scc(G.participating(e), e), "components")


@_r.add("participating_files", "select src as node from {b_import_edges} union select dst from {b_import_edges}")
def _(t: Tables):
    return G.participating(edges(t)).select("node")


@_r.add("scc", REACH + "select node, component, size, in_cycle from s")
def _(t: Tables):
    return graph(t)[1].select("node", "component", "size", "in_cycle")


@_r.add("circular_edges", REACH + """select e.src, e.dst, coalesce(x.in_cycle and y.in_cycle and x.component = y.component, false) as circular
 from {b_import_edges} e join s x on x.node = e.src join s y on y.node = e.dst""")
def _(t: Tables):
    return G.circular_edges(*graph(t)).select("src", "dst", "circular")


@_r.add("dependency_meta", REACH + """select 'corpus' as scan_id, count(*) as modules, (select count(*) from {b_import_edges}) as imports,
 count(distinct component) filter (in_cycle) as cycles, count(*) filter (in_cycle) as in_cycles from s""")
def _(t: Tables):
    return V.dependency_meta(*graph(t))


@_r.add("view_dependencies", REACH + """select node as id, 'node' as kind, component as a, in_cycle as flag from s union all
 select e.src || ' > ' || e.dst, 'edge', e.src, coalesce(x.in_cycle and y.in_cycle and x.component = y.component, false)
 from {b_import_edges} e join s x on x.node = e.src join s y on y.node = e.dst""")
def _(t: Tables):
    nodes, links = V.view_dependencies(edges(t))
    n = nodes.select(F.col("node").alias("id"), F.lit("node").alias("kind"), F.col("component").alias("a"), F.col("in_cycle").alias("flag"))
    return n.unionByName(links.select(F.concat_ws(" > ", "src", "dst").alias("id"), F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("circular").alias("flag")))


@_r.add("neighbourhood", """with n as (select file_id as node from {b_files}), b as (select src as node, dst as neighbour from {b_import_edges} union select dst, src from {b_import_edges})
 select b.node, b.neighbour from b join n on n.node = b.node union select node, node from n""")
def _(t: Tables):
    return G.neighbourhood(edges(t), t.b_files.select("scan_id", F.col("file_id").alias("node"))).select("node", "neighbour")


@_r.add("most_connected", """with d as (select node, count(*) as degree from (select src as node from {b_import_edges} union all select dst from {b_import_edges}) group by 1)
 select node, degree, row_number() over (order by degree desc, node) as rank from d order by rank limit 25""")
def _(t: Tables):
    return G.most_connected(edges(t), 25).select("node", "degree", "rank")


@_r.add("find_cycles", f"with recursive {IMPORT_CYCLES} select component, array_to_string(cycle, ' > ') as cycle from f_cycles")
def _(t: Tables):
    return G.find_cycles(*graph(t)).select("component", F.array_join("cycle", " > ").alias("cycle"))


def connections(t: Tables, kind: str):
    return t.b_import_edges.select("scan_id", F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit(kind).alias("type"))


def calls(t: Tables):
    return t.b_calls.select("scan_id", "source_id", "target_id", F.lit("function_call").alias("type"))


def _shown(df):
    return df.select("category", "level", "title", F.array_join("affected_nodes", ",").alias("nodes"), "confidence")


@_r.add("file_cycles", f"with recursive {IMPORT_CYCLES} {FILE_FINDINGS}")
def _(t: Tables):
    return _shown(D.file_cycles(connections(t, "import"), t.b_files))


@_r.add("function_cycles", f"with recursive {CALL_CYCLES} {CALL_FINDINGS}")
def _(t: Tables):
    return _shown(D.function_cycles(calls(t), t.b_functions))


@_r.add("import_cycles_typed", f"with recursive {IMPORT_CYCLES} {TYPED_FINDINGS}")
def _(t: Tables):
    return _shown(D.import_cycles_typed(edges(t)))


@_r.add("large_files", """select 'large_file' as category, case when end_line > 1000 then 'warning' else 'info' end as level, 'Large file: ' || name as title, file_id as nodes, 0.95::double as confidence
 from {b_files} where end_line > 500""")
def _(t: Tables):
    return _shown(D.large_files(t.b_files))


@_r.add("orphaned_functions", """select f.function_id as nodes, 'Potentially unused: ' || f.name as title from {b_functions} f where not is_exported and function_id not in (select target_id from {b_calls})
 and not (fn_ord % 13 = 5)""")
def _(t: Tables):
    files = t.b_functions.where("fn_ord % 13 = 5").groupBy("scan_id", F.col("parent_file_id").alias("file_id")).agg(F.collect_set("name").alias("top_level_references"))
    called = t.b_calls.select("scan_id", "target_id", F.lit("function_call").alias("type"))
    out = D.orphaned_functions(t.b_functions.withColumn("parent_class_id", F.lit(None).cast("string")), called, files)
    return out.select(F.array_join("affected_nodes", ",").alias("nodes"), "title")


def exports(t: Tables):
    """Each function is an export of its file; some files pass names or all of a file they import on."""
    none = F.lit(None).cast("string")
    own = t.b_functions.select(
        "scan_id", F.col("parent_file_id").alias("file_id"), "file_path", "name", none.alias("alias"), F.lit(False).alias("is_default"), F.lit(False).alias("is_type_only"), F.lit("function").alias("kind"), none.alias("source")
    )
    i = t.b_imports.where("stmt_ord = 1")
    again = i.select(
        "scan_id", "file_id", "file_path", F.when(F.col("n_items") == 0, "*").otherwise(F.concat(F.lit("s"), "n_items")).alias("name"), F.when(F.col("n_items") == 1, F.lit("renamed")).alias("alias"),
        F.lit(False).alias("is_default"), F.lit(False).alias("is_type_only"), F.lit("reexport").alias("kind"), "source",
    )
    return own.unionByName(again)


_TARGET = """regexp_replace(case when source like '@/%' then 'Brand#11/' || substr(source, 3) when source like 'lib1%' then 'vendor/one' || substr(source, 5)
 when source like './%' then regexp_replace(file_path, '/[^/]*$', '') || substr(source, 2) when source like '../../%' then replace(substr(source, 7), '/./', '/') else source end, '\\.(ts|tsx|js|jsx)$', '')"""
_BARREL = "regexp_replace(file_path, '\\.ts$', '')"
NAMED = f"""select distinct {_BARREL} as barrel, case when n_items = 1 then 'renamed' else 's' || n_items end as exported, {_TARGET} as target, 's' || n_items as original from {{b_imports}} where stmt_ord = 1 and n_items > 0"""
STARS = f"select distinct {_BARREL} as barrel, {_TARGET} as target from {{b_imports}} where stmt_ord = 1 and n_items = 0"


@_r.add("reexport_map", NAMED)
def _(t: Tables):
    return D.reexport_map(exports(t), t.b_aliases).select("barrel", "exported", "target", "original")


@_r.add("star_reexports", STARS)
def _(t: Tables):
    return D.star_reexports(exports(t), t.b_aliases).select("barrel", "target")


USED = f"select distinct {_TARGET} as source, case when n_items = 3 and stmt_ord = 2 then '*' else unnest(['s' || stmt_ord, 's' || (stmt_ord + 20)]) end as name from {{b_imports}}"


def imports(t: Tables):
    """(import statements, the two names each takes or its namespace)."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("file_id").orderBy("stmt_ord", "source"))
    numbered = t.b_imports.withColumn("s", F.col("stmt_ord")).withColumn("stmt_ord", n)
    names = F.array(F.concat(F.lit("s"), "s"), F.concat(F.lit("s"), F.col("s") + 20))
    space = (F.col("n_items") == 3) & (F.col("s") == 2)
    items = numbered.select("scan_id", "file_id", "stmt_ord", space.alias("is_namespace"), F.lit(False).alias("is_default"), F.posexplode(names).alias("item_ord", "name"))
    return numbered, items


@_r.add("unused_exports", f"""with u as ({USED}), n as ({NAMED}), st as ({STARS}),
 c as (select source, name from u union select n.target, n.original from u join n on n.barrel = u.source and n.exported = u.name union select st.target, u.name from u join st on st.barrel = u.source where u.name <> '*')
 select 'Unused export: ' || f.name as title, f.parent_file_id as nodes from {{b_functions}} f
 where not exists (select 1 from c where c.source = regexp_replace(f.file_path, '\\.ts$', '') and c.name in ('*', f.name))""")
def _(t: Tables):
    out = D.unused_exports(exports(t), *imports(t), t.b_aliases)
    return out.select("title", F.array_join("affected_nodes", ",").alias("nodes"))


def entry_named(t: Tables):
    """b_files, every fortieth below bin/."""
    return t.b_files.withColumn("file_path", F.when(F.col("k") % 40 == 0, F.concat(F.lit("bin/"), "name")).otherwise(F.col("file_path")))


@_r.add("entry_files", "select file_id from {b_files} where k % 40 = 0")
def _(t: Tables):
    return D.entry_files(entry_named(t)).select("file_id")


_LEFT = """with recursive r(node) as (select file_id from {b_files} where k % 40 = 0 union select e.dst from r join {b_import_edges} e on e.src = r.node)
 select file_id as nodes, 'Unused file: ' || file_path as title from {b_files} where file_id not in (select node from r)"""


@_r.add("unused_files", _LEFT)
def _(t: Tables):
    return D.unused_files(entry_named(t), edges(t)).select(F.array_join("affected_nodes", ",").alias("nodes"), "title")


@_r.add("reachable", """with recursive r(node) as (select file_id from {b_files} where k % 40 = 0 union select e.dst from r join {b_import_edges} e on e.src = r.node) select node from r""")
def _(t: Tables):
    return G.reachable(t.b_files.where("k % 40 = 0").select("scan_id", F.col("file_id").alias("node")), edges(t)).select("node")


@_r.add("dedupe_cycles", "select distinct least(src, dst) || ',' || greatest(src, dst) as members from {b_import_edges}")
def _(t: Tables):
    rows = t.b_import_edges.select("scan_id", F.array("src", "dst").alias("members"))
    return D.dedupe_cycles(rows).select(F.array_join(F.array_sort("members"), ",").alias("members"))


def reports(t: Tables):
    """One report of each kind for every function folder: its files and exports as unused, its import edges as cycles; a
    broken one for every tenth file."""
    f = t.b_files
    issue = F.struct(
        F.col("file_path").alias("file"), F.when(F.col("k") % 3 == 0, F.array(F.struct(F.col("file_path").alias("name")))).alias("files"),
        F.when(F.col("k") % 3 == 1, F.array(F.struct(F.concat(F.lit("e"), "k").alias("name"), F.lit(1).alias("line")))).alias("exports"),
        F.when(F.col("k") % 3 == 2, F.array(F.struct(F.concat(F.lit("T"), "k").alias("name"), F.lit(1).alias("line")))).alias("types"),
    )
    unused = f.select("scan_id", F.lit("unused").alias("kind"), F.to_json(F.struct(F.array(issue).alias("issues"))).alias("content"))
    kinds = F.array(F.when(F.col("is_type_only"), "type-only").otherwise("import"))
    path = lambda c: F.substring(c, 6, 1 << 20)
    hop = lambda c: F.struct(path(F.col(c)).alias("name"), kinds.alias("dependencyTypes"))
    rule = F.struct(F.lit("no-circular").alias("name"), F.lit("warn").alias("severity"))
    v = F.struct(F.lit("cycle").alias("type"), path(F.col("src")).alias("from"), path(F.col("dst")).alias("to"), rule.alias("rule"), F.array(hop("src"), hop("dst")).alias("cycle"))
    # a report of cycles for each file with imports
    one = t.b_import_edges.groupBy("scan_id", "src").agg(F.array_sort(F.collect_list(v)).alias("violations"))
    cycles = one.select("scan_id", F.lit("cycles").alias("kind"), F.to_json(F.struct(F.struct("violations").alias("summary"))).alias("content"))
    broken = f.where("k % 10 = 0").select("scan_id", F.lit("unused").alias("kind"), F.lit('{"issues": 3}').alias("content"))
    return unused.unionByName(cycles).unionByName(broken)


UNUSED_REPORT = """select file_id as nodes, case k % 3 when 0 then 'Unused file: ' || file_path when 1 then 'Unused export: e' || k else 'Unused type export: T' || k end as title,
 case k % 3 when 0 then 0.9::double when 1 then 0.6::double else 0.5::double end as confidence from {b_files}"""


@_r.add("map_unused_report", UNUSED_REPORT)
def _(t: Tables):
    out = D.map_unused_report(D.read_engine_reports(reports(t)), files=t.b_files)
    return out.select(F.array_join("affected_nodes", ",").alias("nodes"), "title", "confidence")


CYCLE_REPORT = """with e as (select src, dst, is_type_only, least(src, dst) || '|' || greatest(src, dst) as key, row_number() over (partition by src order by dst) as o from {b_import_edges}),
 f as (select key, arg_min(src, (o, src)) as src, arg_min(dst, (o, src)) as dst, arg_min(is_type_only, (o, src)) as harmless from e group by key)
 select src || ',' || dst as nodes, case when harmless then 'info' else 'warning' end as level, case when harmless then 0.6::double else 0.85::double end as confidence from f"""


@_r.add("map_cycle_report", CYCLE_REPORT)
def _(t: Tables):
    out = D.map_cycle_report(D.read_engine_reports(reports(t)), files=t.b_files)
    return out.select(F.array_join("affected_nodes", ",").alias("nodes"), "level", "confidence")


@_r.add("read_engine_reports", "select 'unused' as kind, (select count(*) from {b_files}) as parsed, (select count(*) from {b_files} where k % 10 = 0) as errors union all select 'cycles', (select count(distinct src) from {b_import_edges}), 0")
def _(t: Tables):
    return D.read_engine_reports(reports(t)).groupBy("kind").agg(F.count_if(F.col("error").isNull()).alias("parsed"), F.count("error").alias("errors"))


@_r.add("external_detection", f"""with recursive {IMPORT_CYCLES},
 o_r(node) as (select file_id from {{b_files}} where k % 40 = 0 union select e.dst from o_r r join {{b_import_edges}} e on e.src = r.node),
 o_k as (select src, dst, is_type_only, least(src, dst) || '|' || greatest(src, dst) as key, row_number() over (partition by src order by dst) as o from {{b_import_edges}}),
 o_f as (select key, arg_min(src, (o, src)) as src, arg_min(dst, (o, src)) as dst, arg_min(is_type_only, (o, src)) as harmless from o_k group by key)
 select 'orphaned_code' as category, 'info' as level, 'Unused file: ' || case when k % 40 = 0 then 'bin/' || name else file_path end as title, 'graph' as source, file_id as nodes from {{b_files}} where file_id not in (select node from o_r)
 union all select category, level, title, 'graph', nodes from ({TYPED_FINDINGS})
 union all select case when k % 3 = 0 then 'orphaned_code' else 'unused_export' end, 'info', title, 'report', nodes from (select u.*, f.k from ({UNUSED_REPORT}) u join {{b_files}} f on f.file_id = u.nodes where f.k % 40 <> 0)
 union all select case when k % 3 = 0 then 'orphaned_code' else 'unused_export' end, 'info', case k % 3 when 0 then 'Unused file: ' || file_path when 1 then 'Unused export: e' || k else 'Unused type export: T' || k end, 'report', file_path
  from {{b_files}} where k % 40 = 0
 union all select 'circular_dependency', case when harmless then 'info' else 'warning' end,
  'Circular dependency: ' || string_split(src, '/')[-1] || ' → ' || string_split(dst, '/')[-1] || ' → ' || string_split(src, '/')[-1], 'report',
  (case when s.k % 40 = 0 then s.file_path else src end) || ',' || (case when d.k % 40 = 0 then d.file_path else dst end)
  from o_f join {{b_files}} s on s.file_id = src join {{b_files}} d on d.file_id = dst
 union all select 'error', 'error', 'unexpected report: unused', 'unused', '' from {{b_files}} where k % 10 = 0""")
def _(t: Tables):
    t.write("b_import_edges")
    good, bad = D.external_detection(reports(t), entry_named(t), edges(t))
    rows = good.select("category", "level", "title", "source", F.array_join("affected_nodes", ",").alias("nodes"))
    return rows.unionByName(bad.select(F.lit("error").alias("category"), F.lit("error").alias("level"), F.col("error").alias("title"), F.col("kind").alias("source"), F.lit("").alias("nodes")))


@_r.add("union_findings", f"select file_id as nodes, 'Large file: ' || name as title from {{b_files}} where end_line > 500 union all select nodes, title from ({UNUSED_REPORT})")
def _(t: Tables):
    out = D.union_findings(D.large_files(t.b_files), D.map_unused_report(D.read_engine_reports(reports(t)), files=t.b_files))
    return out.select(F.array_join("affected_nodes", ",").alias("nodes"), "title")


# views

@_r.add("view_folders", f"""select 'folder:' || folder as node_id, string_split(folder, '/')[-1] as label, files, functions, warnings, row_number() over (order by folder) as rank from ({ROLLUP})""")
def _(t: Tables):
    return V.view_folders(t.b_files, t.b_functions, t.b_finding_nodes).select("node_id", "label", "files", "functions", "warnings", "rank")


_IN = "(select file_id from {b_files} where regexp_replace(file_path, '/[^/]*$', '') = (select min(regexp_replace(file_path, '/[^/]*$', '')) from {b_files}))"


@_r.add("view_folder", f"select file_id as id, 'file' as kind from {{b_files}} where file_id in {_IN} union all select src || ' > ' || dst, 'edge' from {{b_import_edges}} where src in {_IN} and dst in {_IN}")
def _(t: Tables):
    folder = V.folders_of(t.b_files).agg(F.min("folder")).first()[0]
    nodes, inside = V.view_folder(t.b_files, edges(t), folder)
    return nodes.select(F.col("file_id").alias("id"), F.lit("file").alias("kind")).unionByName(inside.select(F.concat_ws(" > ", "src", "dst").alias("id"), F.lit("edge").alias("kind")))


LANES = f"""with l as (select *, {LANE} as lane from {{b_functions}}),
 o as (select *, list_position(['database', 'network', 'filesystem', 'notification', 'state', 'pure', 'unknown'], lane) as lane_ord from l)
 select function_id, lane, dense_rank() over (order by lane_ord) as lane_no, row_number() over (partition by lane order by file_path, name, function_id) as position from o"""


@_r.add("lane_position", LANES)
def _(t: Tables):
    return V.lane_position(behavioral(t)).select("function_id", "lane", "lane_no", "position")


@_r.add("view_data_flow", f"""select function_id as id, lane as kind, position from ({LANES}) union all
 select c.source_id || ' > ' || c.target_id, 'call', c.weight from {{b_calls}} c where c.source_id in (select function_id from {{b_functions}}) and c.target_id in (select function_id from {{b_functions}})""")
def _(t: Tables):
    nodes, calls = V.view_data_flow(behavioral(t), t.b_calls)
    n = nodes.select(F.col("function_id").alias("id"), F.col("lane").alias("kind"), F.col("position").cast("long").alias("position"))
    return n.unionByName(calls.select(F.concat_ws(" > ", "source_id", "target_id").alias("id"), F.lit("call").alias("kind"), F.col("weight").alias("position")))


@_r.add("build_graph", f"""select 'folders' as view, (select count(*) from ({ROLLUP})) as nodes, 0::bigint as edges
 union all select 'folder', (select count(*) from {{b_files}} where file_id in {_IN}), (select count(*) from {{b_import_edges}} where src in {_IN} and dst in {_IN})
 union all select 'dependencies', (select count(*) from (select src from {{b_import_edges}} union select dst from {{b_import_edges}})), (select count(*) from {{b_import_edges}})
 union all select 'data-flow', (select count(*) from {{b_functions}}),
 (select count(*) from {{b_calls}} c where c.source_id in (select function_id from {{b_functions}}) and c.target_id in (select function_id from {{b_functions}}))""")
def _(t: Tables):
    t.write("b_import_edges", "b_functions")
    scan = {"files": t.b_files, "functions": behavioral(t), "affected": t.b_finding_nodes, "edges": edges(t), "calls": t.b_calls}
    folder, out = V.folders_of(t.b_files).agg(F.min("folder")).first()[0], None
    for name in V.VIEWS:
        n, e = V.build_graph(name, scan, folder if name == "folder" else None)
        rows = n.select(F.lit(1).alias("node"), F.lit(0).alias("edge")).unionByName(e.select(F.lit(0).alias("node"), F.lit(1).alias("edge")))
        row = rows.agg(F.coalesce(F.sum("node"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("edge"), F.lit(0)).alias("edges")).select(F.lit(name).alias("view"), "nodes", "edges")
        out = row if out is None else out.unionByName(row)
    return out


def component_files(t: Tables):
    """For each first import statement a component beside its file, which takes another name from the same place."""
    i = t.b_imports.where("stmt_ord = 1")
    text = F.concat(F.lit("<script>\nimport { s"), F.col("n_items") + 40, F.lit(" } from '"), "source", F.lit("';\n</script>"))
    path = F.concat(F.regexp_replace("file_path", r"\.ts$", "-"), F.substring(F.md5("source"), 1, 12), F.lit(".svelte"))
    return i.select("scan_id", path.alias("file_path"), text.alias("content"))


@_r.add("detect_warnings", f"""with recursive {IMPORT_CYCLES}, {CALL_CYCLES}, u as ({USED}), n as ({NAMED}), st as ({STARS}),
 x as (select source, name from u union select n.target, n.original from u join n on n.barrel = u.source and n.exported = u.name union select st.target, u.name from u join st on st.barrel = u.source where u.name <> '*'
  union select distinct {_TARGET}, 's' || (n_items + 40) from {{b_imports}} where stmt_ord = 1)
 {FILE_FINDINGS} union all {CALL_FINDINGS}
 union all select 'orphaned_code', 'info', 'Potentially unused: ' || name, function_id, 0.3::double from {{b_functions}} where not is_exported and function_id not in (select target_id from {{b_calls}})
 union all select 'unused_export', 'info', 'Unused export: ' || f.name, f.parent_file_id, 0.4::double from {{b_functions}} f
  where not exists (select 1 from x where x.source = regexp_replace(f.file_path, '\\.ts$', '') and x.name in ('*', f.name))
 union all select 'large_file', case when end_line > 1000 then 'warning' else 'info' end, 'Large file: ' || name, file_id, 0.95::double from {{b_files}} where end_line > 500""")
def _(t: Tables):
    t.write("b_import_edges", "b_calls", "b_functions", "b_imports")
    conn = connections(t, "import").unionByName(calls(t))
    files = t.b_files.withColumn("top_level_references", F.array().cast("array<string>"))
    functions = t.b_functions.withColumn("parent_class_id", F.lit(None).cast("string"))
    uses = D.other_uses(component_files(t), t.b_aliases)
    return _shown(D.detect_warnings(files, functions, exports(t), *imports(t), t.b_aliases, conn, other_uses=uses))


@_r.add("count_findings_by_source", "select source, category, count(*) as findings from {b_findings} group by 1, 2")
def _(t: Tables):
    return findings(t).groupBy("source", "category").agg(F.count("*").alias("findings"))


# many small scans: some without cycles, some with several components, files that no entry leads to

SCAN_CYCLES = cycles_sql("g", "{b_scan_edges}")


def scan_edges(t: Tables):
    return t.b_scan_edges.select("scan_id", "src", "dst", F.col("flag").alias("is_type_only"))


@_r.add("cycles_of_scans", f"with recursive {SCAN_CYCLES} select component, array_to_string(cycle, ' > ') as cycle from g_cycles")
def _(t: Tables):
    return G.cycles(scan_edges(t)).select("component", F.array_join("cycle", " > ").alias("cycle"))


@_r.add("edge_cycles", f"with recursive {SCAN_CYCLES} select distinct src, dst from g_i")
def _(t: Tables):
    """The edges of the cycles found: each edge inside a cyclic component lies in one, and no other does."""
    return G.hops_of(G.cycles(scan_edges(t), every_edge=True)).select("src", "dst")


@_r.add("function_cycles_of_scans", f"with recursive {SCAN_CYCLES} {titled_sql('g', 'call', '{b_scan_files}', 'file_id', '0.6')}")
def _(t: Tables):
    t.write("b_scan_edges")
    c = scan_edges(t).select("scan_id", F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.lit("function_call").alias("type"))
    return _shown(D.function_cycles(c, t.b_scan_files.select("scan_id", F.col("file_id").alias("function_id"), "name")))


@_r.add("import_cycles_of_scans", f"with recursive {SCAN_CYCLES} {TYPED_FINDINGS.replace('f_cycles', 'g_cycles').replace('{b_import_edges} e', '(select src, dst, flag as is_type_only from {b_scan_edges}) e')}")
def _(t: Tables):
    return _shown(D.import_cycles_typed(scan_edges(t.write("b_scan_edges"))))


@_r.add("unused_files_of_scans", """with recursive r(node) as (select file_id from {b_scan_files} where file_path = 'src/index.ts' union select e.dst from r join {b_scan_edges} e on e.src = r.node)
 select file_id as nodes, 'Unused file: ' || file_path as title from {b_scan_files} where file_id not in (select node from r)""")
def _(t: Tables):
    t.write("b_scan_edges")
    return D.unused_files(t.b_scan_files, scan_edges(t)).select(F.array_join("affected_nodes", ",").alias("nodes"), "title")


# extraction from programs of the documents' words

_LINES = """(select *, concat('file:', file_path) as path_id, 4 + n1 as la, 10 + n1 + 2 * n2 as ea, 11 + n1 + 2 * n2 as lb, 13 + n1 + 2 * n2 as eb, 14 + n1 + 2 * n2 as ld, 16 + n1 + 2 * n2 + 5 * n3 as ed from {b_program})"""
#: A class's methods by number.
_METHODS = f"""(select *, ld + 2 + 5 * i as lt from {_LINES}, (values (0), (1), (2), (3)) as numbers(i) where i < n3)"""


def code(t: Tables):
    # programs cost far more than their bytes say: they are dealt evenly to all cores, whatever the files' row groups
    tasks = max(t.spark.sparkContext.defaultParallelism, int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return t.b_program.select("scan_id", "file_path", "k", "content").repartition(tasks, "file_path")


def _k(df):
    return df.withColumn("k", F.regexp_extract("file_path", r"(\d+)\.ts$", 1).cast("long"))


def _refs():
    return F.array_join(F.array_sort("references"), ",").alias("refs")


def _names(c):
    return F.array_join(F.transform(c, lambda p: p["name"]), ",")


@_r.add("extract_functions", f"""select k, a as name, la as line, ea as end_line, true as is_exported, is_async, least(h, o) || ',' || greatest(h, o) as refs, p || ',' || q as params from {_LINES}
 union all select k, b, lb, eb, true, false, u, r from {_LINES} union all select k, b || '2', eb, eb, false, false, '', r from {_LINES}""")
def _(t: Tables):
    f = X.extract_functions(code(t))
    return _k(f).select("k", "name", "line", "end_line", "is_exported", "is_async", _refs(), _names("params").alias("params"))


@_r.add("extract_methods", f"""select k, path_id || ':class:' || d || ':' || cast(ld as varchar) as class_id, t as name, lt as line, lt + 4 as end_line, 'Promise<' || e || '>' as return_type, 'string' as first_type, true as is_static, true as is_async,
 'public' as visibility, least(a, h) || ',' || greatest(a, h) as refs, md5('static async ' || t || '(' || chr(10) || '    ' || p || ': string,' || chr(10) || '  ): Promise<' || e || '> ' || chr(123) || chr(10) || '    return ' || a || '(' || p || ', ' || chr(123) || ' ' || o || ': ' || h || ' ' || chr(125) || ');' || chr(10) || '  ' || chr(125)) as source_md5,
 i + 1 as fn_ord from {_METHODS}""")
def _(t: Tables):
    m = _k(X.extract_methods(code(t)))
    return m.select("k", F.col("parent_class_id").alias("class_id"), "name", "line", "end_line", "return_type", F.get("params", F.lit(0))["type"].alias("first_type"), "is_static", "is_async", "visibility", _refs(), F.md5("source").alias("source_md5"), "fn_ord")


@_r.add("calls_of_programs", f"""select path_id || ':class:' || d || ':' || cast(ld as varchar) || ':method:' || t || ':' || cast(lt as varchar) as source_id, path_id || ':fn:' || a || ':' || cast(la as varchar) as target_id, 1::bigint as weight from {_METHODS}""")
def _(t: Tables):
    files = code(t)
    functions = materialise(X.all_functions(files), "functions")  # joined three times
    scope = t.spark.createDataFrame([], "scan_id string, file_id string, local_name string, target_file_id string, original_name string, is_default boolean")
    return J.call_connections(functions, X.extract_exports(files), scope).select("source_id", "target_id", F.col("weight").cast("long").alias("weight"))


@_r.add("missing_types", "select k, a as name from {b_program} where not typed union all select k, b || '2' from {b_program}")
def _(t: Tables):
    return _k(H.missing_types(X.extract_functions(code(t)))).select("k", "name")


@_r.add("extract_references", f"""select k, a as name, least(h, o) || ',' || greatest(h, o) as refs from {_LINES} union all select k, b, u from {_LINES} union all select k, b || '2', '' from {_LINES}
 union all select k, t, least(a, h) || ',' || greatest(a, h) from {_METHODS}""")
def _(t: Tables):
    return _k(X.all_functions(code(t))).select("k", "name", _refs())


@_r.add("extract_classes", f"""select k, d as name, ld as line, ed as end_line, true as is_exported, case when derived then w end as extends, e || ',' || f as implements, n3 as n_methods, s as properties, 'private' as visibility from {_LINES}""")
def _(t: Tables):
    c, _m = X.extract_classes(code(t))
    return _k(c).select("k", "name", "line", "end_line", "is_exported", "extends", F.array_join("implements", ",").alias("implements"), F.size("methods").alias("n_methods"),
                        _names("properties").alias("properties"), F.array_join(F.transform("properties", lambda p: p["visibility"]), ",").alias("visibility"))


@_r.add("extract_exports", """select k, a as name, 'function' as kind, false as is_default, false as is_type_only from {b_program} where exported union all select k, d, 'class', false, false from {b_program}
 union all select k, v, 'type', false, true from {b_program} union all select k, b, 'reexport', false, false from {b_program} union all select k, a, 'reexport', false, false from {b_program}
 union all select k, '*', 'reexport', false, false from {b_program} where n1 > 1 union all select k, a, 'function', true, false from {b_program}
 union all select k, b, 'variable', false, false from {b_program} union all select k, q, 'class', false, false from {b_program}""")
def _(t: Tables):
    return _k(X.extract_exports(code(t))).select("k", "name", "kind", "is_default", "is_type_only")


@_r.add("extract_top_level_references", "select k, 'register,' || b as names from {b_program}")
def _(t: Tables):
    refs = X.extract_top_level_references(code(t))
    return _k(refs).select("k", F.array_join(F.array_sort("names"), ",").alias("names"))


@_r.add("parse_file", "select file_path, 3 as functions, 1 as classes, len(string_split(content, chr(10)))::int as end_line from {b_program}")
def _(t: Tables):
    return X.parse_file(code(t)).select("file_path", F.size("functions").alias("functions"), F.size("classes").alias("classes"), "end_line")


@_r.add("file_rows", f"""select path_id as file_id, string_split(file_path, '/')[-1] as name, len(string_split(content, chr(10)))::int as end_line, path_id || ':class:' || d || ':' || cast(ld as varchar) as classes,
 path_id || ':fn:' || a || ':' || cast(la as varchar) || ',' || path_id || ':fn:' || b || ':' || cast(lb as varchar) || ',' || path_id || ':fn:' || b || '2:' || cast(eb as varchar) as functions from {_LINES}""")
def _(t: Tables):
    files = code(t)
    rows = X.file_rows(files, X.all_functions(files), X.extract_classes(files)[0])
    return rows.select("file_id", "name", "end_line", F.array_join("classes", ",").alias("classes"), F.array_join("functions", ",").alias("functions"))


_OPEN = """(select k, unnest(string_split(content, chr(10))) as text, generate_subscripts(string_split(content, chr(10)), 1) as line from {b_markup})"""
DEPTH = f"select k, line::int as line, sum(len(text) - len(replace(text, '{{{{', '')) - len(text) + len(replace(text, '}}}}', ''))) over (partition by k order by line)::bigint as depth from {_OPEN}"


@_r.add("brace_depth", DEPTH.replace("'{{'", "chr(123)").replace("'}}'", "chr(125)"))
def _(t: Tables):
    return _k(X.lines_with_depth(t.b_markup)).select("k", "line", "depth")


@_r.add("deep_nesting", "select scan_id, file_id, depth from (select scan_id, file_id, greatest(1 + n2, case when n3 > 0 then 2 else 1 end)::bigint as depth from {b_program}) where depth > 1")
def _(t: Tables):
    bare = X.lexed(code(t)).withColumn("content", F.col("code"))
    lines = X.lines_with_depth(bare).join(t.b_program.select("file_path", "file_id"), "file_path")
    return H.deep_nesting(lines, 1)
