"""Queries that roll up, look up and join the tables of a scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import content_hash, finding_identity
from ..operators import clones as C
from ..operators import enrich as E
from ..operators import extract as X
from ..operators import history as H
from ..operators import resolve as J
from ..operators import rollup as A
from ..shared import materialise
from ..sources import readers as R
from ..streaming import progress as T
from . import views as V
from .registry import Registry, Tables
from .scalar_queries import LANE, behavioral

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

FOLDER = "regexp_replace(file_path, '/[^/]*$', '')"
WF = f"select distinct n.id, n.level, {FOLDER} as folder from {{b_finding_nodes}} n join {{b_files}} f on f.file_id = n.node_id"
NODE_LISTS = "select id, string_agg(node_id, ',' order by node_id) as nodes from {b_finding_nodes} group by id"
IDENT = f"select f.*, concat_ws('|', f.source, f.category, coalesce(n.nodes, '')) as identity from {{b_findings}} f left join ({NODE_LISTS}) n on n.id = f.id"


def findings(t: Tables):
    nodes = t.b_finding_nodes.groupBy("id").agg(F.collect_list("node_id").alias("affected_nodes"))
    none = F.array().cast("array<string>")
    return t.b_findings.join(nodes, "id", "left").withColumn("affected_nodes", F.coalesce("affected_nodes", none))


def dismissed(t: Tables):
    rows = A.with_identity(findings(t)).where(F.col("ok") % 5 == 0)
    return rows.select("project", "identity").distinct()


def classes(t: Tables):
    return t.b_functions.select(
        "scan_id", F.concat("parent_file_id", F.lit(":class:C"), "fn_ord").alias("class_id"), F.concat(F.lit("C"), "fn_ord").alias("name"), "file_path", "parent_file_id",
        F.col("fn_ord").alias("cls_ord"), F.array("function_id").alias("methods"), "is_exported", F.when(F.col("fn_ord") % 20 == 3, F.concat(F.lit("C"), F.col("fn_ord") + 1)).alias("extends"),
        F.array().cast("array<string>").alias("implements"),
    )


CLASSES = """select file_path, parent_file_id, parent_file_id || ':class:C' || fn_ord as class_id, 'C' || fn_ord as name, fn_ord as cls_ord, is_exported,
 case when fn_ord % 20 = 3 then 'C' || (fn_ord + 1) end as extends from {b_functions}"""


# filters

@_r.add("runtime_imports", "select file_path, stmt_ord, source from {b_imports} where not is_type_only")
def _(t: Tables):
    return A.runtime_imports(t.b_imports).select("file_path", "stmt_ord", "source")


@_r.add("pending_functions", "select function_id from {b_functions} where not has_behavioral")
def _(t: Tables):
    return A.pending_functions(behavioral(t)).select("function_id")


@_r.add("limit_functions", "select function_id from {b_functions} where not has_behavioral order by file_path, fn_ord, function_id limit 100")
def _(t: Tables):
    return A.limit_functions(behavioral(t), 100).select("function_id")


@_r.add("files_in_folder", f"select file_id from {{b_files}} where {FOLDER} = 'Brand#1/ECONOMY'")
def _(t: Tables):
    return A.files_in_folder(t.b_files, "Brand#1/ECONOMY").select("file_id")


@_r.add("min_confidence", "select id, confidence from {b_findings} where confidence >= 0.5")
def _(t: Tables):
    return A.min_confidence(t.b_findings, 0.5).select("id", "confidence")


# aggregations

@_r.add("scan_stats", """select 'corpus' as scan_id, f + g as total_nodes, f as n_file, g as n_function, 0::bigint as n_class, 0::bigint as n_cluster, g as pending
 from (select count(*) as f from {b_files}), (select count(*) as g from {b_functions})""")
def _(t: Tables):
    nodes = t.b_files.select("scan_id", F.lit("file").alias("type")).unionByName(t.b_functions.select("scan_id", F.lit("function").alias("type")))
    return A.scan_stats(nodes)


@_r.add("warning_stats", """select 'corpus' as scan_id, count(*) as total, count(*) filter (level = 'error') as n_error, count(*) filter (level = 'warning') as n_warning,
 count(*) filter (level = 'info') as n_info from {b_findings}""")
def _(t: Tables):
    return A.warning_stats(t.b_findings)


ROLLUP = f"""select f.folder, f.files, coalesce(g.functions, 0) as functions, coalesce(w.warnings, 0) as warnings from
 (select {FOLDER} as folder, count(*) as files from {{b_files}} group by 1) f left join (select {FOLDER} as folder, count(*) as functions from {{b_functions}} group by 1) g on g.folder = f.folder
 left join (select folder, count(*) as warnings from ({WF}) group by 1) w on w.folder = f.folder"""


@_r.add("folder_rollup", f"select 'corpus' as scan_id, * from ({ROLLUP})")
def _(t: Tables):
    return A.folder_rollup(t.b_files, t.b_functions, t.b_finding_nodes)


@_r.add("folder_summary", f"""select 'corpus' as scan_id, 'Brand#1/ECONOMY' as folder, (select count(*) from {{b_files}} where {FOLDER} = 'Brand#1/ECONOMY') as files,
 (select count(*) from {{b_functions}} where {FOLDER} = 'Brand#1/ECONOMY') as functions, (select count(*) from ({CLASSES}) where {FOLDER} = 'Brand#1/ECONOMY') as classes,
 count(*) as warnings, count(*) filter (level = 'error') as n_error, count(*) filter (level = 'warning') as n_warning, count(*) filter (level = 'info') as n_info
 from ({WF}) where folder = 'Brand#1/ECONOMY'""")
def _(t: Tables):
    return A.folder_summary(t.b_files, t.b_functions, classes(t), t.b_finding_nodes, "Brand#1/ECONOMY")


@_r.add("merge_import_maps", """select distinct scan_id, source, 'n' || n_items as name from {b_imports} union select scan_id, source, '*' from {b_imports} where is_type_only""")
def _(t: Tables):
    return A.merge_import_maps(
        t.b_imports.select("scan_id", "source", F.concat(F.lit("n"), "n_items").alias("name")), t.b_imports.where("is_type_only").select("scan_id", "source", F.lit("*").alias("name"))
    )


@_r.add("count_below_threshold", "select 'corpus' as scan_id, count(*) filter (confidence < 0.5) as hidden from {b_findings}")
def _(t: Tables):
    return A.count_below_threshold(t.b_findings, 0.5)


@_r.add("analysis_stats", "select 'corpus' as scan_id, count(*) filter (has_behavioral) as analyzed, count(*) filter (not has_behavioral) as pending from {b_functions}")
def _(t: Tables):
    return A.analysis_stats(behavioral(t))


@_r.add("effect_group_counts", f"select 'corpus' as scan_id, {LANE} as lane, count(*) as functions, bool_or(has_behavioral) as has_behavioral from {{b_functions}} group by 2")
def _(t: Tables):
    return V.effect_group_counts(behavioral(t))


@_r.add("functions_by_file", "select parent_file_id as file_id, string_agg(function_id, ',' order by fn_ord, function_id) as ids from {b_functions} group by 1")
def _(t: Tables):
    return A.ids_by_file(t.b_functions, "function_id", "fn_ord").select("file_id", F.array_join("ids", ",").alias("ids"))


@_r.add("classes_by_file", f"select parent_file_id as file_id, string_agg(class_id, ',' order by cls_ord, class_id) as ids from ({CLASSES}) group by 1")
def _(t: Tables):
    return A.ids_by_file(classes(t), "class_id", "cls_ord").select("file_id", F.array_join("ids", ",").alias("ids"))


@_r.add("first_wins", "select file_path, source, min(stmt_ord) as stmt_ord from {b_imports} group by 1, 2")
def _(t: Tables):
    return A.first_wins(t.b_imports, ["file_path", "source"], ["stmt_ord"]).select("file_path", "source", "stmt_ord")


@_r.add("last_wins", "select file_path, source, max(stmt_ord) as stmt_ord from {b_imports} group by 1, 2")
def _(t: Tables):
    return A.first_wins(t.b_imports, ["file_path", "source"], ["stmt_ord"], last=True).select("file_path", "source", "stmt_ord")


@_r.add("sorted_folders_files", f"""with r as (select file_id, {FOLDER} as folder, name from {{b_files}})
 select file_id, folder, dense_rank() over (order by folder) as folder_rank, row_number() over (partition by folder order by name, file_id) as file_rank from r""")
def _(t: Tables):
    return A.sorted_names(t.b_files).select("file_id", "folder", "folder_rank", "file_rank")


# findings

@_r.add("finding_identity", f"select id, identity from ({IDENT})")
def _(t: Tables):
    return findings(t).select("id", finding_identity(F.col("source"), F.col("category"), F.col("affected_nodes")).alias("identity"))


@_r.add("filter_findings", f"""with f as ({IDENT}), d as (select distinct identity from f where ok % 5 = 0)
 select id, identity, confidence, row_number() over (order by case level when 'error' then 3 when 'warning' then 2 when 'info' then 1 else 0 end desc, confidence desc, identity, id) as rank
 from f where confidence >= 0.3 and identity not in (select identity from d)""")
def _(t: Tables):
    return A.filter_findings(findings(t), dismissed(t), 0.3).select("id", "identity", "confidence", "rank")


@_r.add("dismiss", f"with f as ({IDENT}) select distinct 'corpus' as project, identity from f where ok % 5 = 0 or ok % 7 = 0")
def _(t: Tables):
    more = A.with_identity(findings(t)).where("ok % 7 = 0")
    return A.dismiss(dismissed(t), more)


@_r.add("restore", f"with f as ({IDENT}) select distinct 'corpus' as project, identity from f where ok % 5 = 0 and identity not in (select identity from f where ok % 7 = 0)")
def _(t: Tables):
    return A.restore(dismissed(t), A.with_identity(findings(t)).where("ok % 7 = 0"))


@_r.add("save_dismissed", f"""with f as ({IDENT}), d as (select distinct identity from f where ok % 5 = 0)
 select 'corpus' as project, md5('[' || string_agg('"' || identity || '"', ',' order by identity) || ']') as stored_md5 from d""")
def _(t: Tables):
    return R.save_dismissed(dismissed(t)).select("project", F.md5("stored").alias("stored_md5"))


_STORED = "case when event_id % 4 = 0 then concat('[\"', event_type, '\", 7, \"x\", null]') when event_id % 4 = 1 then '{\"a\": 1}' when event_id % 4 = 2 then 'broken [' else concat('[\"', event_type, '\"]') end"


@_r.add("load_dismissed", "select event_id, case event_id % 4 when 0 then event_type || ',x' when 3 then event_type else '' end as identities from {events}")
def _(t: Tables):
    return t.events.select("event_id", F.array_join(R.load_dismissed(F.expr(_STORED)), ",").alias("identities"))


@_r.add("resolve_affected_nodes", "select p.path, coalesce(f.file_id, p.path) as node_id from (select case when k % 3 = 0 then 'gone/' || name else file_path end as path from {b_files}) p left join {b_files} f on f.file_path = p.path")
def _(t: Tables):
    path = F.when(F.col("k") % 3 == 0, F.concat(F.lit("gone/"), "name")).otherwise(F.col("file_path"))
    return A.resolve_affected_nodes(t.b_files.select("scan_id", path.alias("path")), t.b_files).select("path", "node_id")


@_r.add("file_class_cards", f"""with c as ({CLASSES}), o as (select *, row_number() over (partition by parent_file_id order by cls_ord, class_id) - 1 as pos from c)
 select parent_file_id as file_id, pos, class_id, name, extends, 1 as n_methods from o""")
def _(t: Tables):
    c = classes(t)
    lists = A.ids_by_file(c, "class_id", "cls_ord").withColumnRenamed("ids", "classes")
    return A.file_class_cards(lists, c).select("file_id", "pos", "class_id", "name", "extends", "n_methods")


_NODES = "(select file_id as node_id from {b_files})"


@_r.add("connections_for_node", f"""select n.node_id, e.src as source_id, e.dst as target_id from {{b_import_edges}} e join {_NODES} n on n.node_id = e.src
 union all select n.node_id, e.src, e.dst from {{b_import_edges}} e join {_NODES} n on n.node_id = e.dst where e.src <> e.dst""")
def _(t: Tables):
    c = t.b_import_edges.select("scan_id", F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    return A.connections_for_nodes(c, t.b_files.select("scan_id", F.col("file_id").alias("node_id"))).select("node_id", "source_id", "target_id")


@_r.add("warnings_for_node", f"select w.node_id, w.id from {{b_finding_nodes}} w join {_NODES} n on n.node_id = w.node_id")
def _(t: Tables):
    return A.warnings_for_nodes(t.b_finding_nodes, t.b_files.select("scan_id", F.col("file_id").alias("node_id"))).select("node_id", "id")


@_r.add("node_by_id", "select file_id as node_id, file_path from {b_files} where file_id = (select min(file_id) from {b_files})")
def _(t: Tables):
    nodes = t.b_files.select("scan_id", F.col("file_id").alias("node_id"), "file_path")
    return A.node_by_id(nodes, nodes.agg(F.min("node_id")).first()[0]).select("node_id", "file_path")


@_r.add("folder_warning_nodes", f"select distinct n.node_id from {{b_finding_nodes}} n join {{b_files}} f on f.file_id = n.node_id where {FOLDER} = 'Brand#1/ECONOMY'")
def _(t: Tables):
    return A.folder_warning_nodes(t.b_finding_nodes, t.b_files, "Brand#1/ECONOMY").select("node_id")


@_r.add("explode_nodes", "select function_id as node_id, 'function' as type, name, is_exported from {b_functions}")
def _(t: Tables):
    node = F.struct(F.col("function_id").alias("id"), F.lit("function").alias("type"), "name", F.col("file_path").alias("filePath"), F.col("is_exported").alias("isExported"))
    doc = t.b_functions.groupBy("parent_file_id").agg(F.map_from_entries(F.collect_list(F.struct("function_id", node))).alias("nodes"))
    empty = F.array().cast("array<string>")
    text = F.to_json(F.struct(
        F.col("parent_file_id").alias("id"), F.lit("p").alias("projectPath"), F.lit("p").alias("projectName"), F.lit("completed").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("createdAt"),
        F.struct(F.lit(1).alias("n")).alias("stats"), "nodes", empty.alias("connections"), empty.alias("warnings"), empty.alias("clusters"), empty.alias("errors")))
    return R.explode_nodes(R.parse_scans(doc.select(text.alias("document")))).select("node_id", "type", "name", F.col("isExported").alias("is_exported"))


_DOC = """case event_id % 5 when 0 then 'not json' when 1 then '{"id": 1, "projectPath": "p"}'
 when 2 then '{"id":"a","projectPath":"p","projectName":"p","status":"s","createdAt":"t","stats":3,"nodes":{},"connections":[],"warnings":[],"clusters":[],"errors":[]}'
 when 3 then '{"id":"a","projectPath":"p","projectName":"p","status":"s","createdAt":"t","stats":{},"nodes":{},"connections":[],"warnings":{},"clusters":[],"errors":[]}'
 else '{"id":"a","projectPath":"p","projectName":"p","status":"s","createdAt":"t","stats":{},"nodes":{},"connections":[],"warnings":[],"clusters":[],"errors":[]}' end"""


@_r.add("validate_scan", """select event_id, case event_id % 5 when 0 then 'not an object' when 1 then 'missing field "projectName"' when 2 then 'stats must be an object'
 when 3 then 'warnings must be an array' end as error from {events}""")
def _(t: Tables):
    return t.events.select("event_id", R.validate_scan(F.expr(_DOC)).alias("error"))


# joins of the graph

_KEYS = """with k as (select file_id, k as ord, unnest([file_path, regexp_replace(file_path, '\\.ts$', '')]) as key from {b_files}) select key, arg_max(file_id, ord) as file_id from k group by key"""


def file_index(t: Tables):
    return J.file_path_index(t.b_files.withColumn("file_ord", F.col("k")))


@_r.add("file_path_index", _KEYS)
def _(t: Tables):
    return file_index(t).select("key", "file_id")


_BASE = """regexp_replace(case when source like '@/%' then 'Brand#11/' || substr(source, 3) when source like './%' then regexp_replace(file_path, '/[^/]*$', '') || substr(source, 2)
 when source like '../../%' then replace(substr(source, 7), '/./', '/') else source end, '\\.(ts|tsx|js|jsx)$', '')"""
RESOLVED = f"""select i.*, f.file_id as target_file_id from (select *, {_BASE} as base from {{b_imports}} where source not like 'lib%' or source like 'lib1%') i
 join {{b_files}} f on f.file_path = case when i.source like 'lib1%' then 'vendor/one' || substr(i.source, 5) else i.base end || '.ts'"""


@_r.add("resolve_imports", f"select file_path, stmt_ord, source, target_file_id from ({RESOLVED})")
def _(t: Tables):
    rows = _numbered(t)
    return J.resolve_imports(rows, t.b_aliases, file_index(t)).select("file_path", F.col("ord0").alias("stmt_ord"), "source", "target_file_id")


def _numbered(t: Tables):
    """b_imports with a statement number that is unique in its file."""
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("file_id").orderBy("stmt_ord", "source"))
    return t.b_imports.withColumn("ord0", F.col("stmt_ord")).withColumn("stmt_ord", n)


IMPORTED = f"""with r as ({RESOLVED}), n as (select file_id, target_file_id, n_items, row_number() over (partition by file_id order by stmt_ord, source) as o from r where not is_type_only)
 select file_id as source_id, target_file_id as target_id, cast(greatest(arg_min(n_items, o), 1) as bigint) as weight from n where file_id <> target_file_id group by 1, 2"""


@_r.add("import_connections", IMPORTED)
def _(t: Tables):
    return J.import_connections(_numbered(t), t.b_aliases, file_index(t)).select("source_id", "target_id", "weight")


def items(t: Tables, numbered=None):
    """Two items a statement: a plain and a renamed one."""
    rows = (numbered or _numbered(t)).select("scan_id", "file_id", "stmt_ord", F.col("source"))
    n = F.regexp_extract("source", r"(\d+)(\.\w+)?$", 1).cast("long") % 100
    plain = F.struct(F.lit(0).alias("item_ord"), F.concat(F.lit("s"), n).alias("name"), F.lit(None).cast("string").alias("alias"))
    named = F.struct(F.lit(1).alias("item_ord"), F.concat(F.lit("s"), n + 1).alias("name"), F.concat(F.lit("r"), n).alias("alias"))
    out = rows.select("scan_id", "file_id", "stmt_ord", F.explode(F.array(plain, named)).alias("i")).select("scan_id", "file_id", "stmt_ord", "i.*")
    return out.withColumn("is_default", F.lit(False)).withColumn("is_namespace", F.lit(False))


_N = "cast(regexp_extract(source, '(\\d+)(\\.\\w+)?$', 1) as bigint) % 100"
SCOPE = f"""with r0 as ({RESOLVED}), r as (select *, row_number() over (partition by file_id order by stmt_ord, source) as o from (select * from {{b_imports}})),
 q as (select r.file_id, r.o, r.source, x.target_file_id from r join r0 x on x.file_id = r.file_id and x.stmt_ord = r.stmt_ord and x.source = r.source where not r.is_type_only),
 i as (select file_id, o, 0 as item, 's' || ({_N}) as local_name, 's' || ({_N}) as original_name, target_file_id from q union all select file_id, o, 1, 'r' || ({_N}), 's' || ({_N} + 1), target_file_id from q)
 select file_id, local_name, arg_max(target_file_id, o * 2 + item) as target_file_id, arg_max(original_name, o * 2 + item) as original_name from i group by 1, 2"""


def scope(t: Tables):
    """Statements and scope, written once."""
    numbered = materialise(_numbered(t), "imports")
    return materialise(J.import_scope(numbered, items(t, numbered), t.b_aliases, file_index(t)), "scope")


@_r.add("import_scope", SCOPE)
def _(t: Tables):
    return scope(t).select("file_id", "local_name", "target_file_id", "original_name")


def exports(t: Tables):
    return t.b_functions.where("fn_ord % 9 = 4").select("scan_id", F.col("parent_file_id").alias("file_id"), "file_path", "name", F.lit(True).alias("is_default"))


@_r.add("exported_functions", "select parent_file_id as file_id, name, max(function_id) as function_id from {b_functions} where is_exported or fn_ord % 9 = 4 group by 1, 2")
def _(t: Tables):
    return J.exported_functions(t.b_functions, exports(t)).select("file_id", "name", "function_id")


@_r.add("exported_classes", f"select parent_file_id as file_id, name, max(class_id) as class_id from ({CLASSES}) where is_exported group by 1, 2")
def _(t: Tables):
    return J.exported_classes(classes(t)).select("file_id", "name", "class_id")


@_r.add("local_functions", "select parent_file_id as file_id, name, min(function_id) as function_id from {b_functions} group by 1, 2")
def _(t: Tables):
    return J.local_functions(t.b_functions).select("file_id", "name", "function_id")


def callers(t: Tables):
    """b_functions that refer to the next two names and to a name that imports may bring."""
    n = F.col("fn_ord")
    names = [F.concat(F.lit("s"), x) for x in (n, n + 1, n % 100)] + [F.concat(F.lit("r"), n % 100)]
    return t.b_functions.withColumn("references", F.array_distinct(F.array(*names)))


CALLS = f"""with sc as ({SCOPE}), x as (select parent_file_id as file_id, name, max(function_id) as function_id from {{b_functions}} where is_exported or fn_ord % 9 = 4 group by 1, 2),
 refs as (select distinct function_id as source_id, parent_file_id as file_id, unnest(['s' || fn_ord, 's' || (fn_ord + 1), 's' || (fn_ord % 100), 'r' || (fn_ord % 100)]) as name from {{b_functions}}),
 j as (select r.source_id, case when l.function_id is not null then case when l.function_id <> r.source_id then l.function_id end else x.function_id end as target_id
  from refs r left join (select parent_file_id as file_id, name, min(function_id) as function_id from {{b_functions}} group by 1, 2) l on l.file_id = r.file_id and l.name = r.name
  left join sc on sc.file_id = r.file_id and sc.local_name = r.name left join x on x.file_id = sc.target_file_id and x.name = sc.local_name)
 select source_id, target_id, count(*) as weight from j where target_id is not null and target_id <> source_id group by 1, 2"""


@_r.add("call_connections", CALLS)
def _(t: Tables):
    names = scope(t)
    t.write("b_functions")
    return J.call_connections(callers(t), exports(t), names).select("source_id", "target_id", "weight")


INHERITS = f"""with c as ({CLASSES}) select a.class_id as source_id, b.class_id as target_id, 1::bigint as weight from c a join c b on b.parent_file_id = a.parent_file_id and b.name = a.extends"""


@_r.add("inheritance_connections", INHERITS)
def _(t: Tables):
    names = scope(t)
    t.write("b_functions")
    return J.inheritance_connections(classes(t), names).select("source_id", "target_id", "weight")


@_r.add("build_connections", f"""select 'function_call' as type, count(*) as edges, sum(weight)::bigint as weight from ({CALLS})
 union all select 'inheritance', count(*), sum(weight)::bigint from ({INHERITS})
 union all select 'import', count(*), sum(weight)::bigint from ({IMPORTED})""")
def _(t: Tables):
    numbered = materialise(_numbered(t), "imports")
    t.write("b_functions")
    full = J.build_connections(t.b_files.withColumn("file_ord", F.col("k")), numbered, items(t, numbered), exports(t), callers(t), classes(t), t.b_aliases)
    return full.groupBy("type").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


# sources over a listing

def listing(t: Tables):
    """Documents as files of repositories: source is the repository, n_chars the size."""
    d = F.col("doc_id")
    file = F.when(d % 9 == 0, "package.json").when(d % 13 == 0, "src/main.ts").when(d % 11 == 0, "tsconfig.json").otherwise(F.concat(F.lit("f"), d, F.lit(".ts")))
    folder = F.when(d % 4 == 0, "").when(d % 4 == 1, "packages/a/").when(d % 4 == 2, "packages/node_modules/x/").otherwise("one/two/three/four/five/")
    return t.documents.select(F.col("source").alias("scan_id"), F.concat(folder, file).alias("file_path"), F.col("n_chars").alias("size_bytes"))


LIST = """select source as scan_id, n_chars as size_bytes, case doc_id % 4 when 0 then '' when 1 then 'packages/a/' when 2 then 'packages/node_modules/x/' else 'one/two/three/four/five/' end ||
 case when doc_id % 9 = 0 then 'package.json' when doc_id % 13 = 0 then 'src/main.ts' when doc_id % 11 = 0 then 'tsconfig.json' else 'f' || doc_id || '.ts' end as file_path from {documents}"""


@_r.add("measure_repos", f"""select scan_id, count(*) as files, sum(size_bytes)::bigint as bytes, case when count(*) > 50 then 'too_many_files' when sum(size_bytes) > 100000 then 'too_large' else 'ok' end as verdict
 from ({LIST}) group by 1""")
def _(t: Tables):
    return R.measure_repos(listing(t), 50, 100_000)


@_r.add("discover_workspaces", f"""with l as ({LIST}) select distinct scan_id, case when file_path = 'package.json' then '.' else 'packages/a' end as workspace from l
 where file_path in ('package.json', 'packages/a/package.json')""")
def _(t: Tables):
    return R.discover_workspaces(listing(t))


@_r.add("derive_source_roots", f"""with l as ({LIST}), w as (select distinct scan_id, file_path from l where file_path in ('package.json', 'packages/a/package.json')),
 s as (select distinct scan_id, regexp_replace(file_path, '/main.ts$', '') as root from l where file_path like '%src/main.ts'),
 f as (select s.scan_id, s.root from s join w on w.scan_id = s.scan_id and s.root = regexp_replace(w.file_path, 'package.json$', 'src'))
 select * from f union all select distinct scan_id, '.' from l where scan_id not in (select scan_id from f)""")
def _(t: Tables):
    return R.derive_source_roots(listing(t), R.discover_workspaces(listing(t)))


@_r.add("root_tsconfig", f"select scan_id, max(case when file_path = 'tsconfig.json' then file_path end) as tsconfig from ({LIST}) group by 1")
def _(t: Tables):
    return R.root_tsconfig(listing(t))


@_r.add("read_source_files", f"""with l as ({LIST}) select distinct scan_id, file_path from l where regexp_matches(file_path, '\\.(ts|tsx|js|jsx)$') and not contains(file_path, 'node_modules/')""")
def _(t: Tables):
    return R.read_source_files(listing(t)).select("scan_id", "file_path")


@_r.add("scan_errors", f"""with l as ({LIST}), s as (select distinct scan_id, file_path from l where regexp_matches(file_path, '\\.ts$') and not contains(file_path, 'node_modules/'))
 select scan_id, file_path, 'not parsed' as message, true as recoverable from s where contains(file_path, '7')""")
def _(t: Tables):
    source = R.read_source_files(listing(t))
    return R.scan_errors(source, source.where(~F.col("file_path").contains("7")))


_PATHS = 'concat(\'{ // paths\n "compilerOptions": { "paths": { "@/*": ["./src/*", "gen/*"], "~\', cast(k % 30 as string), \'": ["x\', cast(k as string), \'"] } } }\')'


@_r.add("read_path_aliases", """with c as (select scan_id, k, case k % 3 when 0 then '' when 1 then 'pkg' || k || '/' else 'zz/pkg' || k || '/' end as dir from (select source as scan_id, doc_id as k from {documents})),
 r as (select scan_id, k, dir, dir || case when k % 3 = 0 then 'tsconfig.' || k || '.json' else 'tsconfig.json' end as f from c),
 e as (select scan_id, f, k, 0 as pos, '@/*' as alias, 0 as o, dir || 'src/*' as target from r union all select scan_id, f, k, 0, '@/*', 1, dir || 'gen/*' from r union all select scan_id, f, k, 1, '~' || (k % 30), 0, dir || 'x' || k from r),
 m as (select scan_id, alias, min((f, pos)) as first from e group by 1, 2)
 select e.scan_id, e.alias, row_number() over (partition by e.scan_id order by m.first, e.f desc, e.o) - 1 as alias_ord, e.target from e join m on m.scan_id = e.scan_id and m.alias = e.alias""")
def _(t: Tables):
    k = F.col("k")
    name = F.when(k % 3 == 0, F.concat(F.lit("tsconfig."), k, F.lit(".json"))).when(k % 3 == 1, F.concat(F.lit("pkg"), k, F.lit("/tsconfig.json"))).otherwise(F.concat(F.lit("zz/pkg"), k, F.lit("/tsconfig.json")))
    rows = t.documents.select(F.col("source").alias("scan_id"), F.col("doc_id").alias("k"))
    return R.read_path_aliases(rows.select("scan_id", name.alias("file_path"), F.expr(_PATHS).alias("content"))).withColumn("alias_ord", F.col("alias_ord").cast("long"))


# enrichment

def functions_with_code(t: Tables):
    none = F.lit(None).cast("struct<summary:string,source:string,analyzed_at:timestamp,flags:struct<" + ",".join(f"{f}:boolean" for f in E.FLAGS) + ">>")
    return t.b_code.select("scan_id", F.concat("file_id", F.lit(":fn:"), "name", F.lit(":1")).alias("function_id"), "name", "file_path", F.col("k").alias("fn_ord"), F.col("content").alias("source"), none.alias("behavioral"))


def cache(t: Tables):
    """Analyses of two thirds of the functions, a quarter of these of older code."""
    k = F.regexp_extract("name", r"\d+", 0).cast("long")
    flags = F.struct(*(F.lit(False).alias(f) for f in E.FLAGS))
    code = F.when(k % 4 == 0, F.concat("source", F.lit("old"))).otherwise(F.col("source"))
    return functions_with_code(t).where(k % 3 < 2).select(
        F.lit("corpus").alias("scan_project"), "function_id", content_hash(code).alias("content_hash"), F.lit("words").alias("provider"), F.lit("v1").alias("model"), F.lit("kept").alias("summary"),
        flags.alias("flags"), F.timestamp_seconds(k * 60).alias("analyzed_at"), F.lit(2).alias("version"))


_FID = "file_id || ':fn:' || name || ':1'"


@_r.add("cache_lookup", f"select {_FID} as function_id, k % 3 < 2 and k % 4 <> 0 as hit from {{b_code}}")
def _(t: Tables):
    hits, misses = E.cache_lookup(E.with_hash(functions_with_code(t)), cache(t), E.Provider())
    return hits.select("function_id", F.lit(True).alias("hit")).unionByName(misses.select("function_id", F.lit(False).alias("hit")))


@_r.add("analyze_behavior", f"""select {_FID} as function_id, k % 3 < 2 and k % 4 <> 0 as cached, case when k % 3 < 2 and k % 4 <> 0 then 'kept' else 'Function ' || name end as summary,
 not (k % 3 < 2 and k % 4 <> 0) and regexp_matches(content, '(?i)\\b(select|find|findOne|query|getBy)\\b') as database_read from {{b_code}} where content <> ''""")
def _(t: Tables):
    return E.analyze_behavior(functions_with_code(t), cache(t)).select("function_id", "cached", "summary", F.col("flags.databaseRead").alias("database_read"))


@_r.add("upsert_cache", f"""select {_FID} as function_id, case when k % 2 = 1 then 'new' else 'kept' end as summary from {{b_code}} where k % 3 < 2 or k % 2 = 1""")
def _(t: Tables):
    rows = functions_with_code(t).where(F.col("fn_ord") % 2 == 1)
    flags = F.struct(*(F.lit(True).alias(f) for f in E.FLAGS))
    new = rows.select(F.lit("corpus").alias("scan_project"), "function_id", content_hash(F.col("source")).alias("content_hash"), F.lit("words").alias("provider"), F.lit("v2").alias("model"),
                      F.lit("new").alias("summary"), flags.alias("flags"), F.timestamp_seconds(F.lit(9)).alias("analyzed_at"), F.lit(2).alias("version"))
    return E.upsert_cache(cache(t), new).select("function_id", "summary")


@_r.add("prune_cache", f"select {_FID} as function_id from {{b_code}} where k % 3 < 2 and k % 5 <> 0")
def _(t: Tables):
    return E.prune_cache(cache(t), functions_with_code(t).where(F.col("fn_ord") % 5 != 0))[0].select("function_id")


@_r.add("cache_stats", "select 'corpus' as scan_project, count(*) as entries, make_timestamp(min(k) * 60000000) as oldest, make_timestamp(max(k) * 60000000) as newest from {b_code} where k % 3 < 2")
def _(t: Tables):
    return A.cache_stats(R.load_cache(cache(t)))


# progress

@_r.add("latest_progress", "select job_id, arg_max(status, (ts, event_id)) as status, arg_max(value, (ts, event_id)) as value, max(ts) as ts from {b_job_events} group by 1")
def _(t: Tables):
    return T.latest_progress(t.b_job_events)


@_r.add("progress_rollup", """with l as (select job_id, arg_max(status, (ts, event_id)) as status, arg_max(value, (ts, event_id)) as value from {b_job_events} group by 1)
 select status, count(*) as jobs, round(avg(value), 6) as mean_value from l group by 1""")
def _(t: Tables):
    return T.progress_rollup(T.latest_progress(t.b_job_events)).withColumn("mean_value", F.round("mean_value", 6))


@_r.add("job_windows", "select time_bucket(interval '60 minutes', ts) as start, status, count(*) as events from {b_job_events} group by 1, 2")
def _(t: Tables):
    return T.job_windows(t.b_job_events)


def jobs(t: Tables):
    return T.latest_progress(t.b_job_events).withColumnRenamed("ts", "created_at")


@_r.add("expire_jobs", """with l as (select job_id, arg_max(status, (ts, event_id)) as status, max(ts) as created_at from {b_job_events} group by 1), n as (select max(created_at) as now from l),
 d as (select l.*, created_at <= now - interval '30 minutes' as dead from l, n), o as (select greatest(count(*) filter (not dead) - 20, 0) as over from d),
 c as (select job_id, row_number() over (order by created_at, job_id) as n from d where not dead and status <> 'running')
 select d.job_id, case when dead then 'expired' when c.n <= (select over from o) then 'capped' end as evicted from d left join c on c.job_id = d.job_id""")
def _(t: Tables):
    j = jobs(t)
    return T.expire_jobs(j, str(j.agg(F.max("created_at")).first()[0]), 20)


# history

def halves(t: Tables):
    node = t.b_code.select(F.col("file_id").alias("node_id"), content_hash(F.col("content")).alias("hash"), "k")
    return node.where("k % 5 <> 0"), node.where("k % 7 <> 0").withColumn("hash", F.when(F.col("k") % 11 == 0, F.lit("changed")).otherwise(F.col("hash")))


@_r.add("scan_diff", """select file_id as node_id, case when k % 5 = 0 then 'added' when k % 7 = 0 then 'removed' else 'modified' end as change from {b_code}
 where (k % 5 = 0 and k % 7 <> 0) or (k % 5 <> 0 and k % 7 = 0) or (k % 5 <> 0 and k % 7 <> 0 and k % 11 = 0)""")
def _(t: Tables):
    return H.scan_diff(*halves(t))


@_r.add("folder_clusters", f"""with f as (select file_id, {FOLDER} as folder from {{b_files}}), e as (select a.folder as a, b.folder as b from {{b_import_edges}} e join f a on a.file_id = e.src join f b on b.file_id = e.dst),
 x as (select a as folder, a = b as inside from e union all select b, false from e where a <> b)
 select 'corpus' as scan_id, f.folder, count(x.folder) filter (x.inside) as internal, count(x.folder) filter (not x.inside) as external from (select distinct folder from f) f left join x on x.folder = f.folder group by 2""")
def _(t: Tables):
    return H.folder_clusters(t.b_files, t.b_import_edges)


@_r.add("recent_scans", """select project_path, scan_id, recency from (select o_custkey as project_path, 's' || o_orderkey as scan_id,
 row_number() over (partition by o_custkey order by o_orderdate desc, 's' || o_orderkey) as recency from {orders}) where recency <= 5""")
def _(t: Tables):
    scans = t.orders.select(F.col("o_custkey").alias("project_path"), F.concat(F.lit("s"), "o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("created_at"))
    return H.recent_scans(scans).select("project_path", "scan_id", "recency")


@_r.add("duplicate_code", f"select left(sha256(content), 16) as content_hash, count(*) as copies, min({_FID}) as first_id from {{b_code}} group by 1 having count(*) > 1")
def _(t: Tables):
    return H.duplicate_code(functions_with_code(t))


_RESERVED = ", ".join(f"'{w}'" for w in C.RESERVED)
_MASK = f"case when regexp_matches(x, '^[\\p{{{{L}}}}_$]') and x not in ({_RESERVED}) then {{}} when regexp_matches(x, '^\\p{{{{N}}}}') then '0' else x end"
_TOKENS = "regexp_extract_all({}, '" + C.TOKEN.replace("{", "{{").replace("}", "}}") + "')"


@_r.add("renamed_copies", f"""with f as (select {_FID} as function_id, content as code from {{b_code}} union all select {_FID} || ':r', replace(content, 'e', 'ee') from {{b_code}} where k % 3 = 0),
 x as (select function_id, code, {_TOKENS.format("code")} as t from f), s as (select function_id, sha256(code) as text, sha256(array_to_string(list_transform(t, lambda x: {_MASK.format("'#' || list_position(t, x)")}), ' ')) as shape_hash from x where len(t) >= 10)
 select shape_hash, count(*) as copies, count(distinct text) as texts, min(function_id) as first_id from s group by 1 having count(*) > 1""")
def _(t: Tables):
    """Every third text comes a second time with other names."""
    own = t.b_code.select(F.concat("file_id", F.lit(":fn:"), "name", F.lit(":1")).alias("function_id"), F.col("content").alias("code"), "k")
    again = own.where("k % 3 = 0").select(F.concat("function_id", F.lit(":r")).alias("function_id"), F.replace("code", F.lit("e"), F.lit("ee")).alias("code"))
    return C.renamed_copies(own.drop("k").unionByName(again))


@_r.add("copied_stretches", f"""with x as (select file_id as function_id, list_transform({_TOKENS.format("content")}, lambda x: {_MASK.format("'i'")}) as t from {{b_markup}}),
 p as (select function_id, t, unnest(range(0, len(t) - 49)) as s from x where len(t) >= 50), w as (select function_id, s, array_to_string(t[s + 1:s + 50], ' ') as d from p),
 h as (select function_id, s from w where d in (select d from w group by d having count(*) > 1)), c as (select function_id, least(50, coalesce(lead(s) over (partition by function_id order by s) - s, 50)) as n from h)
 select x.function_id, len(x.t)::bigint as n_tokens, coalesce((select sum(n) from c where c.function_id = x.function_id), 0)::bigint as n_copied from x where len(x.t) >= 50""")
def _(t: Tables):
    return C.copied_stretches(t.b_markup.select(F.col("file_id").alias("function_id"), F.col("content").alias("code")))


@_r.add("filter_chips", "select function_id from {b_functions} where has_behavioral and (database_read or http_call)")
def _(t: Tables):
    return H.filter_chips(behavioral(t), "databaseRead", "httpCall").select("function_id")


@_r.add("summary_overrides", """select function_id, case when fn_ord % 5 = 0 then 'by hand' when fn_ord % 3 = 0 then 'doc' when has_behavioral then 'about ' || name end as summary,
 case when fn_ord % 5 = 0 then 'manual' when fn_ord % 3 = 0 then 'docstring' when has_behavioral then 'ai' end as summary_source from {b_functions}""")
def _(t: Tables):
    said = lambda n, s: t.b_functions.where(F.col("fn_ord") % n == 0).select("scan_id", "function_id", F.lit(s).alias("summary"))
    return H.summary_overrides(behavioral(t), said(5, "by hand"), said(3, "doc")).select("function_id", "summary", "summary_source")
