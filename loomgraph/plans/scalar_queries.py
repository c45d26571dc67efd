"""Queries that apply scalar functions and row-wise extraction to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scalars as S
from ..operators import extract as X
from ..sources import readers as R
from .registry import Registry, Tables

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql


def _fold(sql: str) -> str:
    """DuckDB: fold ./ and ../ of a path with few of them."""
    out = f"regexp_replace({sql}, '/(\\./)+', '/', 'g')"
    out = f"regexp_replace({out}, '^(\\./)+', '')"
    for _ in range(4):
        out = f"regexp_replace({out}, '(^|/)[^/.][^/]*/\\.\\./', '\\1')"
    return f"regexp_replace({out}, '^(\\.\\./)+', '')"


@_r.add("resolve_path_alias", """
select file_path, stmt_ord, source, case when source like '@/%' then 'Brand#11/' || substr(source, 3)
       when source like 'lib1%' then 'vendor/one' || substr(source, 5) else source end as resolved from {b_imports}""")
def _(t: Tables):
    return P.resolve_path_alias(t.b_imports, t.b_aliases).select("file_path", "stmt_ord", "source", "resolved")


@_r.add("normalize_import_source", f"""
select file_path, stmt_ord, source, regexp_replace(case when source like '.%' then {_fold("regexp_replace(file_path, '/[^/]*$', '') || '/' || source")} else source end,
       '\\.(ts|tsx|js|jsx)$', '') as normalized from {{b_imports}}""")
def _(t: Tables):
    return t.b_imports.select("file_path", "stmt_ord", "source", P.normalize_import_source(F.col("source"), F.col("file_path")).alias("normalized"))


@_r.add("normalize_file_path", "select file_path, regexp_replace(file_path, '\\.(ts|tsx|js|jsx)$', '') as bare from {b_files}")
def _(t: Tables):
    return t.b_files.select("file_path", P.normalize_file_path(F.col("file_path")).alias("bare"))


@_r.add("normalized_paths", """
with p as (select case when k % 3 = 0 then regexp_replace(file_path, '[^/]+$', 'index.tsx') else file_path end as file_path from {b_files}),
q as (select file_path, regexp_replace(file_path, '\\.(ts|tsx|js|jsx)$', '') as path from p)
select file_path, path, case when path like '%/index' then left(path, length(path) - 6) end as dir from q""")
def _(t: Tables):
    path = F.when(F.col("k") % 3 == 0, F.regexp_replace("file_path", "[^/]+$", "index.tsx")).otherwise(F.col("file_path"))
    rows = t.b_files.select(path.alias("file_path"))
    return rows.select("file_path", P.normalized_paths(F.col("file_path")).alias("p")).select("file_path", "p.*")


@_r.add("folder_of", "select url, case when strpos(url, '/') = 0 then '.' else regexp_replace(url, '/[^/]*$', '') end as folder from {pages}")
def _(t: Tables):
    return t.pages.select("url", P.folder_of(F.col("url")).alias("folder"))


@_r.add("last_segment", "select url, string_split(url, '/')[-1] as label from {pages}")
def _(t: Tables):
    return t.pages.select("url", P.last_segment(F.col("url")).alias("label"))


_CONVENTION = """
with e as (select case k % 5 when 0 then 'metadata' when 1 then 'default' when 2 then 'GET' when 3 then 'middleware' else 'helper' end as name,
  regexp_replace(file_path, '[^/]*$', case k % 7 when 0 then 'page.tsx' when 1 then 'layout.js' when 2 then 'route.ts' when 3 then 'middleware.ts' when 4 then 'vite.config.ts' when 5 then 'error.tsx' else 'x.ts' end) as path, k from {b_files})
select k, name, path, """
_CONVENTION_HIT = """path like '%/vite.config.ts' or (name = 'metadata' and regexp_matches(path, '(page|layout)\\.(tsx?|jsx?)$')) or (name = 'GET' and regexp_matches(path, 'route\\.(tsx?|jsx?)$'))
 or (name = 'middleware' and regexp_matches(path, 'middleware\\.(tsx?|jsx?)$')) or (name = 'default' and regexp_matches(path, '(error|loading|not-found|layout|page|template|manifest)\\.(tsx?|jsx?)$'))"""


@_r.add("is_framework_convention", _CONVENTION + _CONVENTION_HIT + " as convention from e")
def _(t: Tables):
    pick = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (F.col("k") % n + 1).cast("int"))
    name = pick(5, ["metadata", "default", "GET", "middleware", "helper"])
    file = pick(7, ["page.tsx", "layout.js", "route.ts", "middleware.ts", "vite.config.ts", "error.tsx", "x.ts"])
    rows = t.b_files.select("k", name.alias("name"), F.concat(F.regexp_replace("file_path", "[^/]*$", ""), file).alias("path"))
    return rows.select("k", "name", "path", P.is_framework_convention(F.col("name"), F.col("path")).alias("convention"))


@_r.add("is_external_import", """
select file_path, stmt_ord, source, not (source like '.%' or source like '/%' or source like '@/%' or source like 'lib1%') as external from {b_imports}""")
def _(t: Tables):
    rows = P.resolve_path_alias(t.b_imports, t.b_aliases)
    return rows.select("file_path", "stmt_ord", "source", P.is_external_import(F.col("source"), F.col("resolved")).alias("external"))


def behavioral(t: Tables):
    """b_functions with a behavioral struct."""
    no = F.lit(False)
    flags = F.struct(
        F.col("database_read").alias("databaseRead"), no.alias("databaseWrite"), F.col("http_call").alias("httpCall"), F.col("file_read").alias("fileRead"), no.alias("fileWrite"),
        F.col("sends_notification").alias("sendsNotification"), no.alias("modifiesGlobalState"), F.col("has_side_effects").alias("hasSideEffects"),
    )
    b = F.struct(F.concat(F.lit("about "), "name").alias("summary"), F.lit("ai").alias("source"), F.lit(None).cast("timestamp").alias("analyzed_at"), flags.alias("flags"))
    return t.b_functions.withColumn("behavioral", F.when(F.col("has_behavioral"), b))


LANE = """case when not has_behavioral then 'unknown' when database_read then 'database' when http_call then 'network' when file_read then 'filesystem'
 when sends_notification then 'notification' when has_side_effects then 'state' else 'pure' end"""


@_r.add("classify_effect", f"select function_id, {LANE} as lane from {{b_functions}}")
def _(t: Tables):
    return behavioral(t).select("function_id", S.classify_effect(F.col("behavioral")).alias("lane"))


@_r.add("active_flags", """
select function_id, array_to_string(list_filter([case when database_read then 'databaseRead' end, case when http_call then 'httpCall' end, case when file_read then 'fileRead' end,
 case when sends_notification then 'sendsNotification' end], lambda x: x is not null), ',') as flags from {b_functions} where has_behavioral""")
def _(t: Tables):
    rows = behavioral(t).where("behavioral is not null")
    return rows.select("function_id", F.array_join(S.active_flags(F.col("behavioral.flags")), ",").alias("flags"))


_CODE = "concat(text, case when turn % 4 = 0 then ' db.findOne(x)' when turn % 4 = 1 then ' await fetch(u); notify(y)' when turn % 4 = 2 then ' fs.writeFile(p, global)' else '' end)"


@_r.add("infer_flags", f"""
with c as (select conv_id, turn, {_CODE} as code from {{conversations}}),
f as (select conv_id, turn, regexp_matches(code, '(?i)\\b(select|find|findOne|query|getBy)\\b') as a, regexp_matches(code, '(?i)\\b(insert|update|delete|save|create)\\b') as b,
 regexp_matches(code, '(?i)\\b(fetch|axios|http)\\b') as c, regexp_matches(code, '(?i)\\b(readFile|createReadStream|readFileSync)\\b') as d,
 regexp_matches(code, '(?i)\\b(writeFile|createWriteStream|writeFileSync)\\b') as e, regexp_matches(code, '(?i)\\b(sendMail|sendEmail|notify|sms|push)\\b') as g,
 regexp_matches(code, '(?i)\\bglobal\\b|process\\.env\\s*=') as h from c)
select conv_id, turn, coalesce(a, false) as "databaseRead", coalesce(b, false) as "databaseWrite", coalesce(c, false) as "httpCall", coalesce(d, false) as "fileRead",
 coalesce(e, false) as "fileWrite", coalesce(g, false) as "sendsNotification", coalesce(h, false) as "modifiesGlobalState", coalesce(a or b or c or d or e or g or h, false) as "hasSideEffects" from f""")
def _(t: Tables):
    rows = t.conversations.select("conv_id", "turn", F.expr(_CODE).alias("code"))
    return rows.select("conv_id", "turn", S.infer_flags(F.col("code")).alias("f")).select("conv_id", "turn", "f.*")


@_r.add("normalize_analysis", """
with n as (select event_id, cast(props->>'n' as int) as n, event_type from {events})
select event_id, event_type <> 'error' as ok, case when event_type <> 'error' then event_type end as summary,
 case when event_type <> 'error' then coalesce(n % 2 = 1, false) end as "databaseRead", case when event_type <> 'error' then true end as "httpCall", case when event_type <> 'error' then true end as "hasSideEffects"
from n""")
def _(t: Tables):
    n = F.get_json_object("props", "$.n").cast("int")
    summary = F.when(F.col("event_type") == "error", F.lit("  ")).otherwise(F.col("event_type"))
    raw = F.format_string('{"summary":"%s","flags":{"databaseRead":%d,"httpCall":"no"}}', summary, n % 2)
    rows = t.events.select("event_id", S.normalize_analysis(raw).alias("a"))
    return rows.select("event_id", "a.ok", "a.summary", "a.flags.databaseRead", "a.flags.httpCall", "a.flags.hasSideEffects")


@_r.add("build_prompt", """
select k, md5('Analyze this function:' || chr(10) || chr(10) || 'File: ' || file_path || chr(10) || 'Function: ' || name || chr(10) || chr(10) || '```typescript' || chr(10) ||
 case when length(content) > 2000 then left(content, 2000) || chr(10) || '// ... truncated' else content end || chr(10) || '```') as prompt_md5 from {b_code}""")
def _(t: Tables):
    return t.b_code.select("k", F.md5(S.build_prompt(F.col("name"), F.col("content"), F.col("file_path"))).alias("prompt_md5"))


@_r.add("content_hash", "select k, left(sha256(content), 16) as content_hash from {b_code}")
def _(t: Tables):
    return t.b_code.select("k", S.content_hash(F.col("content")).alias("content_hash"))


@_r.add("level_rank", "select id, level, case level when 'error' then 3 when 'warning' then 2 when 'info' then 1 else 0 end as rank from {b_findings}")
def _(t: Tables):
    return t.b_findings.select("id", "level", S.level_rank(F.col("level")).alias("rank"))


@_r.add("folder_node_id", """
with f as (select distinct regexp_replace(file_path, '/[^/]*$', '') as folder from {b_files}) select folder, 'folder:' || folder as node_id, true as is_folder, folder as decoded from f""")
def _(t: Tables):
    rows = t.b_files.select(P.folder_of(F.col("file_path")).alias("folder")).distinct().withColumn("node_id", S.folder_node_id(F.col("folder")))
    return rows.select("folder", "node_id", S.is_folder_node_id(F.col("node_id")).alias("is_folder"), S.folder_of_node_id(F.col("node_id")).alias("decoded"))


@_r.add("cycle_is_runtime_harmless", """
select src, dst, is_type_only as harmless from {b_import_edges}""")
def _(t: Tables):
    kinds = F.array(F.when(F.col("is_type_only"), "type-only").otherwise("import"))
    cycle = F.array(F.struct(F.col("src").alias("name"), F.array(F.lit("import")).alias("dependencyTypes")), F.struct(F.col("dst").alias("name"), kinds.alias("dependencyTypes")))
    return t.b_import_edges.select("src", "dst", S.cycle_is_runtime_harmless(cycle, F.lit(None).cast("array<string>")).alias("harmless"))


@_r.add("search_nodes", "select file_id from {b_files} where contains(lower(name), '12') or contains(lower(file_path), '12') or contains(lower(regexp_replace(file_path, '/[^/]*$', '')), '12')")
def _(t: Tables):
    return t.b_files.where(S.matches_search("12", F.col("name"), P.folder_of(F.col("file_path")), F.col("file_path"))).select("file_id")


_ENTRY = "case k % 6 when 0 then 'Main' when 1 then 'initDb' when 2 then '_private' when 3 then 'router' when 4 then 'domain' else 'appHandler' end"


@_r.add("entry_point_names", f"""
select k, {_ENTRY} as name, regexp_matches({_ENTRY}, '(?i)^(main|index|app|handler|middleware|router)$|^(init|setup|bootstrap)') or {_ENTRY} like '\\_%' escape '\\' as entry from {{b_code}}""")
def _(t: Tables):
    rows = t.b_code.select("k", F.expr(_ENTRY).alias("name"))
    return rows.select("k", "name", S.is_entry_point_name(F.col("name")).alias("entry"))


@_r.add("is_common_global", """
with w as (select case k % 4 when 0 then 'console' when 1 then 'Promise' when 2 then 'fetchUser' else 'require' end as name, k from {b_code}) select k, name, name <> 'fetchUser' as common from w""")
def _(t: Tables):
    name = F.element_at(F.array(*map(F.lit, ["console", "Promise", "fetchUser", "require"])), (F.col("k") % 4 + 1).cast("int"))
    return t.b_code.select("k", name.alias("name"), S.is_common_global(name).alias("common"))


@_r.add("node_ids", """
select file_path, l as line, 'file:' || file_path as file_id, 'file:' || file_path || ':fn:' || name || ':' || l as function_id, 'file:' || file_path || ':class:' || name || ':' || l as class_id,
 'file:' || file_path || ':class:' || name || ':' || l || ':method:m:' || (l + 1) as method_id from (select file_path, name, end_line as l from {b_files})""")
def _(t: Tables):
    f, line = X.file_id(F.col("file_path")), F.col("end_line")
    c = X.class_id(f, F.col("name"), line)
    return t.b_files.select(
        "file_path", line.alias("line"), f.alias("file_id"), X.function_id(f, F.col("name"), line).alias("function_id"), c.alias("class_id"), X.method_id(c, F.lit("m"), line + 1).alias("method_id")
    )


@_r.add("slice_function_source", """
select k, md5(array_to_string(list_slice(string_split(content, chr(10)), 2, 4), chr(10))) as source_md5 from {b_code}""")
def _(t: Tables):
    return t.b_code.select("k", F.md5(X.slice_function_source(F.col("content"), F.lit(2), F.lit(4))).alias("source_md5"))


IMPORTS = """concat('import { a', cast(k % 7 as string), ', b as c } from ''./', cast(k % 50 as string), ''';', chr(10), 'import def, {', chr(10), '  x,', chr(10), '  type T', chr(10),
 '} from "@/m', cast(k % 11 as string), '";', chr(10), 'import type { U } from ''./types'';', chr(10), 'import ''./side'';', chr(10), 'import * as ns from ''pkg'';', chr(10), content)"""


def with_imports(t: Tables):
    return t.b_code.withColumn("content", F.expr(IMPORTS))


@_r.add("extract_import_statements", """
select k, 5 as statements, 'import { a' || (k % 7) || ', b as c } from ''./' || (k % 50) || ''';' as first_statement, 'import def, { x, type T } from "@/m' || (k % 11) || '";' as second_statement from {b_code}""")
def _(t: Tables):
    s = X.extract_import_statements(F.col("content"))
    return with_imports(t).select("k", s.alias("s")).select("k", F.size("s").alias("statements"), F.col("s")[0].alias("first_statement"), F.col("s")[1].alias("second_statement"))


@_r.add("parse_import_statements", """
select k, './' || (k % 50) as source, 'a' || (k % 7) || ',b' as names from {b_code} union all select k, '@/m' || (k % 11), 'default,x' from {b_code}
union all select k, './side', '' from {b_code} union all select k, 'pkg', '*' from {b_code}""")
def _(t: Tables):
    rows = with_imports(t).select("k", F.explode(X.extract_import_statements(F.col("content"))).alias("s")).select("k", X.parse_import_statement(F.col("s")).alias("p")).where("p is not null")
    return rows.select("k", "p.source", F.array_join("p.names", ",").alias("names"))


_SCAN_IMPORTS = """
with d as (select k, regexp_replace(file_path, '/[^/]*$', '') as dir from {b_code})
select distinct source, name from (select dir || '/' || (k % 50) as source, unnest(['a' || (k % 7), 'b']) as name from d
 union all select 'Brand#11/m' || (k % 11), unnest(['default', 'x']) from d union all select 'pkg', '*' from d)"""


@_r.add("scan_non_ts_imports", _SCAN_IMPORTS)
def _(t: Tables):
    rows = with_imports(t).withColumn("file_path", F.regexp_replace("file_path", r"\.ts$", ".vue"))
    return X.scan_imports(R.read_non_ts_files(rows), t.b_aliases).select("source", "name")


@_r.add("scan_test_imports", _SCAN_IMPORTS)
def _(t: Tables):
    rows = with_imports(t).withColumn("file_path", F.regexp_replace("file_path", r"\.ts$", ".test.ts"))
    return X.scan_imports(R.read_test_files(rows), t.b_aliases).select("source", "name")


@_r.add("extract_imports", """
select k, 0 as stmt_ord, './' || (k % 50) as source, false as is_type_only, 2 as n_items from {b_code} union all select k, 1, '@/m' || (k % 11), false, 3 from {b_code}
union all select k, 2, './types', true, 1 from {b_code} union all select k, 3, './side', false, 0 from {b_code} union all select k, 4, 'pkg', false, 1 from {b_code}""")
def _(t: Tables):
    imports, _ = X.extract_imports(with_imports(t))
    return imports.select(F.regexp_extract("file_path", r"(\d+)\.ts$", 1).cast("long").alias("k"), "stmt_ord", "source", "is_type_only", "n_items")
