"""Queries that write scans, caches and documents to the shared folder and read them back, and those of configurations
and providers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import enrich as E
from ..shared import shared_dir
from ..sources import readers as R
from ..streaming import progress as T
from . import views as V
from .registry import Registry, Tables
from .scalar_queries import LANE, behavioral
from .table_queries import _FID, cache, functions_with_code

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_NAMES = ("a.svelte", "b.vue", "c.test.ts", "d.spec.jsx", "e.ts", "f.mdx", "g.test.tsx", "h.md", "i.spec.js")
_FOLDERS = ("src/", "node_modules/x/", "", "lib/dist/", "docs/")


def mixed_listing(t: Tables):
    """Documents as files of several kinds: source is the repository."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    path = F.concat(pick(_FOLDERS, len(_FOLDERS)), F.lit("d"), F.col("doc_id").cast("string"), F.lit("-"), pick(_NAMES, len(_NAMES)))
    return t.documents.select(F.col("source").alias("scan_id"), path.alias("file_path"), F.col("text").alias("content"))


def _listed(pattern: str) -> str:
    pick = lambda values: f"[{', '.join(repr(v) for v in values)}][doc_id % {len(values)} + 1]"
    return f"""select scan_id, file_path from (select source as scan_id, {pick(_FOLDERS)} || 'd' || doc_id || '-' || {pick(_NAMES)} as file_path from {{documents}})
 where regexp_matches(file_path, '{pattern}') and not regexp_matches(file_path, '(^|/)(node_modules|dist)/')"""


@_r.add("read_non_ts_files", _listed(r"\.(svelte|vue|mdx|md)$"))
def _(t: Tables):
    return R.read_non_ts_files(mixed_listing(t)).select("scan_id", "file_path")


@_r.add("read_test_files", _listed(r"\.(test|spec)\.(ts|tsx|js|jsx)$"))
def _(t: Tables):
    return R.read_test_files(mixed_listing(t)).select("scan_id", "file_path")


def scan_documents(t: Tables):
    """A scan document for each file, with its functions as nodes: scan, document."""
    node = F.struct(F.col("function_id").alias("id"), F.lit("function").alias("type"), "name", F.col("file_path").alias("filePath"), F.col("is_exported").alias("isExported"))
    doc = t.b_functions.groupBy("parent_file_id").agg(F.map_from_entries(F.collect_list(F.struct("function_id", node))).alias("nodes"))
    empty = F.array().cast("array<string>")
    text = F.to_json(F.struct(
        F.col("parent_file_id").alias("id"), F.lit("p").alias("projectPath"), F.lit("p").alias("projectName"), F.lit("completed").alias("status"), F.lit("2024-01-01T00:00:00Z").alias("createdAt"),
        F.struct(F.size("nodes").alias("n")).alias("stats"), "nodes", empty.alias("connections"), empty.alias("warnings"), empty.alias("clusters"), empty.alias("errors")))
    return doc.select(F.regexp_extract("parent_file_id", r"(\d+)\.ts$", 1).cast("long").alias("scan"), text.alias("document"))


@_r.add("read_scan_json", "select parent_file_id as scan_id, count(*) as nodes from {b_functions} group by 1")
def _(t: Tables):
    """Documents lie in a folder, one a line of its files; each file is read whole."""
    path = shared_dir(t.spark, "scan-documents")
    scan_documents(t).select(F.col("document").alias("value")).write.option("lineSep", "\n").text(path)
    read = R.read_scan_json(t.spark, path)
    documents = read.select(F.explode(F.split(F.rtrim("document"), "\n")).alias("document")).where("document <> ''")
    return R.parse_scans(documents).where("error is null").select(F.col("scan.id").alias("scan_id"), F.size("scan.nodes").cast("long").alias("nodes"))


@_r.add("write_scan", """select source as scan_id, doc_id as node_id, n_chars as size, 'node' as kind from {documents} where source not in ('src1', 'src2') union all select source, doc_id, n_chars + 1, 'node' from {documents} where source = 'src1'
 union all select source, doc_id, n_chars, 'finding' from {documents} where source not in ('src1', 'src2', 'src3')""")
def _(t: Tables):
    """All scans; then one of them again with other sizes, and one that has become empty: each replaces itself alone, and one
    that is written again without findings keeps none."""
    path = shared_dir(t.spark, "scans")
    nodes = t.documents.select(F.col("source").alias("scan_id"), F.col("doc_id").alias("node_id"), F.col("n_chars").alias("size"))
    of = lambda scan: nodes.where(F.col("scan_id") == scan)
    R.write_scan({"nodes": nodes, "findings": nodes}, path)
    R.write_scan({"nodes": of("src1").withColumn("size", F.col("size") + 1), "findings": nodes.limit(0)}, path)
    R.write_scan({"nodes": nodes.limit(0), "findings": nodes.limit(0)}, path, of("src2").select("scan_id").distinct())
    R.write_scan({"nodes": of("src3"), "findings": nodes.limit(0)}, path)
    read = lambda table, kind: R.read_scan(t.spark, path, table).withColumn("kind", F.lit(kind)).select("scan_id", "node_id", "size", "kind")
    return read("nodes", "node").unionByName(read("findings", "finding"))


@_r.add("save_cache", f"select {_FID} as function_id, left(sha256(case when k % 4 = 0 then content || 'old' else content end), 16) as content_hash, 2 as version from {{b_code}} where k % 3 < 2")
def _(t: Tables):
    path = shared_dir(t.spark, "cache")
    R.save_cache(cache(t).withColumn("version", F.lit(1)), path)
    return R.load_cache(t.spark.read.parquet(path)).select("function_id", "content_hash", "version")


_LIBRARY, _OWN = D.DetectionConfig(mode="library"), D.DetectionConfig(mode="library", issue_types=("exports",), large_file_lines=300, large_file_confidence=0.5)


@_r.add("enabled_issue_types", "select file_id, case k % 3 when 0 then 'files,exports,types' when 1 then 'files' else 'exports' end as issue_types from {b_files}")
def _(t: Tables):
    """Every third file belongs to an application, a library, or a library with types of its own choice."""
    said = [F.lit(",".join(c.enabled_issue_types())) for c in (D.DetectionConfig(), _LIBRARY, _OWN)]
    return t.b_files.select("file_id", F.element_at(F.array(*said), (F.col("k") % 3 + 1).cast("int")).alias("issue_types"))


@_r.add("detection_config", """select file_id as nodes, case when end_line > 600 then 'warning' else 'info' end as level, 0.5::double as confidence from {b_files} where end_line > 300
 union all select file_id, 'info', 0.6::double from {b_files} where k % 3 = 1""")
def _(t: Tables):
    """What a configuration with other constants makes of files and of a report: only exports count."""
    from .graph_queries import reports

    unused = D.map_unused_report(D.read_engine_reports(reports(t)), _OWN, t.b_files)
    return D.union_findings(D.large_files(t.b_files, _OWN), unused).select(F.array_join("affected_nodes", ",").alias("nodes"), "level", "confidence")


@_r.add("lane_members", f"select lane, file_path, string_agg(function_id, ',' order by name, function_id) as members from (select *, {LANE} as lane from {{b_functions}}) group by 1, 2")
def _(t: Tables):
    return V.lane_members(behavioral(t)).select("lane", "file_path", F.array_join("members", ",").alias("members"))


@_r.add("analyze_one", f"""select {_FID} as function_id, k % 3 < 2 and k % 4 <> 0 as cached, case when k % 3 < 2 and k % 4 <> 0 then 'kept' else 'Function ' || name end as summary
 from {{b_code}} where content <> '' and {_FID} = (select max({_FID}) from {{b_code}} where content <> '')""")
def _(t: Tables):
    f = functions_with_code(t)
    last = f.where("source <> ''").agg(F.max("function_id")).first()[0]
    return E.analyze_one(f, last, cache(t)).select("function_id", "cached", "summary")


def _answer(name: str, code: str, path: str) -> str:
    """A stand-in for a caller's describing service: it fails for names that end in 7 and gives no summary for 8."""
    if name.endswith("7"):
        raise RuntimeError("no answer")
    return json.dumps({"summary": "" if name.endswith("8") else f"{name} in {path}", "flags": {"httpCall": len(code) % 2 == 0}})


@_r.add("provider", f"""select {_FID} as function_id, name || ' in ' || file_path as summary, length(content) % 2 = 0 as http_call from {{b_code}}
 where content <> '' and name not like '%7' and name not like '%8'""")
def _(t: Tables):
    provider = E.Provider("answers", "m1", describe=_answer)
    return E.analyze_behavior(functions_with_code(t), cache(t), provider).select("function_id", "summary", F.col("flags.httpCall").alias("http_call"))


@_r.add("analysis_failures", f"""select 'corpus' as scan_id, case when name like '%7' then 'RuntimeError: no answer' else '{E.NO_SUMMARY}' end as error, count(*) as functions, min({_FID}) as first_id
 from {{b_code}} where content <> '' and (name like '%7' or name like '%8') group by 2""")
def _(t: Tables):
    provider = E.Provider("answers", "m1", describe=_answer)
    return E.failures(E.attempts(functions_with_code(t), cache(t), provider))


@_r.add("ingest_scans", "select parent_file_id as scan_id, function_id as node_id, name from {b_functions}")
def _(t: Tables):
    """The batch twin of the stream, given each document twice in a batch and half of them again: a scan that comes again
    replaces itself, one that comes twice counts once."""
    path = shared_dir(t.spark, "ingested")
    documents = scan_documents(t).withColumn("batch", F.pmod(F.xxhash64("scan"), F.lit(2))).select("document", "batch")
    for part in (documents.unionAll(documents), documents.where("batch = 1")):
        T.ingest_batch(part, path)
    return R.read_scan(t.spark, path, "nodes").select("scan_id", "node_id", "name")
