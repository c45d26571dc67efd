"""Readers and writers: source trees, scan documents, caches, dismissals, path aliases, repository sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rollup import ranked
from .snapshots import commit, snapshot

# What a scan reads and leaves out.
SOURCE = r"\.(ts|tsx|js|jsx)$"
SOURCE_SKIP = r"(^|/)(node_modules|dist|build|\.git|\.next|\.turbo|\.vercel|coverage)/|\.(test|spec)\.tsx?$|\.d\.ts$|\.min\.js$"
OTHER = r"\.(svelte|vue|astro|mdx|md)$"
TEST = r"\.(test|spec)\.(ts|tsx|js|jsx)$"
BASIC_SKIP = r"(^|/)(node_modules|dist|build|\.git|coverage)/"
WORKSPACE_SKIP = ("node_modules", "dist", "build", "coverage", ".git", ".next", ".turbo", ".vercel", "out")
SOURCE_ROOTS = ("src", "lib", "app", "source")
REQUIRED = "id projectPath projectName status createdAt stats nodes connections warnings clusters errors".split()
ARRAYS = "connections warnings clusters errors".split()
CACHE_VERSION = 2
MOST_FILES, MOST_BYTES = 50_000, 512 * 1024 * 1024


def is_source_file(path: Column) -> Column:
    return path.rlike(SOURCE) & ~path.rlike(SOURCE_SKIP)


def is_non_ts_file(path: Column) -> Column:
    return path.rlike(OTHER) & ~path.rlike(BASIC_SKIP)


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST) & ~path.rlike(BASIC_SKIP)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """scan_id (first folder below root), file_path, size_bytes, content of every file below root/<scan>/...; content is
    read for the rows that a later filter on the path keeps."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rest = F.substring_index(F.col("path"), base.split("://")[-1], -1)
    return files.select(
        F.substring_index(rest, "/", 1).alias("scan_id"), F.regexp_replace(rest, "^[^/]*/", "").alias("file_path"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content")
    )


def read_source_files(tree: DataFrame) -> DataFrame:
    return tree.where(is_source_file(F.col("file_path"))).dropDuplicates(["scan_id", "file_path"])


def read_non_ts_files(tree: DataFrame) -> DataFrame:
    return tree.where(is_non_ts_file(F.col("file_path"))).dropDuplicates(["scan_id", "file_path"])


def read_test_files(tree: DataFrame) -> DataFrame:
    return tree.where(is_test_file(F.col("file_path"))).dropDuplicates(["scan_id", "file_path"])


def read_scan_json(spark: SparkSession, path: str) -> DataFrame:
    """One row a stored scan document: path, document."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("document"))


def validate_scan(document: Column) -> Column:
    """The first violation of a scan document, or null."""
    v = F.try_parse_json(document)
    kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit("VOID"))
    keys = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    isobj = lambda k: k.startswith("OBJECT") | k.startswith("ARRAY")
    top = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    checks = [F.when(~isobj(top), "not an object")]
    checks += [F.when(~F.array_contains(keys, f), f'missing field "{f}"') for f in REQUIRED]
    checks += [F.when(~isobj(kind(f"$.{f}")), f"{f} must be an object") for f in ("stats", "nodes")]
    checks += [F.when(~kind(f"$.{f}").startswith("ARRAY"), f"{f} must be an array") for f in ARRAYS]
    return F.coalesce(*checks)


NODE = (
    "struct<id:string,type:string,name:string,filePath:string,line:int,endLine:int,parentFileId:string,parentClassId:string,isExported:boolean,isAsync:boolean,"
    "references:array<string>,extends:string,implements:array<string>,functions:array<string>,classes:array<string>>"
)
CONNECTION = "struct<id:string,sourceId:string,targetId:string,type:string,weight:int>"
WARNING = "struct<id:string,category:string,level:string,title:string,affectedNodes:array<string>,source:string,confidence:double,dismissible:boolean>"
SCAN = f"struct<id:string,projectPath:string,projectName:string,status:string,createdAt:timestamp,completedAt:timestamp,nodes:map<string,{NODE}>,connections:array<{CONNECTION}>,warnings:array<{WARNING}>>"


def parse_scans(documents: DataFrame) -> DataFrame:
    """Valid documents as a column `scan`; the others have `error`."""
    error = validate_scan(F.col("document"))
    return documents.withColumn("error", error).withColumn("scan", F.when(F.col("error").isNull(), F.from_json("document", SCAN)))


def explode_nodes(scans: DataFrame) -> DataFrame:
    """scan_id, node_id, type and the other fields of each node."""
    rows = scans.where("scan is not null").select(F.col("scan.id").alias("scan_id"), F.explode("scan.nodes").alias("node_id", "n"))
    return rows.select("scan_id", "node_id", "n.*").drop("id")


def explode_connections(scans: DataFrame) -> DataFrame:
    rows = scans.where("scan is not null").select(F.col("scan.id").alias("scan_id"), F.explode("scan.connections").alias("c"))
    return rows.select("scan_id", F.col("c.id").alias("conn_id"), F.col("c.sourceId").alias("source_id"), F.col("c.targetId").alias("target_id"), "c.type", "c.weight")


def explode_findings(scans: DataFrame) -> DataFrame:
    rows = scans.where("scan is not null").select(F.col("scan.id").alias("scan_id"), F.explode("scan.warnings").alias("w"))
    return rows.select("scan_id", "w.id", "w.category", "w.level", "w.title", F.col("w.affectedNodes").alias("affected_nodes"), "w.source", "w.confidence", "w.dismissible")


def write_scan(tables: dict[str, DataFrame], path: str, scans: DataFrame | None = None, token: str | None = None) -> None:
    """The tables of scans below path as one commit: each scan replaces itself wholly (see `snapshots`).  scans: scan_id of
    all that are written, those without rows in any table too."""
    commit(tables, path, scans, token)


def read_scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table that write_scan wrote, as the last commit of each scan left it."""
    return snapshot(spark, path, table)


def last_of_scans(scans: DataFrame) -> DataFrame:
    """One document of each scan id: the one that was completed, else made, last; documents without a scan fall away."""
    order = [F.col("scan.completedAt").desc_nulls_last(), F.col("scan.createdAt").desc_nulls_last(), F.xxhash64("document")]
    rows = scans.where("scan.id is not null").withColumn("_n", F.row_number().over(W.partitionBy("scan.id").orderBy(*order)))
    return rows.where("_n = 1").drop("_n")


def load_cache(cache: DataFrame) -> DataFrame:
    return cache.where(F.col("version") == CACHE_VERSION)


def save_cache(cache: DataFrame, path: str) -> None:
    cache.withColumn("version", F.lit(CACHE_VERSION)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_project").parquet(path)


def read_path_aliases(configs: DataFrame) -> DataFrame:
    """scan_id, alias, alias_ord, target from compiler configurations (scan_id, file_path, content), comments allowed.
    Targets are taken from the configuration's folder; of several files the later one's targets come first, and an alias
    keeps the place where it came up first."""
    schema = "compilerOptions struct<paths:map<string,array<string>>>"
    parsed = configs.where(~F.col("file_path").rlike(BASIC_SKIP) & F.col("file_path").rlike(r"(^|/)tsconfig[^/]*\.json$"))
    parsed = parsed.select("scan_id", "file_path", F.from_json("content", schema, {"allowComments": "true"})["compilerOptions"]["paths"].alias("paths"))
    folder = F.when(F.instr("file_path", "/") > 0, F.regexp_replace("file_path", "[^/]*$", "")).otherwise(F.lit(""))
    entry = parsed.select("scan_id", "file_path", folder.alias("folder"), F.posexplode(F.map_entries("paths")).alias("pos", "e"))
    rows = entry.select("scan_id", "file_path", "pos", F.col("e.key").alias("alias"), "folder", F.posexplode("e.value").alias("t_ord", "target"))
    rows = rows.withColumn("target", F.concat("folder", F.regexp_replace("target", r"^\./", "")))
    first = rows.groupBy("scan_id", "alias").agg(F.min(F.struct("file_path", "pos")).alias("first"))
    numbered = ranked(rows.join(first, ["scan_id", "alias"]), ["scan_id"], [F.col("first").asc(), F.col("file_path").desc(), F.col("t_ord").asc()], "alias_ord")
    return numbered.select("scan_id", "alias", (F.col("alias_ord") - 1).alias("alias_ord"), "target")


def load_dismissed(stored: Column) -> Column:
    """array<string> of a stored JSON array; what isn't an array is empty, what isn't a string in it falls away."""
    v = F.try_parse_json(stored)
    ok = F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))
    items = F.when(ok, F.try_variant_get(v, "$", "array<variant>"))
    text = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(text, F.array().cast("array<string>"))


def save_dismissed(dismissed: DataFrame) -> DataFrame:
    """project, stored: the identities as a sorted JSON array."""
    return dismissed.groupBy("project").agg(F.to_json(F.array_sort(F.collect_set("identity"))).alias("stored"))


def measure_repos(listing: DataFrame, most_files: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """scan_id, files, bytes, verdict of a file listing (scan_id, file_path, size_bytes); files are checked first."""
    sizes = listing.groupBy("scan_id").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    verdict = F.when(F.col("files") > most_files, "too_many_files").when(F.col("bytes") > most_bytes, "too_large").otherwise("ok")
    return sizes.withColumn("verdict", verdict)


def discover_workspaces(listing: DataFrame, depth: int = 4) -> DataFrame:
    """scan_id, workspace: folders with a package.json, down to a depth; `.` is the root."""
    path = F.col("file_path")
    own = listing.where(path.rlike(r"(^|/)package\.json$"))
    folder = F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    parts = F.split("workspace", "/")
    skipped = F.exists(parts, lambda p: p.isin(*WORKSPACE_SKIP) | (p.startswith(".") & (p != ".")))
    return own.select("scan_id", folder.alias("workspace")).where((F.size(parts) <= depth) & ~skipped).distinct()


def derive_source_roots(listing: DataFrame, workspaces: DataFrame) -> DataFrame:
    """scan_id, root: the usual source folders that exist in each workspace; `.` for a scan without any."""
    dirs = listing.select("scan_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("file_path", "/"))), lambda i: F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), i - 1), "/"))).alias("root")).where("root <> ''").distinct()
    head = F.when(F.col("workspace") == ".", F.lit("")).otherwise(F.concat("workspace", F.lit("/")))
    wanted = workspaces.select("scan_id", F.explode(F.transform(F.array(*map(F.lit, SOURCE_ROOTS)), lambda r: F.concat(head, r))).alias("root"))
    found = wanted.join(dirs, ["scan_id", "root"], "left_semi").distinct()
    bare = listing.select("scan_id").distinct().join(found.select("scan_id"), "scan_id", "left_anti").select("scan_id", F.lit(".").alias("root"))
    return found.unionByName(bare)


def root_tsconfig(listing: DataFrame) -> DataFrame:
    return listing.groupBy("scan_id").agg(F.max(F.when(F.col("file_path") == "tsconfig.json", F.col("file_path"))).alias("tsconfig"))


def scan_errors(source: DataFrame, parsed: DataFrame) -> DataFrame:
    """scan_id, file_path, message: source files that gave no row."""
    lost = source.select("scan_id", "file_path").join(parsed.select("scan_id", "file_path"), ["scan_id", "file_path"], "left_anti")
    return lost.select("scan_id", "file_path", F.lit("not parsed").alias("message"), F.lit(True).alias("recoverable"))


def scan_status(source: DataFrame, parsed: DataFrame) -> DataFrame:
    """scan_id, status: failed when there are errors and no node."""
    errors = scan_errors(source, parsed).groupBy("scan_id").agg(F.count("*").alias("errors"))
    nodes = parsed.groupBy("scan_id").agg(F.count("*").alias("nodes"))
    out = source.select("scan_id").distinct().join(errors, "scan_id", "left").join(nodes, "scan_id", "left")
    failed = (F.coalesce("errors", F.lit(0)) > 0) & (F.coalesce("nodes", F.lit(0)) == 0)
    return out.select("scan_id", F.when(failed, "failed").otherwise("completed").alias("status"), F.coalesce("errors", F.lit(0)).alias("errors"))
