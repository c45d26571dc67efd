"""Filters, roll-ups and look-ups over the tables of a scan.  Every table carries scan_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import folder_of
from ..functions.scalars import finding_identity, level_rank
from ..shared import materialise

LEVELS = ("error", "warning", "info")


def first_wins(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first (or last) in order."""
    by = [F.col(c).desc() if last else F.col(c).asc() for c in order]
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """df with the number of each row inside its group, from 1, by tasks that each take a range of the whole order: their
    counts, a row a range and group, are summed to say where each range begins, so no task holds a group."""
    dealt = df.repartitionByRange(*map(F.col, group), *order).withColumn("_range", F.spark_partition_id())
    dealt = materialise(dealt, "ranges")  # ranges must not be dealt anew between counting and numbering
    counts = dealt.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order))
    begun = counts.select(*group, "_range", before.alias("_before"))
    out = dealt.withColumn("_own", own).join(begun, [*group, "_range"])
    return out.select(*df.columns, (F.col("_own") + F.col("_before")).cast("int").alias(name))


def runtime_imports(imports: DataFrame) -> DataFrame:
    return imports.where(~F.col("is_type_only"))


def files_in_folder(files: DataFrame, folder: str) -> DataFrame:
    return files.where(folder_of(F.col("file_path")) == folder)


def pending_functions(functions: DataFrame) -> DataFrame:
    return functions.where(F.col("behavioral").isNull())


def limit_functions(functions: DataFrame, most: int, order: tuple[str, ...] = ("file_path", "fn_ord")) -> DataFrame:
    """The first `most` pending functions of each scan; each task passes on no more than these (a limit of window groups)."""
    n = F.row_number().over(W.partitionBy("scan_id").orderBy(*order, "function_id"))
    return pending_functions(functions).withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def scan_stats(nodes: DataFrame) -> DataFrame:
    """Nodes of each kind a scan; every function awaits analysis."""
    kinds = {k: F.count_if(F.col("type") == k) for k in ("file", "function", "class", "cluster")}
    return nodes.groupBy("scan_id").agg(F.count("*").alias("total_nodes"), *(c.alias(f"n_{k}") for k, c in kinds.items()), kinds["function"].alias("pending"))


def warning_stats(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id").agg(F.count("*").alias("total"), *(F.count_if(F.col("level") == x).alias(f"n_{x}") for x in LEVELS))


def finding_nodes(findings: DataFrame) -> DataFrame:
    return findings.select("scan_id", "id", "level", F.explode("affected_nodes").alias("node_id"))


def _warnings_by_folder(files: DataFrame, affected: DataFrame) -> DataFrame:
    """scan_id, folder, id, level: each finding once in each folder with a file of its; affected: scan_id, id, level, node_id."""
    at = files.select("scan_id", F.col("file_id").alias("node_id"), folder_of(F.col("file_path")).alias("folder"))
    return affected.join(at, ["scan_id", "node_id"]).select("scan_id", "folder", "id", "level").distinct()


def folder_rollup(files: DataFrame, functions: DataFrame, affected: DataFrame) -> DataFrame:
    """scan_id, folder, files, functions, warnings."""
    keys = ["scan_id", "folder"]
    per = lambda df: df.groupBy("scan_id", folder_of(F.col("file_path")).alias("folder"))
    n_files, n_functions = per(files).agg(F.count("*").alias("files")), per(functions).agg(F.count("*").alias("functions"))
    n_warnings = _warnings_by_folder(files, affected).groupBy(*keys).agg(F.count("*").alias("warnings"))
    out = n_files.join(n_functions, keys, "left").join(n_warnings, keys, "left")
    return out.select(*keys, "files", F.coalesce("functions", F.lit(0)).alias("functions"), F.coalesce("warnings", F.lit(0)).alias("warnings"))


def folder_summary(files: DataFrame, functions: DataFrame, classes: DataFrame, affected: DataFrame, folder: str) -> DataFrame:
    """One row a scan for a folder, zeros when nothing is there."""
    inside = lambda df: df.where(folder_of(F.col("file_path")) == folder).groupBy("scan_id")
    out = files.select("scan_id").distinct()
    for name, df in (("files", files), ("functions", functions), ("classes", classes)):
        out = out.join(inside(df).agg(F.count("*").alias(name)), "scan_id", "left")
    levels = _warnings_by_folder(files, affected).where(F.col("folder") == folder).groupBy("scan_id")
    out = out.join(levels.agg(F.count("*").alias("warnings"), *(F.count_if(F.col("level") == x).alias(f"n_{x}") for x in LEVELS)), "scan_id", "left")
    return out.select("scan_id", F.lit(folder).alias("folder"), *(F.coalesce(c, F.lit(0)).alias(c) for c in out.columns[1:]))


def merge_import_maps(*maps: DataFrame) -> DataFrame:
    """scan_id, source, name: the union of tables of used names, each once."""
    out = maps[0]
    for m in maps[1:]:
        out = out.unionByName(m)
    return out.select("scan_id", "source", "name").distinct()


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("scan_project").agg(F.count("*").alias("entries"), F.min("analyzed_at").alias("oldest"), F.max("analyzed_at").alias("newest"))


def count_below_threshold(findings: DataFrame, least: float) -> DataFrame:
    return findings.groupBy("scan_id").agg(F.count_if(F.col("confidence") < least).alias("hidden"))


def analysis_stats(functions: DataFrame) -> DataFrame:
    done = F.col("behavioral").isNotNull()
    return functions.groupBy("scan_id").agg(F.count_if(done).alias("analyzed"), F.count_if(~done).alias("pending"))


def ids_by_file(children: DataFrame, id_col: str, ord_col: str) -> DataFrame:
    """scan_id, file_id, ids: the children of each file in declared order."""
    rows = F.array_sort(F.collect_list(F.struct(ord_col, id_col)))
    return children.groupBy("scan_id", F.col("parent_file_id").alias("file_id")).agg(F.transform(rows, lambda r: r[id_col]).alias("ids"))


def with_identity(findings: DataFrame) -> DataFrame:
    return findings.withColumn("identity", finding_identity(F.col("source"), F.col("category"), F.col("affected_nodes")))


def min_confidence(findings: DataFrame, least: float) -> DataFrame:
    return findings.where(F.col("confidence") >= least)


def filter_findings(findings: DataFrame, dismissed: DataFrame, least: float = 0.0, show_dismissed: bool = False, collate: str | None = None) -> DataFrame:
    """Findings of at least a confidence, without dismissed ones (or with a flag), and their rank in a scan: level,
    confidence, identity.  dismissed: project, identity; a scan's project is its column of that name."""
    marked = min_confidence(with_identity(findings), least).join(dismissed.select("project", "identity", F.lit(True).alias("dismissed")).distinct(), ["project", "identity"], "left")
    marked = marked.withColumn("dismissed", F.coalesce("dismissed", F.lit(False)))
    if not show_dismissed:
        marked = marked.where(~F.col("dismissed"))
    name = F.collate("identity", collate) if collate else F.col("identity")
    return ranked(marked, ["scan_id"], [level_rank(F.col("level")).desc(), F.col("confidence").desc(), name.asc(), F.col("id").asc()])


def dismiss(dismissed: DataFrame, more: DataFrame) -> DataFrame:
    return dismissed.select("project", "identity").unionByName(more.select("project", "identity")).distinct()


def restore(dismissed: DataFrame, less: DataFrame) -> DataFrame:
    return dismissed.select("project", "identity").join(less.select("project", "identity"), ["project", "identity"], "left_anti").distinct()


def resolve_affected_nodes(paths: DataFrame, files: DataFrame) -> DataFrame:
    """Adds node_id: the file of a path, or the path itself."""
    known = files.select("scan_id", F.col("file_path").alias("path"), "file_id")
    return paths.join(known, ["scan_id", "path"], "left").withColumn("node_id", F.coalesce("file_id", "path")).drop("file_id")


def file_class_cards(file_classes: DataFrame, classes: DataFrame) -> DataFrame:
    """Class cards of each file in declared order; file_classes: scan_id, file_id, classes (ids)."""
    ids = file_classes.select("scan_id", "file_id", F.posexplode("classes").alias("pos", "class_id"))
    return ids.join(classes.select("scan_id", "class_id", "name", "extends", F.size("methods").alias("n_methods")), ["scan_id", "class_id"])


def connections_for_nodes(connections: DataFrame, nodes: DataFrame) -> DataFrame:
    """scan_id, node_id and the connections that start or end there, each once."""
    n = nodes.select("scan_id", "node_id").distinct()
    ends = [connections.withColumn("node_id", F.col("source_id")), connections.where("source_id <> target_id").withColumn("node_id", F.col("target_id"))]
    return ends[0].unionByName(ends[1]).join(n, ["scan_id", "node_id"], "left_semi")


def warnings_for_nodes(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    return affected.join(nodes.select("scan_id", "node_id").distinct(), ["scan_id", "node_id"])


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("node_id") == node_id)


def folder_warning_nodes(affected: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    at = files_in_folder(files, folder).select("scan_id", F.col("file_id").alias("node_id"))
    return affected.select("scan_id", "node_id").join(at, ["scan_id", "node_id"], "left_semi").distinct()


def sorted_names(files: DataFrame, name: Column | None = None, collate: str | None = None) -> DataFrame:
    """Adds folder_rank (folders by code unit) and file_rank (files inside a folder by name)."""
    name = F.col("name") if name is None else name
    key = F.collate(name, collate) if collate else name
    rows = files.withColumn("folder", folder_of(F.col("file_path")))
    order = W.partitionBy("scan_id", "folder").orderBy(key, "file_id")
    folders = rows.select("scan_id", "folder").distinct().withColumn("folder_rank", F.row_number().over(W.partitionBy("scan_id").orderBy("folder")))
    return rows.withColumn("file_rank", F.row_number().over(order)).join(folders, ["scan_id", "folder"])
