"""Operators over several scans, and a few over one that have no home elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import folder_of
from ..functions.scalars import EFFECTS, content_hash


def scan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """node_id, change (added, removed, modified): nodes of two scans by their content hash."""
    a, b = before.select("node_id", F.col("hash").alias("old")), after.select("node_id", F.col("hash").alias("new"))
    both = a.withColumn("in_a", F.lit(True)).join(b.withColumn("in_b", F.lit(True)), "node_id", "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select("node_id", change.alias("change")).where("change is not null")


def folder_clusters(files: DataFrame, edges: DataFrame) -> DataFrame:
    """scan_id, folder, internal, external: connections inside a folder and across its border."""
    at = files.select("scan_id", "file_id", folder_of(F.col("file_path")).alias("folder"))
    e = edges.join(at.select("scan_id", F.col("file_id").alias("src"), F.col("folder").alias("a")), ["scan_id", "src"])
    e = e.join(at.select("scan_id", F.col("file_id").alias("dst"), F.col("folder").alias("b")), ["scan_id", "dst"])
    ends = e.select("scan_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("folder"), (F.col("a") == F.col("b")).alias("inside"))
    counts = ends.groupBy("scan_id", "folder").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))
    folders = at.select("scan_id", "folder").distinct().join(counts, ["scan_id", "folder"], "left")
    return folders.select("scan_id", "folder", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("external", F.lit(0)).alias("external"))


def recent_scans(scans: DataFrame, most: int = 5) -> DataFrame:
    order = W.partitionBy("project_path").orderBy(F.col("created_at").desc(), F.col("scan_id"))
    return scans.withColumn("recency", F.row_number().over(order)).where(F.col("recency") <= most)


def duplicate_code(functions: DataFrame, source: str = "source") -> DataFrame:
    """content_hash, copies, first_id: code that more than one function has."""
    hashed = functions.select(content_hash(F.col(source)).alias("content_hash"), "function_id")
    return hashed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("function_id").alias("first_id")).where("copies > 1")


def missing_types(functions: DataFrame) -> DataFrame:
    """Functions with a parameter that has no type; params: array of struct(name, type)."""
    return functions.where(F.exists("params", lambda p: p["type"].isNull()))


def deep_nesting(depths: DataFrame, least: int = 4) -> DataFrame:
    """scan_id, file_id, depth: files whose braces nest deeper than `least`; depths: scan_id, file_id, depth (a row a line)."""
    return depths.groupBy("scan_id", "file_id").agg(F.max("depth").alias("depth")).where(F.col("depth") > least)


def filter_chips(functions: DataFrame, *flags: str, match_all: bool = False) -> DataFrame:
    """Functions with any (or all) of the named effects."""
    unknown = set(flags) - {*EFFECTS, "hasSideEffects"}
    if unknown:
        raise ValueError(f"unknown flags: {sorted(unknown)}")
    keep = F.lit(match_all or not flags)
    for f in flags:
        c = F.coalesce(F.col(f"behavioral.flags.{f}"), F.lit(False))
        keep = keep & c if match_all else keep | c
    return functions.where(keep)


def summary_overrides(functions: DataFrame, manual: DataFrame, docstrings: DataFrame) -> DataFrame:
    """function_id, summary, summary_source: a manual summary first, then the docstring, then the analysis."""
    out = functions.select("scan_id", "function_id", F.col("behavioral.summary").alias("ai"))
    out = out.join(manual.select("scan_id", "function_id", F.col("summary").alias("manual")), ["scan_id", "function_id"], "left")
    out = out.join(docstrings.select("scan_id", "function_id", F.col("summary").alias("doc")), ["scan_id", "function_id"], "left")
    source = F.when(F.col("manual").isNotNull(), "manual").when(F.col("doc").isNotNull(), "docstring").when(F.col("ai").isNotNull(), "ai")
    return out.select("scan_id", "function_id", F.coalesce("manual", "doc", "ai").alias("summary"), source.alias("summary_source"))
