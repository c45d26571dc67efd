"""Query shapes over a scan's graph: nodes, edges and a row of figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import folder_of, last_segment
from ..functions.scalars import EFFECT_GROUPS, classify_effect, folder_node_id
from ..operators.graph import circular_edges, participating, scc
from ..operators.rollup import files_in_folder, folder_rollup, ranked
from ..shared import materialise


def view_folders(files: DataFrame, functions: DataFrame, affected: DataFrame) -> DataFrame:
    """One node a folder with its counts, ranked by folder."""
    rows = folder_rollup(files, functions, affected)
    rows = ranked(rows, ["scan_id"], [F.col("folder").asc()])
    return rows.select("scan_id", folder_node_id(F.col("folder")).alias("node_id"), last_segment(F.col("folder")).alias("label"), "files", "functions", "warnings", "rank")


def view_folder(files: DataFrame, edges: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(files of a folder, import edges with both ends inside)."""
    nodes = files_in_folder(files, folder)
    inside = edges
    for end in ("src", "dst"):
        inside = inside.join(nodes.select("scan_id", F.col("file_id").alias(end)), ["scan_id", end], "left_semi")
    return nodes, inside


def view_dependencies(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(participating files with component, size and in_cycle; edges with circular)."""
    edges = materialise(edges, "edges")  # read by all that follows
    components = materialise(scc(participating(edges), edges), "components")
    return components, circular_edges(edges, components)


def dependency_meta(edges: DataFrame, components: DataFrame) -> DataFrame:
    """modules, imports, cyclic components and nodes in them, a scan."""
    cyclic = F.col("in_cycle")
    c = components.groupBy("scan_id").agg(F.count("*").alias("modules"), F.count_distinct(F.when(cyclic, F.col("component"))).alias("cycles"), F.count_if(cyclic).alias("in_cycles"))
    return c.join(edges.groupBy("scan_id").agg(F.count("*").alias("imports")), "scan_id", "left").select("scan_id", "modules", F.coalesce("imports", F.lit(0)).alias("imports"), "cycles", "in_cycles")


def with_lane(functions: DataFrame) -> DataFrame:
    """Adds lane (of the effect) and lane_ord (its place among all lanes)."""
    out = functions.withColumn("lane", classify_effect(F.col("behavioral")))
    return out.withColumn("lane_ord", F.array_position(F.array(*map(F.lit, EFFECT_GROUPS)), F.col("lane")).cast("int"))


def lane_position(functions: DataFrame, collate: str | None = None) -> DataFrame:
    """Adds lane_no (lanes without members are left out) and position: members by file, then name."""
    key = [F.collate(c, collate) if collate else F.col(c) for c in ("file_path", "name")]
    out = with_lane(functions)
    lanes = out.select("scan_id", "lane_ord").distinct().withColumn("lane_no", F.row_number().over(W.partitionBy("scan_id").orderBy("lane_ord")))
    return ranked(out, ["scan_id", "lane_ord"], [*(k.asc() for k in key), F.col("function_id").asc()], "position").join(lanes, ["scan_id", "lane_ord"])


def lane_members(functions: DataFrame) -> DataFrame:
    """scan_id, lane, lane_ord, file_path, members: the functions of each lane, file by file, by name."""
    members = F.transform(F.array_sort(F.collect_list(F.struct("name", "function_id"))), lambda m: m["function_id"])
    return with_lane(functions).groupBy("scan_id", "lane", "lane_ord", "file_path").agg(members.alias("members"))


def effect_group_counts(functions: DataFrame) -> DataFrame:
    return with_lane(functions).groupBy("scan_id", "lane").agg(F.count("*").alias("functions"), F.bool_or(F.col("behavioral").isNotNull()).alias("has_behavioral"))


def view_data_flow(functions: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions in lanes; call edges between them)."""
    edges = calls
    for end in ("source_id", "target_id"):
        edges = edges.join(functions.select("scan_id", F.col("function_id").alias(end)), ["scan_id", end], "left_semi")
    return lane_position(functions), edges


VIEWS = ("folders", "folder", "dependencies", "data-flow")


def build_graph(view: str, scan: dict[str, DataFrame] | None, folder: str | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(nodes, edges) of a view of a scan's tables (files, functions, affected, edges, calls); None without a scan."""
    if scan is None:
        return None
    if view == "folders" and folder is None:
        return view_folders(scan["files"], scan["functions"], scan["affected"]), scan["edges"].limit(0)
    if view in ("folders", "folder"):
        return view_folder(scan["files"], scan["edges"], folder or ".")
    if view == "dependencies":
        return view_dependencies(scan["edges"])
    if view == "data-flow":
        return view_data_flow(scan["functions"], scan["calls"])
    raise ValueError(f"unknown view: {view}")


def folders_of(files: DataFrame) -> DataFrame:
    return files.select("scan_id", folder_of(F.col("file_path")).alias("folder")).distinct()
