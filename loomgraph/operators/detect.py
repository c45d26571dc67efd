"""Finding detectors and report mappers.  Findings: scan_id, id, category, level, title, affected_nodes, source,
confidence, dismissible; the id is made from identity and title, so it is the same in every run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_framework_convention, last_segment, normalize_import_source, normalized_paths, resolve_path_alias
from ..functions.scalars import cycle_is_runtime_harmless, finding_identity, is_entry_point_name, matches_globs
from ..shared import materialise
from ..sources.readers import read_non_ts_files, read_test_files
from .extract import scan_imports
from .graph import cycles, reachable
from .rollup import merge_import_maps

LARGE_FILE_LINES = 500
EXPORT_LIKE, TYPE_LIKE = ("exports", "nsExports"), ("types", "nsTypes")

# Where a project's entry files are, and what no check looks at.
ENTRY_GLOBS = (
    "{index,cli,main}.{js,mjs,cjs,jsx,ts,tsx,mts,cts}",
    "src/{index,cli,main}.{js,mjs,cjs,jsx,ts,tsx,mts,cts}",
    "**/scripts/**/*.{js,mjs,cjs,jsx,ts,tsx,mts,cts}",
    "bin/**/*.{js,mjs,cjs,ts,mts,cts}",
    "*.config.{js,mjs,cjs,ts,mts,cts}",
    "**/*.config.{js,mjs,cjs,ts,mts,cts}",
)
TEST_GLOBS = ("**/*.{test,spec}.{js,jsx,ts,tsx,mjs,cjs,mts,cts}", "**/__tests__/**/*.{js,jsx,ts,tsx}")
IGNORE_GLOBS = (
    "**/node_modules/**",
    "**/dist/**",
    "**/build/**",
    "**/coverage/**",
    "**/.next/**",
    "**/.turbo/**",
    "**/generated/**",
    "**/__generated__/**",
    "**/test-fixtures/**",
    "**/fixtures/**",
    "**/__mocks__/**",
    "**/__fixtures__/**",
    "**/*.d.ts",
)


@dataclass(frozen=True)
class DetectionConfig:
    """Confidence and other constants of each kind of finding."""

    mode: str = "app"
    issue_types: tuple[str, ...] | None = None
    file_confidence: float = 0.9
    export_confidence: float = 0.6
    type_confidence: float = 0.5
    cycle_confidence: float = 0.85
    type_cycle_confidence: float = 0.6
    large_file_confidence: float = 0.95
    entry_globs: tuple[str, ...] = ENTRY_GLOBS
    ignore_globs: tuple[str, ...] = IGNORE_GLOBS
    large_file_lines: int = LARGE_FILE_LINES
    detect: frozenset[str] = field(default_factory=lambda: frozenset({"circular", "orphaned", "unused_exports", "large_files"}))

    def enabled_issue_types(self) -> tuple[str, ...]:
        """Groups of the unused-code report that count; a library's public names aren't dead unless asked for."""
        if self.issue_types is not None:
            return self.issue_types
        every = ("files", "exports", "types")
        return tuple(t for t in every if t not in (*EXPORT_LIKE, *TYPE_LIKE)) if self.mode == "library" else every


def findings(df: DataFrame, category: str, level: Column, title: Column, nodes: Column, source: str, confidence: Column | float, dismissible: bool = True) -> DataFrame:
    c = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    out = df.select("scan_id", F.lit(category).alias("category"), level.alias("level"), title.alias("title"), nodes.alias("affected_nodes"), F.lit(source).alias("source"), c.alias("confidence"), F.lit(dismissible).alias("dismissible"))
    key = F.concat(finding_identity(F.col("source"), F.col("category"), F.col("affected_nodes")), F.lit("\n"), F.col("title"))
    return out.select("scan_id", F.substring(F.sha2(key, 256), 1, 32).alias("id"), *out.columns[1:])


def large_files(files: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """More lines than the threshold; more than twice as many make a warning."""
    big = files.where(F.col("end_line") > config.large_file_lines)
    level = F.when(F.col("end_line") > 2 * config.large_file_lines, "warning").otherwise("info")
    return findings(big, "large_file", level, F.concat(F.lit("Large file: "), "name"), F.array("file_id"), "lines", config.large_file_confidence, False)


def _cycle_findings(cycles: DataFrame, names: DataFrame, kind: str, confidence: float) -> DataFrame:
    """cycles: scan_id, cycle; names: scan_id, node, name."""
    hop = cycles.select("scan_id", "cycle", F.posexplode("cycle").alias("pos", "node")).join(names, ["scan_id", "node"], "left")
    order = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", "node").alias("name")))), lambda s: s["name"])
    named = hop.groupBy("scan_id", "cycle").agg(order.alias("names"))
    shown = F.concat(F.lit(f"Circular {kind}: "), F.array_join(F.concat("names", F.array(F.col("names")[0])), " → "))
    return findings(named, "circular_dependency", F.lit("warning"), shown, F.col("cycle"), "graph", confidence)


def _cycles(edges: DataFrame, every_edge: bool = False) -> DataFrame:
    return materialise(cycles(edges, every_edge).select("scan_id", "cycle"), "cycles")


def _edges_of(connections: DataFrame, kind: str) -> DataFrame:
    return connections.where(F.col("type") == kind).select("scan_id", F.col("source_id").alias("src"), F.col("target_id").alias("dst"))


def file_cycles(connections: DataFrame, files: DataFrame, confidence: float = 0.7, every_edge: bool = False) -> DataFrame:
    """A finding for one cycle of each component; every_edge: for cycles that hold every circular edge."""
    return _cycle_findings(_cycles(_edges_of(connections, "import"), every_edge), files.select("scan_id", F.col("file_id").alias("node"), "name"), "dependency", confidence)


def function_cycles(connections: DataFrame, functions: DataFrame, confidence: float = 0.6, every_edge: bool = False) -> DataFrame:
    return _cycle_findings(_cycles(_edges_of(connections, "function_call"), every_edge), functions.select("scan_id", F.col("function_id").alias("node"), "name"), "call", confidence)


def import_cycles_typed(edges: DataFrame, config: DetectionConfig = DetectionConfig(), every_edge: bool = False) -> DataFrame:
    """Cycles over all imports; one with a type-only edge between its members does no harm at run time.
    edges: scan_id, src, dst, is_type_only; every_edge: see file_cycles."""
    cycles = _cycles(edges, every_edge)
    hops = cycles.select("scan_id", "cycle", F.posexplode("cycle").alias("pos", "src"))
    hops = hops.withColumn("dst", F.element_at("cycle", (F.pmod(F.col("pos") + 1, F.size("cycle")) + 1).cast("int")))
    typed = hops.join(edges.groupBy("scan_id", "src", "dst").agg(F.bool_and("is_type_only").alias("t")), ["scan_id", "src", "dst"])
    harmless = typed.groupBy("scan_id", "cycle").agg(F.bool_or("t").alias("harmless"))
    names = F.transform("cycle", lambda n: F.element_at(F.split(n, "/"), -1))
    title = F.concat(F.lit("Circular dependency: "), F.array_join(F.concat(names, F.array(F.get(names, F.lit(0)))), " → "))
    level = F.when(F.col("harmless"), "info").otherwise("warning")
    confidence = F.when(F.col("harmless"), config.type_cycle_confidence).otherwise(config.cycle_confidence)
    return findings(harmless, "circular_dependency", level, title, F.col("cycle"), "graph", confidence)


def orphaned_functions(functions: DataFrame, connections: DataFrame, files: DataFrame, conventions: bool = True, confidence: float = 0.3) -> DataFrame:
    """Functions that nothing calls or names: not exported, no method, no entry point."""
    name = F.col("name")
    left = functions.where(~F.col("is_exported") & F.col("parent_class_id").isNull() & ~is_entry_point_name(name))
    if conventions:
        left = left.where(~is_framework_convention(name, F.col("file_path")))
    called = connections.where("type = 'function_call'").select("scan_id", F.col("target_id").alias("function_id")).distinct()
    named = files.select("scan_id", F.col("file_id").alias("parent_file_id"), F.explode("top_level_references").alias("name")).distinct()
    left = left.join(called, ["scan_id", "function_id"], "left_anti").join(named, ["scan_id", "parent_file_id", "name"], "left_anti")
    return findings(left, "orphaned_code", F.lit("info"), F.concat(F.lit("Potentially unused: "), name), F.array("function_id"), "graph", confidence)


def _under(df: DataFrame) -> DataFrame:
    """df once for the file's path without extension and, for an index file, once for its directory: column barrel."""
    p = normalized_paths(F.col("file_path"))
    return df.withColumn("barrel", F.explode(F.filter(F.array(p["path"], p["dir"]), lambda x: x.isNotNull())))


def _target(df: DataFrame, aliases: DataFrame) -> DataFrame:
    return resolve_path_alias(df, aliases).withColumn("target", normalize_import_source(F.col("resolved"), F.col("file_path"))).drop("resolved")


def reexport_map(exports: DataFrame, aliases: DataFrame) -> DataFrame:
    """scan_id, barrel, exported -> target, original: named re-exports under the barrel's path and directory."""
    rows = _target(exports.where("kind = 'reexport' and name <> '*' and source is not null"), aliases)
    return _under(rows).select("scan_id", "barrel", F.coalesce("alias", "name").alias("exported"), "target", F.col("name").alias("original")).distinct()


def star_reexports(exports: DataFrame, aliases: DataFrame) -> DataFrame:
    rows = _target(exports.where("kind = 'reexport' and name = '*' and source is not null"), aliases)
    return _under(rows).select("scan_id", "barrel", "target").distinct()


def used_names(imports: DataFrame, items: DataFrame, aliases: DataFrame) -> DataFrame:
    """scan_id, source, name: what imports (type-only ones too) take from each path; `*` for namespaces, `default`."""
    at = _target(imports, aliases).select("scan_id", "file_id", "stmt_ord", F.col("target").alias("source"))
    name = F.when(F.col("is_namespace"), "*").when(F.col("is_default"), "default").otherwise(F.col("name"))
    return at.join(items, ["scan_id", "file_id", "stmt_ord"]).select("scan_id", "source", name.alias("name")).distinct()


def unused_exports(
    exports: DataFrame, imports: DataFrame, items: DataFrame, aliases: DataFrame, other_uses: DataFrame | None = None, transitive: bool = False, confidence: float = 0.4
) -> DataFrame:
    """Value exports that no import takes.  A barrel passes the names taken from it on to the files behind it, one level
    (or, with transitive, as far as they go); other_uses (scan_id, source, name) come from tests and other files."""
    used = materialise(used_names(imports, items, aliases), "used-names")
    named, stars = reexport_map(exports, aliases), star_reexports(exports, aliases)

    def credit(uses: DataFrame) -> DataFrame:
        at = uses.select("scan_id", F.col("source").alias("barrel"), "name")
        by_name = at.withColumnRenamed("name", "exported").join(named, ["scan_id", "barrel", "exported"]).select("scan_id", F.col("target").alias("source"), F.col("original").alias("name"))
        by_star = at.where("name <> '*'").join(stars, ["scan_id", "barrel"]).select("scan_id", F.col("target").alias("source"), "name")
        return by_name.unionByName(by_star).distinct()

    more = credit(used)
    # read twice below, and it holds the resolution of all imports
    used = materialise(merge_import_maps(used, more, *([other_uses] if other_uses is not None else [])), "used-names")
    while transitive:
        more = credit(more).join(used, ["scan_id", "source", "name"], "left_anti")
        if more.isEmpty():
            break
        used = merge_import_maps(used, more)
    path = F.col("file_path")
    own = exports.where(~F.col("is_type_only") & ~F.col("kind").isin("reexport", "type", "interface") & ~last_segment(path).rlike(r"^index\.(ts|js)$"))
    name = F.when(F.col("is_default"), "default").otherwise(F.coalesce("alias", "name"))
    own = own.withColumn("used_as", name).where(~is_framework_convention(name, path)).withColumn("source", normalized_paths(path)["path"])
    left = own.join(used.where("name = '*'").select("scan_id", "source").distinct(), ["scan_id", "source"], "left_anti")
    left = left.join(used.select("scan_id", "source", F.col("name").alias("used_as")), ["scan_id", "source", "used_as"], "left_anti")
    return findings(left, "unused_export", F.lit("info"), F.concat(F.lit("Unused export: "), "name"), F.array("file_id"), "graph", confidence)


def union_findings(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedupe_cycles(cycles: DataFrame, members: str = "members") -> DataFrame:
    """Cycles of the same members once, the first in order of its text."""
    key = F.array_join(F.array_sort(members), "|")
    return cycles.withColumn("_key", key).groupBy("scan_id", "_key").agg(F.min(members).alias(members)).drop("_key")


def entry_files(files: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    path = F.col("file_path")
    return files.where(matches_globs(path, (*config.entry_globs, *TEST_GLOBS)) & ~matches_globs(path, config.ignore_globs))


def unused_files(files: DataFrame, edges: DataFrame, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Files that no entry file leads to; edges: scan_id, src, dst (files)."""
    seeds = entry_files(files, config).select("scan_id", F.col("file_id").alias("node"))
    left = files.where(~matches_globs(F.col("file_path"), config.ignore_globs)).join(reachable(seeds, edges).withColumnRenamed("node", "file_id"), ["scan_id", "file_id"], "left_anti")
    return findings(left, "orphaned_code", F.lit("info"), F.concat(F.lit("Unused file: "), "file_path"), F.array("file_id"), "graph", config.file_confidence)


def other_uses(tree: DataFrame, aliases: DataFrame, tests: bool = False) -> DataFrame:
    """scan_id, source, name: what components and documents (and, when asked for, test files) of a source tree import."""
    uses = scan_imports(read_non_ts_files(tree), aliases)
    return uses.unionByName(scan_imports(read_test_files(tree), aliases)).distinct() if tests else uses


def detect_warnings(
    files: DataFrame, functions: DataFrame, exports: DataFrame, imports: DataFrame, items: DataFrame, aliases: DataFrame, connections: DataFrame,
    config: DetectionConfig = DetectionConfig(), other_uses: DataFrame | None = None,
) -> DataFrame:
    """All detectors that the configuration asks for; other_uses: names that files outside the graph take."""
    parts = []
    if "circular" in config.detect:
        parts += [file_cycles(connections, files), function_cycles(connections, functions)]
    if "orphaned" in config.detect:
        parts.append(orphaned_functions(functions, connections, files))
    if "unused_exports" in config.detect:
        parts.append(unused_exports(exports, imports, items, aliases, other_uses))
    if "large_files" in config.detect:
        parts.append(large_files(files, config))
    return union_findings(*parts) if parts else large_files(files.limit(0), config)


# Reports of external tools

_SYMBOL = "array<struct<name:string,line:int,col:int,pos:int>>"
UNUSED_REPORT = f"issues array<struct<file:string,files:array<struct<name:string>>,exports:{_SYMBOL},types:{_SYMBOL},nsExports:{_SYMBOL},nsTypes:{_SYMBOL}>>"
CYCLE_REPORT = (
    "summary struct<violations:array<struct<type:string,`from`:string,`to`:string,dependencyTypes:array<string>,"
    "rule:struct<name:string,severity:string>,cycle:array<struct<name:string,dependencyTypes:array<string>>>>>>"
)


def read_engine_reports(reports: DataFrame) -> DataFrame:
    """Adds unused and cycles (parsed, or null) and error; reports: scan_id, kind (`unused` or `cycles`), content."""
    unused, cycles = F.from_json("content", UNUSED_REPORT), F.from_json("content", CYCLE_REPORT)
    kind = F.col("kind")
    # rows that aren't arrays parse to null
    out = reports.withColumn("unused", F.when((kind == "unused") & unused["issues"].isNotNull(), unused))
    out = out.withColumn("cycles", F.when((kind == "cycles") & cycles["summary"]["violations"].isNotNull(), cycles))
    bad = F.col("unused").isNull() & F.col("cycles").isNull()
    return out.withColumn("error", F.when(bad, F.concat(F.lit("unexpected report: "), kind)))


def _resolved(df: DataFrame, files: DataFrame | None) -> DataFrame:
    """df (scan_id, path, ...) with node: the file's id, or the path."""
    if files is None:
        return df.withColumn("node", F.col("path"))
    known = files.select("scan_id", F.col("file_path").alias("path"), F.col("file_id").alias("_id"))
    return df.join(known, ["scan_id", "path"], "left").withColumn("node", F.coalesce("_id", "path")).drop("_id")


def map_unused_report(parsed: DataFrame, config: DetectionConfig = DetectionConfig(), files: DataFrame | None = None) -> DataFrame:
    """Findings of unused-code reports: files, exports and types, as far as the configuration counts them."""
    issue = parsed.where("unused is not null").select("scan_id", F.explode("unused.issues").alias("i"))
    parts, on = [], config.enabled_issue_types()
    if "files" in on:
        rows = _resolved(issue.select("scan_id", F.explode("i.files.name").alias("path")), files)
        parts.append(findings(rows, "orphaned_code", F.lit("info"), F.concat(F.lit("Unused file: "), "path"), F.array("node"), "report", config.file_confidence))
    for groups, label, confidence in ((EXPORT_LIKE, "export", config.export_confidence), (TYPE_LIKE, "type export", config.type_confidence)):
        for group in groups:
            if group in on:
                rows = _resolved(issue.select("scan_id", F.col("i.file").alias("path"), F.explode(f"i.{group}.name").alias("symbol")), files)
                parts.append(findings(rows, "unused_export", F.lit("info"), F.concat(F.lit(f"Unused {label}: "), "symbol"), F.array("node"), "report", confidence))
    empty = findings(issue.select("scan_id", F.lit("").alias("x")).limit(0), "", F.lit(""), F.lit(""), F.array(F.lit("")), "report", 0.0)
    return union_findings(*(parts or [empty]))


def map_cycle_report(parsed: DataFrame, config: DetectionConfig = DetectionConfig(), files: DataFrame | None = None) -> DataFrame:
    """Findings of cycle reports, one for each set of members: the one that stands first in its report, then the least."""
    v = parsed.where("cycles is not null").select("scan_id", F.posexplode("cycles.summary.violations").alias("ord", "v"))
    v = v.where((F.col("v.rule.name") == "no-circular") | (F.col("v.type") == "cycle"))
    hops = F.transform("v.cycle", lambda h: h["name"])
    members = F.when(F.coalesce(F.size("v.cycle"), F.lit(0)) > 0, hops).otherwise(F.array("v.from", "v.to"))
    members = F.filter(members, lambda m: m.isNotNull() & (m != ""))
    rows = v.select("scan_id", "ord", members.alias("members"), cycle_is_runtime_harmless(F.col("v.cycle"), F.col("v.dependencyTypes")).alias("harmless"))
    rows = rows.where(F.size("members") > 0).withColumn("key", F.array_join(F.array_sort("members"), "|"))
    first = rows.groupBy("scan_id", "key").agg(F.min_by(F.struct("members", "harmless"), F.struct("ord", "members")).alias("r")).select("scan_id", "key", "r.members", "r.harmless")
    hop = _resolved(first.select("scan_id", "key", F.posexplode("members").alias("pos", "path")), files)
    nodes = hop.groupBy("scan_id", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda s: s["node"]).alias("nodes"))
    out = first.join(nodes, ["scan_id", "key"])
    names = F.transform("members", lambda m: F.element_at(F.split(m, "/"), -1))
    title = F.concat(F.lit("Circular dependency: "), F.array_join(F.concat(names, F.array(F.get(names, F.lit(0)))), " → "))
    level = F.when(F.col("harmless"), "info").otherwise("warning")
    confidence = F.when(F.col("harmless"), config.type_cycle_confidence).otherwise(config.cycle_confidence)
    return findings(out, "circular_dependency", level, title, F.col("nodes"), "report", confidence)


def external_detection(reports: DataFrame, files: DataFrame, edges: DataFrame, config: DetectionConfig = DetectionConfig()) -> tuple[DataFrame, DataFrame]:
    """(findings, errors): own detection of unused files and cycles with what the reports say; a bad report is an error row."""
    parsed = materialise(read_engine_reports(reports).select("scan_id", "kind", "unused", "cycles", "error"), "reports")  # each text is parsed once
    good = union_findings(
        unused_files(files, edges, config), import_cycles_typed(edges, config), map_unused_report(parsed, config, files), map_cycle_report(parsed, config, files)
    )
    return good, parsed.where("error is not null").select("scan_id", "kind", "error")
