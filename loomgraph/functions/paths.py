"""Path and import-source functions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions that an import source may leave out.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx")
_EXT = r"\.(ts|tsx|js|jsx)$"


def normalize_file_path(path: Column) -> Column:
    return F.regexp_replace(path, _EXT, "")


def folder_of(path: Column) -> Column:
    """The parent folder; `.` at the root."""
    return F.when(F.instr(path, "/") == 0, F.lit(".")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def normalized_paths(path: Column) -> Column:
    """struct(path, dir): the path without extension, and the directory when the file is its index."""
    bare = normalize_file_path(path)
    return F.struct(bare.alias("path"), F.when(bare.endswith("/index"), F.regexp_replace(bare, "/index$", "")).alias("dir"))


def normalize_import_source(source: Column, importer: Column) -> Column:
    """Relative sources against the importing file's directory, `.` and `..` folded; others as they are; no extension.
    `..` above the root falls away."""
    folder = F.when(F.instr(importer, "/") > 0, F.regexp_replace(importer, "/[^/]*$", "")).otherwise(F.lit(""))
    parts = F.filter(F.split(F.concat_ws("/", folder, source), "/"), lambda p: (p != "") & (p != "."))
    up = lambda acc: F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    return normalize_file_path(F.when(source.startswith("."), F.array_join(folded, "/")).otherwise(source))


def is_relative(source: Column) -> Column:
    return source.startswith(".") | source.startswith("/")


def resolve_path_alias(imports: DataFrame, aliases: DataFrame, source: str = "source") -> DataFrame:
    """Adds `resolved`: the first alias (in order) whose pattern fits gives its first target, `*` put in; else the source.

    The aliases of a scan are few; they are folded to one array a scan, so imports meet one row each.
    """
    first = aliases.groupBy("scan_id", "alias").agg(F.min_by("target", "alias_ord").alias("target"), F.min("alias_ord").alias("ord"))
    folded = first.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("ord", "alias", "target"))).alias("_aliases"))
    src = F.col(source)

    def fits(a: Column) -> Column:
        star, head, tail = F.instr(a["alias"], "*"), F.substring_index(a["alias"], "*", 1), F.substring_index(a["alias"], "*", -1)
        wild = src.startswith(head) & src.endswith(tail) & (F.length(src) >= F.length(head) + F.length(tail))
        return F.when(star > 0, wild).otherwise(src == a["alias"])

    hit = F.get(F.filter("_aliases", fits), F.lit(0))
    head, tail = F.substring_index(hit["alias"], "*", 1), F.substring_index(hit["alias"], "*", -1)
    middle = src.substr(F.length(head) + 1, F.length(src) - F.length(head) - F.length(tail))
    filled = F.when(F.instr(hit["alias"], "*") > 0, F.concat(F.substring_index(hit["target"], "*", 1), middle, F.when(F.instr(hit["target"], "*") > 0, F.substring_index(hit["target"], "*", -1)).otherwise(""))).otherwise(hit["target"])
    resolved = F.coalesce(F.regexp_replace(filled, r"^\./", ""), src)
    return imports.join(folded, "scan_id", "left").withColumn("resolved", resolved).drop("_aliases")


def is_external_import(source: Column, resolved: Column) -> Column:
    return ~is_relative(source) & (source == resolved)


# Build tools' configuration files, and the exports a web framework looks for, by kinds of file.
CONFIG_FILES = r"^((next|vitest|vite|jest|tailwind|postcss|eslint)\.config\.(ts|js|mjs)|tsconfig\..*\.json)$"
FRAMEWORK_EXPORTS = (
    (("page", "layout", "route"), ("dynamic", "revalidate", "fetchCache", "runtime", "preferredRegion", "maxDuration")),
    (("page", "layout"), ("metadata", "generateMetadata")),
    (("layout",), ("viewport", "generateViewport")),
    (("page",), ("generateStaticParams",)),
    (("route",), ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")),
    (("middleware",), ("middleware",)),
    (("middleware", "route"), ("config",)),
    (("manifest",), ("manifest",)),
    (("error", "loading", "not-found", "layout", "page", "template", "manifest"), ("default",)),
)


def is_framework_convention(name: Column, path: Column) -> Column:
    """Exports that a build tool or a web framework uses without importing them."""
    hit = last_segment(path).rlike(CONFIG_FILES)
    for kinds, names in FRAMEWORK_EXPORTS:
        hit |= name.isin(*names) & path.rlike(rf"({'|'.join(kinds)})\.(tsx?|jsx?)$")
    return hit
