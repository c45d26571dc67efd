"""Resolution of imports, calls and inheritance to edges, by joins on (scan_id, key)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import EXTENSIONS, is_external_import, normalize_file_path, normalize_import_source, normalized_paths, resolve_path_alias
from ..shared import materialise
from .rollup import runtime_imports


#: Rows (imports, functions, classes) whose edges are looked for at a time.
SLICE = 4_000_000


def _sliced(tables: list[tuple[DataFrame, str]], find: Callable[..., DataFrame]) -> DataFrame:
    """find(*tables), slice after slice of the files, so that the shuffles of one slice are on the disk at a time; in one go
    where the rows of the first are few.  tables: each with the column that names a row's file; they should be written, as
    they are read once a slice."""
    slices = -(-tables[0][0].count() // SLICE)
    if slices <= 1:
        return find(*(df for df, _ in tables))
    mine = lambda n: (df.where(F.pmod(F.xxhash64("scan_id", key), F.lit(slices)) == n) for df, key in tables)
    return functools.reduce(DataFrame.unionByName, [materialise(find(*mine(n)), "slice") for n in range(slices)])


def file_path_index(files: DataFrame) -> DataFrame:
    """scan_id, key, file_id: a file under its path, its path without extension and, for an index, its directory; of
    several files the last in order has the key.  files: scan_id, file_id, file_path, file_ord."""
    path = F.col("file_path")
    both = normalized_paths(path)
    keys = F.filter(F.array_distinct(F.array(path, both["path"], both["dir"])), lambda k: k.isNotNull())
    rows = files.select("scan_id", "file_id", "file_ord", F.explode(keys).alias("key"))
    return rows.groupBy("scan_id", "key").agg(F.max_by("file_id", F.struct("file_ord", "file_id")).alias("file_id"))


def _stems(index: DataFrame) -> DataFrame:
    """scan_id, base, target_file_id: the file that an import of a base leads to; of the keys that may stand for it (as
    written, with each extension, as a directory) the first."""
    key = F.col("key")
    ends = [(0, ""), *enumerate(EXTENSIONS, 1), (len(EXTENSIONS) + 1, "/index")]
    cut = lambda end: key.substr(F.lit(1), F.length(key) - len(end))
    bases = F.array(*(F.when(key.endswith(end), F.struct(F.lit(n).alias("cand_ord"), cut(end).alias("base"))) for n, end in ends))
    rows = index.select("scan_id", "file_id", F.explode(F.filter(bases, lambda b: b.isNotNull())).alias("b"))
    return rows.groupBy("scan_id", F.col("b.base").alias("base")).agg(F.min_by("file_id", "b.cand_ord").alias("target_file_id"))


def resolve_imports(imports: DataFrame, aliases: DataFrame, index: DataFrame) -> DataFrame:
    """Adds target_file_id to imports that lead to a file; external ones and those without a file are left out.

    imports: scan_id, file_id, file_path, stmt_ord, source, ...; candidates are tried in a fixed order: as written, with
    each extension, as a directory.
    """
    src, resolved = F.col("source"), F.col("resolved")
    local = resolve_path_alias(imports, aliases).where(~is_external_import(src, resolved))
    local = local.withColumn("base", normalize_import_source(resolved, F.col("file_path"))).where("base <> ''").drop("resolved")
    return local.join(_stems(index), ["scan_id", "base"]).drop("base")


def _edges(df: DataFrame, kind: str) -> DataFrame:
    """scan_id, source_id, target_id, weight -> connections of one type."""
    name = F.concat_ws(":", F.lit("conn"), F.lit(kind), "source_id", "target_id")
    return df.select("scan_id", name.alias("conn_id"), "source_id", "target_id", F.lit(kind).alias("type"), F.col("weight").cast("long").alias("weight"))


def import_connections(imports: DataFrame, aliases: DataFrame, index: DataFrame) -> DataFrame:
    """One edge for each pair of files; its weight is the number of items of the first statement, 1 at least."""
    return _import_edges(resolve_imports(runtime_imports(imports), aliases, index))


def _import_edges(found: DataFrame) -> DataFrame:
    weight = F.min_by(F.greatest(F.col("n_items"), F.lit(1)), F.col("stmt_ord"))
    pairs = found.where("file_id <> target_file_id").groupBy("scan_id", F.col("file_id").alias("source_id"), F.col("target_file_id").alias("target_id")).agg(weight.alias("weight"))
    return _edges(pairs, "import")


def import_scope(imports: DataFrame, items: DataFrame, aliases: DataFrame, index: DataFrame) -> DataFrame:
    """scan_id, file_id, local_name -> target_file_id, original_name, is_default; the last import of a name wins."""
    found = resolve_imports(runtime_imports(imports), aliases, index).select("scan_id", "file_id", "stmt_ord", "target_file_id")
    return _scope(materialise(found, "resolved"), items)


def _scope(found: DataFrame, items: DataFrame) -> DataFrame:
    local = F.coalesce("alias", "name")
    last = F.max_by(F.struct("target_file_id", F.col("name").alias("original_name"), "is_default"), F.struct("stmt_ord", "item_ord"))

    def find(found: DataFrame, items: DataFrame) -> DataFrame:
        rows = found.drop("n_items").join(items.where("not is_namespace"), ["scan_id", "file_id", "stmt_ord"])
        return rows.groupBy("scan_id", "file_id", local.alias("local_name")).agg(last.alias("t")).select("scan_id", "file_id", "local_name", "t.*")

    return _sliced([(found, "file_id"), (items, "file_id")], find)


def exported_functions(functions: DataFrame, exports: DataFrame) -> DataFrame:
    """scan_id, file_id, name -> function_id: exported functions, and those that a default export names."""
    own = functions.select("scan_id", F.col("parent_file_id").alias("file_id"), "name", "function_id", "fn_ord", "is_exported")
    default = exports.where("is_default").select("scan_id", "file_id", "name").distinct()
    rows = own.where("is_exported").drop("is_exported").unionByName(own.join(default, ["scan_id", "file_id", "name"], "left_semi").drop("is_exported"))
    return rows.groupBy("scan_id", "file_id", "name").agg(F.max_by("function_id", F.struct("fn_ord", "function_id")).alias("function_id"))


def exported_classes(classes: DataFrame) -> DataFrame:
    rows = classes.where("is_exported")
    return rows.groupBy("scan_id", F.col("parent_file_id").alias("file_id"), "name").agg(F.max_by("class_id", F.struct("cls_ord", "class_id")).alias("class_id"))


def local_functions(functions: DataFrame) -> DataFrame:
    """The first function of a name in its file, methods included."""
    return functions.groupBy("scan_id", F.col("parent_file_id").alias("file_id"), "name").agg(F.min_by("function_id", F.struct("fn_ord", "function_id")).alias("function_id"))


def _imported(scope: DataFrame, exported: DataFrame, id_col: str, fix_aliases: bool) -> DataFrame:
    """What a local name stands for in the file it comes from.  Exports are looked up by the local name, so renamed
    imports find nothing, unless fix_aliases asks for the original name."""
    looked = F.col("original_name") if fix_aliases else F.col("local_name")
    names = scope.select("scan_id", "file_id", F.col("local_name").alias("name"), F.col("target_file_id").alias("_file"), looked.alias("_name"))
    out = exported.select("scan_id", F.col("file_id").alias("_file"), F.col("name").alias("_name"), F.col(id_col).alias("imported_id"))
    return names.join(out, ["scan_id", "_file", "_name"]).select("scan_id", "file_id", "name", "imported_id")


def call_connections(functions: DataFrame, exports: DataFrame, scope: DataFrame, fix_aliases: bool = False) -> DataFrame:
    """Each reference of a function to a function of its file (not itself), else to an imported one."""
    brought = materialise(_imported(scope, exported_functions(functions, exports), "function_id", fix_aliases), "imported")

    def find(own: DataFrame) -> DataFrame:
        """Of the functions of some files: references stay in the file or go by what it imports."""
        refs = own.select("scan_id", F.col("function_id").alias("source_id"), F.col("parent_file_id").alias("file_id"), F.explode("references").alias("name"))
        local = local_functions(own).withColumnRenamed("function_id", "local_id")
        there = refs.join(local, ["scan_id", "file_id", "name"], "left").where("local_id is null or local_id <> source_id")
        there = there.join(brought, ["scan_id", "file_id", "name"], "left")
        pairs = there.withColumn("target_id", F.coalesce("local_id", "imported_id")).where("target_id is not null and target_id <> source_id")
        return pairs.groupBy("scan_id", "source_id", "target_id").agg(F.count("*").alias("weight"))

    return _edges(_sliced([(functions, "parent_file_id")], find), "function_call")


def inheritance_connections(classes: DataFrame, scope: DataFrame, fix_aliases: bool = False) -> DataFrame:
    """extends and implements to a class of the file (not itself), else to an imported exported class."""
    up = F.filter(F.concat(F.array("extends"), F.coalesce("implements", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    brought = materialise(_imported(scope, exported_classes(classes), "class_id", fix_aliases), "imported")

    def find(own: DataFrame) -> DataFrame:
        refs = own.select("scan_id", F.col("class_id").alias("source_id"), F.col("parent_file_id").alias("file_id"), F.explode(up).alias("name"))
        local = own.groupBy("scan_id", F.col("parent_file_id").alias("file_id"), "name").agg(F.max_by("class_id", F.struct("cls_ord", "class_id")).alias("local_id"))
        there = refs.join(local, ["scan_id", "file_id", "name"], "left").join(brought, ["scan_id", "file_id", "name"], "left")
        own_id = F.when(F.col("local_id") != F.col("source_id"), F.col("local_id"))
        pairs = there.withColumn("target_id", F.coalesce(own_id, "imported_id")).where("target_id is not null")
        return pairs.groupBy("scan_id", "source_id", "target_id").agg(F.lit(1).alias("weight"))

    return _edges(_sliced([(classes, "parent_file_id")], find), "inheritance")


def build_connections(
    files: DataFrame, imports: DataFrame, items: DataFrame, exports: DataFrame, functions: DataFrame, classes: DataFrame, aliases: DataFrame
) -> DataFrame:
    """All edges of a scan.  What several kinds of edges need is written once, and each kind before the next is looked for,
    so that the shuffles of one step are on the disk at a time."""
    found = resolve_imports(runtime_imports(imports), aliases, file_path_index(files))
    found = materialise(found.select("scan_id", "file_id", "stmt_ord", "target_file_id", "n_items"), "resolved")
    scope = materialise(_scope(found, items), "scope")
    parts = [_import_edges(found), call_connections(functions, exports, scope), inheritance_connections(classes, scope)]
    out = [materialise(p, "connections") for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])
