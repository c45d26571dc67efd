"""Small projects written out as tables, with the results they are known to have."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths as P
from loomgraph.operators import detect as D
from loomgraph.operators import extract as X
from loomgraph.operators import graph as G
from loomgraph.operators import resolve as J

ALIAS = "scan_id string, alias string, alias_ord int, target string"
IMPORT = "scan_id string, file_id string, file_path string, stmt_ord int, source string, is_type_only boolean, n_items int"
ITEM = "scan_id string, file_id string, stmt_ord int, item_ord int, name string, alias string, is_default boolean, is_namespace boolean"
EXPORT = "scan_id string, file_id string, file_path string, exp_ord int, name string, alias string, is_default boolean, is_type_only boolean, kind string, source string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def project(spark, sources):
    """files table (and content) of a dict path -> text."""
    return spark.createDataFrame([("s", p, c) for p, c in sources.items()], "scan_id string, file_path string, content string")


@pytest.mark.parametrize(
    "source, importer, expected",
    [("../../lib/helper", "src/features/auth/login.ts", "src/lib/helper"), ("./config", "index.ts", "config"), ("react", "a.ts", "react"), ("./x.tsx", "a/b.ts", "a/x"), ("../../../z", "a/b.ts", "z")],
)
def test_normalize_import_source(spark, source, importer, expected):
    assert one(spark, P.normalize_import_source(F.lit(source), F.lit(importer))) == expected


@pytest.mark.parametrize("path, expected", [("src/components/ui/index.ts", ("src/components/ui/index", "src/components/ui")), ("src/utils/reindex.ts", ("src/utils/reindex", None))])
def test_normalized_paths(spark, path, expected):
    assert tuple(one(spark, P.normalized_paths(F.lit(path)))) == expected


def test_folder_of_root(spark):
    assert one(spark, P.folder_of(F.lit("index.ts"))) == "."


def test_aliases_first_alias_and_first_target(spark):
    aliases = spark.createDataFrame([("s", "@/*", 0, "./src/*"), ("s", "@/*", 1, "./lib/*"), ("s", "@/utils", 2, "never")], ALIAS)
    imports = spark.createDataFrame([("s", "@/components/Foo"), ("s", "@/utils"), ("s", "react"), ("t", "@/x")], "scan_id string, source string")
    got = {(r.scan_id, r.source): r.resolved for r in P.resolve_path_alias(imports, aliases).collect()}
    assert got == {("s", "@/components/Foo"): "src/components/Foo", ("s", "@/utils"): "src/utils", ("s", "react"): "react", ("t", "@/x"): "@/x"}


SAMPLE = {
    "src/services/userService.ts": "import { db, query } from '../database';\nimport { User, CreateUserInput } from '../types/user';\nimport { hashPassword } from '../utils/crypto';\n\n"
    "export async function createUser(input: CreateUserInput): Promise<User> {\n  const hashed = await hashPassword(input.password);\n  return db.users.create(hashed);\n}\n\n"
    "export async function getUserById(id: string): Promise<User | null> {\n  return query<User>('SELECT', [id]);\n}\n",
    "src/services/authService.ts": "import { getUserById } from './userService';\nimport { signToken } from '../utils/jwt';\n\nexport function validateToken(token: string) {\n  return verify(token);\n}\n\n"
    "export async function refreshToken(token: string) {\n  const payload = validateToken(token);\n  return signToken(payload);\n}\n\nexport async function login(email: string) {\n  return getUserById(email);\n}\n",
    "src/database/index.ts": "export const db = {};\nexport function query(sql: string) {\n  return sql;\n}\n",
    "src/types/user.ts": "export interface User {\n  id: string;\n}\nexport interface CreateUserInput {\n  password: string;\n}\n",
    "src/utils/crypto.ts": "export async function hashPassword(password: string) {\n  return password;\n}\n",
    "src/utils/jwt.ts": "export function signToken(payload: object): string {\n  return 'x';\n}\n",
}


def sample_tables(spark):
    src = project(spark, SAMPLE)
    imports, items = X.extract_imports(src)
    functions, (classes, _) = X.extract_functions(src), X.extract_classes(src)
    files = src.select("scan_id", X.file_id(F.col("file_path")).alias("file_id"), "file_path", F.col("file_path").alias("file_ord"))
    return files, imports, items, X.extract_exports(src), functions, classes, spark.createDataFrame([], ALIAS)


def test_sample_project_edges(spark):
    edges = {(r.type, r.source_id, r.target_id): r.weight for r in J.build_connections(*sample_tables(spark)).collect()}
    user, auth = "file:src/services/userService.ts", "file:src/services/authService.ts"
    assert edges[("import", user, "file:src/database/index.ts")] == 2
    assert ("import", auth, user) in edges
    calls = {(s.split(":")[3], t.split(":")[3]) for (k, s, t) in edges if k == "function_call"}
    assert {("createUser", "hashPassword"), ("refreshToken", "validateToken"), ("refreshToken", "signToken"), ("login", "getUserById"), ("getUserById", "query")} == calls
    assert all(w >= 1 for w in edges.values())


def test_edges_do_not_depend_on_partitions_and_scans_stay_apart(spark):
    tables = sample_tables(spark)
    base = sorted(map(tuple, J.build_connections(*tables).collect()))
    twice = [t.unionByName(t.withColumn("scan_id", F.lit("u"))).repartition(7) if "scan_id" in t.columns else t for t in tables]
    both = sorted(map(tuple, J.build_connections(*twice).collect()))
    assert [r for r in both if r[0] == "s"] == base and [("s", *r[1:]) for r in both if r[0] == "u"] == base


UNUSED = {
    "barrel.ts": "export { reExported } from './source';\nexport * from './star-source';\n",
    "consumer.ts": "import { usedDirect } from './lib';\nimport { reExported } from './barrel';\nimport { starFn } from './barrel';\nimport * as ns from './namespace-target';\n",
    "index.ts": "export function indexOnlyExport() {\n}\n",
    "lib.ts": "export function usedDirect() {\n}\nexport function unusedFn() {\n}\nexport type UnusedType = string;\nexport interface UnusedIface {\n}\n",
    "namespace-target.ts": "export function nsA() {\n}\nexport function nsB() {\n}\n",
    "page.tsx": "export const metadata = {};\nexport function pageHelper() {\n}\nexport default function Page() {\n}\n",
    "source.ts": "export function reExported() {\n}\n",
    "star-source.ts": "export function starFn() {\n}\n",
    "vite.config.ts": "export default {};\n",
}


def test_unused_exports_exact_set(spark):
    src = project(spark, UNUSED)
    imports, items = X.extract_imports(src)
    out = D.unused_exports(X.extract_exports(src), imports, items, spark.createDataFrame([], ALIAS))
    assert sorted(r.title for r in out.collect()) == ["Unused export: pageHelper", "Unused export: unusedFn"]


def edges_of(spark, pairs, typed=()):
    return spark.createDataFrame([("s", a, b, (a, b) in typed) for a, b in pairs], "scan_id string, src string, dst string, is_type_only boolean")


@pytest.mark.parametrize("small", [300, 0])
def test_scc_bridge(spark, monkeypatch, small):
    monkeypatch.setattr(G, "SMALL_CORE", small)
    e = edges_of(spark, [("A", "B"), ("B", "A"), ("C", "D"), ("D", "C"), ("B", "C"), ("x", "x"), ("p", "q"), ("q", "r"), ("z", "gone")])
    nodes = spark.createDataFrame([("s", n) for n in "ABCDxpqrz"], "scan_id string, node string")
    c = G.scc(nodes, e)
    got = {r.node: (r.component, r.size, r.in_cycle) for r in c.collect()}
    assert got["A"] == got["B"] == ("A", 2, True) and got["C"] == got["D"] == ("C", 2, True)
    assert got["x"] == ("x", 1, True) and got["p"] == ("p", 1, False) and got["z"] == ("z", 1, False)
    circular = {(r.src, r.dst): r.circular for r in G.circular_edges(e, c).collect()}
    assert circular[("A", "B")] and circular[("C", "D")] and not circular[("B", "C")] and circular[("x", "x")]
    cycles = {r.component: r.cycle for r in G.find_cycles(e, c).collect()}
    assert cycles == {"A": ["A", "B"], "C": ["C", "D"], "x": ["x"]}


def test_file_cycle_finding(spark):
    conn = spark.createDataFrame([("s", "a", "b", "import"), ("s", "b", "a", "import")], "scan_id string, source_id string, target_id string, type string")
    files = spark.createDataFrame([("s", "a", "a.ts"), ("s", "b", "b.ts")], "scan_id string, file_id string, name string")
    (f,) = D.file_cycles(conn, files).collect()
    assert f.level == "warning" and f.affected_nodes == ["a", "b"] and f.title == "Circular dependency: a.ts → b.ts → a.ts"


def test_typed_cycle_is_info(spark):
    rows = {r.affected_nodes[0]: r for r in D.import_cycles_typed(edges_of(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], typed={("a", "b")})).collect()}
    assert (rows["a"].level, rows["a"].confidence) == ("info", 0.6) and (rows["c"].level, rows["c"].confidence) == ("warning", 0.85)


@pytest.mark.parametrize("lines, level", [(500, None), (501, "info"), (1000, "info"), (1001, "warning")])
def test_large_file_thresholds(spark, lines, level):
    files = spark.createDataFrame([("s", "f", "f.ts", lines)], "scan_id string, file_id string, name string, end_line int")
    assert [r.level for r in D.large_files(files).collect()] == ([level] if level else [])


def test_unused_files_of_planted_project(spark):
    paths = ["src/index.ts", "src/hasUnusedExport.ts", "src/cycleA.ts", "src/cycleB.ts", "src/orphan.ts", "src/generated/api.ts", "src/x.test.ts"]
    files = spark.createDataFrame([("s", p, p) for p in paths], "scan_id string, file_id string, file_path string")
    e = edges_of(spark, [("src/index.ts", "src/hasUnusedExport.ts"), ("src/index.ts", "src/cycleA.ts"), ("src/cycleA.ts", "src/cycleB.ts"), ("src/cycleB.ts", "src/cycleA.ts")])
    assert [r.affected_nodes for r in D.unused_files(files, e).collect()] == [["src/orphan.ts"]]


def test_reports(spark):
    unused = '{"issues":[{"file":"a.ts","files":[{"name":"a.ts"}],"exports":[{"name":"e","line":1}],"types":[{"name":"T"}],"nsExports":[{"name":"n"}]}]}'
    cycles = (
        '{"summary":{"violations":[{"type":"cycle","from":"a","to":"b","rule":{"name":"no-circular","severity":"warn"},"cycle":[{"name":"x/a.ts","dependencyTypes":["type-only"]},{"name":"x/b.ts","dependencyTypes":["import"]}]},'
        '{"type":"cycle","from":"b","to":"a","rule":{"name":"no-circular","severity":"warn"},"cycle":[{"name":"x/b.ts","dependencyTypes":["import"]},{"name":"x/a.ts","dependencyTypes":["import"]}]}]}}'
    )
    rows = [("s", "unused", unused), ("s", "cycles", cycles), ("s", "unused", '{"issues": 4}'), ("s", "cycles", "nonsense")]
    parsed = D.read_engine_reports(spark.createDataFrame(rows, "scan_id string, kind string, content string"))
    assert parsed.where("error is not null").count() == 2
    assert sorted(r.title for r in D.map_unused_report(parsed).collect()) == ["Unused export: e", "Unused file: a.ts", "Unused type export: T"]
    assert [r.title for r in D.map_unused_report(parsed, D.DetectionConfig(mode="library")).collect()] == ["Unused file: a.ts"]
    (c,) = D.map_cycle_report(parsed).collect()
    assert c.level == "info" and c.affected_nodes == ["x/a.ts", "x/b.ts"] and c.title == "Circular dependency: a.ts → b.ts → a.ts"


def test_import_statements_fold(spark):
    text = "import a from 'a';\nconst x = 1;\nimport {\n  b,\n  c as d\n} from \"b\";\nimport type { T } from 't';\nimport './side';\n"
    got = one(spark, X.extract_import_statements(F.lit(text)))
    assert got == ["import a from 'a';", 'import { b, c as d } from "b";', "import type { T } from 't';", "import './side';"]
    parse = lambda s: one(spark, X.parse_import_statement(F.lit(s)))
    assert tuple(parse("import x, { a as b, default as q, type T } from 'm'")) == ("m", ["default", "a"]) or tuple(parse("import x, { a as b, default as q, type T } from 'm'")) == ("m", ["default", "a", "default"])
    assert tuple(parse("import * as n from 'm'")) == ("m", ["*"]) and parse("import type { T } from 't'") is None and tuple(parse("import './s'")) == ("./s", [])


def test_extraction_survives_odd_rows(spark):
    src = spark.createDataFrame([("s", "a.ts", None), ("s", "b.ts", ""), ("s", "c.ts", "}}} {")], "scan_id string, file_path string, content string")
    assert X.extract_functions(src).count() == 0 and X.extract_exports(src).count() == 0 and X.extract_imports(src)[0].count() == 0


PROGRAM = """import { z } from 'z';
// a ( in a comment
export async function load(
  id: string,
  { a, b }: Options,
  limit?: number,
  mode = 'fast',
  ...rest: string[]
): Promise<Map<string, number>> {
  if (id) {
    return z(a, b, outer);
  }
}

function declared(x: number): string;
const add = (a: number, b: number): number => a + b;
export const later = async (
  { id }: Props
) => {
  return fetch(id);
};
const one = x => x * factor;
export class Store<T>
  extends Base<T>
  implements One, Two {
  private size: number = 0;
  get(id: string) {
    if (id) {
      return id;
    }
  }
}
function tail() {
}
use(add);
"""


def test_extraction_of_declarations_over_several_lines(spark):
    src = project(spark, {"a.ts": PROGRAM})
    got = {r.name: r for r in X.extract_functions(src).collect()}
    assert {n: (r.line, r.end_line, r.is_exported, r.is_async) for n, r in got.items()} == {
        "load": (3, 13, True, True), "declared": (15, 15, False, False), "add": (16, 16, False, False), "later": (17, 21, True, True), "one": (22, 22, False, False), "tail": (33, 34, False, False)
    }
    assert [tuple(p) for p in got["load"].params] == [
        ("id", "string", False, None), ("{ a, b }", "Options", False, None), ("limit", "number", True, None), ("mode", None, True, "'fast'"), ("rest", "string[]", True, None)
    ]
    assert got["load"].return_type == "Promise<Map<string, number>>" and got["add"].return_type == "number" and got["tail"].return_type is None
    assert sorted(got["load"].references) == ["outer", "z"] and got["one"].references == ["factor"]
    classes, methods = X.extract_classes(src)
    (c,) = classes.collect()
    assert (c.name, c.line, c.end_line, c.extends, c.implements, c.is_exported) == ("Store", 23, 32, "Base", ["One", "Two"], True)
    assert [p.name for p in c.properties] == ["size"] and [m.name for m in methods.collect()] == ["get"]
    (top,) = X.extract_top_level_references(src, X.extract_functions(src), classes).collect()
    assert sorted(top.names) == ["add", "use"]


def test_connections_of_slices_are_those_of_all_files(spark, monkeypatch):
    tables = sample_tables(spark)
    whole = sorted(map(tuple, J.build_connections(*tables).collect()))
    monkeypatch.setattr(J, "SLICE", 2)
    assert sorted(map(tuple, J.build_connections(*tables).collect())) == whole and len(whole) > 3


def test_bases_lead_to_the_first_file_that_fits(spark):
    from loomgraph.functions.paths import EXTENSIONS

    paths = ["a/x.ts", "a/x.js", "a/x", "b/y.tsx", "b/y/index.ts", "c/index.js", "c.jsx", "d/z.ts.ts", "e/index/index.ts"]
    files = spark.createDataFrame([("s", f"file:{p}", p, n) for n, p in enumerate(paths)], "scan_id string, file_id string, file_path string, file_ord int")
    index = J.file_path_index(files)
    known = {r.key: r.file_id for r in index.collect()}
    bases = ["a/x", "b/y", "c", "d/z.ts", "d/z", "e", "e/index", "gone"]
    want = {b: next((known[k] for k in (b, *(b + e for e in EXTENSIONS), b + "/index") if k in known), None) for b in bases}
    got = {r.base: r.target_file_id for r in J._stems(index).collect()}
    assert {b: got.get(b) for b in bases} == want


def test_a_written_step_leaves_no_shuffle(spark):
    from loomgraph.shared import materialise

    sizes = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size
    before, table = sizes(), materialise(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "step")
    assert sizes() <= before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
