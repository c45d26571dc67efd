"""Extraction on hand-made programs: comments, templates, strings, members, export forms, scopes and types."""

from __future__ import annotations

import random

import pytest

from loomgraph.functions.lexical import scan
from loomgraph.operators import detect as D
from loomgraph.operators import extract as X
from loomgraph.shared import materialise

SOURCE = "scan_id string, file_path string, content string"


def files(spark, **texts):
    return spark.createDataFrame([("s", f"{n}.ts", t) for n, t in texts.items()], SOURCE)


TRICKY = """/** doc { */
const quoted = '}', pattern = /[/"`{]+/g, half = 4 / 2 / 1;
/* function hidden() { return 1; } */
const text = `function shown() { ${nested(`in ${deep} {`)} `;
export async function real(a: { x: number }, ...rest: string[]): Promise<{ ok: boolean }> { return other(a.x, rest); }
function second() { return 1 } function third() { return 2 }
const a1 = 1, b1 = () => 2, c1: Map<string, number> = new Map();
export const handler = async <T>(
  event: T,
): Promise<void> =>
  send(event);
@Injectable()
export class Service<T extends { id: string }>
  extends Base<T>
  implements One, Two<T, string> {
  // a { in a comment
  private readonly cache: Map<string, { n: number }> = new Map();
  static count = 0
  #hidden?: string;
  constructor(private readonly db: Db) { super(); }
  get size() { return this.cache.size }
  async load(
    id: string,
    limit = 10,
  ): Promise<T> {
    const text = `}`;
    return helper(id, limit);
  }
  protected static make<U>(x: U) { return new Service(x) }
  handler = (e: Event) => { this.load(e.id); }
}
abstract class Shape { abstract area(unit: string): number; }
"""


def test_tricky_file_gives_its_declarations(spark):
    src = files(spark, a=TRICKY)
    got = {r.name: r for r in X.extract_functions(src).collect()}
    assert {n: (r.line, r.end_line, r.is_exported, r.is_async) for n, r in got.items()} == {
        "real": (5, 5, True, True), "second": (6, 6, False, False), "third": (6, 6, False, False), "b1": (7, 7, False, False), "handler": (8, 11, True, True),
    }
    assert [p.name for p in got["real"].params] == ["a", "rest"] and got["real"].params[0].type == "{ x: number }"
    assert got["real"].return_type == "Promise<{ ok: boolean }>" and got["handler"].return_type == "Promise<void>"
    assert got["third"].source == "function third() { return 2 }"
    assert sorted(got["real"].references) == ["other"] and sorted(got["handler"].references) == ["send"]
    classes, methods = X.extract_classes(src)
    by = {c.name: c for c in classes.collect()}
    service = by["Service"]
    assert (service.line, service.end_line, service.extends, service.implements, service.is_exported) == (13, 31, "Base", ["One", "Two<T, string>"], True)
    assert [(p.name, p.type, p.visibility, p.is_static, p.is_readonly) for p in service.properties] == [
        ("cache", "Map<string, { n: number }>", "private", False, True), ("count", None, "public", True, False), ("#hidden", "string", "public", False, False), ("handler", None, "public", False, False),
    ]
    assert {(m.name, m.line, m.visibility, m.is_static, m.is_async) for m in methods.collect()} == {
        ("load", 22, "public", False, True), ("make", 29, "protected", True, False), ("area", 32, "public", False, False),
    }
    rows = {m.name: m for m in X.extract_methods(src).collect()}
    assert rows["load"].parent_class_id == service.class_id and rows["load"].end_line == 28 and rows["load"].return_type == "Promise<T>"
    assert [(p.name, p.type, p.default_value) for p in rows["load"].params] == [("id", "string", None), ("limit", None, "10")]
    assert rows["load"].references == ["helper"] and rows["make"].references == ["Service"] and rows["area"].references == []
    assert X.all_functions(src).count() == 8


def test_methods_take_part_in_calls(spark):
    src = files(spark, a="function helper() {}\nclass A {\n  one() { return helper(); }\n  two() { return one(); }\n}\nexport function top() { return two; }\n")
    scope = spark.createDataFrame([], "scan_id string, file_id string, local_name string, target_file_id string, original_name string, is_default boolean")
    from loomgraph.operators.resolve import call_connections

    functions, exports = materialise(X.all_functions(src), "f"), materialise(X.extract_exports(src), "e")
    got = {(r.source_id, r.target_id) for r in call_connections(functions, exports, scope).collect()}
    one, two, helper = "file:a.ts:class:A:2:method:one:3", "file:a.ts:class:A:2:method:two:4", "file:a.ts:fn:helper:1"
    assert got == {(one, helper), (two, one), ("file:a.ts:fn:top:6", two)}


EXPORTS = {
    "lists": ("function f() {}\nconst g = 1;\nclass H {}\nimport { z } from './z';\nexport { f, g as gg, H as default, z };\n", [("f", "function", False), ("gg", "variable", False), ("H", "class", True)]),
    "several": ("export const a = 1, b = () => 2;\nexport let { c, d: e, ...rest } = x;\n", [("a", "variable", False), ("b", "variable", False), ("c", "variable", False), ("e", "variable", False), ("rest", "variable", False)]),
    "default_name": ("const f = 1;\nexport default f;\n", [("f", "variable", True)]),
    "default_arrow": ("export default () => 1;\n", [("default", "function", True)]),
    "default_function": ("export default function () {}\n", [("default", "function", True)]),
    "default_class": ("export default class extends B {}\n", [("default", "class", True)]),
    "types": ("export interface I { a: 1 }\nexport type T = string;\nexport enum E { A }\nexport declare const w: number;\nexport abstract class K {}\n", [("I", "interface", False), ("T", "type", False), ("E", "enum", False), ("w", "variable", False), ("K", "class", False)]),
    "commented": ("// export const no = 1;\n/*\nexport function no2() {}\n*/\nconst t = `\nexport class No {}\n`;\n", []),
    "again": ("export { x as y } from './m';\nexport * from './n';\nexport * as all from './o';\nexport type { T } from './p';\n", [("x", "reexport", False), ("*", "reexport", False), ("*", "reexport", False), ("T", "reexport", False)]),
}


def test_export_forms(spark):
    src = files(spark, **{n: t for n, (t, _) in EXPORTS.items()})
    got: dict = {n: [] for n in EXPORTS}
    for r in X.extract_exports(src).orderBy("file_path", "exp_ord").collect():
        got[r.file_path[:-3]].append((r.name, r.kind, r.is_default))
    assert got == {n: rows for n, (_, rows) in EXPORTS.items()}
    sources = {(r.name, r.alias, r.is_type_only, r.source) for r in X.extract_exports(src).where("kind = 'reexport'").collect()}
    assert sources == {("x", "y", False, "./m"), ("*", None, False, "./n"), ("*", None, False, "./o"), ("T", None, True, "./p")}


def test_listed_exports_are_not_reported_as_unused(spark):
    src = files(spark, a="function used() {}\nfunction lone() {}\nconst arrow = () => 1;\nexport { used, arrow as other };\n")
    f = X.all_functions(src)
    assert {r.name: r.is_exported for r in f.collect()} == {"used": True, "lone": False, "arrow": True}
    tops = src.select("scan_id", X.file_id(src.file_path).alias("file_id"), "file_path").withColumn("top_level_references", X.F.array().cast("array<string>"))
    none = spark.createDataFrame([], "scan_id string, source_id string, target_id string, weight long, type string")
    got = [r.title for r in D.orphaned_functions(f, none, tops).collect()]
    assert len(got) == 1 and "lone" in got[0]


#: Body of a function f(p), and the names it uses.
BODIES = [
    ("return g(p);", {"g"}),
    ("const x = g(); return x + h;", {"g", "h"}),
    ("{ const g = 1; use(g); } return g();", {"use", "g"}),  # shadowed in the block only
    ("{ const g = 1; use(g); }", {"use"}),
    ("return items.map(g => g.id);", {"items"}),
    ("return items.map((g, i) => { return g + i + out; });", {"items", "out"}),
    ("return items.map(({ a, b: [c] }) => a + c + d);", {"items", "d"}),
    ("for (const g of list) { g(); } g();", {"list", "g"}),
    ("for (const g of list) { g(); }", {"list"}),
    ("try { a(); } catch (e) { log(e); }", {"a", "log"}),
    ("const x: Foo<Bar> = y as Baz; return x satisfies Qux;", {"y"}),
    ("return call<Type>(z) as unknown as Other[];", {"call", "z"}),
    ("interface Local { a: Hidden } type T = Hidden | { b: Deep }; return q;", {"q"}),
    ("return { key: value, short, 'quoted': other, method(a) { return a + late; } };", {"value", "short", "other", "late"}),
    ("return c ? yes : no;", {"c", "yes", "no"}),
    ("return obj.prop.deep?.more[index];", {"obj", "index"}),
    ("return `text ${inner} and ${fn(`more ${most}`)}`; // comment word", {"inner", "fn", "most"}),
    ("return /regex word/.test(s) || 'string word';", {"s"}),
    ("const run = (a: Kind, b?: Sort): Result => a.x(b, free); return run(1);", {"free"}),
    ("var v = 1; if (p) { v = w; } function local(n) { return n + m; } return local(v);", {"w", "m"}),
    ("return [...spread, ...p];", {"spread"}),
]


@pytest.mark.parametrize("part", range(3))
def test_scopes_and_types(spark, part):
    some = list(enumerate(BODIES))[part::3]
    src = files(spark, **{f"b{i}": f"function f(p) {{ {body} }}\n" for i, (body, _) in some})
    got = {r.file_path: set(r.references) for r in X.extract_functions(src).collect()}
    assert got == {f"b{i}.ts": want for i, (_, want) in some}


def test_top_level_references(spark):
    src = files(spark, a="import { imported } from './x';\nconst a = compute(b);\nconst arrow = () => hidden();\nfunction f() { return gone; }\nclass C { m() { return gone2; } }\nprocess.on('x', f);\nif (a) { start({ key: val }); }\nimported();\ninterface I { t: T }\ntype U = V;\nexport { arrow };\nexport default a;\n")
    (row,) = X.extract_top_level_references(src).collect()
    assert set(row.names) == {"compute", "b", "process", "f", "a", "start", "val"}


def test_texts_in_comments_and_templates_declare_nothing(spark):
    """Whole documents and pages, put into comments and templates between two declarations, leave just these."""
    from loomgraph.plans.bindings import view

    F = X.F
    sf = "/root/testdata/sf0.001"
    texts = view(spark, sf, "b_code").select("content").unionByName(view(spark, sf, "b_markup").select("content"))
    bare = F.regexp_replace("content", r"\*/|`|\\|\$\{", "")
    inside = F.concat(F.lit("/* { "), bare, F.lit(" */\nfunction first() {}\nconst t = `"), bare, F.lit("`;\n"), F.regexp_replace(F.concat(F.lit("// ("), F.col("content")), r"\n", "\n// ["), F.lit("\nexport const last = () => 1;\n"))
    src = texts.select(F.lit("s").alias("scan_id"), F.concat(F.monotonically_increasing_id().cast("string"), F.lit(".ts")).alias("file_path"), inside.alias("content"))
    n = src.count()
    per = X.extract_functions(src).groupBy("file_path").agg(F.array_sort(F.collect_list("name")).alias("names"))
    assert n > 200 and per.where("names = array('first', 'last')").count() == n
    assert X.extract_exports(src).groupBy("file_path").count().where("count = 1").count() == n


def test_scan_keeps_places_and_nests():
    rnd = random.Random(5)
    bits = ["`", "${", "}", "{", "(", ")", "'", '"', "/", "//", "/*", "*/", "\n", "a", "\\", "[", "]", " ", "=", "\x01"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(40)))
        code, own, nests = scan(text)
        assert len(code) == len(text) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
        for parent, _, at, line, end_at, end_line, _, _ in nests:
            assert 1 <= at <= end_at <= len(text) and line <= end_line and (parent < 0 or nests[parent][2] < at)


def test_odd_files(spark):
    src = files(spark, empty="", blank=" \n", null=None, open_="function f( {\nclass", long="x(" * 200 + "f(1, { a: 2 });\n" * 500)
    assert X.extract_exports(src).count() == 0 and X.extract_classes(src)[0].count() == 0
    assert X.extract_functions(src).count() <= 1 and X.extract_functions(src.limit(0)).count() == 0
    assert {r.file_path for r in X.extract_top_level_references(src).collect()} == {"empty.ts", "blank.ts", "null.ts", "open_.ts", "long.ts"}
