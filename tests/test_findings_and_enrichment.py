import json

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import enrich as E
from loomgraph.operators import rollup as A
from loomgraph.plans import views as V
from loomgraph.sources import readers as R

FINDING = "scan_id string, project string, id string, level string, category string, source string, confidence double, affected_nodes array<string>"
FLAGS = "struct<" + ",".join(f"{f}:boolean" for f in S.FLAGS) + ">"
CACHE = f"scan_project string, function_id string, content_hash string, provider string, model string, summary string, flags {FLAGS}, analyzed_at timestamp, version int"
FUNCTION = f"scan_id string, function_id string, name string, file_path string, fn_ord int, source string, behavioral struct<summary:string,source:string,analyzed_at:timestamp,flags:{FLAGS}>"


def test_order_threshold_and_dismissal(spark):
    rows = [("s", "p", "1", "info", "c", "g", 0.99, ["a"]), ("s", "p", "2", "error", "c", "g", 0.5, ["b"]), ("s", "p", "3", "warning", "c", "g", 0.9, ["c"]), ("s", "p", "4", "warning", "c", "g", 0.6, ["d", "a"])]
    df = spark.createDataFrame(rows, FINDING)
    none = spark.createDataFrame([], "project string, identity string")
    order = lambda out: [r.id for r in out.orderBy("rank").collect()]
    assert order(A.filter_findings(df, none)) == ["2", "3", "4", "1"]
    assert order(A.filter_findings(df, none, 0.6)) == ["3", "4", "1"]
    gone = spark.createDataFrame([("p", "g|c|a,d")], "project string, identity string")
    assert order(A.filter_findings(df.withColumn("id", F.concat(F.lit("n"), "id")), gone)) == ["n2", "n3", "n1"]
    assert order(A.filter_findings(df, gone, show_dismissed=True)) == ["2", "3", "4", "1"]
    assert A.count_below_threshold(df, 0.6).first().hidden == 1


@pytest.mark.parametrize(
    "raw, ok, read, effects",
    [
        ('{"summary":"reads a row","flags":{"databaseRead":1,"httpCall":"yes"}}', True, True, True), ('{"summary":"x","flags":{"databaseRead":"false"}}', True, True, True),
        ('{"summary":"x","flags":{"databaseRead":0,"fileRead":[]}}', True, False, True), ('{"summary":"x","flags":{"databaseRead":"","fileRead":null,"httpCall":false}}', True, False, False),
        ('{"summary":"x"}', True, False, False), ('{"summary":"  "}', False, None, None), ("[]", False, None, None), ("no json", False, None, None), (None, False, None, None),
    ],
)
def test_normalize_analysis(spark, raw, ok, read, effects):
    a = spark.createDataFrame([(raw,)], "raw string").select(S.normalize_analysis(F.col("raw")).alias("a")).first().a
    assert a.ok == ok and (a.flags.databaseRead if a.flags else None) == read and (a.flags.hasSideEffects if a.flags else None) == effects


CODE = {"readUser": "db.findOne(id)", "writeUser": "db.save(u)", "callApi": "fetch(url)", "pureAdd": "return a + b"}


def functions(spark):
    return spark.createDataFrame([("s", n, n, "f.ts", i, c, None) for i, (n, c) in enumerate(CODE.items())], FUNCTION)


def test_enrichment_asks_only_for_what_changed(spark):
    fns, cache = functions(spark), spark.createDataFrame([], CACHE)
    cold = E.analyze_behavior(fns, cache)
    assert cold.where("not cached").count() == 4
    done = E.apply_analysis(fns, cold)
    lanes = {r.name: r.lane for r in V.with_lane(done).collect()}
    assert lanes == {"readUser": "database", "writeUser": "database", "callApi": "network", "pureAdd": "pure"}
    entries = cold.select(F.lit("p").alias("scan_project"), "function_id", "content_hash", F.lit("words").alias("provider"), F.lit("v1").alias("model"), "summary", "flags", F.current_timestamp().alias("analyzed_at"), F.lit(2).alias("version"))
    warm = spark.createDataFrame(E.upsert_cache(cache, entries).collect(), CACHE)
    assert E.analyze_behavior(fns, warm).where("not cached").count() == 0
    assert E.analyze_behavior(fns, warm, E.Provider(model="v2")).where("not cached").count() == 4
    kept, removed = E.prune_cache(warm, fns.where("name <> 'pureAdd'"))
    assert kept.count() == 3 and removed.first().removed == 1


def test_provider_failure_leaves_a_function_out(spark):
    def describe(name, code, path):
        if name == "callApi":
            raise RuntimeError("no answer")
        return json.dumps({"summary": name, "flags": {"httpCall": True}})

    out = E.analyze_behavior(functions(spark), spark.createDataFrame([], CACHE), E.Provider("own", "m", describe, 2))
    assert sorted(r.summary for r in out.collect()) == ["pureAdd", "readUser", "writeUser"]


def test_attempts_say_why(spark):
    def describe(name, code, path):
        if name == "callApi":
            raise ValueError("no answer " + "x" * 900)
        return {"pureAdd": "no json", "readUser": None}.get(name, json.dumps({"summary": name}))

    tried = E.attempts(functions(spark), spark.createDataFrame([], CACHE), E.Provider("own", "m", describe, 2)).collect()
    errors = {r.function_id: r.error for r in tried}
    assert errors["writeUser"] is None and errors["pureAdd"] == errors["readUser"] == E.NO_SUMMARY
    assert errors["callApi"].startswith("ValueError: no answer") and len(errors["callApi"]) == E.ERROR_CHARS
    counts = {r.error[:5]: (r.functions, r.first_id) for r in E.failures(spark.createDataFrame(tried, E.attempts(functions(spark), spark.createDataFrame([], CACHE)).schema)).collect()}
    assert counts == {"Value": (1, "callApi"), E.NO_SUMMARY[:5]: (2, "pureAdd")}
    assert E.attempts(functions(spark).limit(0), spark.createDataFrame([], CACHE), E.Provider("own", "m", describe)).count() == 0


@pytest.mark.parametrize("files, size, limit, expected", [(2, 75, 1000, "ok"), (1, 500, 100, "too_large"), (5, 1, 1000, "too_many_files")])
def test_repo_limits(spark, files, size, limit, expected):
    listing = spark.createDataFrame([("s", f"{i}.ts", size) for i in range(files)], "scan_id string, file_path string, size_bytes long")
    assert R.measure_repos(listing, 3, limit).first().verdict == expected


def test_dismissed_store(spark):
    load = lambda text: spark.createDataFrame([(text,)], "t string").select(R.load_dismissed(F.col("t"))).first()[0]
    assert load('["a", 1, null, "b"]') == ["a", "b"] and load("{}") == [] and load("oops") == [] and load(None) == []


def test_source_file_filter(spark):
    paths = ["src/a.ts", "src/a.test.ts", "src/a.test.js", "src/a.d.ts", "node_modules/x.ts", "lib/x.min.js", "a/b.jsx", "README.md", "dist/a.js"]
    df = spark.createDataFrame([("s", p) for p in paths], "scan_id string, file_path string")
    assert sorted(r.file_path for r in R.read_source_files(df).collect()) == ["a/b.jsx", "src/a.test.js", "src/a.ts"]
    assert sorted(r.file_path for r in R.read_test_files(df).collect()) == ["src/a.test.js", "src/a.test.ts"]


def test_tree_round_trip(spark, tmp_path):
    (tmp_path / "in/repo/src").mkdir(parents=True)
    (tmp_path / "in/repo/src/a.ts").write_text("import './b';\n")
    rows = R.read_source_files(R.read_tree(spark, str(tmp_path / "in"))).collect()
    assert [(r.scan_id, r.file_path, r.content) for r in rows] == [("repo", "src/a.ts", "import './b';\n")]


def document(**changes):
    base = dict(id="s1", projectPath="p", projectName="p", status="completed", createdAt="2024-01-01T00:00:00Z", stats={}, nodes={}, connections=[], warnings=[], clusters=[], errors=[])
    return json.dumps({**base, **changes})


def test_scan_documents(spark):
    node = {"f": {"id": "f", "type": "file", "name": "a.ts", "filePath": "a.ts"}}
    docs = [document(nodes=node), document(id="s2", warnings={}), "not json", json.dumps({"id": 1})]
    scans = R.parse_scans(spark.createDataFrame([(d,) for d in docs], "document string"))
    assert [r.error for r in scans.collect()] == [None, "warnings must be an array", "not an object", 'missing field "projectPath"']
    assert [(r.scan_id, r.node_id, r.type) for r in R.explode_nodes(scans).collect()] == [("s1", "f", "file")]


def test_view_scan(spark):
    files = spark.createDataFrame([("s", f, p, f) for f, p in (("a", "src/a.ts"), ("b", "src/b.ts"), ("c", "src/util/c.ts"), ("d", "src/util/d.ts"))], "scan_id string, file_id string, file_path string, name string")
    fns = spark.createDataFrame([("s", f, f, p) for f, p in (("a1", "src/a.ts"), ("a2", "src/a.ts"), ("b1", "src/b.ts"), ("c1", "src/util/c.ts"))], "scan_id string, function_id string, name string, file_path string")
    affected = spark.createDataFrame([("s", "w1", "warning", "a"), ("s", "w1", "warning", "b"), ("s", "w2", "info", "c")], "scan_id string, id string, level string, node_id string")
    got = {r.folder: (r.files, r.functions, r.warnings) for r in A.folder_rollup(files, fns, affected).collect()}
    assert got == {"src": (2, 3, 1), "src/util": (2, 1, 1)}
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "a"), ("s", "c", "a")], "scan_id string, src string, dst string")
    nodes, links = V.view_dependencies(edges)
    assert {r.node: r.in_cycle for r in nodes.collect()} == {"a": True, "b": True, "c": False}
    meta = V.dependency_meta(links, nodes).first()
    assert (meta.modules, meta.imports, meta.cycles, meta.in_cycles) == (3, 3, 1, 2)
