import json

from pyspark.sql import functions as F
from support import DATA

from sextant.functions import paths
from sextant.operators import ingest as I
from sextant.operators import legacy, resolve
from sextant.sources import annotations, files, patterns, reports


def go_lines(spark, *events):
    rows = [("r", i, e if isinstance(e, str) else json.dumps(e)) for i, e in enumerate(events)]
    return reports.go_events(spark.createDataFrame(rows, "report string, seq long, value string"))


def test_go_stream(spark):
    ev = lambda action, test="TestA/sub", **k: {"Time": "2024-01-01T00:00:00Z", "Action": action, "Package": "x/y/pkg", "Test": test, **k}
    events = go_lines(
        spark, "PASS", "{broken", ev("run"), ev("output", Output="see @covers Auth.Login,b #x"), ev("output", Output="  --- FAIL: TestA \n"), ev("output", Output="FAIL: again"),
        ev("fail", Elapsed=0.25), ev("pass", Elapsed=0.5), ev("run", "TestB"), ev("skip", "TestC", Elapsed=1.0), {"Action": "output", "Package": "x/y/pkg", "Output": "no test"})
    got = {r["name"]: r for r in reports.go_results(events).collect()}
    a = got["x/y/pkg.TestA/sub"]
    assert (a["status"], a["duration_ms"], a["feature_id"], a["message"], a["symbol"]) == ("pass", 500, "auth.login", "--- FAIL: TestA", "pkg.TestA")
    assert got["x/y/pkg.TestB"]["status"] == "fail" and got["x/y/pkg.TestB"]["message"] == reports.TRUNCATED
    assert got["x/y/pkg.TestC"]["status"] == "skip"
    run = reports.go_run(events).first()
    assert (run["pass"], run["fail"], run["skip"]) == (1, 1, 1)


def test_playwright_suites_nest(spark):
    spec = lambda title, **test: {"title": title, "tests": [test]}
    report = {"suites": [{"file": "e2e/auth/login.spec.ts", "specs": [spec("ok", results=[{"status": "failed"}, {"status": "passed", "duration": 12.9}])],
                          "suites": [{"suites": [{"specs": [spec("@note:feature Pay.Now bad", results=[{"status": "odd", "error": {"message": "boom"}}]), spec("no results", status="skipped", duration=3)]}]}]}]}
    got = {r["name"]: r for r in reports.playwright_results(spark.createDataFrame([("r", json.dumps(report))], "report string, text string")).collect()}
    assert (got["ok"]["status"], got["ok"]["duration_ms"], got["ok"]["feature_id"]) == ("pass", 12, "auth.login")
    bad = got["@note:feature Pay.Now bad"]
    assert (bad["status"], bad["message"], bad["feature_id"], bad["file"]) == ("fail", "boom", "pay.now", "e2e/auth/login.spec.ts")
    assert got["no results"]["status"] == "skip"


def test_vitest_and_jest(spark):
    report = {"startTime": 5, "testResults": [{"name": "src\\cart\\__tests__\\Total.test.ts", "endTime": 9, "assertionResults": [
        {"title": "adds", "ancestorTitles": ["cart", "sum"], "status": "passed", "duration": 12.7}, {"fullName": "x", "status": "todo"}, {"title": "y", "status": "weird", "failureMessages": ["a", "b"]}]}]}
    df = spark.createDataFrame([("r", json.dumps(report))], "report string, text string")
    got = [tuple(r) for r in reports.vitest_results(df).select("name", "file", "feature_id", "status", "duration_ms", "message").collect()]
    f = "src/cart/__tests__/Total.test.ts"
    assert got == [("cart > sum > adds", f, "cart.total", "pass", 12, ""), ("x", f, "cart.total", "skip", 0, ""), ("y", f, "cart.total", "fail", 0, "a\nb")]
    assert tuple(reports.vitest_run(df).first())[1:] == (5, 9) and tuple(reports.vitest_run(df, False).first())[1:] == (5, 5)


def test_maestro_by_first_character(spark):
    xml = """ <testsuites><testsuite timestamp="2024-01-01T00:00:00Z" time="2.5"><testcase name="a" file="m/log_in-now.yaml" time="1.5"/>
      <testcase name="b c" time="0.8"><failure message="">body</failure></testcase><testcase name="d"><skipped message="later"/></testcase></testsuite></testsuites>"""
    rows = [("x", xml), ("j", '{"flows": [{"name": "pay", "status": "SUCCESS", "duration_ms": 7}]}'), ("l", '\n[{"name": "q", "status": "?"}]'), ("e", " ")]
    got = {(r["report"], r["name"]): r for r in reports.maestro_results(spark.createDataFrame(rows, "report string, text string")).collect()}
    assert {k: (r["status"], r["duration_ms"], r["message"], r["feature_id"]) for k, r in got.items()} == {
        ("x", "a"): ("pass", 1500, "", "log.in"), ("x", "b c"): ("fail", 800, "body", "b.c"), ("x", "d"): ("skip", 0, "later", "d"),
        ("j", "pay"): ("pass", 7, "", "pay"), ("l", "q"): ("fail", 0, "", "q")}
    assert reports.junit_window(xml)[1] == 2.5


def test_annotation_lines():
    parse = annotations.parse_line
    assert parse("@note:feature auth.login pay.now #tag prose")["ids"] == ["auth.login", "pay.now"]
    assert parse("@note:Feature auth.login") is None and parse("@note:feature Auth.Login") is None and parse("@note:feature #only") is None
    assert parse("@note:owner Team A")["ids"] == ["Team", "A"]
    assert parse("@note:saga s step=x") is None and parse("@note:saga s step=12")["tags"] == ["step=12"]
    assert parse("@note:consumer stream=a.b group=g")["ids"] == ["a.b"] and parse("@note:consumer id stream=a") is None and parse("@note:consumer group=g") is None
    assert parse("@covers a.b, C.d,e #x")["ids"] == ["a.b", "C.d", "e"] and parse("@covers #x") is None
    assert parse("@api POST /v1/x more")["path"] == "/v1/x" and parse("@api get /x") is None
    assert parse("plain prose @ here") is None


def test_comment_styles(spark):
    rows = [("a.ts", 'x = "// @covers no" // @covers yes\n/* @covers one */ code\n/**\n * @covers two\n */\n@covers not.comment'), ("b.py", "x = 1  # @covers py\n@covers no"),
            ("c.md", "@covers no\n<!-- @covers md -->\n<!--\n@covers block\n-->"), ("d.txt", "// @covers no"), ("e.go", None)]
    got = annotations.parse_annotations(spark.createDataFrame(rows, "file_path string, text string")).collect()
    assert sorted((r["file_path"], r["line"], r["ids"][0]) for r in got) == [("a.ts", 1, "yes"), ("a.ts", 2, "one"), ("a.ts", 4, "two"), ("b.py", 1, "py"), ("c.md", 2, "md"), ("c.md", 4, "block")]


def test_paths(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(paths.feature_of_path(F.lit("tests/checkout.spec.ts"), "playwright")) == "checkout"
    assert one(paths.feature_of_path(F.lit("lib/Auth/__tests__/Login.test.jsx"), "vitest")) == "auth.login"
    assert one(paths.feature_id(F.lit("API./v1/{id}/X"))) == "api.v1.id.x"
    assert one(paths.bc_path(F.lit("src/contexts/pay/a.py"))) == "src/contexts/pay" and one(paths.bc_path(F.lit("x.py"))) is None
    assert one(files.camel_head(F.lit("TestLoginFails"))) == "login"


def test_graphql_blocks(spark):
    text = 'type Query {\n  """\n  hidden: Int\n  """\n  item(id: ID!): Item!\n  # no: Int\n}\ntype Item {\n  id: ID\n}\nextend type Mutation {\n  go: Int\n}\n'
    got = [tuple(r) for r in files.graphql_operations(spark.createDataFrame([("s", text)], "file_path string, text string")).orderBy("line").select("line", "name", "signature").collect()]
    assert got == [(5, "Query.item", "query { item(id: ID!): Item! }"), (12, "Mutation.go", "mutation { go: Int }")]


def test_go_benchmarks_and_races(spark):
    ev = lambda action, test="B", **k: {"Action": action, "Package": "p", "Test": test, **k}
    events = go_lines(spark, ev("run"), ev("output", Output="BenchmarkX-8   100  12.5 ns/op  64 B/op  2 allocs/op"), ev("pass", Elapsed=0.5), ev("fail"), ev("pass", "never run"), ev("run", "C"), ev("output", "", Output="WARNING: DATA RACE"))
    got = {r["test"]: r for r in files.go_metrics(events).collect()}
    assert set(got) == {"B", "C"} and (got["B"]["status"], got["B"]["bytes_per_op"], got["B"]["allocs_per_op"], got["B"]["duration_ns"]) == ("pass", 64, 2, 500_000_000)
    assert all(r["race_detected"] for r in got.values())


def test_registry_documents(spark):
    doc = {"domain": "auth", "features": [{"id": "auth.login", "name": "Login", "priority": "high", "coverage": {"unit": {"backend": {"status": "covered"}}, "e2e": {"web": None}}}]}
    got = files.read_registry(spark.createDataFrame([("a", json.dumps(doc)), ("b", "{{{")], "file_path string, text string")).collect()
    assert {(r["feature_id"], r["slot"], r["status"]) for r in got} == {("auth.login", "unit.backend", "covered"), ("auth.login", "e2e.web", None)}


def test_resolution_cascade(spark):
    nodes = [("app", "module", "app/__init__.py"), ("app.a", "module", "app/a.py"), ("app.b", "module", "app/b.py"), ("app.c", "module", "app/c.py"), ("app.a.run", "func", ""), ("app.b.run", "func", ""),
             ("app.b.Box.open", "method", ""), ("app.c.help", "func", ""), ("app.a.main", "func", ""), ("app.b.help", "func", "")]
    edges = [
        (0, "app.a.main", "app.b.run", "call", None), (1, "app.a.main", "Box.open", "call", None), (2, "app.a.main", "run", "call", None), (3, "app.a.main", "tool.x", "call", None),
        (4, "app.a.main", "exported", "call", None), (5, "app.a.main", "help", "call", None), (6, "app.a.main", "os.path", "call", None),
        (7, "app.a", ".c.tool", "import", "module"), (8, "app", ".b.exported", "import", "module"), (9, "app.a", "app.c.help", "import", "function"),
    ]
    n = spark.createDataFrame(nodes, "id string, kind string, file string")
    e = spark.createDataFrame(edges, "seq long, source string, target string, kind string, scope string")
    out = resolve.resolve_names(n, e)
    got = {r["seq"]: (r["resolved"], r["tier"]) for r in out.filter("kind = 'call'").collect()}
    assert got == {0: ("app.b.run", "id"), 1: ("app.b.Box.open", "suffix"), 2: ("app.a.run", "module"), 3: ("app.c.tool", "alias"), 4: ("app.b.exported", "export"), 5: ("app.c.help", "sibling"), 6: ("os.path", "none")}
    assert "os.path" in {r["id"] for r in resolve.stubs(out, n).collect()}


def test_go_calls(spark):
    calls = [(0, "Svc", "repo", "Get"), (1, "Svc", "store", "Put"), (2, "Svc", "cache", "Del"), (3, "", "user", "Get"), (4, "Svc", "repo", "Gone"), (5, "", "nobody", "X")]
    functions = [("UserRepo.Get", "a/x.go"), ("PgStore.Put", "a/x.go"), ("RedisCache.Del", "redis/x.go"), ("MemCache.Del", "mem/x.go")]
    fields = [("Svc", "repo", "*UserRepo"), ("Svc", "store", "Store"), ("Svc", "cache", "redis.Cache")]
    got = resolve.resolve_calls(
        spark.createDataFrame(calls, "seq long, receiver string, variable string, method string"), spark.createDataFrame(functions, "id string, path string"),
        spark.createDataFrame(fields, "receiver string, variable string, type string"), spark.createDataFrame([("Store", "*pg.PgStore")], "interface string, concrete string")).collect()
    assert {r["seq"]: (r["callee"], r["ambiguous"]) for r in got} == {
        0: ("UserRepo.Get", False), 1: ("PgStore.Put", False), 2: ("RedisCache.Del", False), 3: ("UserRepo.Get", True), 4: ("UserRepo.Gone", True)}


def test_ingest_twice_adds_nothing(spark):
    index = {
        "symbols": spark.createDataFrame([("a", "f.py", 1), ("a", "g.py", 2), ("b", "g.py", 3)], "qualified_name string, file_path string, seq long"),
        "edges": spark.createDataFrame([(1, 2, "call", "f.py", 1, 1), (1, 2, "call", "f.py", 1, 2)], "src long, dst long, kind string, file_path string, line int, seq long"),
        "annotations": spark.createDataFrame([("f.py", 1, "feature", "x", 1), ("f.py", 1, "feature", "y", 2)], "file_path string, line int, kind string, value string, seq long"),
        "file_hashes": spark.createDataFrame([("f.py", "h1"), ("g.py", "h2")], "file_path string, content_hash string"),
    }
    none = {k: v.limit(0) for k, v in index.items()}
    tables, stats = I.ingest_scan(none, index)
    assert {r["table"]: r["added"] for r in stats.collect()} == {"symbols": 2, "edges": 1, "annotations": 1, "file_hashes": 2}
    assert tables["annotations"].first()["value"] == "y" and tables["symbols"].filter("qualified_name = 'a'").first()["file_path"] == "f.py"
    again, stats = I.ingest_scan(tables, index)
    assert {r["added"] for r in stats.collect()} == {0} and again["symbols"].count() == 2


def test_deletes_and_swaps(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert [r["id"] for r in I.delete_one(df, "id", 1).collect()] == [2]
    try:
        I.delete_one(df, "id", 9)
        raise AssertionError("no error")
    except KeyError:
        pass
    path = str(tmp_path / "t")
    df.write.parquet(path)
    I.swap(spark.read.parquet(path).filter("id = 2"), path)
    assert [r["id"] for r in spark.read.parquet(path).collect()] == [2]
    assert I.envelope("x", {}, [])["schema_version"] == 1


def test_tests_map_to_features(spark):
    tests = spark.createDataFrame([("a/auth/pay/x_test.go",), ("src/Auth/x_test.go",), ("web/pay.smoke/x.spec.ts",), ("named/auth/x.go",), ("none/x.go",)], "file_path string")
    registry = spark.createDataFrame([("auth", "auth.login"), ("auth", "auth.out"), ("pay", "pay.card")], "domain string, feature_id string")
    marked = spark.createDataFrame([("named/auth/x.go", "own.f")], "file_path string, feature_id string")
    got = {}
    for r in legacy.map_tests(tests, marked, registry).collect():
        got.setdefault(r["file_path"], set()).add(r["feature_id"])
    assert got == {"a/auth/pay/x_test.go": {"pay.card"}, "src/Auth/x_test.go": {"auth.login", "auth.out"}, "web/pay.smoke/x.spec.ts": {"pay.card"}, "named/auth/x.go": {"own.f"}}


def test_mapped_tests_make_no_pairs(spark, tmp_path):
    """Work of j14 follows files and features, not their product; repeated rows count as the SQL counts them."""
    import __spark_entry__
    import duckdb

    part = spark.read.parquet(f"{DATA}/sf0.001/part.parquet").limit(1).drop("p_partkey")
    keys = spark.range(3000).unionByName(spark.range(40)).withColumnRenamed("id", "p_partkey")
    keys.crossJoin(part).select("p_partkey", *part.columns).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    got = __spark_entry__.queries()["j14_map_tests"](spark, str(tmp_path))
    rows = sorted(tuple(r) for r in got.collect())
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW part AS FROM '{tmp_path}/part.parquet/*.parquet'")
        assert rows == sorted(duck.execute(__spark_entry__.oracle_sql()["j14_map_tests"]).fetchall()) and len(rows) == 2280

    def most(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return most(node.executedPlan())
        inner = [most(node.plan())] if name.endswith("QueryStageExec") else [most(node.children().apply(i)) for i in range(node.children().size())]
        own = node.metrics().get("numOutputRows")
        return max([*inner, own.get().value() if own.isDefined() else 0])

    assert 3000 <= most(got._jdf.queryExecution().executedPlan()) < 30_000  # 3,000 files, 250 features a domain


def test_last_component_is_no_folder(spark):
    tests = spark.createDataFrame([("a/x_test.go",), ("a/b.c/x",), ("auth.smoke/x",), ("a/b.c.d",), ("x",), (None,)], "file_path string")
    registry = spark.createDataFrame([("x_test.go", "f"), ("b.c", "g"), ("auth", "h"), ("x", "i")], "domain string, feature_id string")
    got = legacy.map_tests(tests, tests.limit(0).withColumn("feature_id", tests["file_path"]), registry)
    assert sorted(tuple(r)[:2] for r in got.collect()) == [("a/b.c.d", "g"), ("a/b.c/x", "g")]


def test_patterns_read_code_only():
    go = """package svc

// u.outbox.Append(x)
var s = "outbox.Append("
type (
	Agg struct {
		*rec.EventRecorder
		id int
	}
	Plain struct { Recorder EventRecorder }
)

func (a *Agg) Do(f func(x interface{ Run() }) error) error {
	return a.uow.Run(ctx, opt(1), func(ctx context.Context) (struct{ a int }, error) {
		x.repo.Upsert(ctx)
		return deep().Outbox.AppendFromContext(ctx, func() { y() })
	})
}

func free() { a.uow.Run(ctx, wrap(func() { r.Save(); o.outbox.Append() })) }
"""
    got = sorted(patterns.matches(go), key=lambda m: (m[2], m[0]))
    assert got == [
        ("event-recorder-embed", "Agg", 6, "embeds rec.EventRecorder", 1.0),
        ("canonical-service", "Agg.Do", 13, "Run closure has both repo.Save and outbox.Append", 1.0),
        ("outbox-append", "Agg.Do", 16, "calls Outbox.AppendFromContext", 1.0),
        ("outbox-append", "svc.free", 20, "calls outbox.Append", 1.0),
    ]
    assert list(patterns.matches("")) == []


def test_python_scopes_and_own_calls(spark):
    text = "try:\n    import a\nexcept (OSError, ImportError):\n    import b\ntry:\n    import c\nexcept Exception:\n    pass\nif not TYPE_CHECKING:\n    from . import d, e as f\nelse:\n    from x import *\ndef g():\n    if 1:\n        import h\n    @d(1)\n    class K:\n        z = i()\n    return [j(q) for q in k()]\n"
    rows = files.python_edges(spark.createDataFrame([("p/m.py", text), ("p/bad.py", "def (:"), ("p/none.py", None)], "file_path string, text string")).collect()
    assert [(r["target"], r["scope"]) for r in rows if r["kind"] == "import"] == [("a", "try_guard"), ("b", "try_guard"), ("c", "module"), (".d", "conditional"), (".e", "conditional"), ("x.*", "conditional"), ("h", "function")]
    assert sorted((r["source"], r["target"]) for r in rows if r["kind"] == "call") == [("p.m.g", "j"), ("p.m.g", "k")]
    assert [(r["source"], r["target"]) for r in rows if r["kind"] == "decorator"] == [("p.m.g.K", "d(1)")]


def test_stored_note_is_one_of_the_notes(spark):
    notes = spark.createDataFrame([("f", 1, "feature", ["zz"], [], "legacy", 1), ("f", 1, "feature", ["aa"], ["#t"], "current", 2)], "file_path string, line int, kind string, ids array<string>, tags array<string>, source string, seq long")
    assert [(r["value"], r["source"]) for r in annotations.to_store(notes).collect()] == [("aa #t", "current")]


def test_skips_after_an_end_and_ends_before_a_run(spark):
    ev = lambda action, test, **k: {"Action": action, "Package": "p", "Test": test, **k}
    events = go_lines(spark, ev("pass", "A", Elapsed=9), ev("run", "A"), ev("fail", "A", Elapsed=1), ev("run", "B"), ev("pass", "B"), ev("skip", "B"))
    assert [(r["test"], r["status"], r["duration_ns"]) for r in files.go_metrics(events).collect()] == [("A", "fail", 1_000_000_000)]


def test_a_stopped_swap_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path + ".old")  # set aside, and then stopped
    I.restore(spark, path)
    assert spark.read.parquet(path).count() == 3
    I.swap(spark.read.parquet(path).filter("id = 1"), path)
    assert spark.read.parquet(path).count() == 1 and not (tmp_path / "t.old").exists()
