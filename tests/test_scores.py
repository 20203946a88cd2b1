import pytest
from pyspark.sql import functions as F

from sextant.functions import paths
from sextant.operators import coverage as C
from sextant.operators import diffs as D
from sextant.operators import lookup as L
from sextant.operators import ranking as K
from sextant.operators import scoring as S
from sextant.operators import search

DAY = 86_400_000_000


def test_dead_symbols(spark):
    files = ["main.py", "used.py", "pkg/orphan.py", "only.py", "tests/test_x.py", "external:py", "deferred.py"]
    symbols = spark.createDataFrame([(i, f"s{i}", f) for i, f in enumerate(files)], "id long, qualified_name string, file_path string")
    edges = spark.createDataFrame([(0, 1, "import", "module"), (4, 3, "import", "module"), (0, 6, "import", "function"), (1, 2, "call", None)], "src long, dst long, kind string, edge_meta string")
    dead = lambda **k: {files[r["id"]] for r in L.dead_symbols(symbols, edges, **k).collect()}
    assert dead() == {"main.py", "pkg/orphan.py", "only.py", "deferred.py"}
    assert dead(include_tests=True) == {"main.py", "pkg/orphan.py", "tests/test_x.py", "deferred.py"}
    assert dead(scopes=["module", "function"]) == {"main.py", "pkg/orphan.py", "only.py"}
    assert dead(scopes=["nonsense"]) == {"main.py", "pkg/orphan.py", "only.py"}
    assert dead(prefix="pkg/") == {"pkg/orphan.py"}
    assert "pkg/orphan.py" not in dead(kind="all", scopes=[])


def test_test_paths(spark):
    cases = {"tests/a.py": True, "a/test/b.py": True, "conftest.py": True, "x/test_a.py": True, "a_test.py": True, "p/a_test.go": True, "x/tests/y.txt": True,
             "src/contestants.py": False, "latest/a.py": False, "test_a.txt": False, "attest.py": False, "src/testing.py": False, "a.py": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["t"] for r in df.select("p", paths.is_test_path(F.col("p")).alias("t")).collect()} == cases


@pytest.fixture()
def links(spark):
    return spark.createDataFrame([("f", 1, "impl"), ("f", 2, "impl"), ("f", 3, "test"), ("g", 4, "impl")], "feature_id string, symbol_id long, role string")


def coverage(spark, links, rows):
    res = spark.createDataFrame(rows, "symbol_id long, feature_id string, status string")
    return {r["feature_id"]: r["score"] for r in S.coverage_signal(links, res).collect()}


def test_coverage_signal(spark, links):
    assert coverage(spark, links, [(1, None, "pass"), (2, None, "fail")])["f"] == 50
    assert coverage(spark, links, [(1, None, "pass"), (2, None, "skip")])["f"] == 100  # only skipped: not counted
    assert coverage(spark, links, [(1, None, "pass"), (2, None, "skip"), (2, None, "fail")])["f"] == 100
    assert coverage(spark, links, [(None, "f", "pass"), (2, None, "skip")])["f"] == 100  # credit by the feature
    assert coverage(spark, links, [(1, None, "pass")])["f"] == 50  # without a result it stays
    assert "g" not in coverage(spark, links, [(4, None, "skip")])


def test_health_renormalises(spark):
    features = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    signals = spark.createDataFrame([("a", "coverage", 100.0), ("b", "coverage", 0.0), ("b", "pattern_compliance", 100.0)], "feature_id string, signal string, score double")
    got = {r["feature_id"]: r for r in S.health(features, signals).collect()}
    assert got["a"]["score"] == 100 and got["b"]["score"] == pytest.approx(38.4615, abs=1e-3)
    assert got["c"]["score"] == 0 and got["c"]["reason"] == "no signal"
    assert S.health(features, signals, {"coverage": 0}).filter("feature_id = 'b'").first()["score"] == pytest.approx(38.4615, abs=1e-3)


def test_costs_and_decay(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 10, 15, 16, 50)], "n int")
    assert "".join(r[0] for r in df.select(S.cost_bucket(F.col("n"))).collect()) == "SSSMMMLL"
    ages = spark.createDataFrame([(d * DAY,) for d in (0, 7, 52, 97, 200)], "a long")
    assert [r[0] for r in ages.select(S.decay(F.col("a"))).collect()] == pytest.approx([100, 100, 50, 0, 0])


def test_diffs(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 1), (3, "z", 1)], "id int, v string, w int")
    b = spark.createDataFrame([(2, "y", 1), (3, "q", 1), (4, "n", None)], "id int, v string, w int")
    what = lambda p, q: {r["id"]: r["change"] for r in D.keyed_diff(p, q, ["id"], ["v", "w"]).collect()}
    assert what(a, b) == {1: "removed", 3: "changed", 4: "added"}
    assert what(b, a) == {1: "added", 3: "changed", 4: "removed"}
    assert what(a, a) == {}


def test_audit_and_coverage_floors(spark):
    scores = lambda *v: spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(v)], "feature_id string, score int")
    got = lambda p, q, floor=5: {r["feature_id"]: r["change"] for r in D.audit_diff(p, q, floor).collect()}
    assert got(scores(80, 70, 90), scores(82, 65, 80)) == {"f1": "changed", "f2": "changed"}
    assert got(scores(80, 70), scores(80, 71), 0) == {"f1": "changed"}
    assert got(scores(), scores(1)) == {"f0": "missing_on_a"} and got(scores(1), scores()) == {"f0": "missing_on_b"}
    rates = lambda *v: spark.createDataFrame([(f"f{i}", float(r), t) for i, (r, t) in enumerate(v)], "feature_id string, pass_rate double, total long")
    out = {r["feature_id"]: (r["change"], r["flipped_off"]) for r in D.coverage_diff(rates((1, 9), (1, 9), (0.9, 9), (0, 0)), rates((0.99, 9), (1, 9), (0.5, 9), (0.5, 2))).collect()}
    assert out == {"f0": ("changed", True), "f2": ("changed", False), "f3": ("added", False)}


def test_trends_and_health(spark):
    rows = [("f", i, "pass" if i < 3 else "fail", i) for i in range(6)] + [("g", i, "pass", i) for i in range(2)]
    m = spark.createDataFrame(rows, "feature_id string, run_seq long, status string, id long")
    assert [r["feature_id"] for r in K.failing_trends(m).collect()] == ["f"]
    assert K.failing_trends(m, newest_first=True).count() == 0
    t = spark.createDataFrame([("f", 1, "pass", 0), ("f", 1, "flaky", 0), ("f", 2, "pass", 0), ("f", 2, "fail", 0), (None, 3, "pass", 0)], "feature_id string, run_seq int, status string, duration_ns long")
    assert {r["run_seq"]: r["pass_rate"] for r in C.health_trend(t).collect()} == {1: 1.0, 2: 0.5}
    runs = spark.createDataFrame([(1, 10, 5, 2, 3), (2, 0, 0, 0, 0), (3, 4, 1, 3, 3)], "run_seq int, total long, passed long, failed long, flaky long")
    assert [tuple(r) for r in C.trend_series(runs).orderBy("run_seq").collect()] == [(1, 50, 80, 40), (2, 0, 100, 100), (3, 25, 25, 0)]


SLOTS = "domain string, priority string, feature_id string, slot_no int, slot string, status string, has_api boolean, has_web boolean, has_mobile boolean, pass_rate double"


def slots_of(spark, features):
    """Rows of every slot from (domain, priority, id, {slot: status}, surfaces)."""
    return spark.createDataFrame([(d, p, f, i, s, there.get(s), "api" in has, "web" in has, "mobile" in has, 0.456) for d, p, f, there, has in features for i, s in enumerate(C.SLOTS)], SLOTS)


def test_registry_figures(spark):
    slots = slots_of(spark, [
        ("a", "high", "f1", {"unit.backend": "covered", "e2e.web": "failing"}, ["api"]), ("a", "urgent", "f2", {"unit.web": "not-applicable", "integration.mobile": "covered"}, []),
        ("_unmapped", "high", "f3", {}, ["web"]), ("b", "high", "f4", {"unit.mobile": "partial", "unit.web": "missing", "e2e.mobile": "covered"}, [])])
    assert {r["feature_id"]: r["health"] for r in C.registry_health(slots).collect()} == {"f1": 0.5, "f2": 0.5, "f3": 0.0, "f4": pytest.approx(2 / 3)}
    assert {r["feature_id"]: r["health"] for r in C.dashboard_health(slots).collect()} == {"f1": 1.0, "f2": 1.0, "f3": 0.0, "f4": 0.0}
    assert {r["priority"]: (r["features"], r["at_target"], r["pct"]) for r in C.priority_rings(slots).collect()} == {"critical": (0, 0, 0), "high": (3, 1, 33), "medium": (0, 0, 0), "low": (0, 0, 0)}
    assert [tuple(r) for r in C.status_table(slots).orderBy("domain").collect()] == [("a", 2, 1, 1, 0), ("b", 1, 0, 0, 1)]
    assert [tuple(r)[:2] for r in C.status_table(slots, priority="high").orderBy("domain").collect()] == [("a", 1), ("b", 2)]
    gaps = {r["feature_id"]: r["gaps"] for r in S.feature_gaps(slots).collect()}
    assert gaps["f1"] == "Missing integration backend tests; Failing E2E web tests (pass rate: 45%)"
    assert gaps["f2"] == "" and gaps["f3"] == "Missing unit web tests; Missing E2E web tests"
    assert gaps["f4"] == "Missing unit web tests; Partial unit mobile coverage — additional tests needed"


def test_priorities_without_a_target(spark):
    reg = spark.createDataFrame([("x", "critical", 0.95, 2), ("y", "urgent", 0.3, 1), ("z", "low", 0.4, 0)], "feature_id string, priority string, health double, gap_count int")
    assert {r["priority"]: (r["total"], r["at_target"], r["gaps"]) for r in C.tier_summary(reg).collect()} == {"critical": (1, 0, 2), "high": (0, 0, 0), "medium": (0, 0, 0), "low": (1, 1, 0), "overall": (3, 1, 3)}
    assert [(r["feature_id"], round(r["score"], 9)) for r in K.legacy_sprint(reg).collect()] == [("x", 0.2), ("y", 0.2)]


def test_node_status_tiers(spark):
    nodes = spark.createDataFrame([(1, "a.x", "svc/auth.go"), (2, "a.y", "web/Page.tsx"), (3, "b", "svc/other.go"), (4, "c", "q/user.ts"), (5, "d", "z/payments/x.go"), (6, "e", "src/lone.go"), (7, "sql:getUser", ""), (8, "sql:drop", None), (9, "f", "main.go")],
                                  "id long, name string, file_path string")
    tests = spark.createDataFrame([("svc/auth_test.go",), ("web/Page.spec.tsx",), ("r/user_integration_test.go",), ("r/user.spec.ts",), ("e2e/payments/a.spec.ts",), ("src/unit/GetUserById_test.go",)], "file_path string")
    assert dict(S.node_status(nodes, tests).collect()) == {1: "tested", 2: "tested", 3: "partial", 4: "partial", 5: "partial", 6: "untested", 7: "partial", 8: "untested", 9: "untested"}


def test_diagnosis_ranks_the_culprit(spark):
    bodies = spark.createDataFrame([(1, "api.Handler", "func", "panic: nil pointer"), (2, "util.x", "func", "a pointer"), (3, "none", "func", "nothing"), (4, "empty", "func", None)], "id long, name string, kind string, body string")
    callers = spark.createDataFrame([(1, 8), (2, 2)], "id long, callers long")
    links = spark.createDataFrame([("f2", 1), ("f1", 1)], "feature_id string, symbol_id long")
    got = search.diagnose("  PANIC: nil pointer ", bodies, callers, links, most=5).collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["feature_id"] == "f1"
    assert got[0]["confidence"] == pytest.approx(0.55 / 3 + 0.25 * 2 / 6 + 0.2 + 0.15 * 0.5 / 3)
    with pytest.raises(ValueError):
        search.diagnose(" ", bodies, callers)
    assert search.tokens_of("Error at handler.go: nil Handler.go timeout") == ["handler.go", "timeout"]
