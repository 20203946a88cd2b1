import pytest
from support import DATA

from sextant.plans import verbs
from sextant.plans.derived import NOW_US, Tables


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, f"{DATA}/sf0.001")


def test_scopes():
    assert verbs.scopes(None, ["module"]) == ["module"] and verbs.scopes(" ", ["module"]) == ["module"]
    assert verbs.scopes("Function, module", []) == ["function", "module"]
    assert len(verbs.scopes("module,all", [])) == 5
    for bad in ("nope", ",", "nope,all"):
        with pytest.raises(ValueError):
            verbs.scopes(bad, [])


def test_dead_options(t):
    with pytest.raises(ValueError):
        verbs.dead(t, "odd")
    assert verbs.dead(t, "any").count() <= verbs.dead(t, "import").count()


def test_trace_targets(t, spark):
    assert verbs.trace(t, "saga:saga1").count() > 0
    name = t.symbols.filter("id = 5").first()["qualified_name"]
    assert verbs.trace(t, f"symbol:{name}", 1).filter("depth = 0").count() == 1
    assert verbs.trace(t, "f7", 1).filter("depth = 0").count() > 0
    with pytest.raises(LookupError):
        verbs.trace(t, "nothing at all")

    class Both:
        features, symbols = spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([(1, "a.x", "f", 1)], "id long, qualified_name string, file_path string, line long")
        edges, feature_symbols = t.edges, t.feature_symbols

    with pytest.raises(ValueError):
        verbs.trace(Both, "x")


def test_scores_are_in_range(t):
    rows = verbs.audit(t, NOW_US).collect()
    assert len(rows) == 40 and all(0 <= r["score"] <= 100 for r in rows)
    assert [r["score"] for r in rows] == sorted(r["score"] for r in rows)
    assert verbs.audit(t, NOW_US, 3).count() == 3
    assert verbs.sprint(t, NOW_US, 0).count() == 0 and verbs.sprint(t, NOW_US).count() == 40
    assert all(0 <= r["priority"] <= 100 for r in verbs.sprint(t, NOW_US).collect())


def test_compare_a_snapshot_with_itself(t):
    tables = {"features": t.features.select("id", "kind")}
    assert verbs.compare(tables, tables, {"features": ["id"]}).first()["is_empty"]
