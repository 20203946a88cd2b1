"""Orderings, top-k lists and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.operators.coverage import OTHER_PRIORITY_WEIGHT, PASSED, PRIORITIES, WEIGHTS, lookup_of, target_of


def top(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of an order; 0 gives none. Partitions keep ``n`` rows each before they meet."""
    return df.orderBy(*order).limit(max(0, n))


def best_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first of the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def top_reasons(reasons: DataFrame, n: int = 3) -> DataFrame:
    """Per feature the messages of its ``n`` heaviest reasons, joined; weights of zero do not count."""
    w = Window.partitionBy("feature_id").orderBy(F.desc("weight"), "message")
    few = reasons.filter("weight > 0").withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("_k", "message")))
    return few.groupBy("feature_id").agg(F.concat_ws("; ", F.transform(ordered, lambda x: x["message"])).alias("reasons"))


def slowest_tests(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The slowest tests, each at its longest duration."""
    longest = metrics.groupBy("name", "file").agg(F.max("duration_ns").alias("duration_ns"))
    return top(longest, n, F.desc("duration_ns"), "name", "file")


def memory_hogs(metrics: DataFrame, n: int = 10) -> DataFrame:
    """Measurements with the most bytes per operation; a test may come more than once."""
    return top(metrics.filter("bytes_per_op > 0").select("id", "name", "file", "bytes_per_op"), n, F.desc("bytes_per_op"), "id")


def newest_flaky(metrics: DataFrame) -> DataFrame:
    """Tests that were retried or flaky, at their newest such run, the first result in it."""
    return best_of(metrics.filter("retries > 0 OR status = 'flaky'"), ["name", "file"], F.desc("run_seq"), F.asc("id"))


def newest_races(metrics: DataFrame) -> DataFrame:
    """Tests with a data race, at their newest such run, the first result in it."""
    return best_of(metrics.filter("race_detected"), ["name", "file"], F.desc("run_seq"), F.asc("id"))


def failing_trends(metrics: DataFrame, drop: float = 0.05, newest_first: bool = False) -> DataFrame:
    """Features whose pass rate fell by over ``drop`` from the first half of their results to the second.

    Every result is a point, 1 if it passed or was flaky, in the order of runs; three points at least. ``newest_first`` reads
    the runs backwards, which finds those that improved.
    """
    point = F.col("status").isin(*PASSED).cast("double")
    w = Window.partitionBy("feature_id")
    k = F.row_number().over(w.orderBy(F.desc("run_seq") if newest_first else F.asc("run_seq"), "id"))
    halves = metrics.filter("feature_id IS NOT NULL AND feature_id <> ''").select("feature_id", "run_seq", "id", point.alias("p")).withColumn("k", k).withColumn("n", F.count(F.lit(1)).over(w)).filter("n >= 3")
    first = F.col("k") <= F.floor(F.col("n") / 2)
    out = halves.groupBy("feature_id").agg(F.avg(F.when(first, F.col("p"))).alias("before"), F.avg(F.when(~first, F.col("p"))).alias("after"))
    return out.filter(F.col("after") < F.col("before") - drop)


def latest_by_name(metrics: DataFrame, n: int = 5) -> DataFrame:
    """The newest measurement per test name, the first of its run, the slowest ``n`` of these."""
    return top(best_of(metrics, ["name"], F.desc("run_seq"), F.asc("id")).select("id", "name", "duration_ns"), n, F.desc("duration_ns"), "name")


def priority_rank(priority: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), priority)


#: How grave an untested node of a layer is (others: low), and what is told of it.
SEVERITY = {"handler": "critical", "service": "critical", "repository": "high", "query": "medium"}
REASONS = {
    "handler": "unit test for handler", "service": "unit test for service method", "repository": "integration test for repository",
    "query": "test coverage for SQL query", "component": "test for component", "hook": "test for hook",
}
#: The type of test that closes a gap in a layer; others: unit.
TEST_TYPES = {"repository": "integration", "query": "integration"}


def gaps_by_severity(nodes: DataFrame) -> DataFrame:
    """Nodes that are not tested, with their severity, its place in the order of severities, the reason and the test type."""
    lack = nodes.filter("status <> 'tested'")
    severity = F.coalesce(lookup_of(SEVERITY, F.col("layer")), F.lit("low"))
    label = F.when(F.col("status") == "partial", "incomplete").otherwise("no")
    reason = F.concat_ws(" ", label, F.coalesce(lookup_of(REASONS, F.col("layer")), F.lit("test coverage")))
    kind = F.coalesce(lookup_of(TEST_TYPES, F.col("layer")), F.lit("unit"))
    return lack.select("feature_id", "id", "layer", severity.alias("severity"), priority_rank(severity).cast("int").alias("severity_no"), reason.alias("reason"), kind.alias("test_type"))


def e2e_actions(slots: DataFrame) -> DataFrame:
    """Features (feature_id, test_type) with a web or mobile surface whose e2e slot of it is absent or missing."""
    surface = F.when(F.col("slot") == "e2e.web", F.col("has_web")).when(F.col("slot") == "e2e.mobile", F.col("has_mobile"))
    return slots.filter(surface & (F.col("status").isNull() | (F.col("status") == "missing"))).select("feature_id", F.lit("e2e").alias("test_type"))


def legacy_sprint(registry: DataFrame, n: int = 20) -> DataFrame:
    """Features under the target of their priority, by weight times what they lack."""
    lack = F.greatest(F.lit(0.0), target_of(F.col("priority")) - F.col("health"))
    weight = F.coalesce(lookup_of(WEIGHTS, F.col("priority")), F.lit(OTHER_PRIORITY_WEIGHT))
    scored = registry.withColumn("score", weight * lack).filter("score > 0")
    return top(scored.select("feature_id", "priority", "score"), n, F.desc("score"), "feature_id")


#: The order of contract kinds; all others come last, together.
CONTRACT_KINDS = ("huma-op", "route", "graphql", "func")


def contract_order(defs: DataFrame) -> DataFrame:
    """Definitions (kind, file_path, line, name) with their kind's place, in the order of it, file, line and name."""
    at = F.array_position(F.array(*[F.lit(k) for k in CONTRACT_KINDS]), F.col("kind"))
    return defs.withColumn("kind_rank", F.when(at > 0, at - 1).otherwise(99).cast("int")).orderBy("kind_rank", "file_path", "line", "name")


def keep_last_runs(history: DataFrame, n: int = 100) -> DataFrame:
    """Rows of the last ``n`` runs: the runs are counted first, so that the window has a row per run."""
    runs = history.select("run_seq").distinct()
    last = runs.orderBy(F.desc("run_seq")).limit(n)
    return history.join(F.broadcast(last), "run_seq", "left_semi")
