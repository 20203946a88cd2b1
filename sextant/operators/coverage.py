"""Coverage roll-ups and registry metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.paths import status_percent


def n_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def feature_status(results: DataFrame, run: DataFrame | int, feature: str | None = None) -> DataFrame:
    """Pass, fail and skip counts and the pass rate per feature in one run; results without a feature are a group."""
    mine = results.filter(F.col("run_id") == run) if isinstance(run, int) else results.join(F.broadcast(run.select("run_id")), "run_id", "left_semi")
    if feature:
        mine = mine.filter(F.col("feature_id") == feature)
    s = F.col("status")
    out = mine.groupBy("feature_id").agg(n_if(s == "pass").alias("passed"), n_if(s == "fail").alias("failed"), n_if(s == "skip").alias("skipped"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("pass_rate", F.col("passed") / F.col("total"))


def run_summary(results: DataFrame) -> DataFrame:
    """Per run the status counts as a JSON object."""
    s = F.col("status")
    counts = results.groupBy("run_id").agg(n_if(s == "pass").alias("pass"), n_if(s == "fail").alias("fail"), n_if(s == "skip").alias("skip"))
    return counts.select("run_id", F.to_json(F.struct("pass", "fail", "skip")).alias("summary"))


def caller_counts(edges: DataFrame) -> DataFrame:
    """Incoming edges per symbol with the largest such count of all."""
    counts = edges.groupBy(F.col("dst").alias("symbol_id")).agg(F.count(F.lit(1)).alias("callers"))
    # one row
    return counts.crossJoin(F.broadcast(counts.agg(F.max("callers").alias("max_callers"))))


#: The slots of a feature, in their order.
SLOTS = ("unit.backend", "unit.web", "unit.mobile", "integration.backend", "integration.mobile", "e2e.web", "e2e.mobile")


def _any(group: str, status: str) -> Column:
    """1 if a feature has a slot of a group (unit, integration, e2e) with a status, else 0. Absent slots are null."""
    return F.max(F.coalesce((F.col("slot").startswith(group + ".") & (F.col("status") == status)).cast("int"), F.lit(0))).cast("long")


def feature_flags(slots: DataFrame) -> DataFrame:
    """Per feature whether any of its unit, integration and e2e slots is covered, missing or failing, as 0 or 1."""
    return slots.groupBy("domain", "priority", "feature_id").agg(
        _any("unit", "covered").alias("covered_unit"), _any("unit", "missing").alias("missing_unit"), _any("integration", "covered").alias("covered_integration"),
        _any("e2e", "covered").alias("covered_e2e"), _any("e2e", "missing").alias("missing_e2e"), _any("e2e", "failing").alias("failing_e2e"))


FLAGS = ("covered_unit", "missing_unit", "covered_integration", "covered_e2e", "missing_e2e", "failing_e2e")


def registry_metrics(slots: DataFrame) -> DataFrame:
    """Features and how many have a covered, missing or failing slot of each group: in total, by domain and by priority, in one
    pass over grouping sets. Missing unit and failing e2e tests are not told by priority."""
    sets = feature_flags(slots).groupingSets([[], ["domain"], ["priority"]], "domain", "priority")
    out = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("features"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in FLAGS])
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "domain").otherwise("priority")
    told = lambda c: F.when(level != "priority", F.col(c)).alias(c) if c in ("missing_unit", "failing_e2e") else F.col(c)
    return out.select(level.alias("level"), F.coalesce("domain", "priority", F.lit("all")).alias("name"), "features", *map(told, FLAGS))


#: Layers in their order, and their weights in the health score; those without one weigh 0.05.
LAYERS = ("handler", "service", "repository", "query", "component", "hook")
LAYER_WEIGHTS = {"handler": 0.30, "service": 0.30, "repository": 0.25, "query": 0.15}
OTHER_WEIGHT = 0.05


def layer_coverage(nodes: DataFrame) -> DataFrame:
    """Tested percent per feature and layer; partial counts as tested, unknown layers are left out."""
    known = nodes.filter(F.col("layer").isin(*LAYERS))
    out = known.groupBy("feature_id", "layer").agg(n_if(F.col("status").isin("tested", "partial")).alias("tested"), F.count(F.lit(1)).alias("total"))
    order = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    return out.withColumn("pct", status_percent(F.col("tested"), F.col("total"))).withColumn("layer_no", order)


def layer_health(nodes: DataFrame) -> DataFrame:
    """Weighted health per feature, 0 to 1, over the layers it has, the weights renormalised; 0 without any."""
    w = F.coalesce(lookup_of(LAYER_WEIGHTS, F.col("layer")), F.lit(OTHER_WEIGHT))
    rows = layer_coverage(nodes).withColumn("w", w)
    own = rows.groupBy("feature_id").agg((F.sum(F.col("w") * F.col("pct") / 100.0) / F.sum("w")).alias("health"))
    return nodes.select("feature_id").distinct().join(own, "feature_id", "left").na.fill(0.0, ["health"])


def registry_health(slots: DataFrame) -> DataFrame:
    """Share of a feature's slots that are there which are covered or partial; 0 without any."""
    share = F.avg(F.col("status").isin("covered", "partial").cast("double"))  # null for absent slots, which do not count
    return slots.groupBy("feature_id").agg(F.coalesce(share, F.lit(0.0)).alias("health"))


#: Layers that benchmarks and race tests are wanted for.
BENCHMARKABLE, CONCURRENT = ("handler", "service", "repository"), ("handler", "service")


def perf_score(nodes: DataFrame) -> DataFrame:
    """0.6 of the benchmarked share of what can be benchmarked and 0.4 of the race-tested share of what is concurrent; a share
    of nothing is 0."""
    can, runs = F.col("layer").isin(*BENCHMARKABLE), F.col("layer").isin(*CONCURRENT)
    out = nodes.groupBy("feature_id").agg(
        n_if(can).alias("benchmarkable"), n_if(can & F.col("has_bench")).alias("benched"), n_if(runs).alias("concurrent"), n_if(runs & F.col("has_race")).alias("raced"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumn("perf", share("benched", "benchmarkable") * 0.6 + share("raced", "concurrent") * 0.4)


def perf_gaps(nodes: DataFrame) -> DataFrame:
    """What each node lacks (feature_id, id, layer, gap_type): benchmarks, race tests, and a memory baseline for every query."""
    layer = F.col("layer")
    kinds = F.array_compact(F.array(
        F.when(layer.isin(*BENCHMARKABLE) & ~F.col("has_bench"), "no-benchmark"), F.when(layer.isin(*CONCURRENT) & ~F.col("has_race"), "no-race-test"),
        F.when(layer == "query", "no-memory-baseline")))
    return nodes.select("feature_id", "id", "layer", F.explode(kinds).alias("gap_type"))


def updated_status(results: DataFrame) -> DataFrame:
    """Pass rate per feature and the status it gives: covered if all pass, else failing."""
    rated = results.filter("feature_id IS NOT NULL AND status <> 'skip'").groupBy("feature_id").agg(F.avg((F.col("status") == "pass").cast("double")).alias("pass_rate"))
    return rated.withColumn("status", F.when(F.col("pass_rate") >= 1.0, "covered").otherwise("failing"))


#: Priorities from the highest, the health each aims at, and its weight; others aim at 0.5 and weigh 1.
PRIORITIES = ("critical", "high", "medium", "low")
TARGETS = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4}
WEIGHTS = {"critical": 4.0, "high": 3.0, "medium": 2.0, "low": 1.0}
OTHER_TARGET, OTHER_PRIORITY_WEIGHT = 0.5, 1.0


def lookup_of(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def target_of(priority: Column) -> Column:
    return F.coalesce(lookup_of(TARGETS, priority), F.lit(OTHER_TARGET))


def tier_summary(audits: DataFrame) -> DataFrame:
    """Audited features (priority, health, gap_count) at their target, and their gaps, per priority and overall.

    Each of the four priorities has a row; features of others count in the overall row only.
    """
    at = F.col("health") >= target_of(F.col("priority"))
    counts = audits.groupBy("priority").agg(F.count(F.lit(1)).alias("total"), n_if(at).alias("at_target"), F.sum("gap_count").alias("gaps"))
    tiers = audits.sparkSession.createDataFrame([(p,) for p in PRIORITIES], "priority string")
    rows = tiers.join(counts, "priority", "left")
    both = rows.unionByName(counts.agg(F.lit("overall").alias("priority"), F.sum("total").alias("total"), F.sum("at_target").alias("at_target"), F.sum("gaps").alias("gaps")))
    both = both.na.fill(0, ["total", "at_target", "gaps"])
    return both.withColumn("pct", status_percent(F.col("at_target"), F.col("total")))


#: What a fix type of actions and performance gaps is called; other gaps are no fix.
PERF_FIXES = {"no-benchmark": "benchmarks", "no-race-test": "race tests"}


def features_by_fix(actions: DataFrame, gaps: DataFrame) -> DataFrame:
    """Features per fix type of ``actions`` (feature_id, test_type) and performance ``gaps`` (feature_id, gap_type): one with
    several fixes of a type counts once."""
    fixes = actions.select("feature_id", F.concat("test_type", F.lit(" tests")).alias("fix"))
    fixes = fixes.unionByName(gaps.select("feature_id", lookup_of(PERF_FIXES, F.col("gap_type")).alias("fix")).filter("fix IS NOT NULL"))
    return fixes.groupBy("fix").agg(F.countDistinct("feature_id").alias("features"))


def domain_of(feature_id: Column) -> Column:
    return F.substring_index(feature_id, ".", 1)


PASSED = ("pass", "flaky")


def health_trend(metrics: DataFrame) -> DataFrame:
    """Per feature and run 0.8 of the pass rate and 0.2 of how far the mean duration, in whole nanoseconds, is under 30 seconds.
    Flaky tests passed; results without a feature are left out."""
    rows = metrics.filter("feature_id IS NOT NULL AND feature_id <> ''").groupBy("feature_id", "run_seq").agg(
        F.avg(F.col("status").isin(*PASSED).cast("double")).alias("pass_rate"), F.call_function("div", F.sum("duration_ns"), F.count(F.lit(1))).alias("mean_ns"))
    speed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("mean_ns") / 30e9))
    return rows.withColumn("health", F.col("pass_rate") * 0.8 + speed * 0.2)


def run_counts(metrics: DataFrame) -> DataFrame:
    """Per run its results: total, passed (flaky ones too), failed, skipped and flaky."""
    s = F.col("status")
    return metrics.groupBy("run_seq").agg(
        F.count(F.lit(1)).alias("total"), n_if(s.isin(*PASSED)).alias("passed"), n_if(s == "fail").alias("failed"), n_if(s == "skip").alias("skipped"), n_if(s == "flaky").alias("flaky"))


def trend_series(runs: DataFrame) -> DataFrame:
    """Per run (``run_counts``) whole percents: passed, not failed, and passed with flaky ones as half, not below 0. Without
    tests: 0, 100 and 100."""
    pct = lambda n, none: F.when(F.col("total") > 0, F.call_function("div", n * 100, F.col("total"))).otherwise(none).cast("long")
    half = F.call_function("div", F.col("flaky"), F.lit(2))
    return runs.select("run_seq", pct(F.col("passed"), 0).alias("overall"), pct(F.col("total") - F.col("failed"), 100).alias("not_failing"),
                       F.greatest(pct(F.col("passed") - half, 100), F.lit(0)).cast("long").alias("steady"))


def priority_rings(slots: DataFrame) -> DataFrame:
    """Features, those with a covered unit slot, and these in whole percent, for each of the four priorities."""
    found = registry_metrics(slots).filter("level = 'priority'").select(F.col("name").alias("priority"), "features", F.col("covered_unit").alias("at_target"))
    rows = slots.sparkSession.createDataFrame([(p,) for p in PRIORITIES], "priority string").join(found, "priority", "left").na.fill(0, ["features", "at_target"])
    return rows.withColumn("pct", F.when(F.col("features") > 0, F.call_function("div", F.col("at_target") * 100, F.col("features"))).otherwise(0).cast("long"))


def coverage_bars(slots: DataFrame) -> DataFrame:
    """Features with a covered unit, integration and e2e slot, and these in whole percent of all."""
    total = registry_metrics(slots).filter("level = 'all'")
    bar = F.explode(F.array(*[F.struct(F.lit(g).alias("label"), F.col(f"covered_{g}").alias("n")) for g in ("unit", "integration", "e2e")]))
    rows = total.select("features", bar.alias("b")).select("features", "b.*")
    return rows.select("label", "n", F.when(F.col("features") > 0, F.call_function("div", F.col("n") * 100, F.col("features"))).otherwise(0).cast("long").alias("pct"))


#: The slots that the dashboard's health looks at.
DASHBOARD_SLOTS = ("unit.backend", "unit.web", "integration.backend", "e2e.web")


def dashboard_health(slots: DataFrame) -> DataFrame:
    """Share of a feature's four slots, of those that are there, that are not missing; 0 without any."""
    mine = F.when(F.col("slot").isin(*DASHBOARD_SLOTS), (F.col("status") != "missing").cast("double"))
    return slots.groupBy("feature_id").agg(F.coalesce(F.avg(mine), F.lit(0.0)).alias("health"))


def import_popularity(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'import'").groupBy("dst").agg(F.count(F.lit(1)).alias("popularity"))


def ingest_counts(stored: DataFrame, arriving: DataFrame, key: str) -> DataFrame:
    """Rows that would be added to and skipped by an insert-or-ignore on ``key``."""
    seen = stored.select(key).distinct().withColumn("_seen", F.lit(True))
    rows = arriving.select(key).distinct().join(seen, key, "left")
    return rows.agg(n_if(F.col("_seen").isNull()).alias("added"), n_if(F.col("_seen").isNotNull()).alias("skipped"))


def status_table(slots: DataFrame, domain: str = "", priority: str = "", status: str = "") -> DataFrame:
    """Features per domain, and those with a covered unit, integration and e2e slot. The domain ``_unmapped`` has no row.

    ``priority`` and ``status`` (of any slot) filter the features; then a domain's total is the running number of
    features found in it and the domains before it.
    """
    mine = slots.filter("domain <> '_unmapped'")
    if domain:
        mine = mine.filter(F.col("domain") == domain)
    per = mine.groupBy("domain", "priority", "feature_id").agg(
        *[_any(g, "covered").alias(g) for g in ("unit", "integration", "e2e")], F.max(F.coalesce((F.col("status") == status).cast("int"), F.lit(0))).alias("has"))
    found = F.lit(True)
    if priority:
        found = found & (F.col("priority") == priority)
    if status:
        found = found & (F.col("has") == 1)
    n = lambda c: F.coalesce(F.sum(F.when(found, F.col(c))), F.lit(0)).cast("long")
    out = per.groupBy("domain").agg(n_if(found).alias("total"), n("unit").alias("unit_covered"), n("integration").alias("integration_covered"), n("e2e").alias("e2e_covered"))
    # a row per domain
    return out.withColumn("total", F.sum("total").over(Window.orderBy("domain").rowsBetween(Window.unboundedPreceding, 0))) if priority or status else out
