"""Queries for aggregations and orderings (A and W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import coverage as C
from sextant.operators import lookup as L
from sextant.operators import ranking as K
from sextant.plans.registry import query

LATEST = "(SELECT id FROM coverage_runs ORDER BY finished_us DESC, id DESC LIMIT 1)"
FEATURE_STATUS = """
SELECT feature_id, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed,
       count(*) FILTER (WHERE status = 'skip') AS skipped, count(*) AS total, count(*) FILTER (WHERE status = 'pass') / count(*)::DOUBLE AS pass_rate
FROM coverage_results WHERE run_id = """


@query("a01_feature_status", FEATURE_STATUS + LATEST + " GROUP BY feature_id")
def a01(t):
    return C.feature_status(t.coverage_results, L.latest_run(t.coverage_runs))


@query("a02_all_run_coverage", """
SELECT l.feature_id, count(DISTINCT l.symbol_id) AS symbols, count(DISTINCT CASE WHEN c.status = 'pass' THEN l.symbol_id END) AS passed
FROM feature_symbols l LEFT JOIN coverage_results c ON c.symbol_id = l.symbol_id GROUP BY l.feature_id""")
def _(t):
    ok = t.coverage_results.filter("status = 'pass'").select("symbol_id").distinct().withColumn("ok", F.lit(1))
    links = t.feature_symbols.select("feature_id", "symbol_id").distinct().join(ok, "symbol_id", "left")
    return links.groupBy("feature_id").agg(F.count(F.lit(1)).alias("symbols"), F.count("ok").alias("passed"))


@query("a03_run_summary", """
SELECT run_id, '{"pass":' || count(*) FILTER (WHERE status = 'pass') || ',"fail":' || count(*) FILTER (WHERE status = 'fail') || ',"skip":' || count(*) FILTER (WHERE status = 'skip') || '}' AS summary
FROM coverage_results GROUP BY run_id""")
def _(t):
    return C.run_summary(t.coverage_results)


@query("a04_caller_counts", "SELECT dst AS symbol_id, count(*) AS callers, max(count(*)) OVER () AS max_callers FROM edges GROUP BY dst")
def _(t):
    return C.caller_counts(t.edges)


# per feature: any slot of a group with a status; a slot that is not there has a null status
_FLAGS = """f AS (SELECT domain, priority, feature_id, max((slot LIKE 'unit.%' AND status IS NOT DISTINCT FROM 'covered')::INT) AS cu, max((slot LIKE 'unit.%' AND status IS NOT DISTINCT FROM 'missing')::INT) AS mu,
  max((slot LIKE 'integration.%' AND status IS NOT DISTINCT FROM 'covered')::INT) AS ci, max((slot LIKE 'e2e.%' AND status IS NOT DISTINCT FROM 'covered')::INT) AS ce,
  max((slot LIKE 'e2e.%' AND status IS NOT DISTINCT FROM 'missing')::INT) AS me, max((slot LIKE 'e2e.%' AND status IS NOT DISTINCT FROM 'failing')::INT) AS fe FROM slots GROUP BY 1, 2, 3)"""
_SUMS = "count(*) AS features, sum(cu)::BIGINT AS covered_unit, {0} AS missing_unit, sum(ci)::BIGINT AS covered_integration, sum(ce)::BIGINT AS covered_e2e, sum(me)::BIGINT AS missing_e2e, {1} AS failing_e2e FROM f"
_TOLD, _UNTOLD = _SUMS.format("sum(mu)::BIGINT", "sum(fe)::BIGINT"), _SUMS.format("NULL::BIGINT", "NULL::BIGINT")


@query("a05_registry_metrics", f"""
WITH {_FLAGS} SELECT 'all' AS level, 'all' AS name, {_TOLD} UNION ALL SELECT 'domain', domain, {_TOLD} GROUP BY domain UNION ALL SELECT 'priority', priority, {_UNTOLD} GROUP BY priority""")
def _(t):
    return C.registry_metrics(t.slots)


_LAYER = """SELECT feature_id, layer, count(*) FILTER (WHERE status IN ('tested', 'partial')) AS tested, count(*) AS total,
  count(*) FILTER (WHERE status IN ('tested', 'partial')) * 100.0e0 / count(*) AS pct,
  list_position(['handler', 'service', 'repository', 'query', 'component', 'hook'], layer)::BIGINT AS layer_no
  FROM nodes WHERE layer IN ('handler', 'service', 'repository', 'query', 'component', 'hook') GROUP BY feature_id, layer"""


@query("a06_layer_coverage", _LAYER)
def _(t):
    return C.layer_coverage(t.nodes)


@query("a07_layer_health", f"""
SELECT n.feature_id, round(coalesce(h.health, 0), 9) AS health FROM (SELECT DISTINCT feature_id FROM nodes) n LEFT JOIN (
  SELECT feature_id, sum(w * pct / 100) / sum(w) AS health FROM (
    SELECT *, CASE layer WHEN 'handler' THEN 0.30e0 WHEN 'service' THEN 0.30e0 WHEN 'repository' THEN 0.25e0 WHEN 'query' THEN 0.15e0 ELSE 0.05e0 END AS w FROM ({_LAYER})) GROUP BY feature_id) h USING (feature_id)""")
def _(t):
    return C.layer_health(t.nodes).withColumn("health", F.round("health", 9))


@query("a08_registry_health", """
SELECT feature_id, round(CASE WHEN count(status) = 0 THEN 0.0e0 ELSE count(*) FILTER (WHERE status = 'covered' OR status = 'partial') / count(status)::DOUBLE END, 9) AS health FROM slots GROUP BY feature_id""")
def _(t):
    return C.registry_health(t.slots).withColumn("health", F.round("health", 9))


@query("a09_perf_score", """
SELECT feature_id, b AS benchmarkable, bb AS benched, c AS concurrent, cr AS raced,
       round(CASE WHEN b > 0 THEN bb / b::DOUBLE ELSE 0.0e0 END * 0.6e0 + CASE WHEN c > 0 THEN cr / c::DOUBLE ELSE 0.0e0 END * 0.4e0, 9) AS perf
FROM (SELECT feature_id, count(*) FILTER (WHERE layer IN ('handler', 'service', 'repository')) AS b, count(*) FILTER (WHERE layer IN ('handler', 'service', 'repository') AND has_bench) AS bb,
             count(*) FILTER (WHERE layer IN ('handler', 'service')) AS c, count(*) FILTER (WHERE layer IN ('handler', 'service') AND has_race) AS cr FROM nodes GROUP BY feature_id)""")
def _(t):
    return C.perf_score(t.nodes).withColumn("perf", F.round("perf", 9))


@query("a10_updated_status", """
SELECT feature_id, round(r, 9) AS pass_rate, CASE WHEN r >= 1.0 THEN 'covered' ELSE 'failing' END AS status
FROM (SELECT feature_id, avg(CASE WHEN status = 'pass' THEN 1.0e0 ELSE 0.0e0 END) AS r FROM coverage_results WHERE feature_id IS NOT NULL AND status <> 'skip' GROUP BY feature_id)""")
def _(t):
    return C.updated_status(t.coverage_results).withColumn("pass_rate", F.round("pass_rate", 9))


_TARGET = "CASE priority WHEN 'critical' THEN 1.0e0 WHEN 'high' THEN 0.8e0 WHEN 'medium' THEN 0.6e0 WHEN 'low' THEN 0.4e0 ELSE 0.5e0 END"


@query("a11_tier_summary", f"""
WITH c AS (SELECT priority, count(*) AS total, count(*) FILTER (WHERE health >= {_TARGET}) AS at_target, sum(gap_count)::BIGINT AS gaps FROM registry GROUP BY priority),
b AS (SELECT p.priority, coalesce(total, 0) AS total, coalesce(at_target, 0) AS at_target, coalesce(gaps, 0) AS gaps FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) p(priority) LEFT JOIN c USING (priority)
  UNION ALL SELECT 'overall', sum(total)::BIGINT, sum(at_target)::BIGINT, sum(gaps)::BIGINT FROM c)
SELECT priority, total, at_target, gaps, CASE WHEN total > 0 THEN at_target * 100.0e0 / total ELSE 0.0e0 END AS pct FROM b""")
def _(t):
    return C.tier_summary(t.registry)


@query("a12_features_by_fix", """
WITH a AS (
  SELECT feature_id, CASE WHEN layer IN ('repository', 'query') THEN 'integration tests' ELSE 'unit tests' END AS fix FROM nodes WHERE status <> 'tested'
  UNION ALL SELECT feature_id, 'benchmarks' FROM nodes WHERE layer IN ('handler', 'service', 'repository') AND NOT has_bench
  UNION ALL SELECT feature_id, 'race tests' FROM nodes WHERE layer IN ('handler', 'service') AND NOT has_race
  UNION ALL SELECT feature_id, 'e2e tests' FROM slots WHERE (slot = 'e2e.web' AND has_web OR slot = 'e2e.mobile' AND has_mobile) AND (status IS NULL OR status = 'missing'))
SELECT fix, count(DISTINCT feature_id) AS features FROM a GROUP BY fix""")
def _(t):
    actions = K.gaps_by_severity(t.nodes).select("feature_id", "test_type").unionByName(K.e2e_actions(t.slots))
    return C.features_by_fix(actions, C.perf_gaps(t.nodes))


@query("a12_perf_gaps", """
SELECT feature_id, id, layer, g AS gap_type FROM (
  SELECT *, unnest([CASE WHEN layer IN ('handler', 'service', 'repository') AND NOT has_bench THEN 'no-benchmark' END, CASE WHEN layer IN ('handler', 'service') AND NOT has_race THEN 'no-race-test' END,
    CASE WHEN layer = 'query' THEN 'no-memory-baseline' END]) AS g FROM nodes) WHERE g IS NOT NULL""")
def _(t):
    return C.perf_gaps(t.nodes)


@query("a13_features_by_domain", "SELECT split_part(feature_id, '.', 1) AS domain, string_agg(feature_id, ',' ORDER BY feature_id) AS features FROM registry GROUP BY 1")
def _(t):
    ids = F.array_join(F.array_sort(F.collect_list("feature_id")), ",")
    return t.registry.groupBy(C.domain_of(F.col("feature_id")).alias("domain")).agg(ids.alias("features"))


@query("a14_health_trend", """
SELECT feature_id, run_seq, round(p, 9) AS pass_rate, m AS mean_ns, round(p * 0.8e0 + greatest(0.0e0, least(1.0e0, 1.0e0 - m / 30e9)) * 0.2e0, 9) AS health
FROM (SELECT feature_id, run_seq, avg(CASE WHEN status = 'pass' OR status = 'flaky' THEN 1.0e0 ELSE 0.0e0 END) AS p, (sum(duration_ns) // count(*))::BIGINT AS m FROM test_metrics WHERE feature_id IS NOT NULL GROUP BY 1, 2)""")
def _(t):
    return C.health_trend(t.test_metrics).select("feature_id", "run_seq", F.round("pass_rate", 9).alias("pass_rate"), "mean_ns", F.round("health", 9).alias("health"))


# flaky tests are counted as passed and as flaky
_RUNS = """r AS (SELECT run_seq, count(*) AS total, count(*) FILTER (WHERE status IN ('pass', 'flaky')) AS passed, count(*) FILTER (WHERE status = 'fail') AS failed, count(*) FILTER (WHERE status = 'flaky') AS flaky FROM test_metrics GROUP BY run_seq)"""


@query("a15_trend_series", f"""
WITH {_RUNS} SELECT run_seq, (passed * 100 // total)::BIGINT AS overall, ((total - failed) * 100 // total)::BIGINT AS not_failing, greatest((passed - flaky // 2) * 100 // total, 0)::BIGINT AS steady FROM r""")
def _(t):
    return C.trend_series(C.run_counts(t.test_metrics))


@query("a16_priority_rings", f"""
WITH {_FLAGS} SELECT p.priority, count(feature_id) AS features, coalesce(sum(cu), 0)::BIGINT AS at_target, CASE WHEN count(feature_id) > 0 THEN (sum(cu) * 100 // count(feature_id))::BIGINT ELSE 0 END AS pct
FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) p(priority) LEFT JOIN f USING (priority) GROUP BY p.priority""")
def _(t):
    return C.priority_rings(t.slots)


@query("a16_coverage_bars", f"""
WITH {_FLAGS}, b AS (SELECT 'unit' AS label, sum(cu)::BIGINT AS n, count(*) AS total FROM f UNION ALL SELECT 'integration', sum(ci)::BIGINT, count(*) FROM f UNION ALL SELECT 'e2e', sum(ce)::BIGINT, count(*) FROM f)
SELECT label, n, (n * 100 // total)::BIGINT AS pct FROM b""")
def _(t):
    return C.coverage_bars(t.slots)


@query("a17_dashboard_health", """
WITH d AS (SELECT feature_id, status FROM slots WHERE slot IN ('unit.backend', 'unit.web', 'integration.backend', 'e2e.web') AND status IS NOT NULL)
SELECT s.feature_id, round(coalesce(h.health, 0), 9) AS health FROM (SELECT DISTINCT feature_id FROM slots) s
LEFT JOIN (SELECT feature_id, count(*) FILTER (WHERE status <> 'missing') / count(*)::DOUBLE AS health FROM d GROUP BY 1) h USING (feature_id)""")
def _(t):
    return C.dashboard_health(t.slots).withColumn("health", F.round("health", 9))


@query("a18_import_popularity", "SELECT dst, count(*) AS popularity FROM edges WHERE kind = 'import' GROUP BY dst")
def _(t):
    return C.import_popularity(t.edges)


@query("a19_ingest_counts", """
SELECT count(*) FILTER (WHERE NOT old) AS added, count(*) FILTER (WHERE old) AS skipped
FROM (SELECT s.id, s.id % 3 = 0 AS old FROM symbols s WHERE s.id % 2 = 0)""")
def _(t):
    return C.ingest_counts(t.symbols.filter("id % 3 = 0"), t.symbols.filter("id % 2 = 0"), "id")


@query("a20_status_table", f"""
WITH {_FLAGS} SELECT domain, count(*) AS total, sum(cu)::BIGINT AS unit_covered, sum(ci)::BIGINT AS integration_covered, sum(ce)::BIGINT AS e2e_covered FROM f WHERE domain <> '_unmapped' GROUP BY domain""")
def _(t):
    return C.status_table(t.slots)


@query("a20_filtered_status", f"""
WITH {_FLAGS}, h AS (SELECT DISTINCT feature_id FROM slots WHERE status = 'failing'),
d AS (SELECT f.domain, count(*) FILTER (WHERE k) AS n, coalesce(sum(cu) FILTER (WHERE k), 0)::BIGINT AS u, coalesce(sum(ci) FILTER (WHERE k), 0)::BIGINT AS i, coalesce(sum(ce) FILTER (WHERE k), 0)::BIGINT AS e
  FROM (SELECT *, priority = 'high' AND feature_id IN (SELECT feature_id FROM h) AS k FROM f WHERE domain <> '_unmapped') f GROUP BY f.domain)
SELECT domain, sum(n) OVER (ORDER BY domain)::BIGINT AS total, u AS unit_covered, i AS integration_covered, e AS e2e_covered FROM d""")
def _(t):
    return C.status_table(t.slots, priority="high", status="failing")


@query("w03_top_reasons", """
SELECT feature_id, string_agg(message, '; ' ORDER BY k) AS reasons FROM (
  SELECT feature_id, message, row_number() OVER (PARTITION BY feature_id ORDER BY weight DESC, message) AS k
  FROM (SELECT feature_id, slot || ' ' || status AS message, CASE status WHEN 'failing' THEN 3 WHEN 'missing' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END AS weight FROM slots WHERE status IS NOT NULL)
  WHERE weight > 0) WHERE k <= 3 GROUP BY feature_id""")
def _(t):
    weight = F.when(F.col("status") == "failing", 3).when(F.col("status") == "missing", 2).when(F.col("status") == "partial", 1).otherwise(0)
    rows = t.slots.filter("status IS NOT NULL").select("feature_id", F.concat_ws(" ", "slot", "status").alias("message"), weight.alias("weight"))
    return K.top_reasons(rows)


@query("w05_slowest_tests", "SELECT name, file, max(duration_ns) AS duration_ns FROM test_metrics GROUP BY name, file ORDER BY duration_ns DESC, name, file LIMIT 10")
def _(t):
    return K.slowest_tests(t.test_metrics)


@query("w06_memory_hogs", "SELECT id, name, file, bytes_per_op FROM test_metrics WHERE bytes_per_op > 0 ORDER BY bytes_per_op DESC, id LIMIT 10")
def _(t):
    return K.memory_hogs(t.test_metrics)


_NEWEST = "SELECT id, name, file, run_seq FROM (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY run_seq DESC, id) AS k FROM test_metrics WHERE {0}) WHERE k = 1"


@query("w07_newest_flaky", _NEWEST.format("retries > 0 OR status = 'flaky'"))
def _(t):
    return K.newest_flaky(t.test_metrics).select("id", "name", "file", "run_seq")


@query("w07_newest_races", _NEWEST.format("race_detected"))
def _(t):
    return K.newest_races(t.test_metrics).select("id", "name", "file", "run_seq")


# a point per result, in the order of runs; the older half against the newer
@query("w08_failing_trends", """
WITH k AS (SELECT feature_id, CASE WHEN status IN ('pass', 'flaky') THEN 1.0e0 ELSE 0.0e0 END AS p, row_number() OVER (PARTITION BY feature_id ORDER BY run_seq, id) AS k, count(*) OVER (PARTITION BY feature_id) AS n
  FROM test_metrics WHERE feature_id IS NOT NULL),
h AS (SELECT feature_id, avg(p) FILTER (WHERE k <= n // 2) AS b, avg(p) FILTER (WHERE k > n // 2) AS a FROM k WHERE n >= 3 GROUP BY feature_id)
SELECT feature_id, round(b, 9) AS before, round(a, 9) AS after FROM h WHERE a < b - 0.05e0""")
def _(t):
    return K.failing_trends(t.test_metrics).select("feature_id", F.round("before", 9).alias("before"), F.round("after", 9).alias("after"))


@query("w09_latest_by_name", """
SELECT id, name, duration_ns FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY run_seq DESC, id) AS k FROM test_metrics) WHERE k = 1 ORDER BY duration_ns DESC, name LIMIT 5""")
def _(t):
    return K.latest_by_name(t.test_metrics)


@query("w10_gaps_by_severity", """
SELECT feature_id, id, layer, severity, list_position(['critical', 'high', 'medium', 'low'], severity)::INT AS severity_no,
  CASE status WHEN 'partial' THEN 'incomplete' ELSE 'no' END || CASE layer WHEN 'handler' THEN ' unit test for handler' WHEN 'service' THEN ' unit test for service method' WHEN 'repository' THEN ' integration test for repository'
    WHEN 'query' THEN ' test coverage for SQL query' WHEN 'component' THEN ' test for component' WHEN 'hook' THEN ' test for hook' ELSE ' test coverage' END AS reason,
  CASE WHEN layer IN ('repository', 'query') THEN 'integration' ELSE 'unit' END AS test_type
FROM (SELECT *, CASE WHEN layer IN ('handler', 'service') THEN 'critical' WHEN layer = 'repository' THEN 'high' WHEN layer = 'query' THEN 'medium' ELSE 'low' END AS severity FROM nodes WHERE status <> 'tested')""")
def _(t):
    return K.gaps_by_severity(t.nodes)


@query("w11_legacy_sprint", f"""
SELECT feature_id, priority, score FROM (SELECT feature_id, priority, CASE priority WHEN 'critical' THEN 4.0e0 WHEN 'high' THEN 3.0e0 WHEN 'medium' THEN 2.0e0 ELSE 1.0e0 END * greatest(0.0e0, {_TARGET} - health) AS score FROM registry)
WHERE score > 0 ORDER BY score DESC, feature_id LIMIT 20""")
def _(t):
    return K.legacy_sprint(t.registry)


_DEFS = "SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'func' WHEN 1 THEN 'huma-op' WHEN 2 THEN 'graphql' WHEN 3 THEN 'route' WHEN 4 THEN 'func' ELSE 'type' END AS kind, 'f' || (p_partkey % 9) || '.go' AS file_path, p_partkey % 50 AS line, p_name || p_partkey AS name FROM part"


@query("w12_contract_order", f"""
SELECT id, rank AS kind_rank, row_number() OVER (ORDER BY rank, file_path, line, name) AS place FROM (SELECT *, CASE kind WHEN 'huma-op' THEN 0 WHEN 'route' THEN 1 WHEN 'graphql' THEN 2 WHEN 'func' THEN 3 ELSE 99 END::INT AS rank FROM ({_DEFS}))""")
def _(t):
    from sextant.sources.storage import indexed

    rows, _ = indexed(K.contract_order(t.sql(_DEFS)), "kind_rank", "file_path", "line", "name", tag="contract-order")
    return rows.select("id", "kind_rank", (F.col("_at") + 1).alias("place"))


@query("w13_k08_last_runs", "SELECT id, run_seq FROM test_metrics WHERE run_seq IN (SELECT DISTINCT run_seq FROM test_metrics ORDER BY run_seq DESC LIMIT 5)")
def _(t):
    return K.keep_last_runs(t.test_metrics, 5).select("id", "run_seq")
