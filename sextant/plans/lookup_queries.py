"""Queries for look-ups and joins (R and J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import paths
from sextant.operators import lookup as L
from sextant.plans.derived import DAY_US, NOW_US
from sextant.plans.registry import query

_TEST = r"(^|/)tests?/|(^|/)conftest\.py$|(^|/)test_[^/]*\.py$|_test\.(py|go)$"


@query("r01_list_symbols", "SELECT id, qualified_name, kind, file_path, line FROM symbols WHERE package = 'pkg7' AND kind = 'func'")
def _(t):
    return L.symbols(t.symbols, package="pkg7", kind="func").select("id", "qualified_name", "kind", "file_path", "line")


@query("r02_find_by_name", "SELECT id, qualified_name, file_path FROM symbols WHERE qualified_name = (SELECT max(qualified_name) FROM symbols)")
def _(t):
    return t.symbols.join(t.symbols.agg(F.max("qualified_name").alias("qualified_name")), "qualified_name").select("id", "qualified_name", "file_path")


@query("r03_fuzzy_find", """
SELECT id, qualified_name, file_path, line, CASE WHEN qualified_name = 'fn42' THEN 0 WHEN ends_with(qualified_name, '.fn42') THEN 1 ELSE 2 END AS match
FROM symbols WHERE contains(qualified_name, 'fn42') ORDER BY match, file_path, line, qualified_name LIMIT 1""")
def _(t):
    return L.find_symbol(t.symbols, "fn42").select("id", "qualified_name", "file_path", "line", "match")


_NEAR = """
SELECT id, symbol_id, qualified_name, symbol_line FROM (
  SELECT a.id, s.id AS symbol_id, s.qualified_name, s.line AS symbol_line,
         row_number() OVER (PARTITION BY a.id ORDER BY s.line, s.qualified_name, s.id) AS k
  FROM annotations a JOIN symbols s ON a.file_path = s.file_path AND s.line BETWEEN a.line AND a.line + 30) WHERE k = 1"""


@query("r04_j03_nearest_symbol", _NEAR)
def _(t):
    return L.nearest_symbol(t.annotations, t.symbols)


@query("r05_features_by_kind", "SELECT id, title, kind FROM features WHERE kind = 'contract' AND id IN ('f0', 'f4', 'f8', 'f9', 'f16')")
def _(t):
    return L.where_equal(t.features, kind="contract").filter(F.col("id").isin("f0", "f4", "f8", "f9", "f16")).select("id", "title", "kind")


@query("r06_runs_and_results", """
SELECT r.id AS run_id, r.framework, r.finished_us, count(*) AS n_results FROM coverage_runs r JOIN coverage_results c ON c.run_id = r.id
WHERE r.framework = 'vitest' GROUP BY r.id, r.framework, r.finished_us""")
def _(t):
    runs = L.where_equal(t.coverage_runs, framework="vitest").withColumnRenamed("id", "run_id")
    return t.coverage_results.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_results")).join(runs, "run_id").select("run_id", "framework", "finished_us", "n_results")


@query("r07_latest_run", "SELECT id AS run_id, finished_us FROM coverage_runs ORDER BY finished_us DESC, id DESC LIMIT 1")
def _(t):
    return L.latest_run(t.coverage_runs)


@query("r08_find_by_pattern", """
SELECT id, qualified_name FROM symbols WHERE id IN (SELECT symbol_id FROM pattern_matches WHERE pattern = 'outbox-append')""")
def _(t):
    return L.with_pattern(t.symbols, t.pattern_matches, "outbox-append").select("id", "qualified_name")


@query("r09_j05_annotations_of_context", """
SELECT id, file_path, line, kind, value FROM annotations WHERE file_path IN (SELECT file_path FROM annotations WHERE kind = 'bc' AND value = 'bc1')""")
def _(t):
    return L.annotations_of_context(t.annotations, "bc1").select("id", "file_path", "line", "kind", "value")


@query("r10_find_aggregate", r"""
SELECT id, file_path, line, regexp_extract(value, 'service=(\S+)', 1) AS service FROM annotations
WHERE kind = 'aggregate-service' AND split_part(value, ' ', 1) = 'agg2' ORDER BY file_path, line, id LIMIT 1""")
def _(t):
    return L.find_aggregate(t.annotations, "agg2").select("id", "file_path", "line", "service")


@query("r11_walk_saga", r"""
SELECT id, file_path, line, regexp_extract(value, 'step=(\d+)', 1)::INT AS step FROM annotations
WHERE kind = 'saga' AND split_part(value, ' ', 1) = 'saga1' AND regexp_matches(value, 'step=\d+')""")
def _(t):
    return L.walk_saga(t.annotations, "saga1").select("id", "file_path", "line", "step")


@query("r12_consumers", r"SELECT id, file_path, regexp_extract(value, 'stream=(\S+)', 1) AS stream FROM annotations WHERE kind = 'consumer' AND value LIKE 'stream=st2 %'")
def _(t):
    return L.consumers(t.annotations, "st2").select("id", "file_path", "stream")


@query("r13_emitters", """
SELECT event, coalesce(string_agg(site, ',' ORDER BY site) FILTER (WHERE kind = 'event-emit'), '') AS emits,
       coalesce(string_agg(site, ',' ORDER BY site) FILTER (WHERE kind = 'outbox-publish'), '') AS publishes
FROM (SELECT DISTINCT kind, value AS event, file_path || ':' || line AS site FROM annotations WHERE kind IN ('event-emit', 'outbox-publish')) GROUP BY event""")
def _(t):
    return L.emitters(t.annotations)


@query("r14_by_file_and_links", """
SELECT f.id AS feature_id, l.symbol_id, l.role, s.file_path, h.content_hash FROM features f JOIN feature_symbols l ON l.feature_id = f.id
JOIN symbols s ON s.id = l.symbol_id JOIN file_hashes h ON h.file_path = s.file_path WHERE f.id = 'f9'""")
def _(t):
    links = L.where_equal(t.feature_symbols, feature_id="f9").join(t.symbols.select(F.col("id").alias("symbol_id"), "file_path"), "symbol_id")
    links = links.join(t.features.select(F.col("id").alias("feature_id")), "feature_id", "left_semi")
    return links.join(t.file_hashes, "file_path").select("feature_id", "symbol_id", "role", "file_path", "content_hash")


@query("r15_resolve_snapshot", "SELECT max(id) AS id FROM coverage_runs WHERE framework = 'jest'")
def _(t):
    return L.where_equal(t.coverage_runs, framework="jest").agg(F.max("id").alias("id"))


@query("r16_stale_sample", """
WITH n AS (SELECT greatest(1, count(*) // 16) AS step FROM file_hashes),
k AS (SELECT file_path, content_hash, least, row_number() OVER (ORDER BY file_path) - 1 AS k FROM file_hashes)
SELECT file_path, (least % 4 = 0 OR least % 3 = 0) AS stale FROM k, n WHERE k % step = 0 AND k // step < 16""")
def _(t):
    now = t.file_hashes.filter("least % 4 <> 0").withColumn("content_hash", F.when(F.col("least") % 3 == 0, "changed").otherwise(F.col("content_hash")))
    return L.stale_sample(t.file_hashes, now)


@query("r17_expired_files", "SELECT file_path, scanned_us FROM file_hashes WHERE scanned_us < NOW_US - 30 * DAY_US")
def _(t):
    return L.expired(t.file_hashes, NOW_US, 30 * DAY_US).select("file_path", "scanned_us")


@query("r18_test_paths", f"SELECT id, regexp_matches(file_path, '{_TEST}') AS is_test, regexp_matches(file_path, '{_TEST}') OR regexp_matches(file_path, '(^|/)test_') AS loose FROM symbols")
def _(t):
    p = F.col("file_path")
    return t.symbols.select("id", paths.is_test_path(p).alias("is_test"), paths.is_test_path(p, loose=True).alias("loose"))


@query("r19_context_path", "SELECT id, nullif(regexp_extract(file_path, '^(src/contexts/[^/]+)/', 1), '') AS bc FROM symbols")
def _(t):
    return t.symbols.select("id", paths.bc_path(F.col("file_path")).alias("bc"))


@query("r25_ignored_files", "SELECT id, file_path FROM symbols WHERE NOT (file_path LIKE 'tests/%' OR file_path LIKE 'src/%/m1%.py' OR starts_with(file_path, 'vendor/'))")
def _(t):
    from sextant.operators.resolve import not_ignored

    return not_ignored(t.symbols, "file_path", ["tests/*", "src/*/m1*.py"], ["vendor/"]).select("id", "file_path")


_DEAD = f"""
SELECT s.id, s.qualified_name, s.file_path FROM symbols s
WHERE NOT regexp_matches(s.file_path, '{_TEST}') AND NOT EXISTS (
  SELECT 1 FROM edges e JOIN symbols f ON f.id = e.src
  WHERE e.dst = s.id AND e.kind = 'import' AND e.edge_meta IN ('module', 'conditional') AND NOT regexp_matches(f.file_path, '{_TEST}'))"""


@query("j02_dead_symbols", _DEAD)
def _(t):
    return L.dead_symbols(t.symbols, t.edges).select("id", "qualified_name", "file_path")


@query("j02_dead_all_kinds", "SELECT s.id FROM symbols s WHERE starts_with(s.file_path, 'src/contexts/bc1') AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.id AND e.edge_meta = 'function')")
def _(t):
    return L.dead_symbols(t.symbols, t.edges, kind="all", scopes=["function"], include_tests=True, prefix="src/contexts/bc1").select("id")


@query("j01_g10_import_edges", """
SELECT e.seq, e.src, e.dst, a.qualified_name AS src_name, b.qualified_name AS dst_name, e.edge_meta FROM edges e JOIN symbols a ON a.id = e.src JOIN symbols b ON b.id = e.dst
WHERE e.kind = 'import' AND e.edge_meta = 'module' AND (starts_with(a.file_path, 'src/contexts/bc2') OR starts_with(b.file_path, 'src/contexts/bc2'))""")
def _(t):
    return L.import_edges(t.edges, t.symbols, ["module"], "src/contexts/bc2").select("seq", "src", "dst", "src_name", "dst_name", "edge_meta")


@query("j04_declaration_owner", """
SELECT id, file_path, line, value FROM (
  SELECT d.id, d.file_path, d.line, n.value, row_number() OVER (PARTITION BY d.id ORDER BY n.line DESC,
         CASE n.kind WHEN 'contract' THEN 3 WHEN 'feature' THEN 2 ELSE 1 END DESC, n.id) AS k
  FROM symbols d JOIN annotations n ON n.file_path = d.file_path AND d.line > n.line AND d.line - n.line <= 10
  WHERE NOT EXISTS (SELECT 1 FROM symbols x WHERE x.file_path = d.file_path AND x.line > n.line AND x.line < d.line)) WHERE k = 1""")
def _(t):
    return L.declaration_owner(t.annotations, t.symbols)


@query("j06_feature_coverage", """
SELECT f.id, count(DISTINCT l.symbol_id) AS n_symbols, count(DISTINCT CASE WHEN c.status = 'pass' THEN c.symbol_id END) AS n_passed
FROM features f LEFT JOIN feature_symbols l ON l.feature_id = f.id LEFT JOIN coverage_results c ON c.symbol_id = l.symbol_id AND c.run_id = 7 GROUP BY f.id""")
def _(t):
    passed = t.coverage_results.filter("run_id = 7 AND status = 'pass'").select("symbol_id", F.lit(1).alias("ok")).distinct()
    links = t.feature_symbols.select(F.col("feature_id").alias("id"), "symbol_id").distinct().join(passed, "symbol_id", "left")
    counts = links.groupBy("id").agg(F.count(F.lit(1)).alias("n_symbols"), F.count("ok").alias("n_passed"))
    return t.features.select("id").join(counts, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_symbols", "n_passed")])


@query("j07_feature_symbols", """
SELECT f.id AS feature_id, s.id AS symbol_id, s.qualified_name, l.role FROM features f JOIN feature_symbols l ON l.feature_id = f.id JOIN symbols s ON s.id = l.symbol_id WHERE f.kind = 'contract'""")
def _(t):
    f = t.features.filter("kind = 'contract'").select(F.col("id").alias("feature_id"))
    s = t.symbols.select(F.col("id").alias("symbol_id"), "qualified_name")
    return t.feature_symbols.join(f, "feature_id").join(s, "symbol_id").select("feature_id", "symbol_id", "qualified_name", "role")


@query("j09_linked_contracts", """
SELECT DISTINCT a.feature_id, b.feature_id AS contract_id FROM feature_symbols a JOIN feature_symbols b ON a.symbol_id = b.symbol_id AND b.role = 'contract' AND a.feature_id <> b.feature_id""")
def _(t):
    a = t.feature_symbols.select("feature_id", "symbol_id").distinct()
    b = t.feature_symbols.filter("role = 'contract'").select(F.col("feature_id").alias("contract_id"), "symbol_id").distinct()
    return a.join(b, "symbol_id").filter("feature_id <> contract_id").select("feature_id", "contract_id").distinct()


@query("j10_first_link", "SELECT symbol_id, min(feature_id) AS feature_id FROM feature_symbols GROUP BY symbol_id")
def _(t):
    return t.feature_symbols.groupBy("symbol_id").agg(F.min("feature_id").alias("feature_id"))


@query("j15_shared_packages", """
WITH seg AS (SELECT DISTINCT id, x FROM (SELECT id, unnest(string_split(file_path, '/')) AS x FROM symbols) WHERE strlen(x) > 3 AND x NOT IN ('src', 'internal', 'pkg', 'cmd', 'tests', 'test', '__tests__'))
SELECT id, x AS segment, n FROM seg JOIN (SELECT x, count(*) AS n FROM seg GROUP BY x HAVING count(*) > 1) USING (x)""")
def _(t):
    from sextant.operators.legacy import shared_segments
    from sextant.operators.scoring import COMMON_FOLDERS

    return shared_segments(t.symbols, "id", "file_path", list(COMMON_FOLDERS))


@query("j16_contract_merge", """
SELECT DISTINCT s.id, s.qualified_name FROM symbols s JOIN feature_symbols l ON l.symbol_id = s.id AND l.role = 'contract'
WHERE NOT EXISTS (SELECT 1 FROM annotations a JOIN symbols x ON a.id = x.id WHERE x.id = s.id AND a.kind = 'contract')""")
def _(t):
    defs = t.symbols.join(t.feature_symbols.filter("role = 'contract'").select(F.col("symbol_id").alias("id")), "id", "left_semi")
    routed = t.annotations.filter("kind = 'contract'").select("id")
    return defs.join(routed, "id", "left_anti").select("id", "qualified_name")
