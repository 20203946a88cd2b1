"""Queries for scores, differences and symptom search (H, D, W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import coverage as C
from sextant.operators import diffs as D
from sextant.operators import lookup as L
from sextant.operators import scoring as S
from sextant.operators import search
from sextant.plans.derived import NOW_US
from sextant.plans.registry import query

_RUN = "run AS (SELECT id AS run_id, finished_us FROM coverage_runs ORDER BY finished_us DESC, id DESC LIMIT 1), res AS (SELECT * FROM coverage_results WHERE run_id = (SELECT run_id FROM run))"
_COV = """cov AS (
  SELECT w.feature_id, 100.0e0 * count(*) FILTER (WHERE p OR c) / count(*) FILTER (WHERE p OR c OR NOT s) AS score
  FROM (SELECT w.feature_id, w.symbol_id, coalesce(bool_or(r.status = 'pass'), false) AS p, coalesce(bool_or(r.status = 'skip'), false) AS s,
               bool_or(EXISTS (SELECT 1 FROM res x WHERE x.symbol_id IS NULL AND x.feature_id = w.feature_id AND x.status = 'pass')) AS c
        FROM (SELECT DISTINCT feature_id, symbol_id FROM feature_symbols WHERE role <> 'test') w LEFT JOIN res r ON r.symbol_id = w.symbol_id GROUP BY 1, 2) w
  GROUP BY w.feature_id HAVING count(*) FILTER (WHERE p OR c OR NOT s) > 0)"""
_FILES = "files AS (SELECT DISTINCT l.feature_id, s.file_path FROM feature_symbols l JOIN symbols s ON s.id = l.symbol_id)"
_FRESH = """fresh AS (SELECT f.feature_id, 100.0e0 * count(*) FILTER (WHERE NOW_US - b.author_us <= 30 * DAY_US) / count(*) AS score
  FROM files f JOIN annotations a ON a.file_path = f.file_path AND a.kind IN ('feature', 'contract') JOIN blame b ON b.file_path = a.file_path AND b.line = a.line GROUP BY f.feature_id)"""
_PAT = """pat AS (SELECT f.feature_id, 100.0e0 * count(*) FILTER (WHERE a.file_path IN (SELECT s.file_path FROM pattern_matches m JOIN symbols s ON s.id = m.symbol_id WHERE m.pattern = 'canonical-service')) / count(*) AS score
  FROM files f JOIN annotations a ON a.file_path = f.file_path AND a.kind = 'aggregate-service' GROUP BY f.feature_id)"""
_DRIFT = """cand AS (
  SELECT a.feature_id, b.feature_id AS contract_id FROM feature_symbols a JOIN feature_symbols b ON a.symbol_id = b.symbol_id AND a.role = 'contract' AND b.role = 'contract'
  UNION SELECT id, id FROM features WHERE kind = 'contract'),
drift AS (SELECT c.feature_id, 100.0e0 * count(*) FILTER (WHERE NOW_US - f.updated_us <= 30 * DAY_US) / count(*) AS score
  FROM cand c JOIN features f ON f.id = c.contract_id AND f.kind = 'contract' GROUP BY c.feature_id)"""
_ALL = f"WITH {_RUN}, {_COV}, {_FILES}, {_FRESH}, {_PAT}, {_DRIFT}"
_SIGNALS = """(SELECT feature_id, score, 0.40e0 AS w FROM cov UNION ALL SELECT feature_id, score, 0.15e0 FROM fresh UNION ALL SELECT feature_id, score, 0.25e0 FROM pat UNION ALL SELECT feature_id, score, 0.20e0 FROM drift)"""
_HEALTH = f"health AS (SELECT f.id AS feature_id, coalesce(sum(s.w * s.score) / sum(s.w), 0.0e0) AS score, count(s.w) AS n_signals FROM features f LEFT JOIN {_SIGNALS} s ON s.feature_id = f.id GROUP BY f.id)"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


def _latest(t):
    run = L.latest_run(t.coverage_runs)
    return run, t.coverage_results.join(F.broadcast(run.select("run_id")), "run_id", "left_semi")


@query("h01_coverage_signal", f"WITH {_RUN}, {_COV} SELECT feature_id, 'coverage' AS signal, round(score, 9) AS score FROM cov")
def _(t):
    return _rounded(S.coverage_signal(t.feature_symbols, _latest(t)[1]), "score")


@query("h02_freshness_signal", f"WITH {_FILES}, {_FRESH} SELECT feature_id, 'annotation_freshness' AS signal, round(score, 9) AS score FROM fresh")
def _(t):
    return _rounded(S.freshness_signal(t.feature_symbols, t.symbols, t.annotations, t.blame, NOW_US), "score")


@query("h03_pattern_signal", f"WITH {_FILES}, {_PAT} SELECT feature_id, 'pattern_compliance' AS signal, round(score, 9) AS score FROM pat")
def _(t):
    return _rounded(S.pattern_signal(t.feature_symbols, t.symbols, t.annotations, t.pattern_matches), "score")


@query("h04_drift_signal", f"WITH {_DRIFT} SELECT feature_id, 'contract_drift' AS signal, round(score, 9) AS score FROM drift")
def _(t):
    return _rounded(S.drift_signal(t.features, t.feature_symbols, NOW_US), "score")


def _health(t):
    return S.health(t.features, S.all_signals(t, L.latest_run(t.coverage_runs), NOW_US))


@query("h05_feature_health", f"{_ALL}, {_HEALTH} SELECT feature_id, round(score, 9) AS score, n_signals, CASE WHEN n_signals = 0 THEN 'no signal' END AS reason FROM health")
def _(t):
    return _rounded(_health(t), "score")


@query("w01_worst_features", f"{_ALL}, {_HEALTH} SELECT feature_id, round(score, 9) AS score FROM health ORDER BY round(score, 9), feature_id LIMIT 7")
def _(t):
    return _rounded(_health(t), "score").orderBy("score", "feature_id").limit(7).select("feature_id", "score")


_SPRINT = f"""{_ALL}, {_HEALTH},
fails AS (SELECT w.feature_id, least(count(*), 100)::DOUBLE AS bug FROM (SELECT DISTINCT feature_id, symbol_id FROM feature_symbols WHERE role <> 'test') w
  JOIN res r ON r.symbol_id = w.symbol_id AND r.status = 'fail' WHERE (SELECT NOW_US - finished_us <= 7 * DAY_US FROM run) GROUP BY w.feature_id),
touch AS (SELECT f.feature_id, NOW_US - max(b.author_us) AS age FROM files f JOIN annotations a ON a.file_path = f.file_path AND a.kind IN ('feature', 'contract') JOIN blame b ON b.file_path = a.file_path AND b.line = a.line GROUP BY 1),
n AS (SELECT feature_id, count(*) AS n FROM feature_symbols GROUP BY 1),
s AS (SELECT h.feature_id, h.score, coalesce(x.bug, 0.0e0) AS bug, coalesce(CASE WHEN u.age <= 7 * DAY_US THEN 100.0e0 WHEN u.age >= 97 * DAY_US THEN 0.0e0 ELSE 100.0e0 * (1.0e0 - (u.age - 7 * DAY_US) / (90 * DAY_US)::DOUBLE) END, 0.0e0) AS recency, coalesce(n.n, 0) AS n
  FROM health h LEFT JOIN fails x USING (feature_id) LEFT JOIN touch u USING (feature_id) LEFT JOIN n USING (feature_id)),
p AS (SELECT feature_id, round(least(100.0e0, greatest(0.0e0, (100.0e0 - score) * 0.6e0 + bug * 0.2e0 + recency * 0.2e0)), 9) AS priority, bug, round(recency, 9) AS recency, CASE WHEN n <= 3 THEN 'S' WHEN n <= 15 THEN 'M' ELSE 'L' END AS cost FROM s)"""


def _sprint(t):
    run = L.latest_run(t.coverage_runs)
    out = S.sprint(_health(t).select("feature_id", "score"), t.feature_symbols, t.symbols, t.coverage_results, run, t.annotations, t.blame, NOW_US)
    return _rounded(out, "priority", "recency")


@query("h06_sprint_priority", _SPRINT + " SELECT * FROM p")
def _(t):
    return _sprint(t)


@query("w02_sprint_top", _SPRINT + " SELECT feature_id, priority FROM p ORDER BY priority DESC, feature_id LIMIT 5")
def _(t):
    return _sprint(t).orderBy(F.desc("priority"), "feature_id").limit(5).select("feature_id", "priority")


_SYMPTOM = "panic: connection refused by haed handler"
_DIAGNOSE = """
WITH b AS (SELECT doc_id AS id, 'fn' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.Handler' WHEN 1 THEN '.OrderService' WHEN 2 THEN '.httpclient' ELSE '.util' END AS name,
  'func' AS kind, text AS body FROM documents),
c AS (SELECT dst AS id, count(*) AS callers FROM edges GROUP BY dst),
n AS (SELECT b.id, name, len(regexp_extract_all(body, '(?i)panic: connection refused by haed handler')) AS body_hits,
      len(regexp_extract_all(body, '(?i)(panic|connection|refused|haed|handler)')) AS token_hits, coalesce(c.callers, 0) AS callers FROM b LEFT JOIN c ON c.id = b.id),
m AS (SELECT * FROM n WHERE body_hits + token_hits > 0)
SELECT id, name, body_hits::BIGINT AS body_hits, token_hits::BIGINT AS token_hits, callers, round(least(1.0e0, least(1.0e0, body_hits / 3.0e0) * 0.55e0 + least(1.0e0, token_hits / 6.0e0) * 0.25e0
  + callers / (SELECT max(callers) FROM m)::DOUBLE * 0.2e0 + CASE WHEN name LIKE '%Handler' THEN 0.5e0 * 0.15e0 / 3 WHEN name LIKE '%Service' THEN 0.5e0 * 0.15e0 WHEN name LIKE '%client' THEN 0.9e0 * 0.15e0 ELSE 0.0e0 END), 9) AS confidence
FROM m"""


def _diagnose(t):
    name = F.concat(F.lit("fn"), F.col("doc_id"), F.element_at(F.array(*map(F.lit, (".Handler", ".OrderService", ".httpclient", ".util", ".util"))), (F.col("doc_id") % 5 + 1).cast("int")))
    bodies = t.documents.select(F.col("doc_id").alias("id"), name.alias("name"), F.lit("func").alias("kind"), F.col("text").alias("body"))
    out = search.diagnose(_SYMPTOM, bodies, t.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers")))
    return out.select("id", "name", F.col("body_hits").cast("long").alias("body_hits"), F.col("token_hits").cast("long").alias("token_hits"), "callers", F.round("confidence", 9).alias("confidence"))


@query("h07_diagnose", _DIAGNOSE)
def _(t):
    return _diagnose(t)


@query("w04_diagnose_top", f"SELECT id, name, confidence FROM ({_DIAGNOSE}) WHERE confidence >= 0.1 ORDER BY confidence DESC, name LIMIT 12")
def _(t):
    return _diagnose(t).filter("confidence >= 0.1").orderBy(F.desc("confidence"), "name").limit(12).select("id", "name", "confidence")


@query("j11_symptom_rules", """
SELECT p_partkey, rule_no FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ': Duplicate key' WHEN 1 THEN ' 404 not found' WHEN 2 THEN ' unexpected EOF' ELSE ' ok' END AS s FROM part) CROSS JOIN (
  SELECT * FROM (VALUES (0, '(?i)(unique constraint|duplicate key|duplicate entry|violates unique)'), (22, '(?i)(404|not found)'), (19, '(?i)(EOF|unexpected EOF|broken pipe|connection reset)')) v(rule_no, pattern)) r
WHERE regexp_matches(s, pattern)""")
def _(t):
    tail = F.element_at(F.array(*map(F.lit, (": Duplicate key", " 404 not found", " unexpected EOF", " ok"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    said = t.part.select("p_partkey", F.concat("p_name", tail).alias("symptom"))
    return search.matching_rules(said, search.rules_table(t.spark).filter("rule_no IN (0, 22, 19)")).select("p_partkey", "rule_no")


@query("j12_kind_bonus", """
SELECT id, round(max(b), 9) AS bonus FROM (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 0.15e0 * 0.95e0 WHEN c_custkey % 3 = 1 THEN 0.15e0 * 0.95e0 / 3 END AS b FROM customer) WHERE b IS NOT NULL GROUP BY id""")
def _(t):
    name = F.element_at(F.array(*map(F.lit, ("userRepo", "UserService", "plain"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    rules = search.rules_table(t.spark).filter("rule_no = 0").drop("pattern")
    return _rounded(search.kind_bonus(rules, t.customer.select(F.col("c_custkey").alias("id"), name.alias("name"), F.lit("func").alias("kind"))), "bonus")


_NODES = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'internal/' || p_name || '/svc' || (p_partkey % 90) || '.go' WHEN 1 THEN 'web/src/pages/Page' || (p_partkey % 70) || '.tsx'
  WHEN 2 THEN 'lib/m' || (p_partkey % 50) || '.ts' WHEN 3 THEN 'internal/billing/pay' || p_partkey || '.go' WHEN 4 THEN 'cmd/x' || p_partkey || '.go' WHEN 5 THEN 'main.go' WHEN 6 THEN 'pkg/abc/m' || p_partkey || '.go' END AS file_path,
  'sql:Get' || (p_partkey % 40) AS name FROM part"""
_TESTS = """SELECT CASE p_partkey % 7 WHEN 0 THEN 'internal/' || p_name || '/svc' || (p_partkey % 60) || '_test.go' WHEN 1 THEN 'web/src/pages/Page' || (p_partkey % 45) || '.spec.tsx' WHEN 2 THEN 'lib/m' || (p_partkey % 30) || '.test.ts'
  WHEN 3 THEN 'other/x' || (p_partkey % 400) || '_integration_test.go' WHEN 4 THEN 'e2e/billing/a' || p_partkey || '.spec.ts' WHEN 5 THEN 'q/forget' || (p_partkey % 9) || '_e2e_test.go' ELSE 'q/test_m' || p_partkey || '.py' END AS file_path FROM part"""


# a test beside; in the folder; of the name, endings taken off one after another; sharing a segment of over three bytes; by name
@query("h08_node_status", rf"""
WITH n AS ({_NODES}), t AS (SELECT DISTINCT file_path AS p FROM ({_TESTS})),
d AS (SELECT p, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS folder,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '^.*/', ''), '\.[^.]*$', ''), '_test$', ''), '\.test$', ''), '\.spec$', ''), '_e2e_test$', ''), '_integration_test$', '') AS stem FROM t),
seg AS (SELECT DISTINCT x FROM (SELECT unnest(string_split(p, '/')) AS x FROM t) WHERE strlen(x) > 3 AND x NOT IN ('src', 'internal', 'pkg', 'cmd', 'tests', 'test', '__tests__')),
m AS (SELECT id, file_path, lower(replace(name, 'sql:', '')) AS q, regexp_replace(file_path, '\.[^./]*$', '') AS bare, CASE WHEN contains(file_path, '/') THEN regexp_replace(file_path, '/[^/]*$', '') ELSE '.' END AS folder FROM n),
akin AS (SELECT DISTINCT id FROM (SELECT id, unnest(string_split(file_path, '/')) AS x FROM m) WHERE x IN (SELECT x FROM seg))
SELECT id, CASE WHEN file_path IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(stem) AS s FROM d) z WHERE contains(z.s, m.q)) THEN 'partial' ELSE 'untested' END
  WHEN bare || '_test.go' IN (SELECT p FROM t) OR bare || '.test.ts' IN (SELECT p FROM t) OR bare || '.test.tsx' IN (SELECT p FROM t) OR bare || '.spec.ts' IN (SELECT p FROM t) OR bare || '.spec.tsx' IN (SELECT p FROM t) THEN 'tested'
  WHEN folder IN (SELECT folder FROM d) OR regexp_replace(bare, '^.*/', '') IN (SELECT stem FROM d) OR id IN (SELECT id FROM akin) THEN 'partial' ELSE 'untested' END AS status FROM m""")
def _(t):
    return S.node_status(t.sql(_NODES), t.sql(_TESTS))


#: What a slot lacks.
GAP = """CASE WHEN status IS NULL AND CASE WHEN slot IN ('unit.backend', 'integration.backend') THEN has_api WHEN slot IN ('unit.web', 'e2e.web') THEN has_web ELSE has_mobile END OR status = 'missing' THEN 'Missing ' || label || ' tests'
  WHEN status = 'failing' THEN 'Failing ' || label || ' tests' || CASE WHEN slot LIKE 'e2e.%' THEN ' (pass rate: ' || trunc(pass_rate * 100)::INT || '%)' ELSE '' END
  WHEN status = 'partial' THEN 'Partial ' || label || ' coverage — additional ' || CASE WHEN slot LIKE 'e2e.%' THEN 'scenarios' ELSE 'tests' END || ' needed' END"""
LABELLED = "(SELECT *, replace(replace(slot, '.', ' '), 'e2e', 'E2E') AS label FROM slots)"


@query("h09_feature_gaps", f"""
SELECT feature_id, count(gap) AS n_gaps, coalesce(string_agg(gap, '; ' ORDER BY slot_no), '') AS gaps, count(gap) = 0 AS complete FROM (SELECT feature_id, slot_no, {GAP} AS gap FROM {LABELLED}) GROUP BY feature_id""")
def _(t):
    return S.feature_gaps(t.slots).withColumn("n_gaps", F.col("n_gaps").cast("long"))


@query("h09_suggestions", """
WITH s AS (SELECT *, status IS NULL OR status = 'missing' AS lacks FROM slots), x AS (
  SELECT feature_id, 0 AS no, 'Add Go unit tests for the service/handler layer' AS suggestion FROM s WHERE slot = 'unit.backend' AND lacks AND has_api
  UNION ALL SELECT feature_id, 1, 'Add Vitest test for ' || component || ' component' FROM s WHERE slot = 'unit.web' AND lacks AND has_web
  UNION ALL SELECT feature_id, 2, 'Add Jest test for ' || screen || ' screen' FROM s WHERE slot = 'unit.mobile' AND lacks AND has_mobile
  UNION ALL SELECT feature_id, 3, 'Add integration test for GET ' || route || ' endpoint' FROM s WHERE slot = 'integration.backend' AND lacks AND has_api
  UNION ALL SELECT feature_id, 4, 'Add Playwright spec for ' || route || ' route' FROM s WHERE slot = 'e2e.web' AND lacks AND has_web
  UNION ALL SELECT feature_id, 5, 'Add Maestro flow for ' || screen || ' screen' FROM s WHERE slot = 'e2e.mobile' AND lacks AND has_mobile
  UNION ALL SELECT feature_id, 6, 'Consider adding real integration tests — backend unit tests use mocks' FROM s WHERE slot = 'unit.backend' AND status IS NOT NULL AND mocked
  UNION ALL SELECT feature_id, 7, 'Fix failing web E2E tests (pass rate: ' || round(pass_rate * 100)::INT || '%)' FROM s WHERE slot = 'e2e.web' AND status = 'failing'
  UNION ALL SELECT feature_id, 8, 'Fix failing mobile E2E tests (pass rate: ' || round(pass_rate * 100)::INT || '%)' FROM s WHERE slot = 'e2e.mobile' AND status = 'failing')
SELECT feature_id, no::INT AS no, suggestion FROM x""")
def _(t):
    return S.suggestions(t.slots.withColumn("method", F.lit("GET")).withColumn("path", F.col("route")))


# two versions of each table: the rows of one side lack some keys and differ in others
_VERSIONS = {
    "d01_features": ("features", "id", ["kind"], "id <> 'f3'", "id <> 'f5'", {"kind": "CASE WHEN id IN ('f4', 'f6') THEN 'other' ELSE kind END"}),
    "d02_symbols": ("symbols", "id", ["kind", "line"], "id % 17 <> 0", "id % 19 <> 0", {"line": "CASE WHEN id % 23 = 0 THEN line + 1 ELSE line END"}),
    "d05_contracts": ("features", "id", ["kind", "owner"], "id <> 'f8'", "kind = 'contract'", {"owner": "CASE WHEN id IN ('f12', 'f24') THEN 'nobody' ELSE owner END"}),
}


def _version(t, name, side):
    table, key, compare, a, b, change = _VERSIONS[name]
    df = getattr(t, table)
    return df.filter(a).select(key, *compare) if side == "a" else df.filter(b).selectExpr(key, *[f"{change[c]} AS {c}" if c in change else c for c in compare])


def _diff_sql(name):
    table, key, compare, a, b, change = _VERSIONS[name]
    right = ", ".join(f"{change[c]} AS {c}" if c in change else c for c in compare)
    differs = " OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in compare)
    cols = ", ".join(f"a.{c} AS a_{c}, b.{c} AS b_{c}" for c in compare)
    return f"""SELECT * FROM (SELECT coalesce(a.k, b.k) AS {key}, {cols}, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN {differs} THEN 'changed' END AS change
      FROM (SELECT {key} AS k, {', '.join(compare)} FROM {table} WHERE {a}) a FULL JOIN (SELECT {key} AS k, {right} FROM {table} WHERE {b}) b ON a.k = b.k) WHERE change IS NOT NULL"""


for _name in _VERSIONS:
    query(_name, _diff_sql(_name))(lambda t, n=_name: D.keyed_diff(_version(t, n, "a"), _version(t, n, "b"), [_VERSIONS[n][1]], _VERSIONS[n][2]))


_EDGES = "(SELECT DISTINCT src, dst FROM edges WHERE seq % 31 <> {0})"


@query("d03_edges", f"""
SELECT src, dst, 'removed' AS change FROM (SELECT * FROM {_EDGES.format(3)} EXCEPT SELECT * FROM {_EDGES.format(4)})
UNION ALL SELECT src, dst, 'added' FROM (SELECT * FROM {_EDGES.format(4)} EXCEPT SELECT * FROM {_EDGES.format(3)})""")
def _(t):
    side = lambda k: t.edges.filter(f"seq % 31 <> {k}").select("src", "dst").distinct()
    return D.keyed_diff(side(3), side(4), ["src", "dst"])


def _notes_sql(cond, bump):
    return f"(SELECT file_path, line, max_by(kind, id) AS kind, max_by({bump}, id) AS value FROM annotations WHERE {cond} GROUP BY file_path, line)"


_BUMP = "CASE WHEN id % 37 = 0 THEN value || '!' ELSE value END"


@query("d04_annotations", f"""
SELECT * FROM (SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.line, b.line) AS line, a.kind AS a_kind, b.kind AS b_kind, a.value AS a_value, b.value AS b_value,
  CASE WHEN a.file_path IS NULL THEN 'added' WHEN b.file_path IS NULL THEN 'removed' WHEN a.kind <> b.kind OR a.value <> b.value THEN 'changed' END AS change
FROM {_notes_sql('id % 11 <> 0', 'value')} a FULL JOIN {_notes_sql('id % 13 <> 0', _BUMP)} b ON a.file_path = b.file_path AND a.line = b.line) WHERE change IS NOT NULL""")
def _(t):
    a = D.last_of(t.annotations.filter("id % 11 <> 0").select("file_path", "line", "id", "kind", "value"), ["file_path", "line"], "id")
    b = D.last_of(t.annotations.filter("id % 13 <> 0").selectExpr("file_path", "line", "id", "kind", f"{_BUMP} AS value"), ["file_path", "line"], "id")
    return D.keyed_diff(a, b, ["file_path", "line"], ["kind", "value"])


@query("d06_patterns", """
SELECT coalesce(a.symbol_id, b.symbol_id) AS symbol_id, coalesce(a.pattern, b.pattern) AS pattern, CASE WHEN a.symbol_id IS NULL THEN 'added' ELSE 'removed' END AS change
FROM (SELECT symbol_id, pattern FROM pattern_matches WHERE symbol_id % 9 <> 0) a FULL JOIN (SELECT symbol_id, pattern FROM pattern_matches WHERE symbol_id % 8 <> 0) b
  ON a.symbol_id = b.symbol_id AND a.pattern = b.pattern WHERE a.symbol_id IS NULL OR b.symbol_id IS NULL""")
def _(t):
    side = lambda k: t.pattern_matches.filter(f"symbol_id % {k} <> 0").select("symbol_id", "pattern")
    return D.keyed_diff(side(9), side(8), ["symbol_id", "pattern"])


@query("d07_audit_scores", """
SELECT * FROM (SELECT coalesce(a.feature_id, b.feature_id) AS feature_id, a.score AS a_score, b.score AS b_score,
  CASE WHEN a.feature_id IS NULL THEN 'added' WHEN b.feature_id IS NULL THEN 'removed' WHEN abs(a.score - b.score) >= 5 THEN 'changed' END AS change
FROM (SELECT feature_id, seq % 100 AS score FROM registry WHERE seq % 7 <> 0) a FULL JOIN (SELECT feature_id, seq * 3 % 100 AS score FROM registry WHERE seq % 9 <> 0) b ON a.feature_id = b.feature_id) WHERE change IS NOT NULL""")
def _(t):
    a = t.registry.filter("seq % 7 <> 0").selectExpr("feature_id", "seq % 100 AS score")
    return D.audit_diff(a, t.registry.filter("seq % 9 <> 0").selectExpr("feature_id", "seq * 3 % 100 AS score"))


_RATES = "(SELECT feature_id, count(*) FILTER (WHERE status = 'pass') / count(*)::DOUBLE AS r FROM coverage_results WHERE run_id {0} AND feature_id IS NOT NULL GROUP BY feature_id)"


def _rates(t, cond):
    return C.feature_status(t.coverage_results.filter(f"run_id {cond} AND feature_id IS NOT NULL").withColumn("run_id", F.lit(0)), 0)


@query("d08_coverage", f"""
SELECT * FROM (SELECT coalesce(a.feature_id, b.feature_id) AS feature_id, round(a.r, 9) AS a_pass_rate, round(b.r, 9) AS b_pass_rate,
  CASE WHEN a.r IS NULL THEN 'added' WHEN b.r IS NULL THEN 'removed' WHEN abs((b.r - a.r) * 100.0e0) >= 1.0e0 OR (a.r >= 1 AND b.r < 1) THEN 'changed' END AS change,
  round((b.r - a.r) * 100.0e0, 9) AS delta_pp, coalesce(a.r >= 1 AND b.r < 1, false) AS flipped_off
FROM {_RATES.format("< 10 AND feature_id <> 'f7'")} a FULL JOIN {_RATES.format(">= 20 AND feature_id <> 'f9'")} b ON a.feature_id = b.feature_id) WHERE change IS NOT NULL""")
def _(t):
    out = D.coverage_diff(_rates(t, "< 10 AND feature_id <> 'f7'"), _rates(t, ">= 20 AND feature_id <> 'f9'"), 1.0)
    return _rounded(out, "a_pass_rate", "b_pass_rate", "delta_pp")


@query("d09_change_counts", " UNION ALL ".join(
    f"SELECT '{n[4:]}' AS dimension, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed, count(*) = 0 AS is_empty FROM ({_diff_sql(n)})"
    for n in _VERSIONS))
def _(t):
    return D.change_counts({n[4:]: D.keyed_diff(_version(t, n, "a"), _version(t, n, "b"), [_VERSIONS[n][1]], _VERSIONS[n][2]) for n in _VERSIONS})


def _healths(t):
    a = t.registry.filter("seq % 7 <> 0").select("feature_id", "health")
    return a, t.registry.filter("seq % 9 <> 0").selectExpr("feature_id", "(seq * 3 % 101) / 100.0e0 AS health")


_HD = """(SELECT coalesce(a.feature_id, b.feature_id) AS feature_id, CASE WHEN a.health IS NULL THEN 'new' WHEN b.health IS NULL THEN 'removed' WHEN abs(b.health - a.health) < {0} THEN 'unchanged'
  WHEN b.health > a.health THEN 'improved' ELSE 'regressed' END AS change, coalesce(b.health, 0.0e0) - coalesce(a.health, 0.0e0) AS delta
FROM (SELECT feature_id, health FROM registry WHERE seq % 7 <> 0) a FULL JOIN (SELECT feature_id, (seq * 3 % 101) / 100.0e0 AS health FROM registry WHERE seq % 9 <> 0) b ON a.feature_id = b.feature_id)"""


@query("d10_health", f"SELECT feature_id, change, round(delta, 9) AS delta FROM {_HD.format('1e-4')}")
def _(t):
    return _rounded(D.health_diff(*_healths(t)), "delta")


@query("d10_mean_delta", f"SELECT round(avg(delta), 9) AS mean_delta, count(*) AS n FROM {_HD.format('1e-4')} WHERE change NOT IN ('new', 'removed')")
def _(t):
    return _rounded(D.mean_delta(D.health_diff(*_healths(t))), "mean_delta")


@query("d11_dashboard_health", f"SELECT round(avg(delta), 9) AS mean_delta, count(*) AS n FROM {_HD.format('0.005')} WHERE change <> 'removed'")
def _(t):
    return _rounded(D.mean_delta(D.health_diff(*_healths(t), still=0.005), with_new=True), "mean_delta")


@query("j08_full_outer", _diff_sql("d02_symbols"))
def _(t):
    return D.keyed_diff(_version(t, "d02_symbols", "a"), _version(t, "d02_symbols", "b"), ["id"], ["kind", "line"])
