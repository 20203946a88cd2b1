"""Code-intelligence tables derived from the driver's star schema.

Each view is SQL that Spark and DuckDB both read, so that a query and its oracle share their inputs. Times are
microseconds since 1970 as bigint.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from sextant.sources.storage import ship

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: 2024-02-01 00:00 UTC, the reference time of all queries, just after the last event.
NOW_US = 1706745600000000
DAY_US = 86400000000

VIEWS = {
    "symbols": """
        SELECT c_custkey AS id, 'pkg' || c_nationkey || '.fn' || c_custkey AS qualified_name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'func' WHEN 'AUTOMOBILE' THEN 'method' WHEN 'MACHINERY' THEN 'type'
                                 WHEN 'HOUSEHOLD' THEN 'interface' ELSE 'var' END AS kind,
               CASE WHEN c_custkey % 10 = 0 THEN 'tests/test_m' || (c_custkey % 40) || '.py'
                    ELSE 'src/contexts/bc' || c_nationkey || '/m' || (c_custkey % 40) || '.py' END AS file_path,
               c_custkey % 200 + 1 AS line, 'pkg' || c_nationkey AS package
        FROM customer""",
    "edges": """
        SELECT a.o_orderkey AS seq, a.o_custkey AS src, b.o_custkey AS dst,
               CASE a.o_orderpriority WHEN '1-URGENT' THEN 'import' WHEN '2-HIGH' THEN 'call' WHEN '3-MEDIUM' THEN 'inheritance'
                                      WHEN '4-NOT SPECIFIED' THEN 'decorator' ELSE 'embed' END AS kind,
               CASE WHEN a.o_orderpriority = '1-URGENT' AND a.o_orderstatus = 'F' THEN 'module'
                    WHEN a.o_orderpriority = '1-URGENT' AND a.o_orderstatus = 'O' THEN 'function' END AS edge_meta,
               a.o_orderkey % 300 + 1 AS line
        FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""",
    "coverage_results": """
        SELECT event_id AS id, event_id % 30 AS run_id, user_id AS symbol_id,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'f' || (event_id % 40) END AS feature_id,
               CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'pass' END AS status,
               event_id % 977 AS duration_ms
        FROM events""",
    "coverage_runs": """
        SELECT event_id % 30 AS id, CASE WHEN event_id % 3 = 0 THEN 'go-test' WHEN event_id % 3 = 1 THEN 'vitest' ELSE 'jest' END AS framework,
               min({us(ts)}) AS started_us, max({us(ts)}) AS finished_us
        FROM events GROUP BY event_id % 30, CASE WHEN event_id % 3 = 0 THEN 'go-test' WHEN event_id % 3 = 1 THEN 'vitest' ELSE 'jest' END""",
    "features": """
        SELECT 'f' || i AS id, 'Feature ' || i AS title, CASE WHEN i % 4 = 0 THEN 'contract' ELSE 'feature' END AS kind,
               CASE WHEN i % 6 = 0 THEN NULL ELSE 'team' || (i % 3) END AS owner, NOW_US - i * 2 * DAY_US AS updated_us
        FROM (SELECT DISTINCT p_partkey % 40 AS i FROM part)""",
    "feature_symbols": """
        SELECT DISTINCT 'f' || (event_id % 40) AS feature_id, user_id AS symbol_id,
               CASE event_id % 7 WHEN 0 THEN 'test' WHEN 1 THEN 'contract' ELSE 'impl' END AS role,
               CASE event_id % 2 WHEN 0 THEN 'annotation' ELSE 'inferred' END AS source
        FROM events WHERE event_id % 9 = 0""",
    "annotations": """
        SELECT c_custkey AS id,
               CASE WHEN c_custkey % 10 = 0 THEN 'tests/test_m' || (c_custkey % 40) || '.py'
                    ELSE 'src/contexts/bc' || c_nationkey || '/m' || (c_custkey % 40) || '.py' END AS file_path,
               greatest(1, c_custkey % 200 + 1 - c_custkey % 45) AS line,
               CASE c_custkey % 8 WHEN 0 THEN 'feature' WHEN 1 THEN 'contract' WHEN 2 THEN 'bc' WHEN 3 THEN 'aggregate-service'
                    WHEN 4 THEN 'saga' WHEN 5 THEN 'consumer' WHEN 6 THEN 'event-emit' ELSE 'outbox-publish' END AS kind,
               CASE c_custkey % 8 WHEN 0 THEN 'f' || (c_custkey % 40) WHEN 1 THEN 'f' || (c_custkey % 40) WHEN 2 THEN 'bc' || (c_nationkey % 4)
                    WHEN 3 THEN 'agg' || (c_custkey % 5) || ' service=pkg' || c_nationkey
                    WHEN 4 THEN 'saga' || (c_custkey % 3) || CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ' step=' || (c_custkey % 17) END
                    WHEN 5 THEN 'stream=st' || (c_custkey % 3) || ' group=g' || (c_custkey % 2)
                    ELSE 'ev' || (c_custkey % 6) END AS value
        FROM customer""",
    "blame": """
        SELECT file_path, line, max(author_us) AS author_us FROM (
            SELECT CASE WHEN c_custkey % 10 = 0 THEN 'tests/test_m' || (c_custkey % 40) || '.py'
                        ELSE 'src/contexts/bc' || c_nationkey || '/m' || (c_custkey % 40) || '.py' END AS file_path,
                   greatest(1, c_custkey % 200 + 1 - c_custkey % 45) AS line, NOW_US - (c_custkey * 7 % 120) * DAY_US AS author_us
            FROM customer WHERE c_custkey % 13 <> 0) GROUP BY file_path, line""",
    "pattern_matches": """
        SELECT c_custkey AS symbol_id, CASE c_custkey % 3 WHEN 0 THEN 'outbox-append' WHEN 1 THEN 'canonical-service' ELSE 'event-recorder-embed' END AS pattern,
               CASE WHEN c_custkey % 2 = 0 THEN 1.0e0 ELSE 0.85e0 END AS confidence
        FROM customer WHERE c_custkey % 4 <> 1""",
    "file_hashes": """
        SELECT file_path, min(line) AS least, 'h' || sum(id) % 9973 AS content_hash, NOW_US - max(id) % 50 * DAY_US AS scanned_us FROM (
            SELECT c_custkey AS id, c_custkey % 200 + 1 AS line,
                   CASE WHEN c_custkey % 10 = 0 THEN 'tests/test_m' || (c_custkey % 40) || '.py'
                        ELSE 'src/contexts/bc' || c_nationkey || '/m' || (c_custkey % 40) || '.py' END AS file_path
            FROM customer) GROUP BY file_path""",
    "registry": """
        SELECT CASE WHEN p_partkey % 48 = 47 THEN '_unmapped' ELSE 'd' || (p_partkey % 12) END AS domain, 'd' || (p_partkey % 12) || '.' || replace(p_name, ' ', '-') || p_partkey AS feature_id, p_name AS name,
               CASE WHEN p_partkey % 29 = 0 THEN 'urgent' ELSE CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END END AS priority,
               p_partkey AS seq, p_partkey % 101 / 100.0e0 AS health, p_partkey % 6 AS gap_count
        FROM part""",
    "slots": """
        SELECT CASE WHEN p_partkey % 48 = 47 THEN '_unmapped' ELSE 'd' || (p_partkey % 12) END AS domain, 'd' || (p_partkey % 12) || '.' || replace(p_name, ' ', '-') || p_partkey AS feature_id,
               CASE WHEN p_partkey % 29 = 0 THEN 'urgent' ELSE CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END END AS priority,
               s.i AS slot_no, CASE s.i WHEN 0 THEN 'unit.backend' WHEN 1 THEN 'unit.web' WHEN 2 THEN 'unit.mobile' WHEN 3 THEN 'integration.backend'
                            WHEN 4 THEN 'integration.mobile' WHEN 5 THEN 'e2e.web' ELSE 'e2e.mobile' END AS slot,
               CASE WHEN p_partkey % 37 = 0 THEN NULL ELSE CASE (p_partkey * (s.i + 2) + p_size * s.i) % 8 WHEN 0 THEN 'covered' WHEN 1 THEN 'covered' WHEN 2 THEN 'partial' WHEN 3 THEN 'missing'
                    WHEN 4 THEN 'failing' WHEN 5 THEN 'not-applicable' END END AS status,
               p_partkey % 2 = 0 AS has_api, p_partkey % 3 <> 0 AS has_web, p_partkey % 5 = 0 AS has_mobile, (p_partkey + s.i) % 3 = 0 AS mocked,
               (p_partkey * 7 + s.i) % 101 / 100.0e0 AS pass_rate, '/r' || p_partkey AS route, 'C' || p_partkey AS component, 'S' || p_partkey AS screen
        FROM part CROSS JOIN (SELECT DISTINCT p_partkey % 7 AS i FROM part WHERE p_partkey < 7) s""",
    "nodes": """
        SELECT event_id AS id, 'd' || (user_id % 12) || '.x' || (event_id % 60) AS feature_id,
               CASE event_id % 9 WHEN 0 THEN 'handler' WHEN 1 THEN 'service' WHEN 2 THEN 'repository' WHEN 3 THEN 'query' WHEN 4 THEN 'external' WHEN 5 THEN 'component'
                    WHEN 6 THEN 'hook' WHEN 7 THEN 'handler' ELSE 'widget' END AS layer,
               CASE event_type WHEN 'error' THEN 'untested' WHEN 'signup' THEN 'partial' ELSE 'tested' END AS status,
               event_id % 4 = 0 AS has_bench, event_id % 5 = 0 AS has_race
        FROM events""",
    "test_metrics": """
        SELECT event_id AS id, event_id % 20 AS run_seq, 't' || (user_id % 300) AS name, 'pkg' || (user_id % 12) || '/x_test.go' AS file,
               CASE WHEN event_id % 31 <> 0 THEN 'f' || (user_id % 40) END AS feature_id,
               CASE WHEN event_id % 23 = 0 THEN 'flaky' ELSE CASE event_type WHEN 'error' THEN 'fail' WHEN 'signup' THEN 'skip' ELSE 'pass' END END AS status,
               event_id * 7919 % 40000 * 1000000 + event_id % 7 AS duration_ns, CASE WHEN event_id % 5 = 0 THEN event_id % 17 ELSE 0 END AS retries, CASE WHEN event_id % 5 = 0 THEN event_id * 31 % 100003 ELSE 0 END AS bytes_per_op,
               event_id % 29 = 0 AS race_detected
        FROM events""",
}

_US = {"spark": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', \\1)", "duckdb": "epoch_us(\\1)"}


def render(sql: str, engine: str) -> str:
    """``sql`` for one engine: times and constants put in."""
    return re.sub(r"\{us\((.*?)\)\}", _US[engine], sql).replace("NOW_US", str(NOW_US)).replace("DAY_US", str(DAY_US))


class Tables:
    """Driver tables and derived views of one folder, by attribute, each made when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS and name not in BASE:
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self.sql(VIEWS[name]) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables and views that it names after FROM or JOIN."""
        used: dict[str, DataFrame] = {}

        def name(m: re.Match) -> str:
            if m[2] not in VIEWS and m[2] not in BASE:
                return m[0]
            used[m[2]] = getattr(self, m[2])
            return f"{m[1]} {{{m[2]}}}"

        return self.spark.sql(re.sub(r"\b(FROM|JOIN)\s+(\w+)", name, render(text, "spark")), **used)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views it needs in front."""
    need: list[str] = []

    def visit(text: str) -> None:
        for x in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if x in VIEWS and x not in need:
                visit(VIEWS[x])
                need.append(x)

    visit(sql)
    body = sql.strip()
    views = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in need)
    if body.upper().startswith("WITH RECURSIVE"):
        body = body[len("WITH RECURSIVE") :]
        return render(f"WITH RECURSIVE {views}{',' if views else ''}\n{body}", "duckdb")
    if body.upper().startswith("WITH "):
        body = body[5:]
        return render(f"WITH {views}{',' if views else ''}\n{body}", "duckdb")
    return render(f"WITH {views}\n{body}" if views else body, "duckdb")
