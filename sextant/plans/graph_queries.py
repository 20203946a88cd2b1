"""Queries for graph operators (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.operators import graph as G
from sextant.plans.registry import query

_HOP = "hop AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'call')"
_MODULE = "SELECT src, dst FROM edges WHERE kind = 'import' AND edge_meta = 'module' AND src <> dst"


#: Roots of traces: the symbols linked to a feature.
_LINKED = "SELECT DISTINCT symbol_id AS id FROM feature_symbols WHERE feature_id = 'f9'"


def _roots(t):
    return t.sql(_LINKED)


def text_ordered(cycles):
    """Cycles with their nodes in the order of texts, as the SQL has them."""
    return cycles.withColumn("nodes", F.array_join(F.array_sort(F.split("nodes", ",")), ","))


def _module(t):
    return t.edges.filter("kind = 'import' AND edge_meta = 'module'")


@query("g01_j13_walk", """
WITH RECURSIVE w AS (
  SELECT s.id AS root, s.id, 0 AS depth, s.qualified_name AS path FROM symbols s WHERE s.id IN (SELECT symbol_id FROM feature_symbols WHERE feature_id = 'f9')
  UNION ALL
  SELECT w.root, e.dst, w.depth + 1, w.path || ' -> ' || n.qualified_name FROM w JOIN edges e ON e.src = w.id AND e.kind = 'call' JOIN symbols n ON n.id = e.dst WHERE w.depth < 4)
SELECT * FROM w WHERE depth > 0""")
def _(t):
    names = t.symbols.select("id", F.col("qualified_name").alias("name"))
    return G.walk(t.edges.filter("kind = 'call'"), _roots(t), names, 4)


_TREE = f"""
WITH RECURSIVE {_HOP}, w AS (
  SELECT id AS root, id, 0 AS depth, [id] AS path, false AS is_cycle FROM (SELECT DISTINCT symbol_id AS id FROM feature_symbols WHERE feature_id = 'f9') f
  UNION ALL
  SELECT w.root, h.dst, w.depth + 1, list_append(w.path, h.dst), list_contains(w.path, h.dst) FROM w JOIN hop h ON h.src = w.id WHERE NOT w.is_cycle AND w.depth < 4)
"""


@query("g02_tree_walk", _TREE + "SELECT root, id, depth, array_to_string(path, '>') AS path, is_cycle FROM w")
def _(t):
    out = G.tree_walk(G.calls(t.edges), _roots(t), 4)
    return out.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("g03_feature_trace", f"""
WITH RECURSIVE {_HOP}, w AS (
  SELECT DISTINCT symbol_id AS id, 0 AS depth FROM feature_symbols WHERE feature_id = 'f9'
  UNION SELECT h.dst, w.depth + 1 FROM w JOIN hop h ON h.src = w.id WHERE w.depth < 3) SELECT * FROM w""")
def _(t):
    return G.feature_trace(G.calls(t.edges), t.feature_symbols.filter("feature_id = 'f9'"), 3)


@query("g04_trace_from")
def _(t):
    """No SQL: the trace depends on what was entered before. Held to a recursive search in the tests."""
    return G.trace_from(_module(t), _roots(t), 0, t.symbols.filter("kind <> 'var'").select("id"))


@query("g05_path_to")
def _(t):
    """No SQL: a node belongs to the first that finds it. Held to a search with a queue in the tests."""
    target = t.edges.filter("seq = 77").first()["dst"]
    out = G.paths_to(t.edges.filter("kind = 'import' OR kind = 'call'"), t.symbols.select("id", F.col("qualified_name").alias("name")), target, "pkg1.", 12)
    return out.withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


@query("g06_trace_callers")
def _(t):
    """No SQL, as g04_trace_from."""
    return G.trace_callers(_module(t), _roots(t), 3, t.symbols.filter("kind <> 'var'").select("id"))


@query("g07_neighbours", "SELECT DISTINCT src AS id, kind FROM edges WHERE dst = 77")
def _(t):
    return G.neighbours(t.edges, 77, incoming=True)


@query("g08_insertion_cycles", """
WITH RECURSIVE e AS (SELECT seq, src, dst FROM edges WHERE kind = 'import'), r AS (
  SELECT seq, dst AS at FROM e
  UNION SELECT r.seq, e.dst FROM r JOIN e ON e.src = r.at AND e.seq < r.seq)
SELECT e.seq, EXISTS (SELECT 1 FROM r WHERE r.seq = e.seq AND r.at = e.src) AS is_cycle FROM e""")
def _(t):
    return G.insertion_cycles(t.edges.filter("kind = 'import'"))


_CLOSURE = """
WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM ({0})), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b),
m AS (SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
c AS (SELECT * FROM m WHERE component IN (SELECT component FROM m GROUP BY component HAVING count(*) > 1))
"""
_IMPORT = "SELECT src, dst FROM edges WHERE kind = 'import' AND src <> dst"


@query("g09_strong_components", _CLOSURE.format(_IMPORT) + "SELECT node, component FROM c")
def _(t):
    return G.strong_components(t.edges.filter("kind = 'import'"))


@query("g09_strong_components_loop", _CLOSURE.format(_MODULE) + "SELECT node, component FROM c")
def _(t):
    return G.strong_components(_module(t), small=0)


MODULE_CYCLES = _CLOSURE.format(_MODULE) + f"""
SELECT c.component, count(DISTINCT c.node) AS n_nodes, any_value(k.n) AS n_edges, string_agg(DISTINCT c.node::VARCHAR, ',' ORDER BY c.node::VARCHAR) AS nodes FROM c
JOIN (SELECT x.component, count(*) AS n FROM ({_MODULE}) e JOIN c x ON x.node = e.src JOIN c y ON y.node = e.dst AND x.component = y.component GROUP BY x.component) k ON k.component = c.component
GROUP BY c.component"""


@query("g09_module_cycles", MODULE_CYCLES)
def _(t):
    return text_ordered(G.cycles(_module(t)))


@query("g11_cycle_walks")
def _(t):
    edges = t.edges.filter("kind = 'import'")
    return G.cycle_walks(edges, G.strong_components(edges))


@query("g12_prune", """
WITH RECURSIVE e AS (SELECT src, dst FROM edges WHERE kind = 'import' AND edge_meta = 'module'), r AS (
  SELECT DISTINCT symbol_id AS id FROM feature_symbols WHERE feature_id = 'f9' UNION SELECT e.dst FROM r JOIN e ON e.src = r.id)
SELECT id FROM r UNION SELECT src FROM e WHERE dst IN (SELECT id FROM r)""")
def _(t):
    return G.prune(_module(t), _roots(t))


@query("g12_prune_sequential")
def _(t):
    return G.prune(_module(t), _roots(t), sequential=True)


@query("g13_calls_from", f"WITH RECURSIVE {_HOP}, r AS (SELECT 5 AS id UNION SELECT h.dst FROM r JOIN hop h ON h.src = r.id) SELECT id::BIGINT AS id FROM r")
def _(t):
    return G.reachable(G.calls(t.edges), t.symbols.filter("id = 5").select("id")).select("id")


@query("g14_merge_nodes", """
SELECT DISTINCT CASE WHEN src % 50 = 7 THEN src - 7 ELSE src END AS src, CASE WHEN dst % 50 = 7 THEN dst - 7 ELSE dst END AS dst, kind FROM edges""")
def _(t):
    return G.merge_nodes(t.edges, t.symbols.filter("id % 50 = 7").select(F.col("id").alias("old"), (F.col("id") - 7).alias("new")))


@query("g15_stitch", f"""
WITH RECURSIVE {_HOP}, w AS (SELECT DISTINCT id, 0 AS depth FROM symbols WHERE id = 5 UNION SELECT h.dst, w.depth + 1 FROM w JOIN hop h ON h.src = w.id WHERE w.depth < 2),
f AS (SELECT id, id::INT AS depth FROM symbols WHERE id < 4)
SELECT id, depth, 'front' AS part FROM f UNION ALL SELECT id, depth + 4, 'back' FROM w""")
def _(t):
    back = G.feature_trace(G.calls(t.edges), t.symbols.filter("id = 5").select(F.col("id").alias("symbol_id")), 2)
    return G.stitch(t.symbols.filter("id < 4").select("id", F.col("id").cast("int").alias("depth")), back)


@query("g16_trace_problems", _TREE + "SELECT root, id, count(*) AS n, max(is_cycle::INT) AS in_cycle FROM w GROUP BY root, id HAVING count(*) > 1 OR max(is_cycle::INT) = 1")
def _(t):
    return G.trace_problems(G.tree_walk(G.calls(t.edges), _roots(t), 4))


@query("g17_first_chain", """
WITH RECURSIVE k AS (SELECT src, min(dst) AS dst FROM edges WHERE kind = 'call' AND src <> dst GROUP BY src), w AS (
  SELECT id AS root, 0 AS depth, id, [id] AS visited FROM symbols
  UNION ALL SELECT w.root, w.depth + 1, k.dst, list_append(w.visited, k.dst) FROM w JOIN k ON k.src = w.id WHERE w.depth < 6 AND NOT list_contains(w.visited, k.dst))
SELECT root, depth, id FROM w""")
def _(t):
    return G.first_chain(t.edges.filter("kind = 'call'"), t.symbols.select("id"), 6)


_METHOD = "CASE p_partkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'GRAPHQL' WHEN 2 THEN 'POST' ELSE 'JOB' END AS method"
_PATH = "CASE WHEN p_partkey % 4 <> 1 THEN '/' || p_name WHEN p_partkey % 3 = 0 THEN 'Query' ELSE 'Mutation.' || replace(p_name, ' ', '') END AS path"


@query("g18_entry_points", f"""
SELECT p_partkey, CASE WHEN method IN ('GET', 'POST') THEN method || ' ' || path WHEN method = 'JOB' THEN path
  WHEN path LIKE '%.%' THEN 'mutationResolver.' || upper(substr(split_part(path, '.', 2), 1, 1)) || substr(split_part(path, '.', 2), 2) END AS entry
FROM (SELECT p_partkey, {_METHOD}, {_PATH} FROM part)""")
def _(t):
    return t.part.selectExpr("p_partkey", _METHOD, _PATH).select("p_partkey", G.entry_point(F.col("method"), F.col("path")).alias("entry"))


@query("g19_check_order", """
SELECT feature_id, id, row_number() OVER (PARTITION BY feature_id ORDER BY list_position(['service', 'repository', 'handler'], layer), id)::INT AS check_no FROM nodes WHERE layer IN ('service', 'repository', 'handler')""")
def _(t):
    return G.check_order(t.nodes, ["service", "repository", "handler"]).select("feature_id", "id", "check_no")
