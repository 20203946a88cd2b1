"""One function per question that users ask, with its options checked, over a catalog of tables.

A catalog has the tables as attributes: symbols, edges, features, feature_symbols, coverage_runs, coverage_results,
annotations, blame, pattern_matches, file_hashes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import coverage, diffs, graph, lookup, ranking, scoring, search


@dataclass(frozen=True)
class Config:
    """Windows in days, folders that are not scanned, and how long lists are."""

    freshness_days: int = 30
    bug_days: int = 7
    top: int = 10
    skip: tuple[str, ...] = field(default=("node_modules", "vendor", ".git", "dist"))


def scopes(text: str | None, default: Sequence[str]) -> list[str]:
    """Import scopes of a comma-separated option; ``all`` is every one, an unknown one is an error."""
    if text is None or not text.strip():
        return list(default)
    found = [x.strip().lower() for x in text.split(",") if x.strip()]
    if "all" in found:
        found = found[: found.index("all")]
        unknown = [x for x in found if x not in lookup.SCOPES]
        if not unknown:
            return list(lookup.SCOPES)
    else:
        unknown = [x for x in found if x not in lookup.SCOPES]
    if unknown:
        raise ValueError(f"unknown scope {unknown[0]!r}; known are {', '.join(lookup.SCOPES)} and all")
    if not found:
        raise ValueError("no scope is left")
    return found


def dead(t, kind: str = "import", include_scopes: str | None = None, include_tests: bool = False, prefix: str | None = None) -> DataFrame:
    """Symbols that nothing refers to, by file, line and name."""
    kind = (kind or "import").strip().lower()
    kind = "all" if kind == "any" else kind
    if kind not in ("import", "call", "all"):
        raise ValueError(f"unknown kind {kind!r}; known are import, call and all")
    wanted = scopes(include_scopes, ("module", "conditional"))
    return lookup.dead_symbols(t.symbols, t.edges, kind, wanted, include_tests, prefix).orderBy("file_path", "line", "qualified_name")


def cycles(t, include_scopes: str | None = None, prefix: str | None = None) -> DataFrame:
    """Circular imports, the short ones first."""
    edges = lookup.import_edges(t.edges, t.symbols, scopes(include_scopes, ("module",)), prefix)
    return graph.cycles(edges).orderBy("n_nodes", "component")


def coverage_status(t, feature: str | None = None) -> DataFrame:
    """Results per feature in the latest run."""
    return coverage.feature_status(t.coverage_results, lookup.latest_run(t.coverage_runs), feature).orderBy("feature_id")


def audit(t, now_us: int, worst: int = 0) -> DataFrame:
    """Health of every feature, the worst first; ``worst`` gives only so many."""
    out = scoring.health(t.features, scoring.all_signals(t, lookup.latest_run(t.coverage_runs), now_us))
    return out.orderBy("score", "feature_id").limit(worst) if worst > 0 else out.orderBy("score", "feature_id")


def sprint(t, now_us: int, top: int | None = None) -> DataFrame:
    """Features by priority; ``top`` of 0 is none, and None is all."""
    scores = scoring.health(t.features, scoring.all_signals(t, lookup.latest_run(t.coverage_runs), now_us)).select("feature_id", "score")
    out = scoring.sprint(scores, t.feature_symbols, t.symbols, t.coverage_results, lookup.latest_run(t.coverage_runs), t.annotations, t.blame, now_us)
    return out.orderBy(F.desc("priority"), "feature_id") if top is None else ranking.top(out, top, F.desc("priority"), "feature_id")


def trace(t, target: str, depth: int = 50) -> DataFrame:
    """Call chain of ``saga:``, ``feature:`` or ``symbol:`` ids; a bare id is a feature or a symbol, and both is an error."""
    kind, _, name = target.partition(":")
    if kind == "saga" and name:
        return lookup.walk_saga(t.annotations, name).select("step", "file_path", "line")
    if kind not in ("feature", "symbol") or not name:
        kind, name = "", target
    hops = graph.calls(t.edges)
    feature = kind != "symbol" and bool(t.features.filter(F.col("id") == name).take(1))
    found = [] if kind == "feature" else lookup.find_symbol(t.symbols, name, substring=False).select("id").take(1)
    if feature and found:
        raise ValueError(f"{name!r} is a feature and a symbol; say feature:{name} or symbol:{name}")
    if feature:
        return graph.feature_trace(hops, t.feature_symbols.filter(F.col("feature_id") == name), depth).orderBy("depth", "id")
    if not found:
        raise LookupError(f"no feature or symbol is called {name!r}")
    root = t.symbols.filter(F.col("id") == found[0]["id"]).select("id")
    return graph.tree_walk(hops, root, depth).orderBy("depth", F.col("path").cast("array<string>"))


def diagnose(t, symptom: str, bodies: DataFrame, at_least: float = 0.0, most: int = 10) -> DataFrame:
    """Symbols (bodies: id, name, kind, body) that a symptom points to."""
    callers = t.edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    return search.diagnose(symptom, bodies, callers, t.feature_symbols, at_least=at_least, most=most)


def compare(a: dict[str, DataFrame], b: dict[str, DataFrame], keys: dict[str, Sequence[str]]) -> DataFrame:
    """Counts of what came, went and changed between two snapshots' tables, by their keys."""
    out = {}
    for name, key in keys.items():
        rest = [c for c in a[name].columns if c not in key]
        out[name] = diffs.keyed_diff(a[name], b[name], key, rest)
    return diffs.change_counts(out)


def contracts(defs: DataFrame, kind: str | None = None) -> DataFrame:
    """Contract definitions in their order, all or those of a kind."""
    return ranking.contract_order(lookup.where_equal(defs, kind=kind))
