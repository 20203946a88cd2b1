"""Schemas of the stored tables, and how foreign values become theirs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 8

#: Times are timestamps; ids are long; JSON columns are strings.
TABLES = {
    "config": "key string, value string, updated_at timestamp",
    "features": "id string, title string, owner string, kind string, deprecated_since string, introduced_in string, created_at timestamp, updated_at timestamp",
    "symbols": "id long, qualified_name string, kind string, file_path string, line int, end_line int, package string, bc_path string, created_at timestamp,"
               " pattern_matches array<struct<pattern: string, symbol: string, position: struct<path: string, line: int, col: int>, detail: string, confidence: double>>",
    "edges": "id long, from_symbol_id long, to_symbol_id long, kind string, file_path string, line int, edge_meta string, created_at timestamp, seq long",
    "feature_symbols": "feature_id string, symbol_id long, role string, source string",
    "file_hashes": "file_path string, content_hash string, mtime timestamp, last_scanned timestamp",
    "coverage_runs": "id long, framework string, started_at timestamp, finished_at timestamp, raw_path string, summary_json string",
    "coverage_results": "id long, run_id long, symbol_id long, feature_id string, status string, duration_ms long, message string",
    "annotations": "id long, file_path string, line int, kind string, value string, source string, parsed_at timestamp",
    "snapshots": "id long, git_ref string, captured_at timestamp, index_json string, audit_json string, notes string",
    "audit_snapshot_runs": "id long, computed_at timestamp, score_json string",
}

#: The kinds that are stored.
SYMBOL_KINDS = ("type", "func", "method", "interface", "var", "const")
EDGE_KINDS = ("call", "implement", "embed", "construct", "inheritance", "decorator", "import")
EDGE_SCOPES = ("module", "function", "conditional", "type_checking", "try_guard")


def symbol_kind(kind: Column) -> Column:
    """A stored symbol kind; everything else is a function."""
    return F.when(kind.isin(*SYMBOL_KINDS), kind).otherwise("func")


def edge_kind(kind: Column) -> Column:
    """A stored edge kind; everything else is a call."""
    return F.when(kind.isin(*EDGE_KINDS), kind).otherwise("call")


def edge_scope(kind: Column, scope: Column) -> Column:
    """The scope of an import; other edges and unknown scopes have none."""
    return F.when((kind == "import") & scope.isin(*EDGE_SCOPES), scope)
