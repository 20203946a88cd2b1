"""Scan results as JSON, and what is read out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant import schema

INDEX = """root string, generated_at string,
  graph struct<edges: array<struct<from: string, to: string, kind: string, line: int, meta: string>>>,
  symbols array<struct<id: string, kind: string, package: string, position: struct<path: string, line: int>>>,
  annotations array<struct<kind: string, ids: array<string>, tags: array<string>, source: string, position: struct<path: string, line: int>>>,
  file_hashes map<string, string>"""


def read_index(scans: DataFrame) -> dict[str, DataFrame]:
    """Tables of scan documents (scan, text): symbols, edges, annotations and file_hashes, with ``seq`` in the order told.

    Kinds that are not stored become ``func`` and ``call``; scopes stay with imports only.
    """
    d = scans.select("scan", F.from_json("text", INDEX).alias("d"))
    each = lambda field: d.select("scan", F.posexplode(f"d.{field}").alias("seq", "x"))
    s, e, a = each("symbols"), each("graph.edges"), each("annotations")
    return {
        "symbols": s.select("scan", "seq", F.col("x.id").alias("qualified_name"), schema.symbol_kind(F.col("x.kind")).alias("kind"), "x.package", F.col("x.position.path").alias("file_path"), F.col("x.position.line").alias("line")),
        "edges": e.select("scan", "seq", F.col("x.from").alias("source"), F.col("x.to").alias("target"), schema.edge_kind(F.col("x.kind")).alias("kind"), F.col("x.line").alias("line"),
                          schema.edge_scope(F.col("x.kind"), F.col("x.meta")).alias("edge_meta")),
        "annotations": a.select("scan", "seq", F.col("x.position.path").alias("file_path"), F.col("x.position.line").alias("line"), F.col("x.kind").alias("kind"),
                                F.array_join(F.concat(F.coalesce("x.ids", F.array()), F.coalesce("x.tags", F.array())), " ").alias("value"), F.col("x.source").alias("source")),
        "file_hashes": d.select("scan", F.explode("d.file_hashes").alias("file_path", "content_hash")),
    }


def assigned(notes: DataFrame, functions: DataFrame) -> DataFrame:
    """Notes (file_path, line) with the function that starts on the next line, or null: a note for the whole file."""
    f = functions.select("file_path", (F.col("line") - 1).alias("line"), F.col("name").alias("function"))
    one = f.groupBy("file_path", "line").agg(F.min("function").alias("function"))
    return notes.join(one, ["file_path", "line"], "left")


def next_function(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines (file_path, line, value) that match a function's pattern, with its name, the first group."""
    return lines.filter(F.col("value").rlike(pattern)).select("file_path", "line", F.regexp_extract("value", pattern, 1).alias("name"))


def rewritten_marks(lines: DataFrame, old: str, new: str) -> DataFrame:
    """Lines whose older mark would be rewritten, before and after; a dry run, nothing is written."""
    hit = F.col("value").rlike(r"\Q" + old + r"\E\s")
    return lines.filter(hit).withColumn("after", F.replace("value", F.lit(old + " "), F.lit(new + "feature ")))


def latest_scan(scans: DataFrame) -> DataFrame:
    """The last scan per root."""
    w = Window.partitionBy("root").orderBy(F.desc("generated_at"))
    return scans.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
