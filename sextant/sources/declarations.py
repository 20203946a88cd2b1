"""Declarations found by line patterns in Go and TypeScript sources: functions, routes, operations and bindings.

A compiler's front-end sees more; its scan documents are read by ``scans``. These patterns need no tool and run as
built-in functions over the lines of each file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.sources.files import lines

GO_FUNC = r"^func\s+(?:\(\s*\w+\s+\*?(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\("
GO_TYPE = r"^type\s+(\w+)(?:\[[^\]]*\])?\s+(struct|interface)\b"
TS_FUNC = r"^\s*export\s+(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"
TS_CONST = r"^\s*export\s+const\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"
TS_TYPE = r"^\s*export\s+(?:abstract\s+)?(class|interface|type)\s+(\w+)"
ROUTE = r'\.\s*(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete|Head|Options)\(\s*"([^"]+)"\s*,\s*(?:[\w.]+\(\s*)?([\w.]+)'
OPERATION = r"(?s)huma\.Register\(\s*[\w.]+\s*,\s*huma\.Operation\{(.*?)\}\s*,\s*([\w.]+)"
WIRE_BIND = r"wire\.Bind\(\s*new\(\s*([\w.]+)\s*\)\s*,\s*new\(\s*\*?([\w.]+)\s*\)\s*\)"
FX_AS = r"fx\.Annotate\(\s*([\w.]+)\s*,\s*fx\.As\(\s*new\(\s*([\w.]+)\s*\)\s*\)"


def go_symbols(files: DataFrame) -> DataFrame:
    """Functions, methods and types of Go files: file_path, line, qualified_name (with the package or receiver) and kind."""
    own = files.filter(F.col("file_path").endswith(".go"))
    package = own.select("file_path", F.regexp_extract("text", r"(?m)^package\s+(\w+)", 1).alias("package"))
    rows, v = lines(own, f"{GO_FUNC}|{GO_TYPE}").join(package, "file_path"), F.col("value")
    receiver, func, kind = F.regexp_extract(v, GO_FUNC, 1), F.regexp_extract(v, GO_FUNC, 2), F.regexp_extract(v, GO_TYPE, 2)
    name = F.when(func == "", F.concat_ws(".", "package", F.regexp_extract(v, GO_TYPE, 1))).when(receiver == "", F.concat_ws(".", "package", func)).otherwise(F.concat_ws(".", receiver, func))
    what = F.when(kind == "interface", "interface").when(kind == "struct", "type").when(receiver == "", "func").otherwise("method")
    return rows.select("file_path", "line", name.alias("qualified_name"), what.alias("kind"))


def ts_symbols(files: DataFrame) -> DataFrame:
    """Exported functions, classes and types of TypeScript files: file_path, line, name and kind."""
    rows, v = lines(files.filter(F.col("file_path").rlike(r"\.[jt]sx?$")), f"{TS_FUNC}|{TS_CONST}|{TS_TYPE}"), F.col("value")
    parts = [F.regexp_extract(v, TS_FUNC, 1), F.regexp_extract(v, TS_CONST, 1), F.regexp_extract(v, TS_TYPE, 2)]
    kind = F.when(F.regexp_extract(v, TS_TYPE, 1) == "interface", "interface").when(parts[2] != "", "type").otherwise("func")
    return rows.select("file_path", "line", F.concat(*parts).alias("name"), kind.alias("kind"))


def http_routes(files: DataFrame) -> DataFrame:
    """Registered routes: file_path, line, method, path and handler."""
    rows = lines(files, ROUTE)
    return rows.select("file_path", "line", F.upper(F.regexp_extract("value", ROUTE, 1)).alias("method"), F.regexp_extract("value", ROUTE, 2).alias("path"), F.regexp_extract("value", ROUTE, 3).alias("handler"))


def operations(files: DataFrame) -> DataFrame:
    """Registered operations of an API framework: file_path, operation_id, method, path, summary and handler."""
    found = files.filter(F.contains("text", F.lit("huma.Register"))).select("file_path", F.explode(F.regexp_extract_all("text", F.lit(f"({OPERATION})"), 1)).alias("op"))
    get = lambda key: F.regexp_extract("op", key + r':\s*"([^"]*)"', 1)
    method = F.coalesce(F.nullif(F.upper(F.regexp_extract("op", r"Method:\s*http\.Method(\w+)", 1)), F.lit("")), F.upper(get("Method")))
    return found.select("file_path", get("OperationID").alias("operation_id"), method.alias("method"), get("Path").alias("path"), get("Summary").alias("summary"), F.regexp_extract("op", OPERATION, 2).alias("handler"))


def bindings(files: DataFrame) -> DataFrame:
    """Interfaces bound to concrete types: interface (short name) and concrete, from two injection libraries' calls.

    A constructor stands for the type that its name says it makes.
    """
    short = lambda c: F.substring_index(c, ".", -1)
    wire = files.select(F.explode(F.regexp_extract_all("text", F.lit(f"({WIRE_BIND})"), 1)).alias("b"))
    fx = files.select(F.explode(F.regexp_extract_all("text", F.lit(f"({FX_AS})"), 1)).alias("b"))
    return wire.select(short(F.regexp_extract("b", WIRE_BIND, 1)).alias("interface"), F.regexp_extract("b", WIRE_BIND, 2).alias("concrete")).unionByName(
        fx.select(short(F.regexp_extract("b", FX_AS, 2)).alias("interface"), F.regexp_replace(F.regexp_extract("b", FX_AS, 1), r"(^|\.)New", "$1").alias("concrete"))).distinct()
