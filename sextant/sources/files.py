"""Source trees and line-oriented texts as tables.

Texts come as (file_path, text) and are split into lines here, so that a line's number is its place in the file.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import paths


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a folder: file_path, content_hash, mtime and text."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("text"))


def lines(files: DataFrame, keep: str | None = None) -> DataFrame:
    """(file_path, line, value) of texts; ``keep`` is a pattern that lines must match."""
    out = files.select("file_path", F.posexplode(F.split("text", "\n")).alias("_i", "value")).select("file_path", (F.col("_i") + 1).alias("line"), "value")
    return out.filter(F.col("value").rlike(keep)) if keep else out


def hashed(files: DataFrame) -> DataFrame:
    return files.select("file_path", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))


def changed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Current files that are new or whose hash differs from the stored one."""
    old = stored.select("file_path", F.col("content_hash").alias("_old"))
    return current.join(old, "file_path", "left").filter(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")


def parse_blame(files: DataFrame) -> DataFrame:
    """(file_path, line, author_us) of porcelain blame texts: a header names the commit and final line, the first of a commit its time."""
    head = r"^([0-9a-f]{40}) \d+ (\d+)( \d+)?$"
    rows = lines(files, head + r"|^author-time \d+$")
    commit = F.regexp_extract("value", head, 1)
    here = Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("commit", F.last(F.when(commit != "", commit), ignorenulls=True).over(here))
    time = F.regexp_extract("value", r"^author-time (\d+)$", 1).try_cast("long")
    times = rows.filter(time.isNotNull()).groupBy("file_path", "commit").agg(F.min(time).alias("s"))
    final = rows.filter(commit != "").select("file_path", "commit", F.regexp_extract("value", head, 2).cast("int").alias("line"))
    return final.join(times, ["file_path", "commit"]).select("file_path", "line", (F.col("s") * 1_000_000).alias("author_us"))


#: The pattern of a named query's comment and its results.
SQL_NAME = r"^--\s*name:\s*(\w+)\s+:(one|many|exec|execrows|execresult|batchone|batchmany|batchexec|copyfrom)\s*$"


def named_queries(files: DataFrame) -> DataFrame:
    """Named SQL queries: file_path, line, method and result."""
    rows = lines(files, SQL_NAME)
    return rows.select("file_path", "line", F.regexp_extract("value", SQL_NAME, 1).alias("method"), F.regexp_extract("value", SQL_NAME, 2).alias("result"))


#: Line patterns of GraphQL schemas.
GRAPHQL_OPEN, GRAPHQL_TYPE = r"^\s*(?:extend\s+)?type\s+(Mutation|Query|Subscription)\s*\{", r"^\s*(?:type|input)\s+\w+\s*\{"
GRAPHQL_FIELD, GRAPHQL_CLOSE = r"^\s+(\w+)\s*(?:\(([^)]*)\))?\s*:\s*(.+?)\s*$", r"^\s*\}"
GRAPHQL_NOTE, GRAPHQL_DOC = r"^\s*(#|\.\.\.)", r'^\s*"""'


def graphql_operations(files: DataFrame) -> DataFrame:
    """Fields of a schema's operation types: file_path, line, name, signature, return_type.

    Doc strings switch on and off at their marks, and the block a line lies in is the last one opened; both are running
    values over the lines of a file.
    """
    rows = lines(files, f"({GRAPHQL_OPEN})|({GRAPHQL_TYPE})|({GRAPHQL_FIELD})|({GRAPHQL_CLOSE})|({GRAPHQL_DOC})")
    v, here = F.col("value"), Window.partitionBy("file_path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_doc", F.sum(v.rlike(GRAPHQL_DOC).cast("int")).over(here)).filter((F.col("_doc") % 2 == 0) & ~v.rlike(GRAPHQL_DOC) & ~v.rlike(GRAPHQL_NOTE))
    opened = F.when(v.rlike(GRAPHQL_OPEN), F.regexp_extract(v, GRAPHQL_OPEN, 1)).when(v.rlike(GRAPHQL_TYPE), "").when(v.rlike(GRAPHQL_CLOSE), "")
    rows = rows.withColumn("_block", F.last(opened, ignorenulls=True).over(here)).filter((F.col("_block") != "") & v.rlike(GRAPHQL_FIELD) & ~v.rlike(GRAPHQL_OPEN))
    name, args, kind = (F.btrim(F.regexp_extract(v, GRAPHQL_FIELD, i)) for i in (1, 2, 3))
    sig = F.concat(F.lower("_block"), F.lit(" { "), name, F.when(args != "", F.concat(F.lit("("), args, F.lit(")"))).otherwise(""), F.lit(": "), kind, F.lit(" }"))
    return rows.select("file_path", "line", F.concat_ws(".", "_block", name).alias("name"), sig.alias("signature"), kind.alias("return_type"))


def discovered_tests(files: DataFrame) -> DataFrame:
    """Test files by their path: file_path, framework, test_type and platform. Build and dependency folders are left out."""
    p, name = F.lower("file_path"), F.lower(paths.basename(F.col("file_path")))
    skip = p.rlike(r"(^|/)(node_modules|dist|vendor|\.[^/]+|venv|__pycache__|build)/")
    framework = (
        F.when(name.endswith("_test.go"), "go").when(name.endswith(".spec.ts"), "playwright").when(name.rlike(r"\.test\.(ts|tsx)$"), "vitest")
        .when(name.rlike(r"\.test\.(js|jsx)$"), "jest").when(name.rlike(r"\.ya?ml$") & p.rlike(r"(mobile|maestro|e2e)"), "maestro").when(name.rlike(r"^test_.*\.py$|_test\.py$"), "pytest")
    )
    e2e = F.col("framework").isin("playwright", "maestro") | p.rlike(r"e2e|end_to_end")
    kind = F.when(e2e, "e2e").when(p.contains("integration"), "integration").otherwise("unit")
    platform = F.when(F.col("framework") == "maestro", "mobile").when(F.col("framework").isin("go", "pytest"), "backend").otherwise("web")
    return files.filter(~skip).withColumn("framework", framework).filter("framework IS NOT NULL").select("file_path", "framework", kind.alias("test_type"), platform.alias("platform"))


#: A benchmark's line and the warning of a data race.
BENCHMARK, RACE = r"(\S+)\s+\d+\s+[\d.]+ ns/op\s+(\d+) B/op\s+(\d+) allocs/op", "WARNING: DATA RACE"


def go_metrics(events: DataFrame) -> DataFrame:
    """Per package and test that was run: how it ended, bytes and allocations per operation, and whether its package raced.

    Only what follows a test's first run counts: its first pass or fail, the last figures of a benchmark, and any skip,
    which leaves the test out. A test that never ended has an empty status and no duration.
    """
    started = F.min(F.when(F.col("action") == "run", F.col("seq"))).over(Window.partitionBy("package", "test"))
    mine = events.filter("test <> ''").withColumn("_run", started).filter("seq >= _run")
    end = F.when(F.col("action").isin("pass", "fail"), F.col("seq"))
    out = F.when(F.col("action") == "output", F.col("output"))
    n = lambda i: F.max_by(F.regexp_extract(out, BENCHMARK, i).try_cast("long"), F.when(out.rlike(BENCHMARK), F.col("seq")))
    raced = (F.col("action") == "output") & F.col("output").contains(RACE)
    races = events.filter(raced & (F.coalesce("test", F.lit("")) == "")).select("package").unionByName(mine.filter(raced).select("package")).distinct().withColumn("race", F.lit(True))
    tests = mine.groupBy("package", "test").agg(
        F.max((F.col("action") == "skip").cast("int")).alias("skipped"), F.min_by(F.struct("action", "elapsed"), end).alias("e"), n(2).alias("bytes_per_op"), n(3).alias("allocs_per_op"))
    return tests.filter("skipped = 0").join(races, "package", "left").select(
        "package", "test", F.coalesce("e.action", F.lit("")).alias("status"), F.coalesce((F.col("e.elapsed") * 1e9).cast("long"), F.lit(0)).alias("duration_ns"),
        F.coalesce("bytes_per_op", F.lit(0)).alias("bytes_per_op"), F.coalesce("allocs_per_op", F.lit(0)).alias("allocs_per_op"), F.coalesce("race", F.lit(False)).alias("race_detected"))


def latest_run_results(events: DataFrame) -> DataFrame:
    """Test states as the older tool keeps them: a test shows once it was run, and a skip takes it out again."""
    order = F.struct("seq")
    last = events.filter("test <> '' AND action IN ('run', 'pass', 'fail', 'skip')").groupBy("package", "test").agg(F.max_by("action", order).alias("status"), F.max_by("elapsed", order).alias("elapsed"))
    return last.filter("status <> 'skip'").withColumn("status", F.when(F.col("status") == "run", "fail").otherwise(F.col("status")))


def camel_head(name: Column) -> Column:
    """First word of a test's name in lower case, without the ``Test`` in front."""
    return F.lower(F.regexp_extract(F.regexp_replace(name, "^Test_?", ""), r"^([A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+)", 1))


SYMBOLS = "file_path string, id string, kind string, line int"
EDGES = "file_path string, source string, target string, kind string, line int, scope string"

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_NAMED = (*_FUNCTIONS, ast.ClassDef)


def _module(path: str) -> str:
    return path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")


def _parsed(files: DataFrame, found, schema: str) -> DataFrame:
    """What ``found(module, tree)`` yields for each Python file, after its path; broken files have nothing."""
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["file_path"], pdf["text"]):
                try:
                    out += [(path, *x) for x in found(_module(path), ast.parse(text or ""))]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=names)

    return files.filter(F.col("file_path").endswith(".py")).select("file_path", "text").mapInPandas(parse, schema)


def _definitions(body: list, owner: str, in_class: bool = False) -> Iterator[tuple[str, ast.AST, bool]]:
    """Classes and functions of a body and, below them, those of their bodies: id, node, and whether it is a class's own."""
    for node in body:
        if isinstance(node, _NAMED):
            name = f"{owner}.{node.name}"
            yield name, node, in_class
            yield from _definitions(node.body, name, isinstance(node, ast.ClassDef))


def python_symbols(files: DataFrame) -> DataFrame:
    """Modules, classes, functions, methods and a module's constants (upper case, no underscore in front) of Python files, with
    the standard library's parser. Functions in functions have the outer one's id in front."""

    def found(module: str, tree: ast.Module) -> Iterator[tuple[str, str, int]]:
        yield module, "module", 1
        for name, node, in_class in _definitions(tree.body, module):
            yield name, "type" if isinstance(node, ast.ClassDef) else "method" if in_class else "func", node.lineno
        for node in tree.body:
            if isinstance(node, ast.Assign):
                yield from ((f"{module}.{t.id}", "const", node.lineno) for t in node.targets if isinstance(t, ast.Name) and t.id.isupper() and t.id[0] != "_")

    return _parsed(files, found, SYMBOLS)


def _guards_import(node: ast.Try) -> bool:
    """Whether a handler names ImportError or ModuleNotFoundError, alone or in a tuple; a bare one does not."""
    wanted = [h.type for h in node.handlers if h.type is not None]
    while wanted:
        kind = wanted.pop()
        if isinstance(kind, ast.Tuple):
            wanted += kind.elts
        elif getattr(kind, "id", getattr(kind, "attr", "")) in ("ImportError", "ModuleNotFoundError"):
            return True
    return False


def _scopes(node: ast.AST) -> str | None:
    """The scope that a node puts imports below it in."""
    if isinstance(node, ast.If):
        plain = isinstance(node.test, (ast.Name, ast.Attribute)) and getattr(node.test, "id", getattr(node.test, "attr", "")) == "TYPE_CHECKING"
        return "type_checking" if plain else "conditional"
    if isinstance(node, ast.Try):
        return "try_guard" if _guards_import(node) else None
    return "function" if isinstance(node, _FUNCTIONS) else None


#: Scopes from the one that wins.
SCOPES = ("type_checking", "try_guard", "function", "conditional")


def _imports(node: ast.AST, above: frozenset = frozenset()) -> Iterator[tuple[str, int, str]]:
    """Imports at any depth: target, line and scope."""
    for child in ast.iter_child_nodes(node):
        scope = next((s for s in SCOPES if s in above), "module")
        if isinstance(child, ast.Import):
            yield from ((a.name, child.lineno, scope) for a in child.names)
        elif isinstance(child, ast.ImportFrom):
            base = "." * child.level + (child.module or "")
            yield from ((base + ("" if base.endswith(".") or not base else ".") + a.name, child.lineno, scope) for a in child.names)
        else:
            yield from _imports(child, above | {_scopes(child)})


def _calls(nodes: list) -> Iterator[ast.Call]:
    """Calls below some nodes, but not in classes and functions below them, which have their own."""
    for node in nodes:
        if not isinstance(node, _NAMED):
            if isinstance(node, ast.Call):
                yield node
            yield from _calls(list(ast.iter_child_nodes(node)))


def python_edges(files: DataFrame) -> DataFrame:
    """Edges of Python files: source, target as it is written, kind, line and scope.

    ``import``: from the module, with its scope: type checking before a guarding try, a function, a condition and the module.
    ``inheritance``: from a class to its bases. ``decorator``: from classes and functions. ``call``: from a function to what it
    calls itself, calls in lambdas and comprehensions too.
    """

    def found(module: str, tree: ast.Module) -> Iterator[tuple]:
        for name, node, _ in _definitions(tree.body, module):
            if isinstance(node, ast.ClassDef):
                yield from ((name, ast.unparse(b), "inheritance", b.lineno, None) for b in node.bases)
            yield from ((name, ast.unparse(d), "decorator", d.lineno, None) for d in node.decorator_list)
            if isinstance(node, _FUNCTIONS):
                yield from ((name, ast.unparse(c.func), "call", c.lineno, None) for c in _calls(node.body))
        yield from ((module, target, "import", line, scope) for target, line, scope in _imports(tree))

    return _parsed(files, found, EDGES)


def python_imports(files: DataFrame) -> DataFrame:
    """The import edges of Python files: file_path, source, target, line and scope."""
    return python_edges(files).filter("kind = 'import'").select("file_path", "source", "target", "line", "scope")


def read_registry(files: DataFrame) -> DataFrame:
    """Features of registry documents (file_path, text), YAML if its parser is installed, JSON anyway; bad files are skipped."""
    schema = "domain string, feature_id string, name string, priority string, slot string, status string"

    def load(text: str) -> dict:
        try:
            import yaml
        except ImportError:
            import json

            return json.loads(text)
        return yaml.safe_load(text)

    def slots(found: dict, prefix: str = "") -> Iterator[tuple[str, str | None]]:
        for key, value in found.items():
            if isinstance(value, dict) and "status" not in value:
                yield from slots(value, f"{prefix}{key}.")
            else:
                yield prefix + key, (value or {}).get("status") if isinstance(value, dict) else None

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                try:
                    doc = load(text)
                    for f in doc.get("features") or []:
                        for slot, status in slots(f.get("coverage") or {"none": None}):
                            out.append((doc.get("domain"), f.get("id"), f.get("name"), f.get("priority"), slot, status))
                except Exception:  # noqa: BLE001, S112  a bad file must not stop the others
                    continue
            yield pd.DataFrame(out, columns=names)

    return files.select("text").mapInPandas(parse, schema)
