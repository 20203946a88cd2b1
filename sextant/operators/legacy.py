"""Operators over the feature registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_segments(df: DataFrame, key: str, path: str, skip: list[str], longer_than: int = 3) -> DataFrame:
    """Rows (key, segment, n) of the telling path segments that a key shares with others, and how many keys have each.

    Two keys share a package if they have a row of one segment in common. No pairs are made, so that a folder that a third
    of all paths lie in costs its paths, not their square.
    """
    seg = df.select(key, F.explode(F.array_distinct(F.split(path, "/"))).alias("segment")).filter((F.octet_length("segment") > longer_than) & ~F.col("segment").isin(*skip)).distinct()
    classes = seg.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return seg.join(classes, "segment").select(key, "segment", "n")


def folder_domains(tests: DataFrame, marked: DataFrame, registry: DataFrame) -> DataFrame:
    """The nearest domain (file_path, domain) of each test file that names no feature, by its path.

    A folder equal to a domain counts from the deepest up; else the smallest domain that the path contains between a slash
    and a dot. Each file has one row: all features of its domain are its features, and no pairs of the two are made.
    """
    rest = tests.join(marked.select("file_path"), "file_path", "left_anti").select("file_path").distinct()
    parts = F.split(F.lower("file_path"), "/")
    folders = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p, i: F.struct(p.alias("domain"), i.alias("at")))
    # the leading words of each component after a slash; whole components are folders
    leading = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda n: F.struct(F.array_join(F.slice(w, F.lit(1), n), ".").alias("domain"), F.lit(-1).alias("at")))
    dotted = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.contains(p, F.lit(".")))
    inside = F.flatten(F.transform(dotted, lambda p: leading(F.split(p, r"\."))))
    found = rest.select("file_path", F.explode(F.concat(folders, inside)).alias("c")).select("file_path", "c.*").join(registry.select("domain").distinct(), "domain")
    best = found.groupBy("file_path").agg(F.max("at").alias("at"), F.max_by("domain", "at").alias("folder"), F.min("domain").alias("least"))
    return best.select("file_path", F.when(F.col("at") >= 0, F.col("folder")).otherwise(F.col("least")).alias("domain"))


def map_tests(tests: DataFrame, marked: DataFrame, registry: DataFrame) -> DataFrame:
    """Features of test files: those the file names (``marked``: file_path, feature_id), else all of the nearest domain in its path.

    A row per file and feature, as many as their product; ``folder_domains`` has a row per file.
    """
    named = tests.join(marked, "file_path").select("file_path", "feature_id", F.lit("annotation").alias("how")).distinct()
    features = registry.select("domain", "feature_id").distinct()
    auto = folder_domains(tests, marked, registry).join(features, "domain").select("file_path", "feature_id", F.lit("folder").alias("how"))
    return named.unionByName(auto)


def feature_table(rows: DataFrame, text: str = "", priority: str = "", band: str = "", page: int = 1, per_page: int = 15) -> DataFrame:
    """A page of features (seq, feature_id, priority, health) by text, priority and health band; pages beyond the last show the last."""
    out = rows.withColumn("pct", F.floor(F.col("health") * 100).cast("int"))
    if priority:
        out = out.filter(F.col("priority") == priority)
    if text:
        out = out.filter(F.contains(F.lower("feature_id"), F.lit(text.lower())) | F.contains(F.lower("priority"), F.lit(text.lower())))
    if band:
        out = out.filter({"healthy": "pct >= 80", "at-risk": "pct >= 50 AND pct < 80", "critical": "pct < 50"}[band])
    pages = max(1, -(-out.count() // per_page))
    page = min(max(1, page), pages)
    return out.orderBy("seq").offset((page - 1) * per_page).limit(per_page)


def status_filter(slots: DataFrame, domain: str = "", priority: str = "", status: str = "") -> DataFrame:
    """Features of a domain and priority that have any slot of a status."""
    out = slots
    for column, value in (("domain", domain), ("priority", priority), ("status", status)):
        if value:
            out = out.filter(F.col(column) == value)
    return out.select("domain", "feature_id", "priority").distinct()


def open_gaps(registry: DataFrame, gaps: DataFrame, priorities: list[str], below: float, limit: int = 0) -> DataFrame:
    """Features of some priorities under a health, with gaps (feature_id, n_gaps), in the order of the registry."""
    out = registry.filter(F.col("priority").isin(priorities) & (F.col("health") < below)).join(gaps.filter("n_gaps > 0").select("feature_id", "n_gaps"), "feature_id")
    return out.orderBy("seq").limit(limit) if limit else out


def audit_list(rows: DataFrame, priorities: list[str] | None = None, below: float = 0.0, unconfigured: bool = False, sort: str = "health", limit: int = 0) -> DataFrame:
    """Audited features (seq, feature_id, priority, health, n_gaps), filtered, sorted and cut in this order."""
    out = rows.filter(F.col("priority").isin(priorities)) if priorities else rows
    if below > 0:
        out = out.filter(F.col("health") < below)
    if unconfigured:
        out = out.filter("health = 0 AND n_gaps = 0")
    order = {"health": [F.col("health")], "name": [F.col("feature_id")], "priority-score": [F.desc("score")]}[sort]
    out = out.orderBy(*order, "seq")
    return out.limit(limit) if limit > 0 else out


def merge_registry(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Stored features, and those found whose id is new."""
    return stored.unionByName(found.join(stored.select("feature_id"), "feature_id", "left_anti").select(*stored.columns))


def surface_priority(df: DataFrame) -> DataFrame:
    """Routes (method, path) with the priority that their path and method suggest."""
    p = F.lower("path")
    critical = p.rlike("auth|login|payment|billing")
    return df.withColumn("priority", F.when(critical, "critical").when(F.col("method").isin("POST", "PUT", "DELETE", "PATCH"), "high").otherwise("medium"))


def run_commands(results: DataFrame) -> DataFrame:
    """The command that would run each test file; nothing is run."""
    f, p = F.col("framework"), F.col("file_path")
    go = F.concat(F.lit("go test ./"), F.regexp_replace(p, "/?[^/]*$", ""), F.lit("/..."))
    cmd = F.when(f == "go", go).when(f == "playwright", F.concat(F.lit("npx playwright test "), p)).when(f.isin("vitest", "jest"), F.concat(F.lit("npx "), f, F.lit(" run "), p))
    return results.withColumn("command", cmd.when(f == "maestro", F.concat(F.lit("maestro test "), p)).otherwise(F.concat(F.lit("pytest "), p)))


def to_dot(edges: DataFrame) -> DataFrame:
    """Lines of a DOT graph's edges."""
    return edges.select(F.concat(F.lit('"'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), "kind", F.lit('"];')).alias("line"))
