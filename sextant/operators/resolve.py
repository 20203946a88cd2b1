"""Resolution of names across tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.sources.storage import cut


def not_ignored(df: DataFrame, path: str, globs: list[str], prefixes: list[str]) -> DataFrame:
    """Rows whose path matches no glob (``*`` matches anything) and starts with no prefix."""
    hit = F.lit(False)
    for g in globs:
        like = g.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        hit = hit | F.col(path).like(like)
    for p in prefixes:
        hit = hit | F.col(path).startswith(p)
    return df.filter(~hit)


# --- names in Python code ---------------------------------------------------------------------------------------


def parent(name: Column) -> Column:
    """The part of a dotted name before its last dot, empty if it has none."""
    return F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise("")


def indexed(nodes: DataFrame) -> DataFrame:
    """Nodes (id, kind, file) but modules, with their module and the name in it: a class starts the local part."""
    parts = F.split("id", r"\.")
    at = F.coalesce(F.array_position(F.transform(parts, lambda p: p.rlike("^[A-Z]")), F.lit(True)), F.lit(0))
    split = F.when(at > 1, at - 1).otherwise(F.size(parts) - 1).cast("int")
    out = nodes.filter((F.col("kind") != "module") & F.col("id").contains(".")).withColumn("_n", split).withColumn("_p", parts)
    module, local = F.array_join(F.slice("_p", F.lit(1), F.col("_n")), "."), F.array_join(F.slice("_p", F.col("_n") + 1, F.size("_p")), ".")
    return out.select("id", module.alias("module"), local.alias("local")).filter("module <> '' AND local <> ''")


def package_of(modules: DataFrame, inits: DataFrame) -> DataFrame:
    """Package per module: itself if it is a package's ``__init__``, else the part before the last dot."""
    own = inits.select(F.col("id").alias("module"), F.lit(True).alias("_init"))
    return modules.select("module").distinct().join(own, "module", "left").select(
        "module", F.when(F.col("_init"), F.col("module")).otherwise(parent(F.col("module"))).alias("package"))


def _imports(edges: DataFrame, packages: DataFrame) -> DataFrame:
    """Import edges with the name they bind and the qualified name it stands for; leading dots go up from the package."""
    mine = edges.filter("kind = 'import' AND target <> ''").join(packages.withColumnRenamed("module", "source"), "source", "left")
    dots = F.length(F.regexp_extract("target", r"^(\.*)", 1))
    tail = F.regexp_replace("target", r"^\.+", "")
    parts = F.split(F.coalesce("package", F.lit("")), r"\.")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), ".")
    full = F.when(dots == 0, tail).when(tail == "", up).when(up == "", tail).otherwise(F.concat_ws(".", up, tail))
    return mine.withColumn("qualified", full).filter("qualified <> ''").withColumn("bound", F.substring_index("qualified", ".", -1)).select("source", "bound", "qualified", "scope", "seq")


def resolve_names(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (seq, source, target, kind, scope) with ``resolved`` and the ``tier`` that found it.

    Tiers: an exact id; the only id with this dotted suffix of two parts or more; a name in the caller's module; an alias that
    the module imports; a name that its package exports again; a name in a module of the package, the most imported
    first, then the smallest; else the target as it is. Where a name may go on after its head, the longer id wins if there is one.

    Every tier is one join on its key; only keys with one candidate are kept, so no join multiplies rows.
    """
    ids = nodes.select(F.col("id").alias("_id")).distinct()
    inits = nodes.filter("kind = 'module' AND (file = '__init__.py' OR file LIKE '%/\\_\\_init\\_\\_.py')").select("id")
    # used by several tiers: written once, so that the plan stays small
    local = cut(indexed(nodes), "resolve-local")
    known = local.select("module").unionByName(inits.select(F.col("id").alias("module"))).distinct()
    packages = package_of(edges.select(F.col("source").alias("module")).unionByName(known), inits)
    imports = _imports(edges, packages)
    popular = imports.join(ids, F.col("qualified") == F.col("_id"), "left_semi").groupBy("qualified").agg(F.count(F.lit(1)).alias("n"))
    alias = imports.filter("scope IS NULL OR scope IN ('', 'module')").groupBy("source", "bound").agg(F.max_by("qualified", "seq").alias("q"))
    alias = cut(alias, "resolve-alias")

    # the caller's module: its longest prefix that is one, else the part before its last dot
    callers = edges.select("source").distinct().withColumn("_p", F.split("source", r"\."))
    prefix = callers.select("source", F.explode(F.transform(F.sequence(F.lit(0), F.size("_p") - 1), lambda n: F.array_join(F.slice("_p", F.lit(1), n), "."))).alias("module"))
    enclosing = prefix.join(known, "module").groupBy("source").agg(F.max_by("module", F.length("module")).alias("inside"))
    callers = callers.join(enclosing, "source", "left").select("source", F.coalesce("inside", F.when(F.col("source").contains("."), parent(F.col("source"))).otherwise(F.col("source"))).alias("module"))
    callers = cut(callers.join(package_of(callers, inits), "module", "left"), "resolve-callers")

    tails = F.transform(F.sequence(F.lit(2), F.size("_p") - 1), lambda n: F.array_join(F.slice("_p", n, F.size("_p")), "."))
    suffix = nodes.filter("id <> ''").withColumn("_p", F.split("id", r"\.")).filter(F.size("_p") >= 3).select("id", F.explode(tails).alias("target"))
    suffix = suffix.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("by_suffix")).filter("n = 1").drop("n")
    tops = local.filter(~F.col("local").contains(".")).join(package_of(local, inits), "module")
    sibling = tops.join(popular, tops["id"] == popular["qualified"], "left").groupBy(F.col("package").alias("s_package"), F.col("local").alias("s_head")).agg(
        F.min_by("id", F.struct(-F.coalesce("n", F.lit(0)), F.col("id"))).alias("by_sibling"))

    head, tail = F.substring_index("target", ".", 1), F.regexp_extract("target", r"^[^.]+\.(.+)$", 1)
    rows = edges.filter("target <> ''").join(callers, "source", "left").withColumn("head", head).withColumn("tail", tail)
    rows = rows.join(ids, F.col("target") == F.col("_id"), "left").withColumnRenamed("_id", "by_id").join(suffix, "target", "left")
    here = local.select(F.col("module").alias("m"), F.col("local").alias("l"), F.col("id").alias("by_module"))
    rows = rows.join(here, (F.col("module") == F.col("m")) & (F.col("target") == F.col("l")), "left").drop("m", "l")
    a = alias.select(F.col("source").alias("a_m"), F.col("bound").alias("a_h"), F.col("q").alias("by_alias"))
    rows = rows.join(a, (F.col("module") == F.col("a_m")) & (F.col("head") == F.col("a_h")), "left").drop("a_m", "a_h")
    r = alias.join(inits.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("source").alias("r_p"), F.col("bound").alias("r_h"), F.col("q").alias("by_export"))
    rows = rows.join(r, (F.col("package") == F.col("r_p")) & (F.col("head") == F.col("r_h")), "left").drop("r_p", "r_h")
    rows = rows.join(sibling, (F.col("package") == F.col("s_package")) & (F.col("head") == F.col("s_head")) & (F.col("package") != ""), "left").drop("s_package", "s_head")
    first = F.coalesce("by_alias", "by_export", "by_sibling")
    rows = rows.withColumn("_longer", F.when(F.col("tail") != "", F.concat_ws(".", first, F.col("tail"))).otherwise(first)).join(ids.withColumnRenamed("_id", "_whole"), F.col("_longer") == F.col("_whole"), "left")
    tier = F.lit("none")
    for name in ("by_sibling", "by_export", "by_alias", "by_module", "by_suffix", "by_id"):
        tier = F.when(F.col(name).isNotNull(), name[3:]).otherwise(tier)
    return rows.select(*edges.columns, F.coalesce("by_id", "by_suffix", "by_module", "_whole", first, "target").alias("resolved"), tier.alias("tier"))


def stubs(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """A stub node for every resolved name that is no node."""
    return resolved.select(F.col("resolved").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").select("id", F.lit("external").alias("kind"), F.lit("external:py").alias("file"))


# --- calls in Go code --------------------------------------------------------------------------------------------


def resolve_calls(calls: DataFrame, functions: DataFrame, fields: DataFrame, bindings: DataFrame) -> DataFrame:
    """Calls (seq, receiver, variable, method) with ``callee`` and ``ambiguous``.

    A field's type (``fields``: receiver, variable, type) names the callee if the function exists; else the concrete type bound to the interface
    (``bindings``: interface, concrete); else the only function of that method whose type contains the interface's name, the package
    breaking ties; else the callee stays a guess. Without a field: the variable as type, or a type that contains it, as a guess.

    Candidates share the method, so the contains-joins run inside one method's functions.
    """
    f = functions.select("id", "path", F.substring_index("id", ".", 1).alias("type"), F.regexp_extract("id", r"^[^.]+\.(.+)$", 1).alias("m"))
    rows = calls.join(fields.withColumn("type", F.regexp_replace("type", r"^\*", "")).withColumnRenamed("type", "field_type"), ["receiver", "variable"], "left")
    rows = rows.withColumn("short", F.substring_index("field_type", ".", -1)).withColumn("package", F.when(F.col("field_type").contains("."), F.lower(parent(F.col("field_type")))))
    rows = rows.withColumn("direct", F.concat_ws(".", F.coalesce("field_type", "variable"), "method"))
    exact = f.select(F.col("id").alias("direct"), F.lit(True).alias("is_direct"))
    bound = bindings.select(F.col("interface").alias("short"), F.substring_index(F.regexp_replace("concrete", r"^\*", ""), ".", -1).alias("concrete"))
    rows = rows.join(exact, "direct", "left").join(bound, "short", "left").withColumn("bound_id", F.concat(F.col("concrete"), F.lit("."), F.col("method")))
    rows = rows.join(f.select(F.col("id").alias("bound_id"), F.lit(True).alias("is_bound")), "bound_id", "left")
    open_ = rows.filter("is_direct IS NULL AND is_bound IS NULL").select("seq", "method", F.lower(F.coalesce("short", "variable")).alias("part"), "package")
    near = open_.join(f, open_["method"] == f["m"]).filter(F.contains(F.lower("type"), F.col("part")))
    in_package = F.col("package").isNotNull() & F.contains(F.lower("path"), F.col("package"))
    fuzzy = near.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("any_id"), F.count(F.when(in_package, 1)).alias("n_p"), F.min(F.when(in_package, F.col("id"))).alias("p_id"))
    rows = rows.join(fuzzy, "seq", "left")
    has_field = F.col("field_type").isNotNull()
    found = F.when(F.col("is_direct"), F.col("direct")).when(F.col("is_bound"), F.col("bound_id")).when(F.col("n") == 1, F.col("any_id")).when(has_field & (F.col("n_p") == 1), F.col("p_id"))
    callee = F.coalesce(found, F.when(has_field, F.col("direct")).otherwise(F.col("any_id")))
    sure = F.when(has_field, found.isNotNull()).otherwise(F.coalesce("is_direct", F.lit(False)))
    return rows.select("seq", callee.alias("callee"), (~sure).alias("ambiguous")).filter("callee IS NOT NULL")


def merge_placeholders(edges: DataFrame, placeholders: DataFrame, functions: DataFrame) -> DataFrame:
    """Edges (src, dst) with placeholder handlers (id) replaced by the only function whose id ends in their method.

    Handlers outside of tests and mocks go first, then any function. With several handlers the edge is marked ambiguous.
    """
    method = lambda c: F.substring_index(c, ".", -1)
    f = functions.select("id", method(F.col("id")).alias("m"), ((F.col("kind") == "handler") & ~F.lower("path").rlike("test|mock")).alias("good"))
    one = f.groupBy("m").agg(F.count(F.when(F.col("good"), 1)).alias("n_good"), F.min(F.when(F.col("good"), F.col("id"))).alias("good_id"), F.count(F.lit(1)).alias("n"), F.min("id").alias("any_id"))
    p = placeholders.select(F.col("id").alias("dst"), method(F.col("id")).alias("m")).join(one, "m", "left")
    new = F.when(F.col("n_good") == 1, F.col("good_id")).when((F.col("n_good") == 0) & (F.col("n") == 1), F.col("any_id"))
    p = p.select("dst", new.alias("_new"), (F.col("n_good") > 1).alias("_many"))
    out = edges.join(p, "dst", "left")
    return out.select("src", F.coalesce("_new", "dst").alias("dst"), F.coalesce("_many", F.lit(False)).alias("ambiguous"))
