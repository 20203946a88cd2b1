"""Point look-ups, filters and short joins over the code-intelligence tables.

Optional filters are added only if they are set, so that those given reach the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import paths
from sextant.sources.storage import indexed


def where_equal(df: DataFrame, **wanted: str | int | None) -> DataFrame:
    """Rows equal to all values given; None or an empty string leaves a column alone."""
    for column, value in wanted.items():
        if value not in (None, ""):
            df = df.filter(F.col(column) == value)
    return df


def symbols(table: DataFrame, file: str | None = None, package: str | None = None, bc: str | None = None, kind: str | None = None) -> DataFrame:
    out = where_equal(table, file_path=file, package=package, kind=kind)
    return out.filter(paths.bc_path(F.col("file_path")) == bc) if bc else out


def find_symbol(table: DataFrame, name: str, substring: bool = True) -> DataFrame:
    """The best symbol for a name: exact, else a dotted suffix, else (optionally) a substring; then by file, line and name."""
    q = F.col("qualified_name")
    rank = F.when(q == name, 0).when(q.endswith("." + name), 1)
    rank = rank.when(q.contains(name), 2) if substring else rank
    return table.withColumn("match", rank).filter("match IS NOT NULL").orderBy("match", "file_path", "line", "qualified_name").limit(1)


def nearest_symbol(sites: DataFrame, table: DataFrame, within: int = 30, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Forward as-of join: for each site (file_path, line) the first symbol of its file on its line or up to ``within`` below.

    Symbols are bucketed by line so that a file with many of both is matched on (file, bucket), not on the file alone.
    """
    wide = within + 1
    near = sites.select(*keys, F.col("file_path").alias("_file"), F.col("line").alias("_line"))
    near = near.withColumn("_bucket", F.explode(F.array(F.floor(F.col("_line") / wide), F.floor(F.col("_line") / wide) + 1)))
    right = table.select(F.col("id").alias("symbol_id"), "qualified_name", "file_path", "line", F.floor(F.col("line") / wide).alias("bucket"))
    hit = (F.col("_file") == F.col("file_path")) & (F.col("_bucket") == F.col("bucket")) & F.col("line").between(F.col("_line"), F.col("_line") + within)
    best = F.min(F.struct("line", "qualified_name", "symbol_id")).alias("best")
    return near.join(right, hit).groupBy(*keys).agg(best).select(*keys, "best.symbol_id", "best.qualified_name", F.col("best.line").alias("symbol_line"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The run that finished last; of several the one with the highest id. One row, or none."""
    best = F.max(F.struct("finished_us", "id")).alias("best")
    return runs.filter("finished_us > 0").agg(best).filter("best IS NOT NULL").select(F.col("best.id").alias("run_id"), F.col("best.finished_us").alias("finished_us"))


def annotations_of_context(annotations: DataFrame, bc: str) -> DataFrame:
    """All annotations in files that declare the bounded context."""
    files = annotations.filter((F.col("kind") == "bc") & (F.col("value") == bc)).select("file_path").distinct()
    return annotations.join(files, "file_path", "left_semi")


def tokens(value: Column) -> Column:
    """White-space separated tokens."""
    return F.filter(F.split(value, r"\s+"), lambda x: x != "")


def tag(value: Column, name: str) -> Column:
    """The value of the first ``name=`` token, else null."""
    first = F.get(F.filter(tokens(value), lambda x: x.startswith(f"{name}=")), F.lit(0))
    return F.regexp_replace(first, f"^{name}=", "")


def find_aggregate(annotations: DataFrame, aggregate: str) -> DataFrame:
    """The first declaration of an aggregate's service, with its ``service=`` partner."""
    mine = annotations.filter((F.col("kind") == "aggregate-service") & (F.get(tokens(F.col("value")), F.lit(0)) == aggregate))
    return mine.withColumn("service", tag(F.col("value"), "service")).orderBy("file_path", "line", "id").limit(1)


def walk_saga(annotations: DataFrame, saga: str) -> DataFrame:
    """Steps of a saga in order; rows of the saga without a numeric ``step=`` are left out."""
    mine = annotations.filter((F.col("kind") == "saga") & (F.get(tokens(F.col("value")), F.lit(0)) == saga))
    return mine.withColumn("step", tag(F.col("value"), "step").try_cast("int")).filter("step IS NOT NULL").orderBy("step", "file_path", "line", "id")


def consumers(annotations: DataFrame, stream: str | None = None) -> DataFrame:
    """Consumers with the stream they read, all or those of one stream."""
    out = annotations.filter("kind = 'consumer'").withColumn("stream", tag(F.col("value"), "stream")).filter("stream IS NOT NULL")
    return out.filter(F.col("stream") == stream) if stream else out


def emitters(annotations: DataFrame) -> DataFrame:
    """Per event the sorted sites that emit it and those that publish it to the outbox."""
    site = F.concat_ws(":", "file_path", F.col("line").cast("string"))
    mine = annotations.filter(F.col("kind").isin("event-emit", "outbox-publish")).withColumn("event", F.get(tokens(F.col("value")), F.lit(0)))
    sites = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, site))), ",")
    return mine.groupBy("event").agg(sites("event-emit").alias("emits"), sites("outbox-publish").alias("publishes"))


def with_pattern(symbols_: DataFrame, matches: DataFrame, pattern: str) -> DataFrame:
    """Symbols that have a match of the pattern."""
    return symbols_.join(matches.filter(F.col("pattern") == pattern).select(F.col("symbol_id").alias("id")).distinct(), "id", "left_semi")


def stale_sample(stored: DataFrame, current: DataFrame, n: int = 16) -> DataFrame:
    """A strided sample of up to ``n`` files and whether their hash changed or they are gone. The sample is the feature."""
    rows, total = indexed(stored, "file_path", tag="stale-files")
    step = max(1, total // n)
    picked = rows.filter((F.col("_at") % step == 0) & (F.col("_at") < step * n))
    now = current.select("file_path", F.col("content_hash").alias("now_hash"))
    return picked.join(now, "file_path", "left").select("file_path", (~F.col("content_hash").eqNullSafe(F.col("now_hash"))).alias("stale"))


def expired(hashes: DataFrame, now_us: int, ttl_us: int) -> DataFrame:
    """Files scanned longer ago than the time to live."""
    return hashes.filter(F.col("scanned_us") < now_us - ttl_us)


def import_edges(edges: DataFrame, symbols_: DataFrame, scopes: Sequence[str] = (), prefix: str | None = None) -> DataFrame:
    """Import edges with the names and files of both ends; scopes limit ``edge_meta``, a prefix either end's file."""
    mine = edges.filter("kind = 'import'")
    if scopes:
        mine = mine.filter(F.col("edge_meta").isin(*scopes))
    end = lambda side: symbols_.select(F.col("id").alias(side), F.col("qualified_name").alias(f"{side}_name"), F.col("file_path").alias(f"{side}_file"))
    out = mine.join(end("src"), "src").join(end("dst"), "dst")
    return out.filter(F.col("src_file").startswith(prefix) | F.col("dst_file").startswith(prefix)) if prefix else out


#: Edge scopes that can be asked for.
SCOPES = ("module", "function", "conditional", "type_checking", "try_guard")


def dead_symbols(symbols_: DataFrame, edges: DataFrame, kind: str = "import", scopes: Sequence[str] = ("module", "conditional"),
                 include_tests: bool = False, prefix: str | None = None) -> DataFrame:
    """Symbols without an incoming edge that counts: an anti-join with the edges filtered first.

    Tests are neither dead nor keep anything alive unless ``include_tests``; a null scope never satisfies a filter;
    scopes that are all unknown count as no filter. ``kind='all'`` takes every kind of edge. External stubs
    (files that start with ``external:``) are never dead. Self-edges count.
    """
    live = edges if kind == "all" else edges.filter(F.col("kind") == kind)
    known = [s for s in scopes if s in SCOPES]
    if known and kind in ("import", "all"):
        live = live.filter(F.col("edge_meta").isin(*known))
    if not include_tests:
        sources = symbols_.filter(~paths.is_test_path(F.col("file_path"))).select(F.col("id").alias("src"))
        live = live.join(sources, "src", "left_semi")
    out = symbols_.filter(~F.col("file_path").startswith("external:"))
    if not include_tests:
        out = out.filter(~paths.is_test_path(F.col("file_path")))
    if prefix:
        out = out.filter(F.col("file_path").startswith(prefix))
    return out.join(live.select(F.col("dst").alias("id")), "id", "left_anti")


def declaration_owner(notes: DataFrame, declarations: DataFrame, above: int = 10) -> DataFrame:
    """Backward proximity: each declaration's nearest annotation in the ``above`` lines over it, owned by the next declaration.

    Both are laid in one sequence per file; a note belongs to the first declaration below it. Of several the one with
    the larger line wins, then contract over feature over others, then the smaller id.
    """
    rank = F.when(F.col("kind") == "contract", 3).when(F.col("kind") == "feature", 2).otherwise(1)
    both = notes.select("file_path", "line", F.lit(0).alias("_decl"), F.col("id").alias("_note"), rank.alias("_rank"), F.lit(None).cast("long").alias("_id"), "value").unionByName(
        declarations.select("file_path", "line", F.lit(1).alias("_decl"), F.lit(None).cast("long").alias("_note"), F.lit(0).alias("_rank"), F.col("id").alias("_id"), F.lit(None).cast("string").alias("value")))
    # declarations sort after notes of their own line, so the gap is over zero only with the next line's
    below = Window.partitionBy("file_path").orderBy(F.col("line").asc(), F.col("_decl").desc()).rowsBetween(1, Window.unboundedFollowing)
    owner = F.min(F.when(F.col("_decl") == 1, F.col("line"))).over(below)
    owned = both.withColumn("_owner", owner).filter((F.col("_decl") == 0) & (F.col("_owner") > F.col("line")) & (F.col("_owner") - F.col("line") <= above))
    best = owned.groupBy("file_path", F.col("_owner").alias("line")).agg(F.max_by("value", F.struct("line", "_rank", -F.col("_note"))).alias("value"))
    return declarations.select("id", "file_path", "line").join(best, ["file_path", "line"])
