"""Writes: insert-or-ignore, upsert, deletes, runs with results, snapshots. Tables are Parquet folders, swapped when rewritten."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sextant.functions import paths
from sextant.sources.storage import new_path


def first_of(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """One row per key, the first of the order."""
    w = Window.partitionBy(*keys).orderBy(*(order or keys))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def insert_ignore(stored: DataFrame, arriving: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """All stored rows, and arriving ones with a new key; of several the first by ``seq``."""
    new = first_of(arriving, keys, *([seq] if seq else []))
    return stored.unionByName(new.join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def upsert(stored: DataFrame, arriving: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Arriving rows, the last by ``seq`` of each key, over stored ones."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    last = arriving.withColumn("_k", F.row_number().over(w)).filter("_k = 1").select(*stored.columns)
    return stored.join(last.select(*keys), list(keys), "left_anti").select(*stored.columns).unionByName(last)


def delete_files(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """``symbols``, ``edges``, ``links`` and ``results`` without the symbols of some files: edges and links go, results lose their symbol."""
    gone = tables["symbols"].join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")
    out = dict(tables)
    out["symbols"] = tables["symbols"].join(gone, "id", "left_anti")
    edges = tables["edges"]
    for end in ("src", "dst"):
        edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti")
    out["edges"] = edges.select(*tables["edges"].columns)
    out["links"] = tables["links"].join(gone.withColumnRenamed("id", "symbol_id"), "symbol_id", "left_anti").select(*tables["links"].columns)
    lost = tables["results"].join(gone.select(F.col("id").alias("symbol_id"), F.lit(True).alias("_gone")), "symbol_id", "left")
    out["results"] = lost.withColumn("symbol_id", F.when(F.col("_gone").isNull(), F.col("symbol_id"))).select(*tables["results"].columns)
    return out


def delete_one(table: DataFrame, key: str, value) -> DataFrame:
    """``table`` without the rows of a key; no such row is an error."""
    if not table.filter(F.col(key) == value).take(1):
        raise KeyError(f"no row with {key} = {value!r}")
    return table.filter(~F.col(key).eqNullSafe(F.lit(value)))


def ingest_scan(stored: dict[str, DataFrame], index: dict[str, DataFrame], replace_changed: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """A scan's ``symbols``, ``edges``, ``annotations`` and ``file_hashes`` put into the stored tables, and counts of what came.

    Files with the stored hash are skipped with their rows; edges by the file of their source only. Symbols and edges are
    inserted if new, annotations and hashes overwrite. With ``replace_changed`` the old rows of changed files go first.
    """
    old = stored["file_hashes"].select("file_path", F.col("content_hash").alias("_h"))
    same = index["file_hashes"].join(old, "file_path").filter("content_hash = _h").select("file_path")
    new = {k: index[k].join(same, "file_path", "left_anti") for k in ("symbols", "annotations", "file_hashes", "edges")}
    base = dict(stored)
    if replace_changed:
        for k in ("symbols", "edges", "annotations"):
            base[k] = stored[k].join(new["file_hashes"].select("file_path"), "file_path", "left_anti").select(*stored[k].columns)
    out = {
        "symbols": insert_ignore(base["symbols"], new["symbols"], ["qualified_name"], "seq"),
        "edges": insert_ignore(base["edges"], new["edges"], ["src", "dst", "kind", "file_path", "line"], "seq"),
        "annotations": upsert(base["annotations"], new["annotations"], ["file_path", "line", "kind"], "seq"),
        "file_hashes": upsert(base["file_hashes"], new["file_hashes"], ["file_path"], "content_hash"),
    }
    keys = {"symbols": ["qualified_name"], "edges": ["src", "dst", "kind", "file_path", "line"], "annotations": ["file_path", "line", "kind"], "file_hashes": ["file_path"]}
    stats = None
    for k, key in keys.items():
        row = new[k].select(*key).distinct().join(base[k].select(*key), key, "left_anti").agg(F.lit(k).alias("table"), F.count(F.lit(1)).alias("added"))
        stats = row if stats is None else stats.unionByName(row)
    return out, stats


def run_with_results(results: DataFrame, run_id: int, symbols: DataFrame) -> DataFrame:
    """Parsed results as rows of a run, with the symbol that their qualified name has, or null; empty messages are null."""
    known = symbols.select(F.col("qualified_name").alias("symbol"), F.col("id").alias("symbol_id"))
    message = F.when(F.col("message") != "", F.col("message"))
    return results.join(known, "symbol", "left").select(F.lit(run_id).cast("long").alias("run_id"), "symbol_id", "feature_id", "status", "duration_ms", message.alias("message"))


def run_window(run: DataFrame, now_us: int) -> DataFrame:
    """A run's start, now if it has none, and its end, the start if it has none."""
    start = F.coalesce("started_us", F.lit(now_us))
    return run.withColumn("started_us", start).withColumn("finished_us", F.coalesce("finished_us", F.col("started_us")))


def snapshot(tables: dict[str, DataFrame], git_ref: str, captured_us: int) -> DataFrame:
    """A version of small tables as JSON rows (git_ref, captured_us, table_name, row_json): a row each, so no value grows with the input."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(git_ref).alias("git_ref"), F.lit(captured_us).cast("long").alias("captured_us"), F.lit(name).alias("table_name"), F.to_json(F.struct(*df.columns)).alias("row_json"))
        out = rows if out is None else out.unionByName(rows)
    return out


def valid_json(df: DataFrame, column: str) -> DataFrame:
    """Rows whose JSON parses."""
    return df.filter(F.try_parse_json(column).isNotNull())


def audit_snapshot(scores: DataFrame, run_id: int, computed_us: int) -> DataFrame:
    """An audit's scores as stored rows (id, computed_us, feature_id, score_json): a row per feature, so that none grows with the audit."""
    return scores.select(F.lit(run_id).cast("long").alias("id"), F.lit(computed_us).cast("long").alias("computed_us"), "feature_id", F.to_json(F.struct(*scores.columns)).alias("score_json"))


def audit_history(snapshots: DataFrame, n: int = 0) -> DataFrame:
    """The stored audits, newest first: id, computed_us and how many features they scored; the last ``n``, 0 for all."""
    runs = snapshots.groupBy("id", "computed_us").agg(F.count(F.lit(1)).alias("features")).orderBy(F.desc("computed_us"), F.desc("id"))
    return runs.limit(n) if n > 0 else runs


def load_audit(snapshots: DataFrame, schema: str, run_id: int | None = None) -> DataFrame:
    """The scores of a stored audit, the latest if none is named; no row if there is none."""
    if run_id is None:
        # one row
        mine = snapshots.join(F.broadcast(audit_history(snapshots, 1).select("id")), "id", "left_semi")
    else:
        mine = snapshots.filter(F.col("id") == run_id)
    return mine.select(F.from_json("score_json", schema).alias("s")).select("s.*")


def swap(df: DataFrame, path: str) -> None:
    """Replace the Parquet folder ``path``: the rows are written beside it, so readers of ``path`` can be in ``df``. The old
    folder is set aside before the new one takes its name and goes only then: a stop in between leaves the old rows in
    ``path``.old, which ``restore`` puts back."""
    spark = df.sparkSession
    restore(spark, path)
    fresh = f"{path}.new"
    df.write.mode("overwrite").parquet(fresh)
    jvm = spark.sparkContext._jvm
    to, came, aside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh, f"{path}.old"))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to):
        fs.rename(to, aside)
    fs.rename(came, to)
    fs.delete(aside, True)


def restore(spark: SparkSession, path: str) -> None:
    """Undo a ``swap`` that was stopped: the folder set aside comes back if ``path`` is missing, and goes if it is there."""
    jvm = spark.sparkContext._jvm
    to, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(aside):
        if fs.exists(to):
            fs.delete(aside, True)
        else:
            fs.rename(aside, to)


def save_version(df: DataFrame, name: str) -> str:
    """Write a table as a new version in the shared folder, and tell where."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def contract_id(kind: Column, name: Column, method: Column, path: Column, symbol: Column, prefix: str = "") -> Column:
    """Feature id of a contract definition, made of what identifies its kind."""
    part = F.when(kind == "route", F.concat_ws(".", F.lit("route"), method, path)).when(kind == "graphql", F.concat_ws(".", F.lit("graphql"), name))
    part = part.when(kind == "func", F.concat_ws(".", F.lit("func"), name, symbol)).otherwise(F.concat_ws(".", kind, name))
    return paths.feature_id(F.concat_ws(".", F.lit(prefix), part) if prefix else part)


def envelope(command: str, args: dict, result, warnings: Sequence[str] = (), generated_at: str = "") -> dict:
    """What the command line prints as JSON."""
    return {"schema_version": 1, "command": command, "args": args, "result": result, "warnings": list(warnings), "generated_at": generated_at}
