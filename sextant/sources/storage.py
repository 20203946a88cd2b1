"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: The folders of the open scopes of this thread, innermost last.
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application: they may run elsewhere, or in another folder."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="sextant-code-")  # on the driver, which serves the file to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    packed = Path(folder) / "sextant-code.zip"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. In local mode only, one is made if the session names none."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="sextant-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, tag: str) -> str:
    """An unused path below the shared folder, or below the open scope."""
    open_ = _scopes.get()
    return f"{open_[-1] if open_ else shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def scope(spark: SparkSession, tag: str) -> Iterator[str]:
    """Tables cut inside by this thread lie below one folder, whose path is given, so that they can be removed together."""
    path = new_path(spark, tag)
    token = _scopes.set((*_scopes.get(), path))
    try:
        yield path
    finally:
        _scopes.reset(token)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor lose it with an executor."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str | Column, tag: str) -> DataFrame:
    """Sort globally by ranges of ``order`` and write the rows with ``_part`` (the range) and ``_row`` (the place in it).

    Range and place together follow the global order. Nothing is gathered in one task: a hot leading
    column is split as long as the whole order tells its rows apart.
    """
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    return cut(out.withColumn("_part", F.shiftright("_mid", 33).cast("int")).withColumn("_row", F.col("_mid").bitwiseAND((1 << 33) - 1)).drop("_mid"), tag)


def indexed(df: DataFrame, *order: str | Column, tag: str) -> tuple[DataFrame, int]:
    """The rows with their place ``_at`` in the global order, from 0, and how many there are. The driver sees a count per range."""
    rows, run, before = numbered(df, *order, tag=tag), 0, []
    for part, n in sorted(map(tuple, rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())):
        before.append((part, run))
        run += n
    offsets = df.sparkSession.createDataFrame(before, "_part int, _before long")
    # one row per range of the sort
    return rows.join(F.broadcast(offsets), "_part").withColumn("_at", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before"), run
