"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.sources.storage import cut, indexed, new_path, numbered, shared_dir, ship  # noqa: F401

#: White space of the contracts: space and U+0009..U+000D. A word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_matches(text: Column, pattern: str) -> Column:
    """Characters of ``text`` in a one-character class ``pattern``."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for columns in between that ``df`` does not have, whatever its letters' case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def where(df: DataFrame, cond: Column) -> DataFrame:
    """Filter on computed columns. No filter is pushed through a column that depends on the partition, so they are not computed
    again below, inside lambdas and once per element."""
    (fence,) = free(df, "_fence")
    return df.withColumn(fence, F.spark_partition_id()).filter(cond & (F.col(fence) >= 0)).drop(fence)


#: Bytes per core under which a table of fewer files than cores is dealt anew to all cores: a small file often has one row
#: group, and so one task.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if the planner knows it to be small and in few files; other tables have splits enough and are not
    shuffled. No result depends on it: all orders are by content."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if known <= SPREAD_BYTES * cores and len(df.inputFiles()) < cores else df


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    """A driver table."""
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def is_empty(df: DataFrame) -> bool:
    """Whether there is no row."""
    return not df.take(1)
