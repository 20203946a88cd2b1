"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing, one after another.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, columns that are not those of
``documents`` (left out) and empty tables (an empty result).
"""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import common, jaccard_dedup, line_dedup, mixing, packing, quality_rules
from sextant.sources.storage import remove, scope

#: Working tables of the stage that this thread ran last, by application and input.
_last: ContextVar[dict[tuple[str, str], str]] = ContextVar("last", default={})  # noqa: B039  never changed in place


def stage(f):
    """A stage whose working tables go when the same thread asks for the next stage of the same input: by then, what it
    returned has been written and is read from there. Pipelines in other threads have tables of their own."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.ship(spark)
        key = (spark.sparkContext.applicationId, sf_dir)
        if key in _last.get():
            remove(spark, _last.get()[key])
        with scope(spark, f"work-{f.__name__}") as path:
            out = f(spark, docs, sf_dir)
        _last.set({**_last.get(), key: path})
        return out

    run_stage.__name__, run_stage.__doc__ = f.__name__, f.__doc__
    return run_stage


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def own(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``: those that are missing are null, others are left out."""
    types = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(types.get(c, "string")).alias(c) for c in COLUMNS])


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null texts have no word and go."""
    return quality_rules.filter_documents(own(docs))


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of repeated line runs; documents of which no line with a word is left go."""
    out = common.where(line_dedup.dedup_lines(own(docs)), F.col("n_lines") > F.col("n_removed"))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: Golay fuzzy hashing of the segments of a SimHash fingerprint over shingles
    of five words, candidates of a similarity of 0.8 verified exactly, star components. Rows of one id are told apart by their
    text."""
    return jaccard_dedup.keep_one(own(docs))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it."""
    return mixing.mixed_documents(own(docs))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Tokens and XXH64 fingerprints have no SQL; a test holds the pipeline to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read as the next one's input."""
    docs = common.documents(spark, sf_dir)
    for name, f in STAGES[:-1]:
        docs = common.cut(f(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
