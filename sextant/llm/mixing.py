"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a hash of its document ids; a document's virtual finish time is the source's tokens up
to and including it, divided by the source's target. A further pass over a source adds its whole size first. All
passes of all documents are sorted by finish time in ranges, and the order is truncated where the total budget is
spent: at that point every source has served its target but for a document.

Cumulative sums are taken inside ranges of one global sort and raised by the sums of the ranges before; these sums,
one per range and source in it, are the only thing that the driver sees besides the recipe (one row per source).
A hot source is spread over ranges like any other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm import common

PASSES = 2


@dataclass(frozen=True)
class Share:
    """A source of the recipe: its place in the order of sources, its size and the tokens it is to serve."""

    source: str | None
    place: int
    size: int
    target: float


def recipe(sizes: dict[str | None, int], weights: list[float], budget: float, passes: int = PASSES) -> list[Share]:
    """Targets by weight (sources by code point, null last; weights repeat). No target is above ``passes`` times its
    source's size: what is above goes to the others by weight, until none is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = budget - sum(passes * sizes[s] for s in full)
        total = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * rest / total > passes * sizes[s]} if total else set()
        if not over:
            break
        full |= over
    return [Share(s, i, sizes[s], float(passes * sizes[s]) if s in full else weight[s] * rest / total) for i, s in enumerate(order)]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def _raised(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Running sums of ``_size`` per key over rows of ``common.numbered`` as ``_cum``."""
    sums = sorted(map(tuple, rows.groupBy("_part", *keys).agg(F.sum("_size").alias("s")).collect()))
    before: dict[tuple, int] = defaultdict(int)
    offsets = []
    for part, *key, s in sums:
        offsets.append((part, *key, before[tuple(key)]))
        before[tuple(key)] += s
    schema = ", ".join(f"{c} int" for c in ["_part", *keys]) + ", _before long"
    offset = rows.sparkSession.createDataFrame(offsets, schema)
    w = Window.partitionBy("_part", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # one row per range and source in it
    out = rows.withColumn("_in", F.sum("_size").over(w)).join(F.broadcast(offset), ["_part", *keys])
    return out.withColumn("_cum", F.col("_in") + F.col("_before")).drop("_in", "_before", "_part", "_row")


def mix(docs: DataFrame, weights: list[float], share: float, passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """Per row of ``docs`` (_id, _source, _size, and columns to carry): ``_target`` and ``_source_size`` of its source
    and ``_copies``, how often the mix takes the document (0 to ``passes``).

    The budget is ``share`` times all sizes. Null sources are a source of their own; null ids and repeated rows are
    shuffled like others, and rows equal in id, size and ``_tie``, if given, are interchangeable. A document without words weighs nothing;
    it is taken if its finish time is in the mix. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = common.cut(docs, "mix-docs")
    sizes = {r["_source"]: int(r["s"] or 0) for r in docs.groupBy("_source").agg(F.sum("_size").alias("s")).collect()}
    total = sum(sizes.values())
    budget = share * total
    shares = recipe(sizes, weights, budget, passes)
    table = spark.createDataFrame([(x.source, x.place, x.size, x.target) for x in shares], "_source string, _place int, _source_size long, _target double")
    placed = docs.join(F.broadcast(table), docs["_source"].eqNullSafe(table["_source"])).drop(table["_source"])
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    tie = ["_tie"] if "_tie" in docs.columns else []
    queue = common.numbered(placed.withColumn("_key", key), "_place", "_key", "_id", "_size", *tie, tag="mix-queue")
    served = _raised(queue, ["_place"])
    finish = [F.when(F.col("_target") > 0, (F.col("_cum") + p * F.col("_source_size")) / F.col("_target")).otherwise(F.lit(0.0 if p == 0 else float("inf"))) for p in range(passes)]
    served = common.cut(served.withColumn("_finish", F.array(*finish)), "mix-served")
    turns = served.select("_place", "_size", F.explode("_finish").alias("_at")).filter("_size > 0")
    cutoff = _cutoff(common.numbered(turns, "_at", "_place", tag="mix-turns"), int(budget))
    if cutoff is None:  # everything fits, or nothing weighs anything
        copies = F.lit(passes)
    else:
        at, place = F.lit(cutoff[0]), F.lit(cutoff[1])
        copies = F.size(F.filter("_finish", lambda x: (x < at) | ((x == at) & (F.col("_place") <= place))))
    return served.withColumn("_copies", copies.cast("int")).drop("_place", "_key", "_cum", "_finish")


def _cutoff(turns: DataFrame, budget: int) -> tuple[float, int] | None:
    """The last (finish time, place) within the budget; None if all are. A source has no two turns with words at one
    time, so the pair tells turns apart."""
    parts = [tuple(r) for r in turns.groupBy("_part").agg(F.sum("_size").alias("s")).orderBy("_part").collect()]
    ends, run = [], 0
    for _, s in parts:
        run += s
        ends.append(run)
    if run <= budget:
        return None
    at = bisect_left(ends, budget + 1)
    left = budget - (ends[at - 1] if at else 0)
    # inside one range of the sort: a running sum over its rows
    inside = turns.filter(F.col("_part") == parts[at][0])
    w = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = inside.withColumn("_run", F.sum("_size").over(w)).filter(F.col("_run") <= left)
    last = fits.agg(F.max(F.struct("_at", "_place")).alias("x")).first()["x"]
    if last is None and at:
        last = turns.filter(F.col("_part") == parts[at - 1][0]).agg(F.max(F.struct("_at", "_place")).alias("x")).first()["x"]
    return (float("-inf"), -1) if last is None else (last["_at"], last["_place"])


WEIGHTS, SHARE = [5.0, 2.0, 1.0], 1.5


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = mix(docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(F.col("text")).alias("_size")), WEIGHTS, SHARE)
    return out.select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as mixed by the query's recipe: rows that the mix takes twice come twice, others once or not at all."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row_id"))
    base = common.cut(packed, "mix-rows")
    slim = base.select("_row_id", F.col("_doc.doc_id").alias("_id"), F.col("_doc.source").alias("_source"), word_count(F.col("_doc.text")).alias("_size"), F.xxhash64("_doc.text").alias("_tie"))
    taken = mix(slim, WEIGHTS, SHARE).filter("_copies > 0").select("_row_id", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return base.join(taken.hint("merge"), "_row_id").select("_doc.*")  # grows with the input: never broadcast


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, size, place, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS w
  FROM (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source)
), fill(round, capped, rest, total) AS (
  SELECT 0, []::BIGINT[], 1.5 * (SELECT sum(size) FROM s)::DOUBLE, (SELECT sum(w) FROM s)
  UNION ALL
  SELECT round + 1, n.places, 1.5 * (SELECT sum(size) FROM s)::DOUBLE - n.used, n.total
  FROM fill f, LATERAL (
    SELECT list(place ORDER BY place) FILTER (WHERE o) AS places, coalesce(sum(2 * size) FILTER (WHERE o), 0)::DOUBLE AS used,
           coalesce(sum(w) FILTER (WHERE NOT o), 0) AS total
    FROM (SELECT place, size, w, list_contains(f.capped, place) OR w * f.rest / f.total > 2 * size AS o FROM s)) n
  WHERE f.total > 0 AND len(coalesce(n.places, [])) > len(f.capped)
), last AS (
  SELECT * FROM fill ORDER BY round DESC LIMIT 1
), t AS (
  SELECT s.source, s.place, s.size AS source_size,
         CASE WHEN list_contains(last.capped, s.place) THEN (2 * s.size)::DOUBLE ELSE s.w * last.rest / last.total END AS target FROM s, last
), q AS (
  SELECT d.doc_id, d.size, t.place, t.source_size, t.target,
         sum(d.size) OVER (PARTITION BY t.place ORDER BY md5('mix:' || d.doc_id), d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), turns AS (
  SELECT doc_id, place, size, (cum + p * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS passes(p) WHERE size > 0
), run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, place ROWS UNBOUNDED PRECEDING) AS upto FROM turns
), taken AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM run WHERE upto <= floor(1.5 * (SELECT sum(size) FROM s)) GROUP BY doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(taken.taken, 0)::BIGINT AS taken FROM q LEFT JOIN taken USING (doc_id)
"""
