"""Differences of two keyed tables, and what is made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], compare: Sequence[str] = (), changed: Column | None = None) -> DataFrame:
    """Keys with what happened to them: added, removed or changed; unchanged ones are left out.

    Each side has one row per key. Columns of ``compare`` come as ``a_`` and ``b_``; a row is changed if one differs,
    nulls being equal, or if ``changed`` over these columns says so. One full outer join on the keys.
    """
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in compare], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in compare], F.lit(1).alias("_b"))
    both = left.join(right, list(keys), "full_outer")
    differs = changed
    if differs is None:
        differs = F.lit(False)
        for c in compare:
            differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    what = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(differs, "changed")
    return both.withColumn("change", what).filter("change IS NOT NULL").drop("_a", "_b")


def last_of(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row per key, where later ones overwrite."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*")


def audit_diff(a: DataFrame, b: DataFrame, floor: int = 5) -> DataFrame:
    """Scores (feature_id, score int) that came, went or moved by ``floor`` or more; a floor of 0 tells every move.

    If one side is empty all features are missing there instead.
    """
    d = F.abs(F.col("b_score") - F.col("a_score"))
    out = keyed_diff(a, b, ["feature_id"], ["score"], d >= floor if floor > 0 else d != 0)
    # one row each
    sides = F.broadcast(a.agg(F.count(F.lit(1)).alias("_na"))).crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("_nb"))))
    what = F.when(F.col("_na") == 0, "missing_on_a").when(F.col("_nb") == 0, "missing_on_b").otherwise(F.col("change"))
    return out.crossJoin(sides).withColumn("change", what).drop("_na", "_nb")


def coverage_diff(a: DataFrame, b: DataFrame, floor_pp: float = 5.0) -> DataFrame:
    """Pass rates (feature_id, pass_rate, total) that came, went, moved by the floor in points, or fell from 1; a total of 0 is no signal."""
    flipped = (F.col("a_pass_rate") >= 1.0) & (F.col("b_pass_rate") < 1.0)
    moved = F.abs((F.col("b_pass_rate") - F.col("a_pass_rate")) * 100.0) >= floor_pp
    out = keyed_diff(a.filter("total > 0"), b.filter("total > 0"), ["feature_id"], ["pass_rate"], moved | flipped)
    return out.withColumn("delta_pp", (F.col("b_pass_rate") - F.col("a_pass_rate")) * 100.0).withColumn("flipped_off", F.coalesce(flipped, F.lit(False)))


def change_counts(diffs: dict[str, DataFrame]) -> DataFrame:
    """Per dimension how many rows came, went and changed, and whether none did."""
    out = None
    for name, d in diffs.items():
        n = lambda c: F.count(F.when(F.col("change") == c, 1)).alias(c)
        row = d.agg(n("added"), n("removed"), n("changed")).select(F.lit(name).alias("dimension"), "*")
        out = row if out is None else out.unionByName(row)
    return out.withColumn("is_empty", (F.col("added") + F.col("removed") + F.col("changed")) == 0)


def health_diff(a: DataFrame, b: DataFrame, still: float = 1e-4) -> DataFrame:
    """Features by what their health did: improved, regressed, unchanged, new or removed, with the difference."""
    both = a.select("feature_id", F.col("health").alias("a")).join(b.select("feature_id", F.col("health").alias("b")), "feature_id", "full_outer")
    d = F.col("b") - F.col("a")
    what = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.abs(d) < still, "unchanged").when(d > 0, "improved").otherwise("regressed")
    return both.select("feature_id", what.alias("change"), (F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))).alias("delta"))


def mean_delta(diff: DataFrame, with_new: bool = False) -> DataFrame:
    """Mean difference of features on both sides; ``with_new`` also counts those only on the later one."""
    kept = diff.filter(F.col("change") != "removed") if with_new else diff.filter(~F.col("change").isin("new", "removed"))
    return kept.agg(F.coalesce(F.avg("delta"), F.lit(0.0)).alias("mean_delta"), F.count(F.lit(1)).alias("n"))
