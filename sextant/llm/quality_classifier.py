"""Quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on binned statistics of a bounded sample of labelled rows. Every path from a root is a
conjunctive rule; a logistic model with an L1 penalty over all rules keeps a few of them. These are compiled into one
Spark column expression, so that scoring is code generated with the scan of the statistics, and no Python runs.

Statistics are over whole texts; null and empty texts have zeros and are scored like others. Repeated rows, null ids
and other columns than ``f_*`` are kept as they are; without labelled rows the score is 0.5 throughout, with one class only near
that class. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import common, quality_rules
from sextant.llm.language_id import held_out

#: Labelled rows that the model is fitted on at most, those with the smallest hash of the id.
TRAIN_ROWS = 20_000
TREES, DEPTH, BINS, SHRINKAGE, PENALTY, THRESHOLD = 24, 3, 32, 0.3, 1e-3, 0.7

FEATURES = ("words", "word_length", "symbols", "capitals", "letters", "dup_lines", "repeats", "line_words", "distinct", "marks")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one double column per feature, named ``f_`` and the feature; columns of these names are replaced, all
    others are kept."""
    (name,) = common.free(docs, "_stats")
    out = quality_rules.measured(docs, text, name, lambda w, t: {"n_distinct": F.size(F.array_distinct(w)), "n_marks": common.count_matches(t, r"[!?]+")})
    m = F.col(name)
    over = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(0.0)
    values = {
        "words": F.log1p(m["n_words"]), "word_length": over(m["word_chars"], m["n_words"]), "symbols": over(m["n_symbols"], m["n_words"]),
        "capitals": over(m["n_upper"], m["n_letters"]), "letters": over(m["n_letters"], m["word_chars"]), "dup_lines": over(m["n_dup_lines"], m["n_lines"]),
        "repeats": over(m["n_repeat_words"], m["n_words"]), "line_words": over(m["n_words"], m["n_lines"]), "distinct": over(m["n_distinct"], m["n_words"]),
        "marks": over(m["n_marks"], m["n_words"]),
    }
    return out.withColumns({f"f_{k}": values[k] for k in FEATURES}).drop(name)


#: A condition is (feature, above, bound): the feature is over the bound if ``above``, else not.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, bounds: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> tuple[list[Rule], np.ndarray]:
    """All paths of one regression tree on gradients, and its values for the rows."""
    rules: list[Rule] = []
    value = np.zeros(len(g))

    def split(rows: np.ndarray, path: Rule) -> None:
        value[rows] = -g[rows].sum() / (h[rows].sum() + 1.0)
        if path:
            rules.append(path)
        if len(path) >= depth or len(rows) < 20:
            return
        total_g, total_h, best = g[rows].sum(), h[rows].sum(), (1e-6, -1, 0)
        for f, cuts in enumerate(bounds):
            if len(cuts):
                b = binned[rows, f]
                gl = np.cumsum(np.bincount(b, g[rows], len(cuts) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(cuts) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        if best[1] >= 0:
            f, k = best[1:]
            right = binned[rows, f] > k
            if right.any() and not right.all():
                split(rows[~right], (*path, (f, False, float(bounds[f][k]))))
                split(rows[right], (*path, (f, True, float(bounds[f][k]))))

    split(np.arange(len(g)), ())
    return rules, value


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, bound in rule:
        out &= (x[:, f] > bound) == above
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic model, by accelerated proximal gradient."""
    n = len(y)
    a = np.hstack([r, np.ones((n, 1))])
    step = 4.0 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    w = np.zeros(a.shape[1])
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -30, 30)))
        new = z - step * (a.T @ (p - y) / n)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class RuleModel:
    """Rules with their weights, and the intercept."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def column(self) -> Column:
        """The score over the columns of ``statistics`` as one expression."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            cond = F.lit(True)
            for f, above, bound in rule:
                c = F.col(f"f_{FEATURES[f]}") > bound
                cond = cond & (c if above else ~c)
            total = total + F.when(cond, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules as text, heaviest first."""
        say = lambda c: f"{FEATURES[c[0]]} {'>' if c[1] else '<='} {c[2]:.4g}"
        return [f"{w:+.3f} if {' and '.join(map(say, r))}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit_rows(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A model of statistics ``x`` (rows by features) and labels ``y`` (0 or 1)."""
    if not len(y):
        return RuleModel((), 0.0)
    mean = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return RuleModel((), float(np.log(mean / (1 - mean))))
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bounds = [b[b < c.max()] for b, c in zip(bounds, x.T)]
    binned = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(bounds, x.T)], axis=1)
    margin, rules = np.full(len(y), np.log(mean / (1 - mean))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        found, value = grow(x, bounds, binned, p - y, p * (1 - p), DEPTH)
        margin += SHRINKAGE * value
        rules |= dict.fromkeys(tuple(sorted(r)) for r in found)
    names = list(rules)
    if not names:
        return RuleModel((), float(np.log(mean / (1 - mean))))
    w, b = lasso_logistic(np.stack([holds(r, x) for r in names], axis=1).astype(float), y, PENALTY)
    return RuleModel(tuple((r, float(v)) for r, v in zip(names, w) if abs(v) > 1e-3), b)


def fit(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> RuleModel:
    """A model of ``stats`` (_id and features) and ``labels`` (_id, _y). Ids with several labels count with the larger."""
    one = labels.filter(F.col("_y").isNotNull() & F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_y").cast("double").alias("_y"))
    cols = [f"f_{k}" for k in FEATURES]
    # a threshold on the hash leaves about twice the sample, so that the ranking sees few rows of a large table
    n = one.count()
    near = (F.xxhash64("_id").cast("double") / F.lit(2.0**64) + 0.5) * n <= 2.0 * train_rows + 100
    rows = stats.filter(near).join(one.filter(near), "_id").orderBy(F.xxhash64("_id"), "_id", *cols).limit(train_rows).select(*cols, "_y").toPandas().to_numpy(dtype=float)
    return fit_rows(rows[:, :-1], rows[:, -1])


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"), 4, 2))
    stats = common.cut(statistics(docs).drop("text"), "quality-statistics")
    labels = common.documents(spark, sf_dir, "labels").select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y"))
    model = fit(stats.filter(~F.col("held_out")).withColumnRenamed("doc_id", "_id"), labels)
    scored = stats.select("doc_id", "held_out", model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
