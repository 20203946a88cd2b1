"""Language identification by nearest centroid.

A text is a vector of hashed byte trigrams of its lower-cased letters, weighted by log term frequency and inverse
document frequency, and normalised. Each language has several centroids, found by spherical k-means in a bounded
sample of its texts; a text goes to the language of the centroid with the largest cosine. A text nearer to none
than ``reject`` of the training sample is told as rejected.

Document frequencies are counted over all training rows, as one vector per task that is summed per dimension.
The sample has at most ``SAMPLE`` texts per language, chosen by a hash of id and text, whatever the input; only its
sparse vectors reach the driver. The model has a fixed number of dimensions, so it is small, whatever the input.

Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing was learned. Training rows
with null language or text are left out; ids may be null or repeat, ties in the sample are rows equal in id and text.
Repeated rows are predicted alike, texts of any length as a whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm import common

BITS = 14
DIM = 1 << BITS
#: Texts per language that centroids are fitted on, centroids per language, and the share of these texts that may be rejected.
SAMPLE, CENTROIDS, REJECT = 400, 4, 0.005
UNKNOWN = "und"
#: Up to so many languages the thresholds of the sample are broadcast.
LANGUAGES = 10_000

#: ASCII characters but letters become spaces; bytes above 127 are parts of letters mostly.
_TABLE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and log-scaled frequencies of one whole text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_TABLE).split()) + b" "
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    n = np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=DIM)
    at = np.flatnonzero(n)
    return at.astype(np.int32), (1 + np.log(n[at])).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Texts that have each dimension, and texts, over all rows."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIM, dtype=np.int64), 0
        for pdf in batches:
            for text in pdf[text_col]:
                at, _ = counts(text)
                total[at] += 1
                n += 1
        dims = np.flatnonzero(total)
        yield pd.DataFrame({"dim": np.append(dims, -1).astype(np.int32), "n": np.append(total[dims], n)})

    rows = docs.select(text_col).filter(F.col(text_col).isNotNull()).mapInPandas(tally, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(DIM, dtype=np.int64), 0
    for dim, c in rows:  # at most one row per dimension
        if dim < 0:
            n = c
        else:
            df[dim] = c
    return df, n


def sample(docs: DataFrame, per_lang: int = SAMPLE) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Sparse counts of up to ``per_lang`` texts per language, those with the smallest hash of id and text.

    Counts of a logarithmic scale of the hash, a bounded number per language, give a threshold that at least ``per_lang``
    texts of the language are under (all, if it has fewer), and not many more, so that the ranking sees few rows.
    """
    # the hash is of id and text, as ids may be null or repeat; log2 of it as a fraction of all hashes, in sixteenths
    h = F.xxhash64(F.col("_id"), F.col("text"), F.lit(7))
    step = F.floor(F.log2(F.greatest(h.cast("double") / F.lit(2.0**64) + 0.5, F.lit(2.0**-64))) * 16).cast("int")
    upto = F.sum("n").over(Window.partitionBy("_lang").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1))
    steps = docs.groupBy("_lang", step.alias("_step")).agg(F.count(F.lit(1)).alias("n"))
    last = steps.withColumn("_below", F.coalesce(upto, F.lit(0))).filter(F.col("_below") < per_lang).groupBy("_lang").agg(F.max("_step").alias("_last"))
    last = common.cut(last, "language-last")
    # a row per language: checked, and beyond that joined by shuffling
    few = docs.join(F.broadcast(last) if last.count() <= LANGUAGES else last, "_lang").filter(step <= F.col("_last")).drop("_last")
    ranked = few.withColumn("_h", h).withColumn("_k", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id", "text"))).filter(F.col("_k") <= per_lang)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [counts(t) for t in pdf["text"]]
            yield pd.DataFrame({"lang": pdf["_lang"], "at": [a.tobytes() for a, _ in both], "v": [v.tobytes() for _, v in both]})

    rows = ranked.select("_lang", "text", "_k").orderBy("_lang", "_k").select("_lang", "text").mapInPandas(vectors, "lang string, at binary, v binary").collect()
    return [(r["lang"], np.frombuffer(r["at"], dtype=np.int32), np.frombuffer(r["v"], dtype=np.float32)) for r in rows]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means, started from far-apart vectors."""
    picks = [0]
    while len(picks) < min(k, len(x)):
        picks.append(int(np.argmin((x @ x[picks].T).max(axis=1))))
    c = x[picks]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c.astype(np.float32)


class Model:
    """Languages, their centroids and the weights of the dimensions."""

    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, threshold: float):
        self.idf, self.langs, self.centroids, self.threshold = idf, langs, centroids, threshold

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        langs, scores, rejected = [], [], []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            x = np.zeros((len(part), DIM), dtype=np.float32)
            for i, t in enumerate(part):
                dims, v = counts(t or "")
                x[i, dims] = v * self.idf[dims]
            cos = _unit(x) @ self.centroids.T if self.langs else np.zeros((len(part), 0))
            for t, row in zip(part, cos):
                known = len(row) > 0 and has_letter(t)
                best = int(row.argmax()) if known else -1
                score = float(min(1.0, max(0.0, row[best]))) if known else 0.0
                langs.append(self.langs[best] if known else UNKNOWN)
                scores.append(score)
                rejected.append(score < self.threshold)
        return langs, scores, rejected


def fit(docs: DataFrame, per_lang: int = SAMPLE, k: int = CENTROIDS, reject: float = REJECT) -> Model:
    """A model of ``docs`` (_id, _lang, text), rows with null language or text left out."""
    docs = docs.filter(F.col("_lang").isNotNull() & F.col("text").isNotNull())
    df, n = document_frequencies(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    by: dict[str, list] = {}
    for lang, at, v in sample(docs, per_lang):
        x = np.zeros(DIM, dtype=np.float32)
        x[at] = v * idf[at]
        if len(at):
            by.setdefault(lang, []).append(x)
    langs, centroids, own = [], [], []
    for lang in sorted(by):
        x = _unit(np.stack(by[lang]))
        c = cluster(x, k)
        langs += [lang] * len(c)
        centroids.append(c)
        own.append((x @ c.T).max(axis=1))
    threshold = float(np.quantile(np.concatenate(own), reject)) if own else 0.0
    return Model(idf, langs, np.concatenate(centroids) if centroids else np.zeros((0, DIM), dtype=np.float32), threshold)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_p``: lang_pred, score (the cosine) and rejected. Null texts and texts without a letter are ``und``.
    A column ``_p`` before is replaced, all others are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(texts: pd.Series) -> pd.DataFrame:
        langs, scores, rejected = shared.value.predict(list(texts))
        return pd.DataFrame({"lang_pred": langs, "score": scores, "rejected": rejected})

    return docs.withColumn("_p", nearest(F.col(text_col)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether CRC-32 of the id as text falls in ``fold``; a null id counts as empty text."""
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % folds) == fold


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id"), 5, 0))
    model = fit(docs.filter(~F.col("held_out")).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "text"))
    return predict(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "_p.lang_pred", "_p.score", "_p.rejected")
