"""SimHash near-duplicates, found by fuzzy hashing with the Golay code.

Fingerprints of 64 bits are cut into three segments (23, 23 and 18 bits). If two fingerprints differ in at most
2 bits, one of the three segments is equal in both, and the next one differs in at most 2 bits, so that it shares
a codeword index of ``golay.nearby``. Keys are (segment, its bits, index of the next): 18 at most per fingerprint,
35 bits wide. Equal fingerprints are folded first. Buckets of up to ``bucket`` fingerprints are verified pair by
pair. For larger ones the same links are found without pairs: two fingerprints differ in at most 2 bits exactly if
some word is within one flip of both, and such a word has at most 65 fingerprints around it, which are linked to
the smallest. Links go into connected components; nothing is capped or dropped.

Null and empty texts, and texts without words, have the fingerprint zero and are linked like any other. Rows are
never merged: repeated rows, ties and null ids are kept. The component id is the smallest non-null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import common, golay
from sextant.llm.components import components

SHINGLE, SEED, DISTANCE, BUCKET = 3, 42, 2, 48
#: First bit and width of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    parts = [found[i:] for i in range(shingle)] if len(found) >= shingle else None
    one = xxhash.xxh64_intdigest
    return majority(np.array([one(b" ".join(z), seed) for z in zip(*parts)] if parts else [one(b" ".join(found), seed)], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """The word of the bits that over half of the 64-bit ``hashes`` have; 0 of none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        h = np.ascontiguousarray(hashes[at : at + (1 << 14)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint in ``_fp`` as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn("_fp", simhash(F.col(text)))


def golay_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned 64-bit fingerprints, 18 a row, and which of them are there."""
    parts = [((bits >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    near = [golay.nearby(parts[(i + 1) % len(parts)]) for i in range(len(parts))]
    key = [(np.int64(i) << 35) | (exact[:, None] << 12) | near[i] for i, exact in enumerate(parts)]
    return np.hstack(key), np.hstack(near) >= 0


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 20_000):
            fps = pdf["_fp"].to_numpy()[at : at + 20_000]
            key, there = golay_keys(fps.view(np.uint64))
            yield pd.DataFrame({"key": key[there], "_fp": np.repeat(fps, there.sum(axis=1))})


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) between the distinct fingerprints of ``fps`` (_fp), complete up to connection."""
    keyed = common.cut(fps.mapInPandas(_keys, "key long, _fp long"), "simhash-keys")
    # written, both sides of the join are shuffled for it, so that a hot key can be split
    sizes = common.cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-sizes")
    shared = common.cut(keyed.join(sizes, "key"), "simhash-buckets")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= DISTANCE
    few = shared.filter(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("_fp").alias("m"))
    pair = F.flatten(F.transform("m", lambda u: F.transform(F.filter("m", lambda v: (v < u) & near(u, v)), lambda v: F.struct(u.alias("u"), v.alias("v")))))
    verified = few.select(F.explode(pair).alias("e")).select("e.u", "e.v")
    many = shared.filter(F.col("n") > bucket).select("_fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    around = many.select("_fp", F.explode(flips).alias("flip")).select("_fp", F.col("_fp").bitwiseXOR(F.col("flip")).alias("word"))
    meet = around.groupBy("word").agg(F.min("_fp").alias("v"), F.collect_list("_fp").alias("m")).filter(F.size("m") > 1)
    stars = meet.select(F.explode("m").alias("u"), "v").filter("u <> v")
    return verified.unionByName(stars).distinct()


def classes(slim: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Component of each fingerprint: (_fp, component_id) from ``slim`` (_id, _fp)."""
    fps = common.cut(slim.groupBy("_fp").agg(F.min("_id").alias("least")), "simhash-distinct")
    roots = common.cut(components(links(fps.select("_fp"), bucket), "simhash-links"), "simhash-roots")
    linked = fps.join(roots.withColumnRenamed("node", "_fp"), "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    linked = common.cut(linked, "simhash-members")
    least = common.cut(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    return linked.join(least, "root").select("_fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """Per row its id, ``fingerprint`` (16 hex digits) and ``component_id``; an empty table gives an empty result."""
    slim = fingerprints(docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("text"))).drop("text")
    slim = common.cut(slim, "simhash-docs")
    out = slim.join(classes(slim, bucket), "_fp")
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id, among rows of one id that
    with the smallest hash of the text, null ids last. All columns are returned, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row_id"))
    base = common.cut(packed, "simhash-rows")
    flat = base.select("_row_id", F.col(f"_doc.`{id_col}`").alias("_own"), F.col(f"_doc.`{text_col}`").alias("text"))
    slim = common.cut(fingerprints(flat).withColumn("_hash", F.xxhash64("text")).drop("text"), "simhash-docs")
    order = F.struct(F.col("_own").isNull().alias("none"), F.col("_own").alias("own"), F.col("_hash").alias("hash"), F.col("_row_id").alias("row"))
    slim = slim.select("_fp", order.alias("_id"))
    kept = classes(slim, bucket).select(F.col("component_id.row").alias("_row_id")).distinct()
    return base.join(kept.hint("merge"), "_row_id", "left_semi").select("_doc.*")  # grows with the input: never broadcast


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
