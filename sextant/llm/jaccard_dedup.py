"""Near-duplicates by word shingles: pairs whose Jaccard similarity is 0.8 or more, found by fuzzy keys and verified exactly.

A text is the set of its shingles of five words. Equal sets are folded first. The method is that of ``simhash_dedup``, fuzzy
hashing of the segments of a SimHash fingerprint with the Golay code, made for this distance: a similarity of 0.8 means that
15 % of the bits differ, of a segment of 23 bits 3.5, and two segments then share a codeword index of ``golay.nearby`` with
probability 0.60. So the fingerprint has ``BANDS`` segments. An index has 12 bits, too few to tell the texts of a large table
apart, so that each segment's is read together with the least of the shingles in ``ROWS`` orders (one that texts of similarity
s share with probability s). Every candidate shares such an index: two sets of similarity 0.8 have one in common with
probability 0.999998 (0.9999 if they have under ten shingles), and above with more. Minima that no other set has cannot meet,
and are left out before indices are made.
Every candidate is verified on its whole sets, so no pair below the similarity is linked. Before that, candidates
go whose bitmaps of parities (``odd``) differ in more bits than the sets may differ in shingles: the bits never differ in more.

Buckets of up to ``bucket`` sets are verified pair by pair. In larger ones all are first held to the smallest, and then all
pairs that this left in different components are verified, so that a large group of copies is not compared pair by pair.
Links go into connected components; nothing is capped or dropped.

Texts without words have the empty set, which is equal to itself. Texts of fewer than five words are one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import common, golay
from sextant.llm.components import components

SHINGLE, PERCENT, SEED, BUCKET = 5, 80, 42, 12
BANDS, ROWS = 20, 1
#: Words of 64 bits in a bitmap of parities, and in a fingerprint of ``BANDS`` segments.
ODD, WORDS = 8, -(-golay.N * BANDS // 64)
#: Shingles hashed at once: bounds the memory of a long text, fits a core's cache, and a count of them fits a byte.
STEP = 255

_rng = np.random.default_rng(SEED)
_FLIP = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_FACTOR = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_BASE, _MIX, _REMIX = (_rng.integers(0, 1 << 64, 3, dtype=np.uint64) | np.uint64(1))
_WORD = _rng.integers(0, 1 << 64, WORDS, dtype=np.uint64)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The set of a text's shingles as sorted unsigned 64-bit hashes: polynomials of the hashes of their words."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.array([], dtype=np.uint64)
    one = xxhash.xxh64_intdigest
    each = np.array([one(w, SEED) for w in found], dtype=np.uint64)
    width = min(shingle, len(each))
    n = len(each) - width + 1
    out = each[:n].copy()
    for i in range(1, width):
        out = out * _BASE + each[i : i + n]
    out = (out ^ out >> np.uint64(32)) * _MIX
    return np.unique(out ^ out >> np.uint64(29))


def segments(found: np.ndarray) -> np.ndarray:
    """The segments of a set's SimHash fingerprint: of each bit of the remixed hashes, whether over half of them have it."""
    ones = np.zeros(64 * WORDS, dtype=np.int64)
    for at in range(0, len(found), STEP):
        h = (found[at : at + STEP, None] ^ _WORD) * _MIX
        h = (h ^ h >> np.uint64(32)) * _REMIX
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    bits = (ones * 2 > len(found))[: golay.N * BANDS].reshape(BANDS, golay.N)
    return bits @ (1 << np.arange(golay.N, dtype=np.int64))


def minima(found: np.ndarray) -> np.ndarray:
    """One hash of 41 bits a band of the ``ROWS`` minima of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), STEP):
        np.minimum(least, ((found[at : at + STEP, None] ^ _FLIP) * _FACTOR).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) >> golay.N for i, r in enumerate(rows)], dtype=np.int64)


def bands(found: np.ndarray) -> np.ndarray:
    """Per band the minima and, in the last 23 bits, the segment, as signed longs; none of an empty set."""
    return minima(found) << golay.N | segments(found) if len(found) else np.array([], dtype=np.int64)


def fuzzy_keys(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Golay keys of bands, 6 a row, and which of them are there: the minima and a codeword index near the segment."""
    near = golay.nearby(band & ((1 << golay.N) - 1))
    return (band >> golay.N << golay.K)[:, None] | near, near >= 0


def _fuzzy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 20_000):
            part = pdf.iloc[at : at + 20_000]
            key, there = fuzzy_keys(part["band"].to_numpy())
            yield pd.DataFrame({"id": np.repeat(part["id"].to_numpy(), there.sum(axis=1)), "key": key[there]})


def odd(found: np.ndarray) -> np.ndarray:
    """The bits that an odd number of a set's hashes fall on. A shingle that only one of two sets has flips one bit."""
    bits = np.bincount((found >> np.uint64(64 - 9)).astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


_BITS = [f"o{i}" for i in range(ODD)]


def _near(x, y, percent: int) -> Column:
    """What sets of at least this similarity fulfil; ``x`` and ``y`` give the columns n and o0.. of two sets."""
    differ = sum((F.bit_count(x(o).bitwiseXOR(y(o))) for o in _BITS[1:]), F.bit_count(x("o0").bitwiseXOR(y("o0"))))
    sizes = F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * percent
    return sizes & (differ * (100 + percent) <= (x("n") + y("n")) * (100 - percent))


def _sketched(text: Column, shingle: int) -> Column:
    @F.pandas_udf("digest string, bands array<long>, n int, " + ", ".join(f"{o} long" for o in _BITS))
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, shingle) for t in texts]
        return pd.DataFrame({
            "digest": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets],
            "bands": [bands(s) for s in sets],
            "n": np.array([len(s) for s in sets], dtype=np.int32),
            **dict(zip(_BITS, np.array([odd(s) for s in sets], dtype=np.int64).reshape(-1, ODD).T)),
        })

    return sketch(text)


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, tag: str) -> DataFrame:
    """The ``pairs`` (u, v) whose similarity is at least ``percent`` / 100, by the whole sets of ``texts`` (id, text)."""

    @F.pandas_udf("array<long>")
    def whole(column: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle).view(np.int64) for t in column])

    pairs = common.cut(pairs.distinct(), f"{tag}-pairs")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    # written, both sides of the joins are shuffled for them, so that the pairs of a hot text can be split
    sets = common.cut(texts.join(common.cut(wanted, f"{tag}-wanted"), "id", "left_semi").select("id", whole("text").alias("s")), f"{tag}-sets")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    near = both.withColumn("c", shared).filter(F.col("c") * 100 >= (F.size("a") + F.size("b") - F.col("c")) * percent)
    return common.cut(near.select("u", "v"), f"{tag}-links")


def links(sketches: DataFrame, texts: DataFrame, bucket: int = BUCKET, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Links (u, v) between ``sketches`` (id, n, o0.., bands) of distinct sets, complete up to connection."""
    banded = common.cut(sketches.select("id", F.explode("bands").alias("band")).withColumn("least", F.shiftright("band", golay.N)), "jaccard-bands")
    met = common.cut(banded.groupBy("least").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("least"), "jaccard-minima")
    keyed = common.cut(banded.join(met, "least").select("id", "band").mapInPandas(_fuzzy, "id long, key long"), "jaccard-keys")
    sizes = common.cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "jaccard-sizes")
    shared = common.cut(keyed.join(sizes, "key"), "jaccard-shared")
    shared = common.cut(shared.join(sketches.drop("bands"), "id"), "jaccard-buckets")
    field = lambda e: lambda c: e[c]
    few = shared.filter(F.col("size") <= bucket).groupBy("key").agg(F.collect_list(F.struct("id", "n", *_BITS)).alias("m"))
    pair = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: (y["id"] < x["id"]) & _near(field(x), field(y), percent)), lambda y: F.struct(x["id"].alias("u"), y["id"].alias("v")))))
    pairs = few.select(F.explode(pair).alias("e")).select("e.u", "e.v")
    many = shared.filter(F.col("size") > bucket).select("key", "id", "n", *_BITS)
    if common.is_empty(many):
        return _verified(pairs, texts, shingle, percent, "jaccard-few")
    first = common.cut(many.groupBy("key").agg(F.min(F.struct("id", "n", *_BITS)).alias("first")), "jaccard-first")
    stars = many.join(first, "key").filter((F.col("id") != F.col("first.id")) & _near(F.col, field(F.col("first")), percent))
    found = _verified(pairs.unionByName(stars.select(F.col("id").alias("u"), F.col("first.id").alias("v"))), texts, shingle, percent, "jaccard-few")
    roots = common.cut(components(found, "jaccard-first-links").withColumnRenamed("node", "id"), "jaccard-first-roots")
    placed = common.cut(many.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "jaccard-placed")
    split = common.cut(placed.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key"), "jaccard-split")
    left = common.cut(placed.join(split, "key", "left_semi"), "jaccard-left")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    across = left.alias("x").join(left.alias("y"), (x("key") == y("key")) & (x("root") < y("root")) & _near(x, y, percent))
    across = across.select(F.greatest(x("id"), y("id")).alias("u"), F.least(x("id"), y("id")).alias("v"))
    return found.unionByName(_verified(across, texts, shingle, percent, "jaccard-across"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest id, among rows of one id that
    with the smallest hash of the text, null ids last. Null texts are empty; an empty table gives an empty result. All
    columns are returned, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.monotonically_increasing_id().alias("_row_id"))
    base = common.cut(packed, "jaccard-rows")
    flat = base.select(F.col("_row_id").alias("id"), F.col(f"_doc.`{id_col}`").alias("own"), F.col(f"_doc.`{text_col}`").alias("text"))
    order = F.struct(F.col("own").isNull().alias("none"), F.col("own").alias("own"), F.xxhash64("text").alias("hash"), F.col("id").alias("row"))
    slim = common.cut(flat.select("id", order.alias("order"), _sketched(F.col("text"), shingle).alias("s")).select("id", "order", "s.*"), "jaccard-docs")
    sets = common.cut(slim.groupBy("digest").agg(F.min("id").alias("id"), F.min("order").alias("least"), *[F.first(c).alias(c) for c in ("bands", "n", *_BITS)]).drop("digest"), "jaccard-distinct")
    found = links(sets.drop("least"), flat.select("id", "text"), bucket, shingle, percent)
    roots = common.cut(components(found, "jaccard-links").withColumnRenamed("node", "id"), "jaccard-roots")
    placed = common.cut(sets.select("id", "least").join(roots, "id", "left").select("least", F.coalesce("root", "id").alias("root")), "jaccard-members")
    kept = placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("_row_id"))
    return base.join(kept.hint("merge"), "_row_id", "left_semi").select("_doc.*")  # grows with the input: never broadcast
