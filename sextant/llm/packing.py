"""Best-fit packing by minimum bin slack.

Only lengths matter for a plan, so it is made from the histogram of lengths: at most ``capacity`` numbers, whatever
the input. For each bin the longest length left goes in, then a bitset subset-sum over the lengths left finds the
fullest combination for the rest. That combination stays the fullest feasible one until one of its lengths runs
short, so it is repeated that often at once, and removed; every step runs a length short, so there are few steps.

Documents are then numbered within their length by one global range sort of slim rows, and a step's share of each
length is a range of these numbers: a binary search in the plan gives sequence and offset. Nothing is gathered in
one task, and a length that a third of all pieces share is spread over many ranges.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import common
from sextant.llm.tokens import VOCABULARY, Encoder

CAPACITY, END_ID = 1024, 2


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths (with repeats, no more than ``counts``) of the largest sum up to ``room``; longer lengths first."""
    reach, steps = 1, []  # bit s of reach: some choice sums up to s
    limit = (1 << (room + 1)) - 1
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        n, chunk = min(counts[length], room // length), 1
        while n:  # chunks of 1, 2, 4, ... give every number up to n
            take = min(chunk, n)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & limit
            n, chunk = n - take, chunk * 2
        if reach >> room & 1:
            break
    out, at = [], reach.bit_length() - 1
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Steps (repeats, lengths of one bin) that use up the histogram ``lengths``."""
    left, out = Counter({x: n for x, n in lengths.items() if n}), []
    while left:
        seed = max(left)
        left[seed] -= 1
        combo = [seed, *fullest(left, capacity - seed)]
        left[seed] += 1
        need = Counter(combo)
        times = min(left[x] // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        left += Counter()
        out.append((times, combo))
    return out


def layout(steps: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first, end, per_bin, sequence, offset, step): items ``first`` to ``end - 1`` of a length go, ``per_bin`` in
    each, to the bins from ``sequence`` on; the items of a bin lie one after another from ``offset``."""
    used, out, sequence = Counter(), [], 0
    for k, (times, combo) in enumerate(steps):
        offset = 0
        for length, n in sorted(Counter(combo).items(), reverse=True):
            out.append((length, used[length], used[length] + n * times, n, sequence, offset, k))
            used[length] += n * times
            offset += n * length
        sequence += times
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """``items`` with ``_length`` (1 to ``capacity``) gets ``sequence_id`` and ``offset``, both long.

    ``order`` names columns that tell items of one length apart, for a plan that does not depend on the read order;
    ties are broken by place. An empty table gives an empty result.
    """
    spark = items.sparkSession
    at, _ = common.indexed(items, "_length", *order, tag="pack-items")
    hist = {r["_length"]: r["n"] for r in at.groupBy("_length").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, run = {}, 0
    for x in sorted(hist):
        starts[x] = run
        run += hist[x]
    # ranges of the global numbers, one after another: a step's share of a length
    ranges = np.array(sorted((starts[x] + a, n, s, o, x) for x, a, _, n, s, o, _ in layout(plan(hist, capacity))), dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(ranges)  # a few rows per step and length, whatever the input

    @F.pandas_udf("sequence_id long, offset long")
    def place(at: pd.Series) -> pd.DataFrame:
        table, at = shared.value, at.to_numpy()
        first, per, sequence, offset, length = table[np.searchsorted(table[:, 0], at, side="right") - 1].T
        k = at - first
        return pd.DataFrame({"sequence_id": sequence + k // per, "offset": offset + k % per * length})

    return at.withColumn("_to", place("_at")).select("*", "_to.*").drop("_at", "_to")


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts: doc_id, piece, start, length, ids_crc32, and the ids with ``with_ids``.

    A document is its ids and ``end_id``; a longer one than ``capacity`` is cut into pieces of ``capacity``, of which
    the first takes the remainder. Null text is empty: one piece that holds ``end_id`` alone.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocabulary)
        for pdf in batches:
            for lo in range(0, len(pdf), 2000):
                out = []
                for doc_id, text in zip(pdf["doc_id"][lo : lo + 2000], pdf["text"][lo : lo + 2000]):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    ends = range(len(ids) % capacity or capacity, len(ids) + 1, capacity)
                    for k, end in enumerate(ends):
                        start = max(0, end - capacity)
                        raw = ids[start:end].tobytes() if k else ids[:end].tobytes()
                        out.append((doc_id, k, start, len(raw) // 4, zlib.crc32(raw), *([raw] if with_ids else [])))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """``pieces`` of ``docs`` with ``sequence_id`` and ``offset``. Full pieces have a sequence each, without a plan.

    Repeated rows are packed as often as they come; null ids are kept. Other columns are ignored.
    """
    cut = common.cut(pieces(docs, capacity, end_id, vocabulary, with_ids).withColumn("_full_id", F.monotonically_increasing_id()), "pack-pieces")
    part = pack(cut.filter(F.col("length") < capacity).withColumn("_length", F.col("length").cast("int")).drop("_full_id"), capacity, ("doc_id", "piece", "ids_crc32"))
    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("_full_id")).withColumn("offset", F.lit(0).cast("long"))
    own = [c for c in cut.columns if c != "_full_id"]
    return part.select(*own, "sequence_id", F.col("offset").cast("long").alias("offset")).unionByName(full.select(*own, "sequence_id", "offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences from pieces ``with_ids``: sequence_id, ids (little-endian unsigned 32-bit) and the pieces' starts."""
    p = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(p.alias("p")).select(
        "sequence_id", F.concat(F.lit(b""), F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))).alias("ids"), F.col("p.offset").alias("starts"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
