"""Chat formatting on token level.

A turn is ``### Role: text </turn>`` and a line end. Role and text are encoded by themselves, and the marks between
are reserved ids above the vocabulary, so no text can make a mark. Inside roles and texts the strings that look like
marks are escaped with a backslash that splits them, and the backslash itself is doubled; ``unescape`` undoes it.
The loss mask is the prefix sum of +1 and -1 at the ends of the texts that count; offsets of the turns in their
conversation are prefix sums of lengths.

Turns are sorted by ranges of (conversation, turn, role, text), nulls first, and encoded there; null roles and texts are
empty. Numbers and offsets run inside a range, and what ranges before hold of the same conversation is added: each range
goes on with one conversation at most, so that is a row per range. A conversation of any size is thus split over tasks. The
output has a row per turn. Reading back decodes turns where they lie; only the digests, which SHA-256 lets nobody split,
pass through a conversation in order, one turn at a time. Null conversation ids are one conversation; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm import common
from sextant.llm.tokens import VOCABULARY, Encoder

#: Reserved ids, above the 50,257 of the vocabulary, and what they stand for in the text.
ROLE, TEXT, END = 50257, 50258, 50259
MARKS = {ROLE: "### ", TEXT: ": ", END: " </turn>\n"}
LOSS_ROLE = "assistant"

_CONTROL = re.compile(r"\\|#{3,}|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """``text`` without three number signs in a row and without the end mark, reversibly."""
    return _CONTROL.sub(lambda m: "<\\/turn>" if m[0][0] == "<" else "".join("\\" + c for c in m[0]), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def encode_turn(encode: Encoder, role: str, text: str, loss: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids of one turn and its loss mask."""
    head, body = encode(escape(role)), encode(escape(text))
    ids = np.concatenate([[ROLE], head, [TEXT], body, [END]]).astype("<u4")
    steps = np.zeros(len(ids) + 1, dtype=np.int64)
    begin = len(head) + 2
    steps[begin] += loss
    steps[begin + len(body)] -= loss
    return ids, np.cumsum(steps)[:-1].astype(np.uint8)


def split_turn(encode: Encoder, ids: np.ndarray) -> tuple[str, str, str]:
    """Role, text and formatted string of one turn's ids."""
    role_end, text_end = int(np.flatnonzero(ids == TEXT)[0]), len(ids) - 1
    if ids[0] != ROLE or ids[text_end] != END:
        raise ValueError("not a turn")
    role = encode.decode(ids[1:role_end]).decode("utf-8")
    text = encode.decode(ids[role_end + 1 : text_end]).decode("utf-8")
    return unescape(role), unescape(text), MARKS[ROLE] + role + MARKS[TEXT] + text + MARKS[END]


def format_conversations(rows: DataFrame, loss_role: str = LOSS_ROLE, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per turn of ``rows`` (conv_id, turn, role, text): conv_id, turn_no (from 0), offset (ids before it in its
    conversation), ids (little-endian unsigned 32-bit) and mask (a byte per id, 1 under the loss)."""

    order = ["conv_id", "turn", "role", "text"]

    def turns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocabulary, special=False)
        conv, nth, at = object(), 0, 0  # nothing equals the first
        for pdf in batches:
            for begin in range(0, len(pdf), 1000):
                part, out = pdf.iloc[begin : begin + 1000], []
                for c, p, r, t in zip(part["conv_id"], part["part"], part["role"], part["text"]):
                    c = None if pd.isna(c) else int(c)
                    if c != conv:
                        conv, nth, at = c, 0, 0
                    ids, mask = encode_turn(encode, r or "", t or "", r == loss_role)
                    out.append((c, p, nth, at, ids.tobytes(), mask.tobytes()))
                    nth, at = nth + 1, at + len(ids)
                yield pd.DataFrame(out, columns=["conv_id", "part", "nth", "at", "ids", "mask"]).astype({"conv_id": "Int64"})

    slim = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ranges = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    encoded = common.cut(ranges.mapInPandas(turns, "conv_id long, part int, nth long, at long, ids binary, mask binary"), "chat-encoded")
    held = encoded.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("mask").cast("long")).alias("size"))
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.sum("n").over(w).alias("turns_before"), F.sum("size").over(w).alias("ids_before")).filter("turns_before > 0")
    # a row per range of the sort at most
    out = encoded.join(F.broadcast(before), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    total = lambda own, more: (F.col(own) + F.coalesce(F.col(more), F.lit(0))).cast("long")
    return out.select("conv_id", total("nth", "turns_before").alias("turn_no"), total("at", "ids_before").alias("offset"), "ids", "mask")


def read_conversations(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Digests of each conversation read back from the ids and masks: conv_id, n_turns, turns_sha256 (role, line end,
    text, line end per turn), loss_chars and loss_sha256 (all text under the mask), formatted_chars."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [x.split()[0] for x in schema.split(", ")]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocabulary, special=False)
        for pdf in batches:
            for begin in range(0, len(pdf), 1000):
                part, out = pdf.iloc[begin : begin + 1000], []
                for conv, turn_no, raw, mask in zip(part["conv_id"], part["turn_no"], part["ids"], part["mask"]):
                    ids = np.frombuffer(raw, dtype="<u4")
                    role, text, formatted = split_turn(encode, ids)
                    under = ids[np.frombuffer(mask, dtype=np.uint8) == 1]
                    loss = unescape(encode.decode(under).decode("utf-8"))
                    out.append((conv, turn_no, role, text, None if loss == text else loss, len(formatted)))
                yield pd.DataFrame(out, columns=["conv_id", "turn_no", "role", "text", "other_loss", "chars"]).astype({"conv_id": "Int64"})

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []

        def done() -> None:
            if state:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for pdf in batches:
            for conv, turn_no, role, text, other, chars in zip(pdf["conv_id"], pdf["turn_no"], pdf["role"], pdf["text"], pdf["other_loss"], pdf["chars"]):
                if turn_no == 0:
                    done()
                    now, state = None if pd.isna(conv) else int(conv), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                loss = text if other is None else other
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += chars
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
            out = []
        done()
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    plain = turns.select("conv_id", "turn_no", "ids", "mask").mapInPandas(decode, "conv_id long, turn_no long, role string, text string, other_loss string, chars long")
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInPandas(digest, schema)


def query(spark, sf_dir: str) -> DataFrame:
    odd = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    common.ship(spark)
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_conversations(format_conversations(rows.unionByName(extra)))
