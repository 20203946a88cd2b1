"""Media columns: MPEG transport streams.

A payload is cut into access units, each one packetized elementary stream packet with a presentation time stamp.
These go into transport packets of 188 bytes with continuity counters; program tables precede every random-access
point, whose packet carries a clock reference. ``demux`` reads a stream from its bytes alone: it parses the program
tables (and their CRC) to find the stream, checks continuity, reassembles the packets and returns the payload, the
time stamps and the random-access points.

Work is per row, without a shuffle. Null texts are empty payloads, reading a null stream gives nulls; an empty table gives an
empty result. Repeated rows, null ids and texts of any length are taken as they are; ``features`` replaces a column ``_read``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm import common

PACKET, UNIT = 188, 576
PAT_PID, PMT_PID, STREAM_PID, STREAM_TYPE, STREAM_ID = 0x0000, 0x1000, 0x0100, 0x06, 0xBD
#: Payload units in an access unit, ticks of 90 kHz from one to the next, and access units from one random-access point to the next.
UNITS, TICKS, GROUP = 8, 3600, 12


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        c = byte << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = (c << 8) & 0xFFFFFFFF ^ _CRC[c >> 24 ^ x]
    return c


def _section(table: int, extension: int, body: bytes) -> bytes:
    n = len(body) + 9
    head = bytes([table, 0xB0 | n >> 8, n & 0xFF]) + extension.to_bytes(2, "big") + bytes([0xC1, 0, 0]) + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return bytes([0x47, 0x40 | pid >> 8, pid & 0xFF]) + b"\x10" + (b"\0" + section).ljust(PACKET - 4, b"\xff")


_PAT = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, 1, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"))
_HEADS = [bytes([0x47, STREAM_PID >> 8, STREAM_PID & 0xFF, 0x10 | c]) for c in range(16)]


def _stamp(pts: int) -> bytes:
    pts &= (1 << 33) - 1
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def _clock(pcr: int) -> bytes:
    pcr &= (1 << 33) - 1
    return (pcr << 15 | 0x3F << 9).to_bytes(6, "big")


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """``data`` and bytes 255 up to a positive multiple of ``unit``."""
    return data + b"\xff" * (max(1, -(-len(data) // unit)) * unit - len(data))


def mux(payload: bytes) -> bytes:
    """A transport stream of a payload."""
    out, cc, tables, step = [], 0, 0, UNIT * UNITS
    for k in range(max(1, -(-len(payload) // step))):
        unit = payload[k * step : (k + 1) * step]
        pes = b"\0\0\1" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(k * TICKS) + unit
        field = b""
        if k % GROUP == 0:  # a random-access point
            for table in (_PAT, _PMT):
                out += [table[:3], bytes([0x10 | tables]), table[4:]]
            tables = (tables + 1) & 15
            field = b"\x07\x50" + _clock(k * TICKS)
        at, first = 0, True
        while at < len(pes):
            room, head, rest = PACKET - 4 - len(field), _HEADS[cc], len(pes) - at
            if rest < room:  # fill the packet with stuffing in the adaptation field
                gap = room - rest
                field = bytes([len(field) - 1 + gap]) + field[1:] + b"\xff" * gap if field else bytes([gap - 1]) + (b"\0" + b"\xff" * (gap - 2) if gap > 1 else b"")
                room = rest
            if first or field:
                head = bytes([0x47, head[1] | 0x40 * first, head[2], (0x30 if field else 0x10) | cc])
            out += [head, field, pes[at : at + room]]
            at, cc, first, field = at + room, (cc + 1) & 15, False, b""
    return b"".join(out)


def _sections(packets: list[bytes]) -> bytes:
    data = b"".join(packets)
    section = data[1 + data[0] :]
    section = section[: 3 + ((section[1] & 0x0F) << 8 | section[2])]
    if crc32_mpeg(section):
        raise ValueError("a program table fails its CRC")
    return section


def demux(stream: bytes) -> dict:
    """Payload, time stamps, random-access points (access unit numbers) and errors of a transport stream."""
    if len(stream) % PACKET:
        raise ValueError("not whole transport packets")
    pmt_pid = pid_wanted = None
    last: dict[int, int] = {}
    units: list[list[bytes]] = []
    access, clocks, errors, packets = [], [], 0, len(stream) // PACKET
    for at in range(0, len(stream), PACKET):
        b1, b3 = stream[at + 1], stream[at + 3]
        if stream[at] != 0x47:
            raise ValueError(f"no sync byte at {at}")
        pid, cc, start = (b1 & 0x1F) << 8 | stream[at + 2], b3 & 15, b1 & 0x40
        begin, random = at + 4, False
        if b3 & 0x20:
            size = stream[at + 4]
            flags = stream[at + 5] if size else 0
            random = bool(flags & 0x40)
            if flags & 0x10:
                clocks.append(int.from_bytes(stream[at + 6 : at + 12], "big") >> 15)
            begin += 1 + size
        if b3 & 0x10:
            if pid in last and cc != (last[pid] + 1) & 15:
                errors += 1
            last[pid] = cc
        if pid == pid_wanted:
            if start:
                if random:
                    access.append(len(units))
                units.append([])
            if units:
                units[-1].append(stream[begin : at + PACKET])
        elif pid == PAT_PID:
            pat = _sections([stream[begin : at + PACKET]])
            programs = [(int.from_bytes(pat[i : i + 2], "big"), int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF) for i in range(8, len(pat) - 4, 4)]
            pmt_pid = next(p for n, p in programs if n)
        elif pid == pmt_pid:
            pmt = _sections([stream[begin : at + PACKET]])
            i = 12 + ((pmt[10] & 0x0F) << 8 | pmt[11])
            pid_wanted = int.from_bytes(pmt[i + 1 : i + 3], "big") & 0x1FFF
    payload, stamps = [], []
    for unit in units:
        pes = b"".join(unit)
        length = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\0\0\1" or len(pes) != 6 + length:
            errors += 1
            continue
        p = pes[9:14]
        stamps.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        payload.append(pes[9 + pes[8] :])
    return {"payload": b"".join(payload), "stamps": stamps, "access": access, "clocks": clocks, "errors": errors, "packets": packets}


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, ``n_bytes`` of the text (null: empty) and ``media``, the transport stream of its padded payload."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 500):
                part = pdf.iloc[at : at + 500]
                data = [(t or "").encode("utf-8", "replace") for t in part["text"]]
                yield pd.DataFrame({id_col: part["id"].astype("Int64"), "n_bytes": [len(x) for x in data], "media": [mux(padded(x)) for x in data]})

    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return slim.mapInPandas(rows, f"{id_col} long, n_bytes long, media binary")


def features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``_read``: payload, stamps, access, clocks, errors and packets read back from the stored streams."""
    kind = "payload binary, stamps array<long>, access array<int>, clocks array<long>, errors int, packets int"

    @F.pandas_udf(kind)
    def read(streams: pd.Series) -> pd.DataFrame:
        columns = ["payload", "stamps", "access", "clocks", "errors", "packets"]
        out = pd.DataFrame([dict.fromkeys(columns) if x is None else demux(x) for x in streams], columns=columns, dtype=object)
        return out.astype({"errors": "Int32", "packets": "Int32"})

    return df.withColumn("_read", read(F.col(media_col)))


def query(spark, sf_dir: str) -> DataFrame:
    media = stored(common.documents(spark, sf_dir))
    r = lambda x: F.col(f"_read.{x}")
    payload = r("payload")
    last = F.lit(0).cast("long") + F.coalesce(F.element_at(r("stamps"), -1), F.lit(0))
    parts = {"packets": r("packets"), "units": F.size(r("stamps")), "access": F.size(r("access")), "last_pts": last, "errors": r("errors")}
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])
    return features(media).select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), r("access").alias("random_access"),
        F.transform(r("access"), lambda k: F.get(r("stamps"), k)).alias("access_pts"),
    )
