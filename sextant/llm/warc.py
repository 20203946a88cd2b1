"""WARC archives with revisit records.

Only headers are shuffled: page id, url, size, payload digest and address (file and place in it) of each row. Of the
rows with one payload, that with the smallest id is the response and the others revisit it; among rows that repeat
this id, the first by address. Revisit records are made from their headers alone. Payloads are read where they lie: a bit
per row says which are revisits, the bitmaps of 32,768 rows each are broadcast for so many files at a time that they stay under
``GROUP_BITMAPS`` times 4 KB, and the rows that are left become responses without a shuffle.

Records are written by Spark's text writer, whose line separator is the two line ends that close a WARC record, so its
committed part files are gzipped archives, wherever the shared folder lies. A file of responses holds no more than one
split of the input. Reading streams through each archive by Content-Length, takes payloads and digests from the bytes, and
joins revisits to their responses by record id.

A payload in a third of all pages has one original, joined to headers only. Null html is an empty payload, a null or odd
url gets an escaped one, null ids come after all others. Record ids are unique: they cover the address. An empty table
writes no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import common

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 4000
#: Rows of a bitmap, as Spark's bitmap aggregates have it.
BITMAP_ROWS = 8 * 4096
#: Bitmaps broadcast at once: 32 MB, or 268 million rows. More take one write for each group of files.
GROUP_BITMAPS = 8192


def base32_of_hex(digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: five hexadecimal digits are four letters."""
    def letters(i: Column) -> Column:
        bits = F.conv(F.substring(digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        letter = lambda shift: F.substring(F.lit(BASE32), F.call_function("shiftright", bits, F.lit(shift)).bitwiseAND(31) + 1, F.lit(1))
        return F.concat(*[letter(s) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def headers(pages: DataFrame, file: str, row: str, with_html: bool = False) -> DataFrame:
    """Per row of ``pages``: _page, _url, _bytes, _digest, its address _file and _row, given by two columns, and _html if asked for."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").alias("_page"), F.col("url").alias("_url"), F.octet_length(html).cast("long").alias("_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("_digest"),
        F.col(file).alias("_file"), F.col(row).alias("_row"), *[html.alias("_html") for _ in range(with_html)])


def revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Headers that revisit another's payload, with that one as ``_first``: (no id, id, file, row)."""
    equal = heads.filter(F.col("_bytes") >= min_bytes)
    address = F.struct(F.col("_page").isNull().alias("none"), F.col("_page").alias("page"), F.col("_file").alias("file"), F.col("_row").alias("row"))
    first = equal.groupBy("_digest").agg(F.min(address).alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    first = common.cut(first, "warc-first")  # written, both sides of the join are shuffled for it, so that a hot payload can be split
    return equal.join(first, "_digest").filter((F.col("_file") != F.col("_first.file")) | (F.col("_row") != F.col("_first.row")))


def bitmaps(marked: DataFrame) -> DataFrame:
    """Rows (_file, _chunk, _bits) with a bit for each address of ``marked``."""
    place = F.col("_row") % BITMAP_ROWS
    return marked.groupBy("_file", F.expr(f"_row div {BITMAP_ROWS}").alias("_chunk")).agg(F.call_function("bitmap_construct_agg", place).alias("_bits"))


def unmarked(pages: DataFrame, file: str, row: str, maps: DataFrame) -> DataFrame:
    """Rows of ``pages`` whose bit is not set in ``maps``, which are broadcast."""
    maps = maps.select(F.col("_file").alias("_f"), F.col("_chunk").alias("_c"), F.col("_bits").alias("_b"))
    byte = F.conv(F.hex(F.substring(F.col("_b"), F.expr(f"cast(`{row}` % {BITMAP_ROWS} div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, F.expr(f"cast(`{row}` % 8 as int)")).bitwiseAND(1)
    joined = pages.join(F.broadcast(maps), (F.col(file) == F.col("_f")) & (F.expr(f"`{row}` div {BITMAP_ROWS}") == F.col("_c")), "left")
    return joined.filter(F.coalesce(bit, F.lit(0)) == 0).drop("_f", "_c", "_b")


def file_groups(maps: DataFrame, most: int) -> list[tuple[str | None, str | None]]:
    """Ranges of file names (from, below) that cover all files, with at most ``most`` bitmaps each, or those of one file. The
    driver sees a count per file, as it does when the files are listed."""
    cuts, held = [], 0
    if maps.count() > most:
        for name, n in maps.groupBy("_file").agg(F.count(F.lit(1)).alias("n")).orderBy("_file").collect():
            if held and held + n > most:
                cuts.append(name)
                held = 0
            held += n
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def _record_id(page: Column, digest: Column, file: Column, row: Column) -> Column:
    name = F.element_at(F.split(file, "/"), -1)
    h = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("")), digest, name, row.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: str, date: str, first: Column | None, html: Column | None) -> Column:
    """A record from the columns of ``headers``, without the closing line ends; ``html`` makes it a response, ``first`` a revisit."""
    url = F.regexp_replace(F.coalesce(F.col("_url"), F.lit("urn:none")), r"[\x00-\x20\x7F]", "_")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit("\r\n\r\n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    own = _record_id(F.col("_page"), F.col("_digest"), F.col("_file"), F.col("_row"))
    refers = []
    if first is not None:
        refers = [line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(first["page"], F.col("_digest"), first["file"], first["row"])), line("WARC-Refers-To-Date", F.lit(date))]
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.lit(kind)), line("WARC-Record-ID", own), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("_digest")))), *refers,
        line("X-Page-ID", F.coalesce(F.col("_page").cast("string"), F.lit(""))), line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + (F.lit(0) if html is None else F.col("_bytes"))).cast("string")), F.lit("\r\n"), http,
        *([] if html is None else [html]),
    )


def addressed(pages: DataFrame) -> tuple[DataFrame, str, str]:
    """``pages``, which must be read from Parquet files and from nothing else, with each row's file and place, and these columns' names."""
    file, row = common.free(pages, "_file", "_row")
    return pages.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row)), file, row


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = DATE, records_per_file: int = RECORDS_PER_FILE, as_read: bool = False, most: int = GROUP_BITMAPS) -> None:
    """Write deduplicated archives of ``pages`` (page_id, url, html), gzipped, below ``path``. Unless ``as_read`` says that
    they are read straight from Parquet files, they are written to such files first."""
    pages = pages.select("page_id", "url", "html")
    pages, file, row = addressed(pages if as_read else common.cut(pages, "warc-pages"))
    heads = common.cut(headers(pages, file, row), "warc-heads")
    again = common.cut(revisits(heads, min_bytes), "warc-revisits")
    maps = common.cut(bitmaps(again), "warc-bitmaps")

    def write(records: DataFrame, name: str) -> None:
        out = records.write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip")
        out.option("maxRecordsPerFile", records_per_file).text(f"{path}/{name}")

    write(again.select(_record("revisit", date, F.col("_first"), None).alias("value")), "revisit")
    for low, below in file_groups(maps, most):
        some, own = pages, maps
        if low is not None:
            some, own = some.filter(F.col(file) >= low), own.filter(F.col("_file") >= low)
        if below is not None:
            some, own = some.filter(F.col(file) < below), own.filter(F.col("_file") < below)
        full = headers(unmarked(some, file, row, own), file, row, with_html=True)
        write(full.select(_record("response", date, None, F.col("_html")).alias("value")), "response")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record of a stream."""
    while first := stream.readline():
        if first in (b"\r\n", b"\n"):
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, stream.read(int(head["content-length"]))


def read_archives(spark, path: str) -> DataFrame:
    """Per record: page_id, record_id, record_type, digest and refers_id from its header; payload_bytes and payload from its block."""
    schema = "page_id long, record_id string, record_type string, payload_digest string, refers_id string, payload_bytes long, computed string, payload binary"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        frame = lambda x: pd.DataFrame(x, columns=names).astype({"page_id": "Int64", "payload_bytes": "Int64"})
        for pdf in batches:
            for content in pdf["content"]:
                out, held = [], 0
                for head, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    payload = block.partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None
                    size = None if payload is None else len(payload)
                    digest = None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    page = int(head["x-page-id"]) if head["x-page-id"] else None
                    out.append((page, head["warc-record-id"], head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), head.get("warc-refers-to"), size, digest, payload))
                    held += size or 0
                    if len(out) >= 2000 or held > 8 << 20:
                        yield frame(out)
                        out, held = [], 0
                if out:
                    yield frame(out)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInPandas(rows, schema)


def resolve(read: DataFrame) -> DataFrame:
    """Records of ``read_archives`` with revisits joined to their original responses: full size, digest and the original's page."""
    slim = common.cut(read.drop("payload"), "warc-read")
    response = slim.filter("record_type = 'response'")
    originals = response.groupBy(F.col("record_id").alias("refers_id")).agg(
        F.first("page_id").alias("refers_to"), F.first("payload_bytes").alias("full"), F.first("computed").alias("seen"))
    originals = common.cut(originals, "warc-originals")
    revisit = slim.filter("record_type = 'revisit'").join(originals, "refers_id", "left")
    none = F.lit(None).cast("long")
    return response.select("page_id", "payload_bytes", F.col("computed").alias("payload_digest"), "record_type", none.alias("refers_to")).unionByName(
        revisit.select("page_id", F.col("full").alias("payload_bytes"), F.col("seen").alias("payload_digest"), "record_type", "refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    common.ship(spark)
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path, as_read=True)
    return resolve(read_archives(spark, path))
