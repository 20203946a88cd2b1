"""Deduplication of repeated line runs with a suffix array over line ids.

The corpus is read as one sequence of lines in the order (id, hash of the text, place); lines without a word are skipped, and
documents end the sequence. Suffixes are ranked by distributed prefix doubling: round k ranks the blocks of
2^k lines that occur at least twice, from pairs of ranks of round k-1. Ranks follow the lexicographic order of
the line hashes, so equal ranks of round k are an interval of the suffix array whose longest common prefix is
2^k lines or more; blocks that occur once leave, as no longer run through them repeats.

A run counts if it has ``min_words`` words or more. It then starts with a shortest counting block (its first
lines up to ``min_words`` words) and ends with one, and both depend on content alone. The interval for a block
of n lines is the pair of its two overlapping 2^k ranks, so grouping these pairs gives all its occurrences.
Every occurrence but the first is a later copy; the union of the copies' lines is that of all maximal repeated
runs with ``min_words`` words, and is deleted. The rounds needed are log2(min_words), whatever the input.

Only DataFrame functions; groups are counted before anything is joined to them, and no pair of members is ever
made, so a line in a third of all rows costs what other lines cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import common

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    """Per line with a word: its place, two hashes of its words joined by single spaces, and its words."""
    # runs of white space inside lines become one space; a text seldom has any
    even = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]{2,}|[\x09\x0B-\x0D]", " ")

    def one(line: Column, i: Column) -> Column:
        return F.struct(
            i.alias("line"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"),
            F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("words"))

    return F.filter(F.transform(F.transform(F.split(even, "\n"), lambda x: F.trim(x)), one), lambda x: x["words"] > 0)


def _steps(counts, least: int) -> Column:
    """How many leading entries sum up to less than ``least``; ``counts(n)`` gives the first n. A few mostly suffice."""
    start = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).alias("n"))

    def add(a: Column, x: Column) -> Column:
        s = a["s"] + x
        return F.struct(s.alias("s"), (a["n"] + F.when(s < least, 1).otherwise(0)).alias("n"))

    def among(n: int) -> Column:
        return F.aggregate(counts(n), start, add, lambda a: a["n"])

    few = min(6, least)
    return common.let(among(few), lambda n: F.when(n < few, n).otherwise(among(least)))


def positions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line with a word: ``pos`` numbers them in the order of (id, hash of the text, row), without gaps inside a document.

    ``left``: lines of its document from here on; ``ahead``/``back``: lines of the shortest block of ``min_words``
    words that starts/ends here (null: none); ``reach``: no block from here that is needed has more lines.
    """
    slim = common.cut(docs.select("_id", F.xxhash64("_text").alias("_order"), "_row_id", _lines(F.col("_text")).alias("ls")), "line-ids").filter(F.size("ls") > 0)
    order = ["_id", "_order", "_row_id"]  # by content, so that rows of one id stand alike in every layout of the input
    slim = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    n = F.size("ls")
    w = F.transform("ls", lambda x: x["words"])

    def block(x: Column, i: Column) -> Column:
        back_slice = lambda n: F.reverse(F.slice(F.col("w"), F.greatest(i - n + 2, F.lit(1)), F.least(i + 1, F.lit(n))))
        ahead = _steps(lambda n: F.slice(F.col("w"), i + 1, F.lit(n)), min_words) + 1
        back = _steps(back_slice, min_words) + 1
        inner = _steps(lambda n: F.slice(F.col("w"), i + 2, F.lit(n)), min_words) + 2
        return F.struct(
            x["line"].alias("line"), x["h1"].alias("h1"), x["h2"].alias("h2"), (F.col("n") - i).alias("left"),
            F.when(ahead <= F.col("n") - i, ahead).alias("ahead"), F.when(back <= i + 1, back).alias("back"), inner.alias("reach"))

    each = slim.withColumn("n", n).withColumn("w", w).select("_row_id", F.posexplode(F.transform("ls", block)).alias("idx", "x"))
    out = each.select("_row_id", F.monotonically_increasing_id().alias("pos"), "idx", "x.*")
    return common.cut(out, "line-positions")


def _ranked(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Keys that occur at least twice, with ranks in their order. Only these keys are sorted, by ranges."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    order = twice.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return common.cut(order.withColumn("rank", F.monotonically_increasing_id()), tag)


def suffix_ranks(pos: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (level, pos, rank): ranks of the repeated blocks of 2^level lines, by prefix doubling."""
    keep = ["_row_id", "pos", "left", "reach"]
    level = common.cut(pos.join(_ranked(pos, ["h1", "h2"], "line-ranks"), ["h1", "h2"]).select(*keep, "rank"), "line-level")
    out, k = level.select(F.lit(0).alias("level"), "pos", "rank"), 0
    while 2 ** (k + 1) <= min_words + 1:
        step = 2**k
        wide = level.filter((F.col("left") >= 2 * step) & (F.col("reach") >= 2 * step))
        after = level.select((F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"))
        pairs = common.cut(wide.withColumnRenamed("rank", "r1").join(after, "pos"), "line-pairs")
        if common.is_empty(pairs):
            break
        level = common.cut(pairs.join(_ranked(pairs, ["r1", "r2"], "line-ranks"), ["r1", "r2"]).select(*keep, "rank"), "line-level")
        k += 1
        out = out.unionByName(level.select(F.lit(k).alias("level"), "pos", "rank"))
    return out


def later_copies(pos: DataFrame, ranks: DataFrame) -> DataFrame:
    """Blocks (_row_id, start idx, len) whose lines occur earlier, at least ``min_words`` words each."""
    ends = F.array(F.struct(F.col("pos").alias("start"), F.col("idx"), F.col("ahead").alias("len")),
                   F.struct((F.col("pos") - F.col("back") + 1).alias("start"), (F.col("idx") - F.col("back") + 1).alias("idx"), F.col("back").alias("len")))
    two = pos.select("_row_id", F.explode(F.filter(F.array_distinct(ends), lambda b: b["len"].isNotNull())).alias("b")).select("_row_id", "b.*")
    blocks = two.withColumn("level", F.floor(F.log2("len")).cast("int"))
    a = ranks.select("level", F.col("pos").alias("start"), F.col("rank").alias("ra"))
    b = ranks.select("level", F.col("pos").alias("last"), F.col("rank").alias("rb"))
    last = F.col("start") + F.col("len") - F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    keyed = blocks.join(a, ["level", "start"]).withColumn("last", last).join(b, ["level", "last"]).select("_row_id", "start", "idx", "len", "ra", "rb")
    keyed = common.cut(keyed, "line-blocks")
    first = keyed.groupBy("len", "ra", "rb").agg(F.min("start").alias("first"), F.max("start").alias("final")).filter("first < final").drop("final")
    first = common.cut(first, "line-first")  # written, both sides of the join are shuffled for it, so that a hot block can be split
    return keyed.join(first, ["len", "ra", "rb"]).filter("start > first").select("_row_id", "idx", "len")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs taken out of the text, and ``n_lines`` and ``n_removed``.

    The first copy is the one with the smallest id, then the smaller place; null ids come first, and rows with the
    same id are ordered by a hash of their text, so that the layout of the input does not matter. Runs may lie in one document or in several. Lines are compared by their words, so
    white space does not tell them apart; kept lines keep theirs. Null or empty texts are returned as they are,
    with no line. Columns called ``n_lines`` or ``n_removed`` before are replaced; all others are returned.
    An empty table gives an empty result. No document is dropped: a text that is a later copy becomes empty.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_doc"), F.monotonically_increasing_id().alias("_row_id"))
    base = common.cut(packed, "line-docs")
    pos = positions(base.select(F.col(f"_doc.`{id_col}`").alias("_id"), "_row_id", F.col(f"_doc.`{text_col}`").alias("_text")), min_words)
    copies = later_copies(pos, suffix_ranks(pos, min_words))
    gone = copies.select("_row_id", F.explode(F.sequence("idx", F.col("idx") + F.col("len") - 1)).alias("idx")).distinct()
    # places in the text, from places among the lines with a word
    gone = gone.groupBy("_row_id").agg(F.collect_list("idx").alias("gone"))
    text = F.col(f"_doc.`{text_col}`")
    # grows with the input: never broadcast
    joined = base.join(gone.hint("merge"), "_row_id", "left").withColumn("_lines", F.split(F.coalesce(text, F.lit("")), "\n"))
    joined = joined.withColumn("_worded", F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.get(F.col("_lines"), i).rlike(common.WORD)))
    drop = F.transform("gone", lambda i: F.get(F.col("_worded"), i))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), drop)
    clean = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return joined.select(
        *[(clean if c == text_col else F.col(f"_doc.`{c}`")).alias(c) for c in own],
        F.size("_worded").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(common.documents(spark, sf_dir).select("doc_id", "text"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), raw AS (
  SELECT r, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS s FROM d
), l AS (
  SELECT r, line, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws FROM raw
), p AS (
  SELECT r, line, array_to_string(ws, ' ') AS c, len(ws) AS n,
         row_number() OVER (PARTITION BY r ORDER BY line) AS i, sum(len(ws)) OVER (PARTITION BY r ORDER BY line) AS cum
  FROM l WHERE len(ws) > 0
), ahead AS (
  SELECT a.r, a.i AS f, min(b.i) AS t FROM p a JOIN p b ON a.r = b.r AND b.i BETWEEN a.i AND a.i + 49 AND b.cum - a.cum + a.n >= 50 GROUP BY 1, 2
), back AS (
  SELECT b.r, max(a.i) AS f, b.i AS t FROM p a JOIN p b ON a.r = b.r AND b.i BETWEEN a.i AND a.i + 49 AND b.cum - a.cum + a.n >= 50 GROUP BY b.r, b.i
), blocks AS (
  SELECT * FROM ahead UNION SELECT * FROM back
), named AS (
  SELECT b.r, b.f, b.t, string_agg(p.c, chr(10) ORDER BY p.i) AS content FROM blocks b JOIN p ON p.r = b.r AND p.i BETWEEN b.f AND b.t GROUP BY 1, 2, 3
), copies AS (
  SELECT r, f, t FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY r, f) AS k FROM named) WHERE k > 1
), gone AS (
  SELECT DISTINCT p.r, p.line FROM copies c JOIN p ON p.r = c.r AND p.i BETWEEN c.f AND c.t
), kept AS (
  SELECT l.r, string_agg(l.s, chr(10) ORDER BY l.line) FILTER (WHERE g.r IS NULL) AS text,
         count(*) FILTER (WHERE len(l.ws) > 0) AS n_lines, count(g.r) AS n_removed
  FROM l LEFT JOIN gone g ON g.r = l.r AND g.line = l.line GROUP BY l.r
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, k.n_lines::BIGINT AS n_lines, k.n_removed::BIGINT AS n_removed
FROM d JOIN kept k ON k.r = d.r
"""
