"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once for each document and stores the measurements and a mask of the rules
that failed. A ``Policy`` is a versioned choice of rules: applying it, or comparing policies, reads only the
mask. ``ablations`` tells what each rule of a policy rejects alone and what dropping it would keep.

Everything is a DataFrame expression on one row: no shuffle, and memory is bounded by the longest text.
Null text counts as empty; an empty or null text has zero words and fails ``few_words``.
Repeated rows, ties and null ids are kept as they are; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import common

SYMBOLS = r"[#*$%&|<>]"


def n_repeat_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more, first ones included.

    Windows are told apart by a 64-bit hash. Texts without a repeat, the most, end at the distinct count.
    """
    hashes = F.transform(words, lambda w, i: F.when(i < F.size(words) - 2, F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))

    def covered(starts: Column) -> Column:
        step = F.transform(starts, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(starts, j + 1), p + 3) - p))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        same = lambda s, j: F.coalesce(F.get(ordered, j)["h"] == s["h"], F.lit(False))
        hits = F.filter(ordered, lambda s, j: same(s, j - 1) | same(s, j + 1))
        return common.let(F.sort_array(F.transform(hits, lambda s: s["i"])), covered)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(common.let(ordered, repeated))

    return F.when(F.size(words) < 4, 0).otherwise(common.let(F.slice(hashes, 1, F.greatest(F.size(words) - 2, F.lit(1))), count)).cast("long")


def measured(docs: DataFrame, text: str = "text", out: str = "_m", more=None) -> DataFrame:
    """``docs`` with one struct column ``out`` of whole-text measurements, which replaces a column of that name.

    ``more`` gives further measurements by name from the words and the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a, b = common.free(docs, "_words", "_lines")
    split = docs.withColumn(a, common.words(F.col(text))).withColumn(b, F.filter(F.split(t, "\n"), lambda x: x.rlike(common.WORD)))
    w, lines = F.col(a), F.col(b)
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long")
    m = {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": common.count_matches(t, SYMBOLS),
        "n_letters": letters,
        "n_upper": common.count_matches(t, r"[\p{Lu}]+"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": n_repeat_words(w),
    }
    if more:
        m |= more(w, t)
    return split.withColumn(out, F.struct(*[v.alias(k) for k, v in m.items()])).drop(a, b)


def rules(m: Column) -> dict[str, Column]:
    """Name to failure condition."""
    return {
        "few_words": m["n_words"] < 50,
        "repeats": m["n_repeat_words"] * 100 > m["n_words"] * 50,
        "symbols": m["n_symbols"] * 100 > m["n_words"] * 10,
        "capitals": m["n_upper"] * 100 > m["n_letters"] * 40,
        "few_letters": m["n_letters"] * 100 < m["word_chars"] * 60,
        "short_words": m["word_chars"] < m["n_words"] * 2,
        "long_words": m["word_chars"] > m["n_words"] * 25,
        "dup_lines": m["n_dup_lines"] * 2 > m["n_lines"],
    }


#: The rules in the order of their bits.
NAMES = ("few_words", "repeats", "symbols", "capitals", "few_letters", "short_words", "long_words", "dup_lines")


@dataclass(frozen=True)
class Policy:
    """A document is rejected if more than ``allowed`` of the named rules failed."""

    version: str
    reject: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << NAMES.index(x) for x in self.reject)

    def keeps(self, bits: Column) -> Column:
        return F.bit_count(bits.bitwiseAND(self.mask)) <= self.allowed


BASE = Policy("base-1", ("few_words", "repeats"))
DEFAULT = Policy("full-1", NAMES)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measurements in ``_m`` and failed rules in ``_bits`` (bit k: rule ``NAMES[k]``).

    Columns of these two names are replaced, all others are kept.
    """
    out = measured(docs, text)
    bits = sum((F.when(c, 1 << k).otherwise(0).cast("long") for k, c in enumerate(map(rules(F.col("_m")).get, NAMES))), F.lit(0).cast("long"))
    return out.withColumn("_bits", bits)


def apply_policy(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The ledger with a boolean ``kept``."""
    return led.withColumn("kept", policy.keeps(F.col("_bits")))


def filter_documents(docs: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns as they are, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col("text"))
    return common.where(ledger(packed), policy.keeps(F.col("_bits"))).select("_doc.*")


def ablations(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of the policy: documents it fails, fails alone, and that would be kept without it.

    The masks are counted first, so that what is shuffled is one row per distinct mask.
    """
    masks = led.groupBy(F.col("_bits").bitwiseAND(policy.mask).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.lit(1 << NAMES.index(x)).cast("long").alias("bit")) for x in policy.reject]))
    each = masks.select("mask", "n", rule.alias("r")).select("mask", "n", "r.rule", "r.bit")
    hit = F.col("mask").bitwiseAND(F.col("bit")) != 0
    fails = F.bit_count("mask")
    kept_now = fails <= policy.allowed
    kept_then = F.bit_count(F.col("mask").bitwiseAND(F.bitwise_not("bit"))) <= policy.allowed
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        total(hit).alias("n_failed"), total(hit & (fails == 1)).alias("n_failed_alone"), total(~kept_now & kept_then).alias("n_kept_without"),
        F.coalesce(F.bit_or(F.when(hit, F.col("mask"))), F.lit(0).cast("long")).alias("fails_with"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    led = apply_policy(ledger(common.documents(spark, sf_dir).select("doc_id", "text")))
    m = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = ~BASE.keeps(F.col("_bits"))
    rest = [F.col(f"_m.{x}").alias(x) for x in ("n_letters", "n_upper", "n_lines")]
    return led.select(
        "doc_id", *[F.col(f"_m.{x}").alias(x) for x in m], base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"),
        F.col("_bits").alias("failed_bits"), F.lit(DEFAULT.version).alias("policy"), *rest,
    )


def ablation_query(spark, sf_dir: str) -> DataFrame:
    """What each rule of the full policy does to ``documents``, from the masks alone."""
    return ablations(ledger(common.documents(spark, sf_dir).select("text")))


MEASURED = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d
), win AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), dup AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT i + o) AS n FROM (SELECT r, i, unnest([0, 1, 2]) AS o FROM dup) GROUP BY r
), m AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(t, '[^\p{L}]+', '', 'g')) AS n_letters,
         length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) AS n_upper,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (r)
), led AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (n_repeat_words * 100 > n_words * 50)::BIGINT + 4 * (n_symbols * 100 > n_words * 10)::BIGINT + 8 * (n_upper * 100 > n_letters * 40)::BIGINT
    + 16 * (n_letters * 100 < word_chars * 60)::BIGINT + 32 * (word_chars < n_words * 2)::BIGINT + 64 * (word_chars > n_words * 25)::BIGINT + 128 * (n_dup_lines * 2 > n_lines)::BIGINT)::BIGINT AS failed_bits FROM m
)
"""

ABLATION_ORACLE = MEASURED + r"""
SELECT r.rule, count(*) FILTER (WHERE failed_bits & r.bit <> 0) AS n_failed, count(*) FILTER (WHERE failed_bits = r.bit) AS n_failed_alone, count(*) FILTER (WHERE failed_bits = r.bit) AS n_kept_without,
       coalesce(bit_or(failed_bits) FILTER (WHERE failed_bits & r.bit <> 0), 0)::BIGINT AS fails_with
FROM led, (VALUES ('few_words', 1), ('repeats', 2), ('symbols', 4), ('capitals', 8), ('few_letters', 16), ('short_words', 32), ('long_words', 64), ('dup_lines', 128)) r(rule, bit) GROUP BY r.rule
"""

ORACLE = MEASURED + r"""
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, failed_bits, 'full-1' AS policy, n_letters::BIGINT AS n_letters, n_upper::BIGINT AS n_upper, n_lines::BIGINT AS n_lines,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols * 100 > n_words * 10
            OR n_upper * 100 > n_letters * 40 OR n_letters * 100 < word_chars * 60 OR word_chars < n_words * 2
            OR word_chars > n_words * 25 OR n_dup_lines * 2 > n_lines) AS kept
FROM led
"""
