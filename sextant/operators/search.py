"""From a symptom to the code that may cause it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symptom rules as (pattern, layer, kinds to check in order, confidence); patterns ignore case.
RULES = [
    ("(unique constraint|duplicate key|duplicate entry|violates unique)", "data", ["repository", "query", "service"], 0.95),
    ("(foreign key.*violat|referential integrity|fk constraint)", "data", ["repository", "query", "service"], 0.95),
    ("(deadlock detected|deadlock found)", "data", ["repository", "service"], 0.95),
    (r"(sql:\s*no rows|no rows in result|record not found)", "data", ["repository", "query", "service"], 0.90),
    (r"(json:\s*cannot unmarshal|json.*unmarshal|invalid character.*looking for)", "backend-bug", ["handler", "service", "external"], 0.90),
    ("(login failed|invalid credentials|wrong password|authentication error)", "backend-auth", ["service", "handler", "external"], 0.90),
    ("(connection refused|ECONNREFUSED|dial tcp|network unreachable|ENETUNREACH)", "infra", ["external", "repository"], 0.90),
    ("(CORS|origin not allowed|cross-origin|access-control-allow-origin)", "infra", ["handler", "external"], 0.90),
    ("(selector.*not found|element not found|no element|getBy.*failed|queryBy.*null)", "frontend", ["component", "hook"], 0.85),
    ("(TypeError|Cannot read propert|undefined is not|is not a function)", "frontend", ["component", "hook", "service"], 0.85),
    ("(hydration.*mismatch|hydration.*failed|text content does not match)", "frontend", ["component", "hook"], 0.85),
    ("(tls|certificate|x509|cert.*expir|ssl)", "infra", ["external"], 0.85),
    ("(no route|route not matched|route not found|endpoint.*not found)", "backend-routing", ["endpoint", "handler"], 0.85),
    ("(409|conflict)", "data", ["repository", "service", "handler"], 0.80),
    ("(422|unprocessable|validation failed|invalid.*field|missing.*required)", "backend-bug", ["handler", "service"], 0.80),
    ("(429|rate.?limit|too many requests|throttl)", "infra", ["handler", "external"], 0.80),
    ("(502|bad gateway)", "infra", ["external", "handler"], 0.80),
    ("(503|service unavailable)", "infra", ["external", "service"], 0.80),
    ("(context canceled|request canceled|client disconnected)", "infra", ["service", "external"], 0.75),
    ("(EOF|unexpected EOF|broken pipe|connection reset)", "infra", ["external", "repository", "service"], 0.75),
    ("(401|unauthorized|unauthenticated)", "backend-auth", ["handler", "service", "external"], 0.70),
    ("(403|forbidden|permission denied|access denied)", "backend-auth", ["handler", "service"], 0.70),
    ("(404|not found)", "backend-routing", ["endpoint", "handler", "repository"], 0.55),
    ("(timeout|timed? ?out|deadline exceeded|context deadline|ETIMEDOUT)", "infra", ["external", "repository", "service"], 0.60),
    ("(500|internal server error|panic|runtime error|nil pointer)", "backend-bug", ["service", "repository", "handler"], 0.50),
    ("(empty response|no data|null response|empty body|content.length.*0)", "data", ["repository", "query", "service"], 0.50),
]
#: What a name contains if it is of a kind.
KIND_HINTS = {
    "handler": ["handler"], "service": ["service"], "repository": ["repo"], "query": ["query"], "component": ["component"],
    "hook": ["hook"], "endpoint": ["route", "endpoint"], "external": ["client", "external", "provider"],
}
#: Words of a symptom that tell nothing, and the length of those that can.
STOP_WORDS = {"error", "failed", "failure", "server", "client", "request", "http", "https", "with", "from", "this", "that", "true", "false", "null", "value"}
TOKEN_LENGTH = 4
#: Weights of whole matches, token matches and callers, and the largest bonus for a kind.
WHOLE, TOKEN, CENTRAL, BONUS = 0.55, 0.25, 0.20, 0.15


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules as rows (rule_no, pattern, layer, kinds, confidence)."""
    rows = [(i, "(?i)" + p, layer, kinds, c) for i, (p, layer, kinds, c) in enumerate(RULES)]
    return spark.createDataFrame(rows, "rule_no int, pattern string, layer string, kinds array<string>, confidence double")


def matching_rules(symptoms: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that match each symptom (id, symptom), every rule being tried on every symptom."""
    # as many rows as there are rules
    return symptoms.crossJoin(F.broadcast(rules)).filter(F.expr("symptom rlike pattern")).drop("pattern")


def tokens_of(symptom: str) -> list[str]:
    """Telling words of a symptom, each once, in order."""
    found = (x for x in re.findall(r"[A-Za-z0-9_.]+", symptom) if len(x) >= TOKEN_LENGTH and x.lower() not in STOP_WORDS)
    return list({x.lower(): x for x in reversed(list(found))}.values())[::-1]


def kind_bonus(matched: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per symbol (id, kind, name) the best bonus of the matched rules: the rule's confidence over the place of the first kind that fits.

    The rules that matched one symptom are at most as many as there are rules.
    """
    hints = symbols.sparkSession.createDataFrame(list(KIND_HINTS.items()), "hint string, parts array<string>")
    places = matched.select("rule_no", "confidence", F.posexplode("kinds").alias("at", "hint")).join(F.broadcast(hints), "hint")
    fits = (F.lower("kind") == F.col("hint")) | F.exists("parts", lambda p: F.contains(F.lower("name"), p))
    first = symbols.crossJoin(F.broadcast(places)).filter(fits).groupBy("id", "rule_no").agg(F.min(F.struct("at", "confidence")).alias("x"))
    return first.groupBy("id").agg(F.max(F.col("x.confidence") * BONUS / (F.col("x.at") + 1)).alias("bonus"))


def diagnose(symptom: str, bodies: DataFrame, callers: DataFrame, links: DataFrame | None = None, rules: DataFrame | None = None, at_least: float = 0.0, most: int = 0) -> DataFrame:
    """Symbols (id, name, kind, body) by how well their body echoes a symptom: id, name, body_hits, token_hits, callers, confidence, feature_id.

    ``callers`` has incoming edges per symbol (id, callers); they are related to the most among the candidates.
    """
    symptom = symptom.strip()
    if not symptom:
        raise ValueError("the symptom is empty")
    spark = bodies.sparkSession
    words = "|".join(map(re.escape, tokens_of(symptom)))
    body_hits = F.regexp_count("body", F.lit("(?i)" + re.escape(symptom)))
    token_hits = F.regexp_count("body", F.lit(f"(?i)({words})")) if words else F.lit(0)
    near = bodies.filter(F.coalesce("body", F.lit("")) != "").select("id", "name", "kind", body_hits.alias("body_hits"), token_hits.alias("token_hits"))
    near = near.filter("body_hits > 0 OR token_hits > 0").join(callers.select("id", "callers"), "id", "left").na.fill(0, ["callers"])
    said = spark.createDataFrame([(0, symptom)], "symptom_id int, symptom string")
    bonus = kind_bonus(matching_rules(said, rules if rules is not None else rules_table(spark)), near.select("id", "name", "kind"))
    # one row
    scored = near.join(bonus, "id", "left").crossJoin(F.broadcast(near.agg(F.max("callers").alias("most_callers"))))
    share = lambda x, full: F.least(F.lit(1.0), x / F.lit(float(full)))
    central = F.when(F.col("most_callers") > 0, F.col("callers") / F.col("most_callers")).otherwise(0.0)
    total = share(F.col("body_hits"), 3) * WHOLE + share(F.col("token_hits"), 6) * TOKEN + central * CENTRAL + F.coalesce("bonus", F.lit(0.0))
    out = scored.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))).filter(F.col("confidence") >= at_least)
    if links is not None:
        out = out.join(links.groupBy(F.col("symbol_id").alias("id")).agg(F.min("feature_id").alias("feature_id")), "id", "left")
    out = out.drop("most_callers", "bonus")
    return out.orderBy(F.desc("confidence"), "name").limit(most) if most else out
