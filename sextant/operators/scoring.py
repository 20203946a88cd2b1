"""Composite scores: feature health from four signals, sprint priority, test status of nodes, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import paths
from sextant.operators.coverage import n_if
from sextant.operators.lookup import tokens

#: Weight of each signal, and the window in microseconds that counts as fresh.
SIGNALS = {"coverage": 0.40, "annotation_freshness": 0.15, "pattern_compliance": 0.25, "contract_drift": 0.20}
WINDOW_US = 30 * 86_400_000_000


def coverage_signal(links: DataFrame, results: DataFrame) -> DataFrame:
    """Percent of a feature's symbols that passed in a run; only-skipped ones leave the count, those without a result stay.

    Links of tests do not count. A pass without a symbol but with the feature credits all its symbols.
    """
    wanted = links.filter("role <> 'test'").select("feature_id", "symbol_id").distinct()
    by = results.filter("symbol_id IS NOT NULL").groupBy("symbol_id").agg(
        F.max((F.col("status") == "pass").cast("int")).alias("p"), F.max((F.col("status") == "skip").cast("int")).alias("s"))
    whole = results.filter("symbol_id IS NULL AND feature_id IS NOT NULL AND status = 'pass'").select("feature_id", F.lit(1).alias("credit")).distinct()
    rows = wanted.join(by, "symbol_id", "left").join(whole, "feature_id", "left")
    passed = (F.coalesce("p", F.lit(0)) == 1) | F.col("credit").isNotNull()
    counted = passed | (F.coalesce("s", F.lit(0)) == 0)
    out = rows.groupBy("feature_id").agg(n_if(passed).alias("n"), n_if(counted).alias("d"))
    return _signal(out, "coverage")


def _signal(ratio: DataFrame, name: str) -> DataFrame:
    return ratio.filter("d > 0").select("feature_id", F.lit(name).alias("signal"), (F.col("n") * 100.0 / F.col("d")).alias("score"))


def files_of(links: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct files per feature, of all its linked symbols."""
    return links.join(symbols.select(F.col("id").alias("symbol_id"), "file_path"), "symbol_id").select("feature_id", "file_path").distinct()


def freshness_signal(links: DataFrame, symbols: DataFrame, annotations: DataFrame, blame: DataFrame, now_us: int) -> DataFrame:
    """Percent of feature and contract annotations in a feature's files that were touched inside the window; those without blame do not count."""
    sites = annotations.filter(F.col("kind").isin("feature", "contract")).join(blame, ["file_path", "line"])
    fresh = F.lit(now_us) - F.col("author_us") <= WINDOW_US
    per_file = sites.groupBy("file_path").agg(n_if(fresh).alias("n"), F.count(F.lit(1)).alias("d"))
    out = files_of(links, symbols).join(per_file, "file_path").groupBy("feature_id").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return _signal(out, "annotation_freshness")


def pattern_signal(links: DataFrame, symbols: DataFrame, annotations: DataFrame, matches: DataFrame) -> DataFrame:
    """Percent of aggregate services in a feature's files whose file has a canonical-service match."""
    hits = matches.filter("pattern = 'canonical-service'").join(symbols.select(F.col("id").alias("symbol_id"), "file_path"), "symbol_id").select("file_path").distinct().withColumn("hit", F.lit(1))
    sites = annotations.filter((F.col("kind") == "aggregate-service") & (F.size(tokens(F.col("value"))) > 0))
    per_file = sites.join(hits, "file_path", "left").groupBy("file_path").agg(F.count("hit").alias("n"), F.count(F.lit(1)).alias("d"))
    out = files_of(links, symbols).join(per_file, "file_path").groupBy("feature_id").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return _signal(out, "pattern_compliance")


def drift_signal(features: DataFrame, links: DataFrame, now_us: int) -> DataFrame:
    """Percent of a feature's contracts updated inside the window: itself, and contract features linked to its contract symbols."""
    mine = links.filter("role = 'contract'").select("feature_id", "symbol_id").distinct()
    other = mine.select(F.col("feature_id").alias("contract_id"), "symbol_id")
    linked = mine.join(other, "symbol_id").select("feature_id", "contract_id")
    own = features.filter("kind = 'contract'").select(F.col("id").alias("feature_id"), F.col("id").alias("contract_id"))
    known = linked.join(features.select(F.col("id").alias("feature_id")), "feature_id", "left_semi").unionByName(own).distinct()
    contracts = features.filter("kind = 'contract'").select(F.col("id").alias("contract_id"), (F.lit(now_us) - F.col("updated_us") <= WINDOW_US).alias("fresh"))
    out = known.join(contracts, "contract_id").groupBy("feature_id").agg(n_if(F.col("fresh")).alias("n"), F.count(F.lit(1)).alias("d"))
    return _signal(out, "contract_drift")


def health(features: DataFrame, signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted mean of the signals a feature has, 0 to 100; without any it is 0 and says so.

    Weights of zero or less, or missing ones, fall back to the defaults.
    """
    used = {k: (weights or {}).get(k) if ((weights or {}).get(k) or 0) > 0 else v for k, v in SIGNALS.items()}
    w = F.element_at(F.create_map(*[F.lit(x) for kv in used.items() for x in kv]), F.col("signal"))
    mean = signals.withColumn("w", w).groupBy("feature_id").agg((F.sum(F.col("w") * F.col("score")) / F.sum("w")).alias("m"), F.count(F.lit(1)).alias("n_signals"))
    out = features.select(F.col("id").alias("feature_id")).join(mean, "feature_id", "left")
    score = F.coalesce(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("m"))), F.lit(0.0))
    reason = F.when(F.col("n_signals").isNull(), "no signal")
    return out.select("feature_id", score.alias("score"), F.coalesce("n_signals", F.lit(0)).alias("n_signals"), reason.alias("reason"))


def all_signals(t, run: DataFrame, now_us: int) -> DataFrame:
    """The four signals of a catalog's tables as rows (feature_id, signal, score)."""
    latest = t.coverage_results.join(F.broadcast(run.select("run_id")), "run_id", "left_semi")
    return (
        coverage_signal(t.feature_symbols, latest)
        .unionByName(freshness_signal(t.feature_symbols, t.symbols, t.annotations, t.blame, now_us))
        .unionByName(pattern_signal(t.feature_symbols, t.symbols, t.annotations, t.pattern_matches))
        .unionByName(drift_signal(t.features, t.feature_symbols, now_us))
    )


#: Weights of score, bugs and recency, the windows in days, and the largest bug count.
SPRINT = {"score": 0.6, "bug": 0.2, "recency": 0.2}
BUG_DAYS, FRESH_DAYS, DECAY_DAYS, MOST_BUGS = 7, 7, 90, 100
DAY_US = 86_400_000_000


def cost_bucket(n: Column) -> Column:
    return F.when(n <= 3, "S").when(n <= 15, "M").otherwise("L")


def decay(age_us: Column) -> Column:
    """100 up to a week, then a straight line to 0 over 90 days."""
    over = (age_us - FRESH_DAYS * DAY_US) / float(DECAY_DAYS * DAY_US)
    return F.when(age_us <= FRESH_DAYS * DAY_US, 100.0).when(age_us >= (FRESH_DAYS + DECAY_DAYS) * DAY_US, 0.0).otherwise(100.0 * (1.0 - over))


def sprint(scores: DataFrame, links: DataFrame, symbols: DataFrame, results: DataFrame, run: DataFrame, annotations: DataFrame, blame: DataFrame, now_us: int) -> DataFrame:
    """Priority per feature from its health (feature_id, score), failures in the latest run and how lately it was touched."""
    # one row
    fails = results.filter("status = 'fail' AND symbol_id IS NOT NULL").join(F.broadcast(run.filter(F.lit(now_us) - F.col("finished_us") <= BUG_DAYS * DAY_US)), "run_id")
    per_symbol = fails.groupBy("symbol_id").agg(F.count(F.lit(1)).alias("fails"))
    wanted = links.filter("role <> 'test'").select("feature_id", "symbol_id").distinct()
    bugs = wanted.join(per_symbol, "symbol_id").groupBy("feature_id").agg(F.least(F.sum("fails"), F.lit(MOST_BUGS)).cast("double").alias("bug"))
    touched = annotations.filter(F.col("kind").isin("feature", "contract")).join(blame, ["file_path", "line"]).groupBy("file_path").agg(F.max("author_us").alias("t"))
    recent = files_of(links, symbols).join(touched, "file_path").groupBy("feature_id").agg(F.max("t").alias("t"))
    sizes = links.groupBy("feature_id").agg(F.count(F.lit(1)).alias("n"))
    rows = scores.join(bugs, "feature_id", "left").join(recent, "feature_id", "left").join(sizes, "feature_id", "left")
    bug, recency = F.coalesce("bug", F.lit(0.0)), F.coalesce(decay(F.lit(now_us) - F.col("t")), F.lit(0.0))
    total = (100.0 - F.col("score")) * SPRINT["score"] + bug * SPRINT["bug"] + recency * SPRINT["recency"]
    priority = F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))
    return rows.select("feature_id", priority.alias("priority"), bug.alias("bug"), recency.alias("recency"), cost_bucket(F.coalesce("n", F.lit(0))).alias("cost"))


#: Folders that say nothing about a package, endings of a test that lies beside its source, and endings that are
#: taken off a test's name, each once and in this order.
COMMON_FOLDERS = ("src", "internal", "pkg", "cmd", "tests", "test", "__tests__")
BESIDE = r"(_test\.go|\.test\.ts|\.test\.tsx|\.spec\.ts|\.spec\.tsx)$"
TEST_ENDINGS = (r"_test$", r"\.test$", r"\.spec$", r"_e2e_test$", r"_integration_test$")


def _no_ending(path: Column) -> Column:
    """A path without what follows the last dot of its file name."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def node_status(nodes: DataFrame, tests: DataFrame) -> DataFrame:
    """Test status of nodes (id, name, file_path) by tests (file_path).

    ``tested``: a test of the node's file lies beside it. ``partial``: a test lies in the folder, or has the file's name, or
    shares a path segment of four bytes or more that is no common folder; for nodes without a file, the name of a test
    contains theirs (without ``sql:`` in front), in any case. Others are ``untested``. Each way is a join on a key: no pairs
    of nodes and tests are made.
    """
    path = F.col("file_path")
    folder, base = paths.dirname(path), F.regexp_replace(_no_ending(path), "^.*/", "")
    segments = lambda p: F.filter(F.array_distinct(F.split(p, "/")), lambda x: (F.octet_length(x) > 3) & ~x.isin(*COMMON_FOLDERS))
    stem = base
    for ending in TEST_ENDINGS:
        stem = F.regexp_replace(stem, ending, "")
    known = tests.select(path.alias("file_path")).distinct()
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(1))
    beside = flag(known.filter(path.rlike(BESIDE)).select(F.regexp_replace(path, BESIDE, "").alias("_source")), "_beside")
    near = flag(known.select(folder.alias("_folder")), "_near")
    same = flag(known.select(stem.alias("_base")), "_same")
    shared = known.select(F.explode(segments(path)).alias("_segment")).distinct()
    filed = nodes.filter("file_path IS NOT NULL AND file_path <> ''")
    akin = flag(filed.select("id", F.explode(segments(path)).alias("_segment")).join(shared, "_segment", "left_semi").select("id"), "_akin")
    out = filed.select("id", _no_ending(path).alias("_source"), folder.alias("_folder"), base.alias("_base"))
    out = out.join(beside, "_source", "left").join(near, "_folder", "left").join(same, "_base", "left").join(akin, "id", "left")
    status = F.when(F.col("_beside") == 1, "tested").when(F.coalesce("_near", "_same", "_akin") == 1, "partial").otherwise("untested")
    # names in names: all parts of the short names of tests are keys
    low = known.select(F.lower(stem).alias("s")).distinct().filter("s <> ''")
    starts = low.select("s", F.explode(F.sequence(F.lit(1), F.length("s"))).alias("i"))
    parts = flag(starts.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - F.col("i") + 1), lambda n: F.substring("s", F.col("i"), n))).alias("_name")), "_named")
    loose = nodes.filter("file_path IS NULL OR file_path = ''").select("id", F.lower(F.regexp_replace("name", "^sql:", "")).alias("_name")).join(parts, "_name", "left")
    return out.select("id", status.alias("status")).unionByName(loose.select("id", F.when(F.col("_named") == 1, "partial").otherwise("untested").alias("status")))


#: The surface that each slot belongs to, and what it is called in a gap.
SLOT_SURFACES = {
    "unit.backend": "has_api", "unit.web": "has_web", "unit.mobile": "has_mobile", "integration.backend": "has_api", "integration.mobile": "has_mobile",
    "e2e.web": "has_web", "e2e.mobile": "has_mobile",
}
SLOT_LABELS = {
    "unit.backend": "unit backend", "unit.web": "unit web", "unit.mobile": "unit mobile", "integration.backend": "integration backend",
    "integration.mobile": "integration mobile", "e2e.web": "E2E web", "e2e.mobile": "E2E mobile",
}


def gap_text() -> Column:
    """What a slot (slot, status, pass_rate and the surfaces has_api, has_web and has_mobile) lacks, null if nothing.

    A slot that is not there lacks tests if the feature has its surface. Failing end-to-end tests tell their pass rate.
    """
    slot, status = F.col("slot"), F.col("status")
    surface, label, e2e = F.lit(False), F.lit(None).cast("string"), slot.startswith("e2e.")
    for name, column in SLOT_SURFACES.items():
        surface, label = F.when(slot == name, F.col(column)).otherwise(surface), F.when(slot == name, SLOT_LABELS[name]).otherwise(label)
    rate = F.when(e2e, F.concat(F.lit(" (pass rate: "), F.coalesce(F.col("pass_rate"), F.lit(0.0)).__mul__(100).cast("int").cast("string"), F.lit("%)"))).otherwise("")
    more = F.when(e2e, "scenarios").otherwise("tests")
    return (
        F.when((status.isNull() & surface) | (status == "missing"), F.concat(F.lit("Missing "), label, F.lit(" tests")))
        .when(status == "failing", F.concat(F.lit("Failing "), label, F.lit(" tests"), rate))
        .when(status == "partial", F.concat(F.lit("Partial "), label, F.lit(" coverage — additional "), more, F.lit(" needed")))
    )


def feature_gaps(slots: DataFrame) -> DataFrame:
    """Per feature its gaps in the order of the slots, how many, and whether nothing lacks."""
    rows = slots.withColumn("_gap", gap_text())
    items = F.array_sort(F.collect_list(F.when(F.col("_gap").isNotNull(), F.struct("slot_no", F.col("_gap").alias("gap")))))
    out = rows.groupBy("feature_id").agg(items.alias("g"))
    return out.select("feature_id", F.size("g").alias("n_gaps"), F.concat_ws("; ", F.transform("g", lambda x: x["gap"])).alias("gaps"), (F.size("g") == 0).alias("complete"))


def suggestions(slots: DataFrame) -> DataFrame:
    """Per feature what would close its gaps, in a fixed order (feature_id, no, suggestion).

    ``slots`` also has mocked, route, component and screen of the surfaces, and method and path of the first API.
    """
    slot, status = F.col("slot"), F.col("status")
    lacks = status.isNull() | (status == "missing")
    text = lambda *parts: F.concat(*[F.col(p[1:]) if p.startswith("$") else F.lit(p) for p in parts])
    rate = F.format_string("%.0f%%)", F.coalesce("pass_rate", F.lit(0.0)) * 100)
    told = [
        ((slot == "unit.backend") & lacks & F.col("has_api"), F.lit("Add Go unit tests for the service/handler layer")),
        ((slot == "unit.web") & lacks & F.col("has_web"), text("Add Vitest test for ", "$component", " component")),
        ((slot == "unit.mobile") & lacks & F.col("has_mobile"), text("Add Jest test for ", "$screen", " screen")),
        ((slot == "integration.backend") & lacks & F.col("has_api"), text("Add integration test for ", "$method", " ", "$path", " endpoint")),
        ((slot == "e2e.web") & lacks & F.col("has_web"), text("Add Playwright spec for ", "$route", " route")),
        ((slot == "e2e.mobile") & lacks & F.col("has_mobile"), text("Add Maestro flow for ", "$screen", " screen")),
        ((slot == "unit.backend") & status.isNotNull() & F.col("mocked"), F.lit("Consider adding real integration tests — backend unit tests use mocks")),
        ((slot == "e2e.web") & (status == "failing"), F.concat(F.lit("Fix failing web E2E tests (pass rate: "), rate)),
        ((slot == "e2e.mobile") & (status == "failing"), F.concat(F.lit("Fix failing mobile E2E tests (pass rate: "), rate)),
    ]
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(i).alias("no"), s.alias("suggestion"))) for i, (c, s) in enumerate(told)]))
    return slots.select("feature_id", F.explode(each).alias("x")).select("feature_id", "x.no", "x.suggestion")
