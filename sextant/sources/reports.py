"""Test reports of several frameworks as result rows.

Every parser gives: report, name, symbol (go-test only), file, feature_id, status, duration_ms and message.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import paths
from sextant.sources.annotations import MARKS, Marks

RESULT = "report string, name string, file string, feature_id string, status string, duration_ms long, message string"
TRUNCATED = "no terminal event in -json stream (truncated?)"


def marked_feature(text: Column, marks: Marks = MARKS) -> Column:
    """The feature that a text names by a mark, in lower case, else null; of a list the first."""
    one = F.regexp_extract(text, re.escape(marks.current) + r"feature\s+([A-Za-z0-9_.-]+)", 1)
    first = F.btrim(F.substring_index(F.regexp_extract(text, re.escape(marks.legacy) + r"\s+([A-Za-z0-9_.,-]+)", 1), ",", 1))
    return F.lower(F.when(one != "", one).when(first != "", first))


EVENT = "Time string, Action string, Package string, Test string, Elapsed double, Output string"


def go_events(lines: DataFrame) -> DataFrame:
    """Events of NDJSON lines (report, seq, value); other lines and broken ones are left out."""
    ev = lines.filter(F.col("value").startswith("{")).withColumn("e", F.from_json("value", EVENT)).filter("e IS NOT NULL AND (e.Action IS NOT NULL OR e.Time IS NOT NULL)")
    return ev.select("report", "seq", F.col("e.Time").alias("time"), F.col("e.Action").alias("action"), F.coalesce("e.Package", F.lit("")).alias("package"),
                     F.coalesce("e.Test", F.lit("")).alias("test"), F.coalesce("e.Elapsed", F.lit(0.0)).alias("elapsed"), F.coalesce("e.Output", F.lit("")).alias("output"))


def go_results(events: DataFrame, marks: Marks = MARKS) -> DataFrame:
    """A row per report, package and test: the last terminal event gives status and duration, the first mark the feature, the first
    failure line the message. A test without a terminal event failed. Subtests keep their name but have their parent's symbol."""
    end = F.when(F.col("action").isin("pass", "fail", "skip"), F.col("seq"))
    out = F.col("action") == "output"
    fails = out & (F.col("output").contains("--- FAIL") | F.col("output").contains("FAIL:"))
    mark = F.when(out, marked_feature(F.col("output"), marks))
    last = F.max_by(F.struct("action", "elapsed"), end)
    rows = events.filter("test <> ''").groupBy("report", "package", "test").agg(
        F.max(end).alias("ended"), last.alias("last"), F.min_by(mark, F.when(mark.isNotNull(), F.col("seq"))).alias("feature_id"),
        F.min_by(F.btrim("output", F.lit(" \t\r\n")), F.when(fails, F.col("seq"))).alias("message"))
    done = F.col("ended").isNotNull()
    short = F.substring_index("package", "/", -1)
    return rows.select(
        "report", F.concat_ws(".", "package", "test").alias("name"),
        F.when(F.col("package") != "", F.concat_ws(".", short, F.substring_index("test", "/", 1))).otherwise("").alias("symbol"), "feature_id",
        F.when(done, F.col("last.action")).otherwise("fail").alias("status"), F.when(done, (F.col("last.elapsed") * 1000).cast("long")).otherwise(0).alias("duration_ms"),
        F.coalesce("message", F.when(~done, TRUNCATED), F.lit("")).alias("message"))


def go_run(events: DataFrame) -> DataFrame:
    """Per report its window and terminal events by kind; an event that comes again counts again."""
    n = lambda a: F.count(F.when((F.col("action") == a) & (F.col("test") != ""), 1)).alias(a)
    return events.groupBy("report").agg(F.min("time").alias("started"), F.max("time").alias("finished"), n("pass"), n("fail"), n("skip"))


VITEST = """startTime bigint, testResults array<struct<name: string, startTime: bigint, endTime: bigint, assertionResults: array<struct<
  title: string, fullName: string, ancestorTitles: array<string>, status: string, duration: double, failureMessages: array<string>>>>>"""


def vitest_results(reports: DataFrame, marks: Marks = MARKS) -> DataFrame:
    """Results of Vitest or Jest reports (report, text)."""
    t = reports.select("report", F.explode(F.from_json("text", VITEST)["testResults"]).alias("t")).select("report", F.regexp_replace("t.name", r"\\", "/").alias("file"), F.explode("t.assertionResults").alias("a"))
    a = lambda x: F.col(f"a.{x}")
    titles = F.array_join(F.concat(F.coalesce(a("ancestorTitles"), F.array()), F.array(F.coalesce(a("title"), F.lit("")))), " > ")
    name = F.when(F.coalesce(a("fullName"), F.lit("")) != "", a("fullName")).otherwise(titles)
    status = F.when(a("status") == "passed", "pass").when(a("status").isin("skipped", "pending", "todo"), "skip").otherwise("fail")
    path = paths.feature_of_path(F.coalesce("file", F.lit("")), "vitest")
    return t.select(
        "report", name.alias("name"), "file", F.coalesce(marked_feature(name, marks), F.when(path != "", path)).alias("feature_id"), status.alias("status"),
        F.coalesce(a("duration"), F.lit(0.0)).cast("long").alias("duration_ms"), F.array_join(F.coalesce(a("failureMessages"), F.array()), "\n").alias("message"))


def vitest_run(reports: DataFrame, with_end: bool = True) -> DataFrame:
    """Per report when it started and ended, in milliseconds; a Jest report (``with_end`` false) has no end, so it is its start."""
    r = reports.select("report", F.from_json("text", VITEST).alias("r"))
    end = F.array_max(F.transform("r.testResults", lambda t: t["endTime"])) if with_end else F.col("r.startTime")
    return r.select("report", F.col("r.startTime").alias("started_ms"), end.alias("finished_ms"))


def _named(rows: DataFrame, framework: str, marks: Marks) -> DataFrame:
    """Rows of a Python parser with their feature: a mark in the name, else the path."""
    file = F.coalesce("file", F.lit(""))
    path = paths.feature_of_flow(F.col("name"), file) if framework == "maestro" else paths.feature_of_path(file, framework)
    return rows.withColumn("feature_id", F.coalesce(marked_feature(F.col("name"), marks), F.when(path != "", path)))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")])


#: Words for a result in Playwright's results, in its tests without results, and in Maestro's flows.
PLAYWRIGHT_RESULT = {"passed": "pass", "failed": "fail", "timedOut": "fail", "skipped": "skip"}
PLAYWRIGHT_TEST = {"expected": "pass", "skipped": "skip", "unexpected": "fail"}
MAESTRO_FLOW = {"passed": "pass", "pass": "pass", "success": "pass", "skipped": "skip", "skip": "skip"}


def playwright_results(reports: DataFrame, marks: Marks = MARKS) -> DataFrame:
    """Results of Playwright reports (report, text). Suites nest without a limit, so each report is walked in Python, by batches."""

    def rows(report: str, text: str) -> Iterator[tuple]:
        work = [(s, s.get("file") or "") for s in reversed(json.loads(text).get("suites") or [])]
        while work:
            suite, above = work.pop()
            file = suite.get("file") or above
            for spec in suite.get("specs") or []:
                for test in spec.get("tests") or []:
                    done = (test.get("results") or [None])[-1]
                    if done:
                        status, took = PLAYWRIGHT_RESULT.get(done.get("status"), "fail"), done.get("duration")
                    else:
                        status, took = PLAYWRIGHT_TEST.get(test.get("status"), "fail"), test.get("duration")
                    message = ((done or {}).get("error") or {}).get("message") or ""
                    yield report, spec.get("title") or "", (spec.get("file") or file).replace("\\", "/"), None, status, int(took or 0), message
            work += [(s, file) for s in reversed(suite.get("suites") or [])]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _frame([x for r, t in zip(pdf["report"], pdf["text"]) for x in rows(r, t)])

    return _named(reports.select("report", "text").mapInPandas(parse, RESULT), "playwright", marks)


#: Folders that say nothing about a feature in the older tool's metrics.
METRIC_NOISE = ("e2e", "tests", "test", "specs")
METRIC = "report string, name string, file string, status string, duration_ns long, retries int"


def _metric_feature(file: Column) -> Column:
    """``folder.file`` as the older tool has it: the last folder that is no noise, also ``.`` for none."""
    stem = F.lower(F.regexp_replace(F.regexp_replace(paths.basename(file), r"\.spec\.ts$", ""), r"\.spec\.js$", ""))
    telling = F.filter(F.transform(F.split(paths.dirname(file), "/"), F.lower), lambda x: ~x.isin(*METRIC_NOISE))
    return F.when(F.size(telling) > 0, F.concat(F.element_at(telling, -1), F.lit("."), stem)).otherwise(stem)


def playwright_metrics(reports: DataFrame) -> DataFrame:
    """Metrics of Playwright reports (report, text): name, file, feature_id, status, duration_ns, retries. The last result
    counts; every result before it is a retry, and a test that passed after one is flaky. A suite without a file has that
    of the suite around it, the outermost its title."""

    def rows(report: str, text: str) -> Iterator[tuple]:
        work = [(s, "") for s in reversed(json.loads(text).get("suites") or [])]
        while work:
            suite, above = work.pop()
            file = suite.get("file") or above or suite.get("title") or ""
            for spec in suite.get("specs") or []:
                for test in spec.get("tests") or []:
                    results = test.get("results") or []
                    last = results[-1] if results else {"status": "passed" if test.get("status") == "expected" else "failed", "duration": test.get("duration")}
                    status = {"passed": "flaky" if len(results) > 1 else "pass", "skipped": "skip"}.get(last.get("status"), "fail")
                    yield report, spec.get("title") or "", file, status, int(last.get("duration") or 0) * 1_000_000, max(0, len(results) - 1)
            work += [(s, file) for s in reversed(suite.get("suites") or [])]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in METRIC.split(", ")]
        for pdf in batches:
            yield pd.DataFrame([x for r, t in zip(pdf["report"], pdf["text"]) for x in rows(r, t)], columns=names)

    out = reports.select("report", "text").mapInPandas(parse, METRIC)
    return out.withColumn("feature_id", _metric_feature(F.col("file")))


def vitest_metrics(reports: DataFrame) -> DataFrame:
    """Metrics of Vitest reports (report, text): name, file, feature_id, status, duration_ns, retries (none are told)."""
    t = reports.select("report", F.explode(F.from_json("text", VITEST)["testResults"]).alias("t")).select("report", F.col("t.name").alias("file"), F.explode("t.assertionResults").alias("a"))
    s = F.col("a.status")
    status = F.when(s == "passed", "pass").when(s.isin("skipped", "pending"), "skip").otherwise("fail")
    took = F.coalesce(F.col("a.duration"), F.lit(0.0)).cast("long") * 1_000_000
    return t.select("report", F.coalesce("a.title", F.lit("")).alias("name"), "file", status.alias("status"), took.alias("duration_ns"), F.lit(0).alias("retries"), _metric_feature(F.col("file")).alias("feature_id"))


def playwright_outcomes(reports: DataFrame) -> DataFrame:
    """What the older tool's update reads from Playwright reports: file, feature_id, whether the test passed, duration_ns."""
    m = playwright_metrics(reports)
    return m.select("report", "name", "file", "feature_id", F.col("status").isin("pass", "flaky").alias("passed"), "duration_ns")


def maestro_results(reports: DataFrame, marks: Marks = MARKS) -> DataFrame:
    """Results of Maestro reports (report, text), JUnit XML or JSON by the first character that is no space.

    A JSON array is a list of flows. Empty reports have no results.
    """

    def xml(report: str, text: str) -> Iterator[tuple]:
        for case in ET.fromstring(text).iter("testcase"):
            kind = next((k for k in ("failure", "error", "skipped") if case.find(k) is not None), None)
            found = case.find(kind) if kind else None
            message = "" if found is None else found.get("message") or (found.text or "" if kind != "skipped" else "")
            status = "pass" if kind is None else "skip" if kind == "skipped" else "fail"
            yield report, case.get("name") or "", (case.get("file") or "").replace("\\", "/"), None, status, int(float(case.get("time") or 0) * 1000), message

    def flows(report: str, text: str) -> Iterator[tuple]:
        found = json.loads(text)
        for f in found if isinstance(found, list) else found.get("flows") or []:
            status = MAESTRO_FLOW.get(str(f.get("status") or "").lower(), "fail")
            yield report, f.get("name") or "", (f.get("file") or "").replace("\\", "/"), None, status, int(f.get("duration_ms") or 0), f.get("message") or ""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r, t in zip(pdf["report"], pdf["text"]):
                start = (t or "").lstrip(" \t\r\n")[:1]
                if start and start not in "<{[":
                    raise ValueError(f"{r} is neither XML nor JSON")
                out += [] if not start else xml(r, t) if start == "<" else flows(r, t)
            yield _frame(out)

    return _named(reports.select("report", "text").mapInPandas(parse, RESULT), "maestro", marks)


def junit_window(text: str) -> tuple[datetime, float] | None:
    """Start and seconds of the earliest suite that has a time stamp."""
    suites = [(datetime.fromisoformat(s.get("timestamp").replace("Z", "+00:00")), float(s.get("time") or 0)) for s in ET.fromstring(text).iter("testsuite") if s.get("timestamp")]
    return min(suites) if suites else None
