"""Annotations in comments of source files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: File endings by comment style, annotation kinds, those whose ids are checked, and the patterns.
STYLES = {"go": "c", "ts": "c", "tsx": "c", "js": "c", "jsx": "c", "py": "hash", "md": "html", "markdown": "html"}
KINDS = {"feature", "contract", "owner", "deprecated", "since", "bc", "aggregate", "aggregate-service", "saga", "consumer", "event-emit", "outbox-publish"}
STRICT = {"feature", "contract", "bc", "aggregate", "aggregate-service", "saga", "consumer", "event-emit", "outbox-publish"}
ID = re.compile(r"[a-z0-9_-]+(\.[a-z0-9_-]+)*")
API = re.compile(r"@api\s+(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(\S+)")
STEP = re.compile(r"[0-9]+")



@dataclass(frozen=True)
class Marks:
    """The words that start an annotation: one that a kind follows, and an older one for features alone. A code base has
    its own; they are told to the parsers. ``sources`` names them in the results."""

    current: str = "@note:"
    legacy: str = "@covers"
    sources: tuple[str, str] = ("current", "legacy")

    @property
    def current_re(self) -> str:
        return re.escape(self.current) + r"([a-zA-Z][a-zA-Z0-9_-]*)\s+(.+?)\s*$"

    @property
    def legacy_re(self) -> str:
        return re.escape(self.legacy) + r"\s+(.+?)\s*$"


MARKS = Marks()

_QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*(?:\"|$)|'[^']*(?:'|$)|`[^`]*(?:`|$)")


def _opens(line: str, mark: str) -> int:
    """Where a comment opens outside of quotes, -1 if nowhere."""
    at = 0
    while (hit := line.find(mark, at)) >= 0:
        quotes = [m for m in _QUOTED.finditer(line) if m.start() < hit]
        inside = next((m for m in quotes if m.end() > hit), None)
        if inside is None:
            return hit
        at = inside.end()
    return -1


def comments(text: str, style: str) -> Iterator[tuple[int, str]]:
    """Line number and text of each comment line; block comments go on until they close."""
    block_open, block_close = {"c": ("/*", "*/"), "html": ("<!--", "-->"), "hash": (None, None)}[style]
    inside = False
    for no, line in enumerate(text.split("\n"), 1):
        if inside:
            body = line.strip()
            if style == "c":
                body = body.removeprefix("*") if not body.startswith("*/") else body
            body, closed, _ = body.partition(block_close)
            inside = not closed
            if body.strip():
                yield no, body.strip()
            continue
        mark = {"c": "//", "hash": "#"}.get(style)
        if mark:
            at = _opens(line, mark) if style == "c" else line.find(mark)
            if at >= 0 and (body := line[at + len(mark) :].strip()):
                yield no, body
        if block_open:
            at = _opens(line, block_open) if style == "c" else line.find(block_open)
            if at >= 0:
                body, closed, _ = line[at + len(block_open) :].partition(block_close)
                inside = not closed
                if body.strip():
                    yield no, body.strip()


def _parts(payload: str, commas: bool) -> tuple[list[str], list[str]]:
    """Ids and tags of a payload; what follows the first tag and is no tag is prose."""
    ids, tags = [], []
    for word in payload.split():
        if word.startswith("#") or word.find("=") > 0:
            tags.append(word)
        elif not tags:
            ids += [x.strip() for x in word.split(",") if x.strip()] if commas else [word]
    return ids, tags


def _tag(tags: list[str], key: str) -> str | None:
    return next((t[len(key) + 1 :] for t in tags if t.startswith(key + "=")), None)


def parse_line(text: str, marks: Marks = MARKS) -> dict | None:
    """The annotation of one comment line: the first grammar that fits wins."""
    if (m := re.search(marks.current_re, text)) and m[1] in KINDS:
        kind, raw = m[1], m[2].strip()
        ids, tags = _parts(raw, False)
        ok = bool(ids)
        if kind == "consumer":
            stream = _tag(tags, "stream")
            ok = not ids and stream is not None and ID.fullmatch(stream) is not None
            ids = [stream] if ok else []
        if kind in STRICT:
            ok = ok and all(ID.fullmatch(x) for x in ids)
        if kind == "saga" and (step := _tag(tags, "step")) is not None:
            ok = ok and STEP.fullmatch(step) is not None
        if ok:
            return {"kind": kind, "ids": ids, "tags": tags, "source": marks.sources[0], "raw": raw}
    if m := re.search(marks.legacy_re, text):
        ids, tags = _parts(m[1].strip(), True)
        if ids:
            return {"kind": "feature", "ids": ids, "tags": tags, "source": marks.sources[1], "raw": m[1].strip()}
    if m := API.search(text):
        return {"kind": "api", "ids": [], "tags": [], "source": "api", "raw": f"{m[1]} {m[2]}", "method": m[1], "path": m[2]}
    return None


SCHEMA = "file_path string, line int, kind string, ids array<string>, tags array<string>, source string, raw string, method string, path string"


def parse_annotations(files: DataFrame, marks: Marks = MARKS) -> DataFrame:
    """Annotations of source files (file_path, text), a file at a time in batches; unknown endings have none."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["file_path"], pdf["text"]):
                style = STYLES.get(path.rpartition(".")[2].lower())
                for no, body in comments(text or "", style) if style else ():
                    if found := parse_line(body, marks):
                        out.append({"file_path": path, "line": no, "method": None, "path": None, **found})
            yield pd.DataFrame(out, columns=names)

    mine = files.filter(F.col("text").contains("@"))
    return mine.select("file_path", "text").mapInPandas(parse, SCHEMA)


def to_store(annotations: DataFrame) -> DataFrame:
    """Rows as they are kept: API notes are left out, ids and tags make the value, the last of a (file, line, kind) wins, whole.

    A line has one note, so the last is that of the largest ``seq``, if there is one; the larger (source, value) settles ties.
    """
    kept = annotations.filter("kind <> 'api'").withColumn("value", F.array_join(F.concat("ids", "tags"), " "))
    order = [F.col("seq")] if "seq" in annotations.columns else []
    last = F.max(F.struct(*order, "source", "value"))
    return kept.groupBy("file_path", "line", "kind").agg(last.alias("x")).select("file_path", "line", "kind", "x.value", "x.source")
