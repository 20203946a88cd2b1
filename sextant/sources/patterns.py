"""Coding patterns in Go sources: outbox appends, embedded event recorders and canonical services.

Sources are read by their brackets: comments and literals are blanked first, so that what is left is code. A parser sees
more (build tags, broken files); nothing here needs a Go tool.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "file_path string, pattern string, symbol string, line int, detail string, confidence double"


@dataclass(frozen=True)
class Names:
    """Fixed values by default: names that the patterns look for."""

    unit_of_work: tuple[str, ...] = ("Run",)
    append: tuple[str, ...] = ("Append", "AppendFromContext")
    save: tuple[str, ...] = ("Save", "Insert", "Update", "Upsert")
    recorder: tuple[str, ...] = ("EventRecorder",)


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.DOTALL)
_FUNC = re.compile(r"^func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)\s*(\[[^\]]*\])?\s*\)\s*)?(\w+)", re.MULTILINE)
_STRUCT = re.compile(r"^(?:type\s+|\s+)(\w+)\s+struct\s*\{", re.MULTILINE)
_CLOSE = {"(": ")", "{": "}", "[": "]"}


def code(text: str) -> str:
    """``text`` with comments and literals blanked; every character keeps its place and line."""
    return _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(src: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``; the end of the text if none does."""
    depth = 0
    for i in range(at, len(src)):
        if src[i] in "({[":
            depth += 1
        elif src[i] in ")}]":
            depth -= 1
            if not depth:
                return i + 1
    return len(src)


def _body(src: str, at: int) -> tuple[int, int] | None:
    """The braces of a function whose parameters start at or after ``at``: those of types in its signature are passed over."""
    i = at
    while i < len(src):
        c = src[i]
        if c == "\n" and not src[at:i].strip().endswith(("(", ",")):
            return None
        if c == "{":
            end = _end(src, i)
            if not re.search(r"\b(interface|struct)\s*$", src[at:i]):
                return i, end
            i = end
        elif c in "([":
            i = _end(src, i)
        else:
            i += 1
    return None


def _closure(src: str, open_at: int, close_at: int) -> tuple[int, int] | None:
    """The body of the first function literal that is itself an argument of the call between two brackets."""
    i, fresh = open_at + 1, True
    while i < close_at - 1:
        if src[i].isspace():
            i += 1
        elif fresh and re.match(r"func\b", src[i:]):
            return _body(src, i + 4)
        elif src[i] in "({[":
            i, fresh = _end(src, i), False
        else:
            fresh, i = src[i] == ",", i + 1
    return None


def matches(text: str, names: Names = Names()) -> Iterator[tuple[str, str, int, str, float]]:
    """Pattern, symbol, line, detail and confidence of the matches in one Go file."""
    src = code(text)
    package = m[1] if (m := re.search(r"(?m)^package\s+(\w+)", src)) else ""
    line = lambda at: src.count("\n", 0, at) + 1
    funcs = []
    for m in _FUNC.finditer(src):
        if span := _body(src, m.end()):
            owner = m[1] if m[1] and not m[2] else package
            funcs.append((m.start(), span, f"{owner}.{m[3]}"))
    calls = re.compile(rf"\b(\w+)((?:\s*\.\s*\w+)*?)\s*\.\s*({'|'.join(names.append)})\s*\(")
    for m in calls.finditer(src):
        chain = [m[1], *re.findall(r"\w+", m[2])]
        if chain[-1].lower() != "outbox":
            continue
        chained = len(chain) > 1 or src[: m.start()].rstrip().endswith(".")
        inside = next((name for start, (_, end), name in funcs if start <= m.start() < end), None)
        yield "outbox-append", inside or f":L{line(m.start())}", line(m.start()), f"calls {chain[-1]}.{m[3]}", 1.0 if chained else 0.85
    for m in _STRUCT.finditer(src):
        if any(a <= m.start() < b for _, (a, b), _ in funcs):
            continue
        for field in re.split(r"[\n;]", src[m.end() : _end(src, m.end() - 1) - 1]):
            got = re.fullmatch(r"\s*\*?\s*(?:(\w+)\s*\.\s*)?(\w+)\s*", field)
            if got and got[2] in names.recorder:
                what = f"{got[1]}.{got[2]}" if got[1] else got[2]
                yield "event-recorder-embed", m[1], line(m.start(1)), f"embeds {what}", 1.0 if got[1] else 0.95
                break
    call = re.compile(rf"\.\s*({'|'.join(names.unit_of_work)})\s*\(")
    has = lambda wanted, a, b: re.search(rf"\.\s*(?:{'|'.join(wanted)})\s*\(", src[a:b]) is not None
    for start, (a, b), name in funcs:
        at = a
        while m := call.search(src, at, b):
            at, end = m.end(), _end(src, m.end() - 1)
            inner = _closure(src, m.end() - 1, end)
            if inner and has(names.save, *inner) and has(names.append, *inner):
                yield "canonical-service", name, line(start), f"{m[1]} closure has both repo.Save and outbox.Append", 1.0
                at = end  # what lies in a match is not told again


def pattern_matches(files: DataFrame, names: Names = Names()) -> DataFrame:
    """Matches in Go files (file_path, text): pattern, symbol (receiver or package and name; a call outside of functions: the
    file and line), line, detail and confidence. Null texts have none."""
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *m) for p, t in zip(pdf["file_path"], pdf["text"]) for m in matches(t or "", names)]
            yield pd.DataFrame([(p, k, f"{p}{s}" if s.startswith(":") else s, n, d, c) for p, k, s, n, d, c in rows], columns=columns)

    return files.filter(F.col("file_path").endswith(".go")).select("file_path", "text").mapInPandas(parse, SCHEMA)
