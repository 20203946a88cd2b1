"""Column functions on paths, names and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def is_test_path(path: Column, loose: bool = False) -> Column:
    """Whether a path is a test's: below a ``tests`` or ``test`` folder, ``conftest.py``, ``test_*.py`` or ``*_test.py``.

    ``loose`` also takes any path component that starts with ``test_``, whatever its extension.
    """
    strict = path.rlike(r"(^|/)tests?/|(^|/)conftest\.py$|(^|/)test_[^/]*\.py$|_test\.(py|go)$")
    return strict | path.rlike(r"(^|/)test_") if loose else strict


def bc_path(path: Column) -> Column:
    """The bounded context folder ``src/contexts/<name>`` of a path, else null."""
    found = F.regexp_extract(path, r"^(src/contexts/[^/]+)/", 1)
    return F.when(found != "", found)


def framework_of(path: Column) -> Column:
    """Test framework guessed from a report's file name; the order of the tests matters."""
    name = F.lower(basename(path))
    out = F.when(name.contains("playwright"), "playwright").when(name.contains("vitest"), "vitest").when(name.contains("jest"), "jest")
    return out.when(name.contains("maestro"), "maestro").otherwise("go-test")


#: Folder names that say nothing about a feature, and endings that name a test, for each framework.
NOISE = {
    "playwright": ["e2e", "tests", "test", "specs", "spec", ".", ""],
    "vitest": ["src", "lib", "test", "tests", "__tests__", ".", ""],
}
SUFFIX = {"playwright": r"\.(spec|test)\.(tsx|ts|js)$", "vitest": r"\.(test|spec)\.(tsx|ts|jsx|js)$"}


def feature_of_path(path: Column, framework: str) -> Column:
    """``folder.file`` of a test file: the last folder that is no noise, else the file alone; empty path: empty."""
    stem = F.lower(F.regexp_replace(basename(path), SUFFIX[framework], ""))
    folders = F.transform(F.split(dirname(path), "/"), F.lower)
    telling = F.filter(folders, lambda x: ~x.isin(NOISE[framework]))
    return F.when(path == "", "").otherwise(F.when(F.size(telling) > 0, F.concat_ws(".", F.element_at(telling, -1), stem)).otherwise(stem))


def feature_of_flow(name: Column, file: Column) -> Column:
    """The first two words of a flow's file (or else its name), joined by a dot."""
    stem = F.when(F.coalesce(file, F.lit("")) != "", F.regexp_replace(basename(file), r"\.ya?ml$", "")).otherwise(name)
    parts = F.filter(F.split(F.lower(stem), r"[-_ .]"), lambda x: x != "")
    return F.array_join(F.slice(parts, 1, 2), ".")


def feature_id(text: Column) -> Column:
    """A feature id made of any text: lower case, other characters to dots, dots folded and trimmed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_.]", "."), r"\.+", "."), F.lit("."))


#: What a package folder's name contains if it is of a layer, in the order tried; nothing fits: service.
LAYER_HINTS = {"handler": ["handler", "resolver"], "repository": ["persistence", "repository"], "service": ["service"], "query": ["generated"]}


def layer_of_dir(folder: Column, rules: dict[str, list[str]] | None = None) -> Column:
    """Layer of a package folder by what its name contains: configured rules first, then the defaults."""
    name, tests = F.lower(folder), []
    for hints in (rules or {}, LAYER_HINTS):
        tests += [(layer, h.lower()) for layer in LAYER_HINTS for h in hints.get(layer, [])]
    out = F.when(name.contains(tests[0][1]), tests[0][0])
    for layer, h in tests[1:]:
        out = out.when(name.contains(h), layer)
    return out.otherwise("service")


def status_percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent; nothing of nothing is 0."""
    return F.when(whole > 0, part * 100.0 / whole).otherwise(0.0)
