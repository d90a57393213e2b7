"""Predicates on repository paths, as column expressions. The two notions of a test file are kept apart on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the path rules.
CODE_SUFFIXES = [".bash", ".c", ".cc", ".cpp", ".cs", ".cxx", ".fish", ".go", ".h", ".hpp", ".java", ".js", ".jsx", ".kt", ".kts", ".m", ".mm", ".php", ".proto", ".py", ".pyi", ".rb", ".rs", ".scala", ".sh", ".swift", ".ts", ".tsx", ".zsh"]
NOISE_PARTS = [".github", ".idea", ".vscode", "benchmark", "benchmarks", "changelog", "changelogs", "doc", "docs", "documentation", "examples", "licenses", "node_modules", "snapshot", "snapshots", "template", "templates", "vendor"]
NOISE_NAMES = ["changelog", "changelog.md", "contributing.md", "license", "license.md", "readme", "readme.md"]
TEST_PARTS = ["__tests__", "test", "testdata", "testing", "tests", "testsuite", "testsuites"]
TEST_NAME_ENDS = ["_test.go", "_test.py", "_test.rs", "_test.cc", "_test.cpp", ".spec.js", ".spec.jsx", ".spec.ts", ".spec.tsx", ".test.js", ".test.jsx", ".test.ts", ".test.tsx", "test.java", "tests.java"]
GENERATED_PARTS = ["dist/", "build/", "vendor/", "third_party/", "node_modules/", "target/", ".tox/", ".venv/"]
GENERATED_ENDS = [".lock", ".min.js", ".map", ".snap", ".snapshot", ".pb.go", ".generated.go", ".g.cs"]
LOCK_NAMES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "Pipfile.lock", "Cargo.lock", "Gemfile.lock", "go.sum"]
CHANGED_TEST_PARTS = ["test", "tests", "__tests__", "testing", "testdata", "testsuite", "testsuites", "spec", "specs", "it", "integration-test", "integration-tests"]
CHANGED_TEST_PATTERNS = [r"(?i)(^|[_\-.])(test|spec)([_\-.]|$)", r"(?i)(test|spec)\.(py|ts|tsx|js|jsx|java|go|rs)$", r"(?i)(_test\.go|_test\.rs)$", r"(Test|Tests)\.java$"]
SOURCE_SUFFIXES = [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".rs", ".kt", ".scala"]


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dot of the name and what follows it; empty for dot files and names without one."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1)


def _any(test, values: list[str]) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(F.lit(v))
    return out


def _parts_hit(path: Column, parts: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(p) for p in parts]))


def is_noise_path(path: Column) -> Column:
    p = slashes(path)
    name = F.lower(basename(p))
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")
    return _parts_hit(p, NOISE_PARTS) | name.isin(NOISE_NAMES) | stem.isin(NOISE_NAMES)


def is_code_path(path: Column) -> Column:
    return (path != "") & ~is_noise_path(path) & F.lower(suffix(path)).isin(CODE_SUFFIXES)


def is_test_path(path: Column) -> Column:
    """A test by folder or name, among code files."""
    p = F.lower(slashes(path))
    name = basename(p)
    named = name.startswith("test_") | _any(name.endswith, TEST_NAME_ENDS)
    return (path != "") & (_parts_hit(p, TEST_PARTS) | named) & F.lower(suffix(path)).isin(CODE_SUFFIXES)


def is_generated(path: Column) -> Column:
    p = slashes(path)
    return basename(p).isin(LOCK_NAMES) | _any(p.contains, GENERATED_PARTS) | _any(p.endswith, GENERATED_ENDS)


def is_changed_test(path: Column) -> Column:
    """A test among the files of a change: also specs and integration folders, any suffix."""
    p = slashes(path)
    named = F.lower(basename(p)).startswith("test_")
    for x in CHANGED_TEST_PATTERNS:
        named = named | p.rlike(x)
    return ~is_generated(path) & (_parts_hit(p, CHANGED_TEST_PARTS) | named)


def is_changed_source(path: Column) -> Column:
    return suffix(path).isin(SOURCE_SUFFIXES) & ~is_generated(path)


def change_role(path: Column) -> Column:
    """generated, test, source or other: how a changed file is taken."""
    return F.when(is_generated(path), "generated").when(is_changed_test(path), "test").when(is_changed_source(path), "source").otherwise("other")


def passes(path: Column, candidate_filter: str) -> Column:
    """Whether a file is a candidate under all_files, code_only or tests_only."""
    if candidate_filter == "all_files":
        return F.lit(True)
    if candidate_filter == "code_only":
        return is_code_path(path)
    if candidate_filter == "tests_only":
        return is_test_path(path)
    raise ValueError(f"unknown candidate filter {candidate_filter!r}")
