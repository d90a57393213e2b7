"""Functions on texts, as column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How texts are split into tokens and what marks them.
LEXICAL_TOKEN = "[A-Za-z0-9]+"
BUDGET_TOKEN = r"(?U)[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_\s]"
PATCH_MARKER = r"diff --git\b|(^|\n)(---\s+(?:a/|/dev/null)|\+\+\+\s+(?:b/|/dev/null))"
TRACE_PATH = r"(?i)((?:[A-Za-z]:)?[^\s:'\"]+\.(?:py|js|jsx|ts|tsx|java|go|rs|kt|scala))[\"']?(?::|, line |\()"
REVIEW_LEAKS = ["```suggestion", "git --no-pager diff", "<summary>🧩 analysis chain</summary>", "learnings added", "learnings used", "learnt from:", "auto-generated reply by coderabbit"]
FAILURE_SIGNALS = [r"\bFAILED?\s+[^\s]+::[A-Za-z0-9_.$:-]+", r"\bFAIL(?:ED)?\b", r"\bTraceback\b", r"\bAssertionError\b", r"\bRuntimeError\b", r"\bException\b", r"\bpanic\b", r"\bstack backtrace\b", r"\bError Trace:\b", r"\bCaused by\b", r"\bTest:\s*[A-Za-z0-9_.$:-]+", r"\.(?:py|js|jsx|ts|tsx|java|go|rs|kt|scala):\d+"]
SETUP_MARKERS = ["current runner version", "runner image", "hosted compute agent", "actions/cache", "cache hit for:", "setup-python", "version ", "downloaded", "extract downloaded archive", "postinstall", "node_modules", "go: downloading"]
IGNORED_CHECKS = ["dependabot", "codecov", "dco", "developer certificate of origin"]


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits, camel case split, in order."""
    split = F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2")
    return F.transform(F.regexp_extract_all(split, F.lit(LEXICAL_TOKEN), F.lit(0)), F.lower)


def count_budget_tokens(text: Column) -> Column:
    """Identifiers, runs of digits and single other signs."""
    return F.coalesce(F.regexp_count(text, F.lit(BUDGET_TOKEN)), F.lit(0))


def stable_id(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the parts, nulls spelled None."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 24)


def truncate(text: Column, limit: int) -> Column:
    """Trimmed text with LF line ends; beyond limit characters cut there and marked."""
    t = F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), r"^\s+|\s+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"\s+$", ""), F.lit("\n...[truncated]")))


def has_patch_marker(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n")).rlike(PATCH_MARKER)


def has_review_leak(text: Column) -> Column:
    low = F.lower(F.replace(text, F.lit("\r\n"), F.lit("\n")))
    out = F.lit(False)
    for m in REVIEW_LEAKS:
        out = out | low.contains(m)
    return out


def has_failure_signal(text: Column) -> Column:
    return F.replace(text, F.lit("\\n"), F.lit("\n")).rlike("(?i)" + "|".join(FAILURE_SIGNALS))


def is_setup_noise(text: Column) -> Column:
    low, out = F.lower(text), F.lit(False)
    for m in SETUP_MARKERS:
        out = out | low.contains(m)
    return out & ~has_failure_signal(text)


def is_ignored_check(name: Column, signal: Column) -> Column:
    low, out = F.lower(F.concat_ws("\n", F.coalesce(name, F.lit("")), F.coalesce(signal, F.lit("")))), F.lit(False)
    for m in IGNORED_CHECKS:
        out = out | low.contains(m)
    return out


def is_name_only(name: Column, signal: Column) -> Column:
    """Whether a check's signal says no more than its name: empty, the name itself, or one short line without a sign of failure."""
    compact = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    said, named = compact(signal), compact(name)
    return (said == "") | ((named != "") & (said == named)) | (~F.coalesce(signal, F.lit("")).contains("\n") & (F.length(said) < 120) & ~has_failure_signal(said))


def without_fences(body: Column, limit: int = 2200) -> Column:
    """A review's body without proposed changes: fenced diffs and suggestions, patch lines, added and removed lines; cut at limit and marked.

    Whether a line stands in a removed fence depends on the lines before, so these are folded from first to last.
    """
    ls = F.split(F.replace(F.coalesce(body, F.lit("")), F.lit("\r\n"), F.lit("\n")), "\n")
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("inside"))

    def step(state: Column, line: Column) -> Column:
        bare = F.trim(line)
        opens = bare.startswith("```diff") | bare.startswith("```suggestion")
        fence = bare.startswith("```")
        patch = bare.rlike(r"^(?:diff --git|index |--- |\+\+\+ |@@ )") | line.rlike("^[+-]")
        inside = state["inside"]
        keep = ~opens & ~inside & (fence | ~patch)
        return F.struct(F.when(keep, F.concat(state["kept"], F.array(line))).otherwise(state["kept"]).alias("kept"), (opens | (inside & ~fence)).alias("inside"))

    kept = F.array_join(F.aggregate(ls, start, step, lambda s: s["kept"]), "\n")
    t = F.regexp_replace(kept, r"^\s+|\s+$", "")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"\s+$", ""), F.lit("\n...[truncated]")))


def token_prefix(text: Column, most: int) -> Column:
    """The text up to its most-th word or number, marked where something follows; empty for most <= 0."""
    if most <= 0:
        return F.lit("")
    token = r"(?:[A-Za-z_][A-Za-z0-9_]*|[0-9]+)"
    gap = r"(?:[^A-Za-z0-9_]*)"
    n = F.regexp_count(text, F.lit(token))
    return F.when(n <= most, text).otherwise(F.concat(F.regexp_extract(text, f"^(?:{gap}{token}){{{most}}}", 0), F.lit("\n[TRUNCATED]")))


def without_changes(hunk: Column, most_lines: int = 16) -> Column:
    """A diff hunk without its added and removed lines: at most most_lines lines of 240 characters."""
    lines = F.filter(F.split(F.replace(hunk, F.lit("\r\n"), F.lit("\n")), "\n"), lambda x: ~x.rlike("^[+-]"))
    return F.array_join(F.transform(F.slice(lines, 1, most_lines), lambda x: F.substring(x, 1, 240)), "\n")


def trace_paths(text: Column) -> Column:
    """Distinct paths that stand in a failure trace, in order, less those of installed packages."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TRACE_PATH), F.lit(1)), lambda p: F.replace(p, F.lit("\\"), F.lit("/")))
    return F.array_distinct(F.filter(found, lambda p: ~(p.contains("site-packages/") | p.contains("node_modules/") | p.contains("/.cargo/"))))


def distinct_paths(paths: Column) -> Column:
    """Order kept, repeated, null and empty ones dropped; null becomes the empty list."""
    return F.coalesce(F.array_distinct(F.filter(paths, lambda p: p.isNotNull() & (p != ""))), F.array().cast("array<string>"))
