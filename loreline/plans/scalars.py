"""Scalar functions and predicates over documents, chunks and samples, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions import paths, text
from loreline.operators.samples import current_samples
from loreline.plans.retrieval import BUDGET_TOKENS, SAMPLES_SQL, SUFFIX_SQL, TOKENS, code_sql, test_sql
from loreline.sources.tables import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter(F.col("text").isNotNull())


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("path").filter(F.col("path").isNotNull()).distinct()


def tokenize_lexical(spark: SparkSession, folder: str) -> DataFrame:
    tokens = text.tokenize(F.col("text"))
    return _docs(spark, folder).select("doc_id", F.size(tokens).cast("long").alias("tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("distinct_tokens"))


def token_count_budget(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", text.count_budget_tokens(F.col("text")).cast("long").alias("tokens"))


def stable_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", text.stable_id(F.col("repo"), F.col("base_commit"), F.col("path"), F.col("kind"), F.col("start_line")).alias("stable_id")).distinct()


def truncated_texts(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).select("doc_id", text.truncate(F.col("text"), 500).alias("short"))


def path_predicates(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("path")
    return _files(spark, folder).select("path", paths.is_code_path(p).alias("code"), paths.is_test_path(p).alias("test"), paths.is_noise_path(p).alias("noise"), paths.is_generated(p).alias("generated"), paths.is_changed_test(p).alias("changed_test"), paths.is_changed_source(p).alias("changed_source"), paths.suffix(p).alias("suffix"))


def split_changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """How many files of each snapshot are sources, tests or neither, as the files of a change would be taken."""
    files = table(spark, folder, "chunks").filter("kind = 'file'").select("repo", "base_commit", "path").distinct()
    role = paths.change_role(F.col("path"))
    return files.groupBy("repo", "base_commit").agg(F.count_if(role == "source").alias("sources"), F.count_if(role == "test").alias("tests"), F.count_if(role.isin("generated", "other")).alias("ignored"))


def text_markers(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, folder).select("doc_id", text.has_patch_marker(t).alias("patch"), text.has_review_leak(t).alias("review_leak"), text.has_failure_signal(t).alias("failure"), text.is_setup_noise(t).alias("setup_noise"))


def ignored_checks(spark: SparkSession, folder: str) -> DataFrame:
    return _docs(spark, folder).groupBy("kind").agg(F.count_if(text.is_ignored_check(F.col("path"), F.col("text"))).alias("ignored"), F.count(F.lit(1)).alias("texts"))


def trace_paths(spark: SparkSession, folder: str) -> DataFrame:
    logs = _docs(spark, folder).filter(F.col("kind").isin("failure_log", "issue"))
    return logs.select("doc_id", F.explode(text.trace_paths(F.col("text"))).alias("path"))


def sanitized_hunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "comment2context").filter(F.col("query.diff_hunk_context").isNotNull()).select("id", "version", F.col("query.diff_hunk_context").alias("h")).distinct()
    return rows.select("id", "version", text.without_changes(F.col("h")).alias("hunk")).distinct()


def query_leakage(spark: SparkSession, folder: str) -> DataFrame:
    """Which queries give their answer away: a raw patch, the fixing commit, the path or the name of a gold file."""
    samples = current_samples(table(spark, folder, "comment2context"))
    fixes = table(spark, folder, "comment2context").groupBy(F.col("id").alias("sample_id")).agg(F.max_by("gold.fix_commit", "version").alias("fix"))
    q = F.col("query_text")
    hit = lambda f: F.exists("gold_files", f)
    return samples.filter(q.isNotNull()).join(fixes, "sample_id").select("sample_id", text.has_patch_marker(q).alias("patch"), F.coalesce((F.length("fix") > 0) & q.contains(F.col("fix")), F.lit(False)).alias("fix_commit"), hit(lambda p: F.lower(q).contains(F.lower(p))).alias("gold_path"), hit(lambda p: F.lower(q).contains(F.lower(F.element_at(F.split(p, "/"), -1)))).alias("gold_name"))


def sample_errors(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with each sample: rules that it breaks, in order."""
    s = current_samples(table(spark, folder, "comment2context"))
    rule = lambda cond, name: F.when(cond, F.lit(name))
    commit = F.coalesce("base_commit", F.lit(""))
    errors = F.array_compact(F.array(rule(F.coalesce("repo", F.lit("")) == "", "missing repo"), rule(~commit.rlike("^[0-9a-f]{40}$"), "bad base_commit"), rule(F.trim(F.coalesce("query_text", F.lit(""))) == "", "empty query"), rule(F.size("gold_files") == 0, "no gold"), rule(F.size(F.array_intersect("gold_files", "hard_negatives")) > 0, "gold among negatives"), rule(F.exists("gold_spans", lambda x: ~F.array_contains("gold_files", x["path"])), "span outside gold")))
    return s.select("sample_id", F.array_join(errors, "; ").alias("errors")).filter("errors <> ''")


_NAME = "string_split(replace(path, '\\', '/'), '/')[-1]"
_LIST = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]"
_GENERATED = f"(list_contains({_LIST(paths.LOCK_NAMES)}, {_NAME}) OR " + " OR ".join(f"contains(replace(path, '\\', '/'), '{x}')" for x in paths.GENERATED_PARTS) + " OR " + " OR ".join(f"ends_with(replace(path, '\\', '/'), '{x}')" for x in paths.GENERATED_ENDS) + ")"
_CHANGED_TEST = f"(NOT {_GENERATED} AND (list_has_any(string_split(lower(replace(path, '\\', '/')), '/'), {_LIST(paths.CHANGED_TEST_PARTS)}) OR starts_with(lower({_NAME}), 'test_') OR " + " OR ".join(f"regexp_matches(replace(path, '\\', '/'), '{x}')" for x in paths.CHANGED_TEST_PATTERNS) + "))"
_CHANGED_SOURCE = f"(list_contains({_LIST(paths.SOURCE_SUFFIXES)}, {SUFFIX_SQL.format('path')}) AND NOT {_GENERATED})"
_NOISE = f"(list_has_any(string_split(lower(replace(path, '\\', '/')), '/'), {_LIST(paths.NOISE_PARTS)}) OR list_contains({_LIST(paths.NOISE_NAMES)}, lower({_NAME})) OR list_contains({_LIST(paths.NOISE_NAMES)}, regexp_replace(lower({_NAME}), '([^.])\\.[^.]+$', '\\1')))"
_FAILURE = "regexp_matches(replace(text, '\\n', chr(10)), '(?i)" + "|".join(text.FAILURE_SIGNALS) + "')"
_LOW = "lower(replace(text, chr(13) || chr(10), chr(10)))"

ORACLE = {
    "tokenize_lexical": f"SELECT doc_id, len({TOKENS.format('text')}) AS tokens, len(list_distinct({TOKENS.format('text')})) AS distinct_tokens FROM documents WHERE text IS NOT NULL",
    "token_count_budget": f"SELECT doc_id, {BUDGET_TOKENS.replace('{0}', 'text')} AS tokens FROM documents WHERE text IS NOT NULL",
    "stable_ids": "SELECT DISTINCT chunk_id, substr(sha256(concat_ws(chr(31), coalesce(repo, 'None'), coalesce(base_commit, 'None'), coalesce(path, 'None'), coalesce(kind, 'None'), coalesce(CAST(start_line AS VARCHAR), 'None'))), 1, 24) AS stable_id FROM chunks",
    "truncated_texts": r"WITH t AS (SELECT doc_id, regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN length(t) <= 500 THEN t ELSE regexp_replace(substr(t, 1, 500), '[ \t\n\x0B\f\r]+$', '') || chr(10) || '...[truncated]' END AS short FROM t",
    "path_predicates": f"SELECT DISTINCT path, {code_sql()} AS code, {test_sql()} AS test, {_NOISE} AS noise, {_GENERATED} AS generated, {_CHANGED_TEST} AS changed_test, {_CHANGED_SOURCE} AS changed_source, {SUFFIX_SQL.format('path')} AS suffix FROM chunks WHERE path IS NOT NULL",
    "split_changed_files": f"WITH f AS (SELECT DISTINCT repo, base_commit, path FROM chunks WHERE kind = 'file') SELECT repo, base_commit, count(*) FILTER (WHERE {_CHANGED_SOURCE} AND NOT {_CHANGED_TEST}) AS sources, count(*) FILTER (WHERE {_CHANGED_TEST}) AS tests, count(*) FILTER (WHERE NOT {_CHANGED_TEST} AND NOT {_CHANGED_SOURCE}) AS ignored FROM f GROUP BY 1, 2",
    "text_markers": f"SELECT doc_id, regexp_matches(replace(text, '\\n', chr(10)), '{text.PATCH_MARKER}') AS patch, " + " OR ".join(f"contains({_LOW}, '{m}')" for m in text.REVIEW_LEAKS) + f" AS review_leak, {_FAILURE} AS failure, (" + " OR ".join(f"contains(lower(text), '{m}')" for m in text.SETUP_MARKERS) + f") AND NOT {_FAILURE} AS setup_noise FROM documents WHERE text IS NOT NULL",
    "ignored_checks": "SELECT kind, count(*) FILTER (WHERE " + " OR ".join(f"contains(lower(coalesce(path, '') || chr(10) || text), '{m}')" for m in text.IGNORED_CHECKS) + ") AS ignored, count(*) AS texts FROM documents WHERE text IS NOT NULL GROUP BY kind",
    "trace_paths": "WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '" + text.TRACE_PATH.replace("'", "''") + "', 1)) AS p FROM documents WHERE text IS NOT NULL AND kind IN ('failure_log', 'issue')), n AS (SELECT doc_id, replace(p, '\\', '/') AS path FROM e) SELECT DISTINCT doc_id, path FROM n WHERE NOT (contains(path, 'site-packages/') OR contains(path, 'node_modules/') OR contains(path, '/.cargo/'))",
    "sanitized_hunks": "SELECT DISTINCT id, version, array_to_string(list_transform(list_slice(list_filter(string_split(replace(query.diff_hunk_context, chr(13) || chr(10), chr(10)), chr(10)), lambda x: NOT regexp_matches(x, '^[+-]')), 1, 16), lambda x: substr(x, 1, 240)), chr(10)) AS hunk FROM comment2context WHERE query.diff_hunk_context IS NOT NULL",
    "query_leakage": SAMPLES_SQL.replace("{filter}", "true") + f"fx AS (SELECT id, gold.fix_commit AS fix FROM now) SELECT e.sample_id, regexp_matches(replace(query_text, '\\n', chr(10)), '{text.PATCH_MARKER}') AS patch, coalesce(length(fix) > 0 AND contains(query_text, fix), false) AS fix_commit, len(list_filter(gold_files, lambda p: contains(lower(query_text), lower(p)))) > 0 AS gold_path, len(list_filter(gold_files, lambda p: contains(lower(query_text), lower(string_split(p, '/')[-1])))) > 0 AS gold_name FROM every e JOIN fx ON fx.id = e.sample_id WHERE query_text IS NOT NULL",
    "sample_errors": SAMPLES_SQL.replace("{filter}", "true") + "x AS (SELECT sample_id, array_to_string(list_filter([CASE WHEN coalesce(repo, '') = '' THEN 'missing repo' END, CASE WHEN NOT regexp_matches(coalesce(base_commit, ''), '^[0-9a-f]{40}$') THEN 'bad base_commit' END, CASE WHEN trim(coalesce(query_text, '')) = '' THEN 'empty query' END, CASE WHEN len(gold_files) = 0 THEN 'no gold' END, CASE WHEN list_has_any(gold_files, hard_negatives) THEN 'gold among negatives' END, CASE WHEN len(list_filter(gold_spans, lambda s: coalesce(s.path, '') <> '' AND s.start_line IS NOT NULL AND s.end_line IS NOT NULL AND NOT list_contains(gold_files, s.path))) > 0 THEN 'span outside gold' END], lambda e: e IS NOT NULL), '; ') AS errors FROM every) SELECT * FROM x WHERE errors <> ''",
}
_ALL = [tokenize_lexical, token_count_budget, stable_ids, truncated_texts, path_predicates, split_changed_files, text_markers, ignored_checks, trace_paths, sanitized_hunks, query_leakage, sample_errors]
QUERIES = {f.__name__: f for f in _ALL}
