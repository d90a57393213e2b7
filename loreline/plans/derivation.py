"""Samples derived from the corpus' own changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions import text
from loreline.operators import analysis, derivation, graph, grep, samples
from loreline.operators.snapshots import file_changes
from loreline.plans.analysis import _FLAGS, _with_fixes
from loreline.plans.data_quality import P1_SQL
from loreline.plans.retrieval import SAMPLES_SQL, TOKENS, code_sql, test_sql
from loreline.plans.scalars import _CHANGED_SOURCE, _CHANGED_TEST
from loreline.plans.search import _GREP, _Q, _STOP, PATTERNS_SQL
from loreline.sources.tables import table


def _telling(spark: SparkSession, folder: str) -> DataFrame:
    """Samples whose queries, by their ids, end in the path, the name or the stem of their first gold file, or in the fixing commit."""
    s = _with_fixes(spark, folder).filter(F.size("gold_files") > 0)
    path = F.col("gold_files")[0]
    name = F.element_at(F.split(path, "/"), -1)
    d = F.conv(F.substring("sample_id", -1, 1), 16, 10).cast("int")
    hint = F.when(d < 4, path).when(d < 8, name).when(d < 12, F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")).otherwise(F.coalesce("fix_commit", F.lit("")))
    return s.withColumn("query_text", F.concat(F.coalesce("query_text", F.lit("")), F.lit(" `"), hint, F.lit("`")))


def leak_flags(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.leak_flags(_telling(spark, folder))


def redacted_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _telling(spark, folder).select("sample_id", derivation.redact(F.col("query_text"), F.col("gold_files"), F.col("fix_commit")).alias("query_text"))


def derived_samples(spark: SparkSession, folder: str) -> DataFrame:
    s = _telling(spark, folder).filter("repo is not null")
    return derivation.build_samples(s, "comment2context", ["sample_id"]).select("id", F.col("version").cast("long").alias("version"), "task_type", "repo", "base_commit", "query_text", F.array_join("gold_files", "|").alias("gold_files"))


def rank_grep(spark: SparkSession, folder: str) -> DataFrame:
    """Pattern ranking of queries that name something of the corpus."""
    s = _telling(spark, folder).dropna(subset=["repo", "base_commit"])
    r = grep.rank_files(s, samples.snapshot_chunks(table(spark, folder, "chunks"), s))
    return r.select("sample_id", "path", F.col("rank").cast("long").alias("rank"), "matched", "hit_chunks", F.round("score", 6).alias("score"))


def trace_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a repository's corpus that a trace names: the paths of its symbols, as a run elsewhere would print them."""
    c = table(spark, folder, "chunks").filter("path <> ''")
    log = F.concat(F.lit("  at /work/"), "path", F.lit(":12"))
    traces = c.filter("kind = 'symbol'").select("repo", log.alias("log")).distinct().select("repo", F.explode(text.trace_paths(F.col("log"))).alias("path")).distinct()
    return derivation.match_traces(traces, c.filter("kind = 'file'"), ["repo"]).select("repo", "path", "file").distinct()


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return file_changes(table(spark, folder, "chunks"), table(spark, folder, "corpus_manifest"))


def related_changes(spark: SparkSession, folder: str) -> DataFrame:
    r = derivation.related_changes(_changes(spark, folder), ["repo", "base_commit"])
    return r.select("repo", "base_commit", "anchor", "path", F.array_join("signals", "|").alias("signals"), F.col("place").cast("long").alias("place"))


def context_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """For each file of a snapshot that the next one changes, the other changed files that may be its context."""
    changed = _changes(spark, folder).filter("change = 'changed'").select("repo", F.col("prev_commit").alias("base_commit"), "path")
    given = changed.withColumnRenamed("path", "given").withColumn("sample_id", F.concat_ws("|", "repo", "base_commit", "given"))
    c = derivation.context_candidates(given, changed).join(given.select("sample_id", "given"), "sample_id")
    e = derivation.evidence(F.col("path"), F.col("given"), F.lit(None).cast("string"))
    return c.select("sample_id", "path", F.col("place").cast("long").alias("place"), F.array_join(e, "|").alias("evidence"))


def _linked(spark: SparkSession, folder: str) -> DataFrame:
    """The files of the corpus as a chain: each imports the next one of its snapshot by its path without suffix."""
    from pyspark.sql import Window

    f = samples.current_chunks(table(spark, folder, "chunks")).filter("kind = 'file' and path <> ''").select("repo", "base_commit", "path").distinct()
    nxt = F.lead("path").over(Window.partitionBy("repo", "base_commit").orderBy("path"))
    return f.withColumn("text", F.concat(F.lit("// import 'no/comment'\nconst x = require('"), F.regexp_replace(nxt, r"(?<=[^/.])\.[^./]+$", ""), F.lit("');\n")))


def import_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.import_edges(_linked(spark, folder))


def source_test_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Every source of the corpus and a test made for it, as the graph pairs them."""
    from loreline.functions.paths import is_code_path, is_test_path

    p = F.col("path")
    f = samples.current_chunks(table(spark, folder, "chunks")).filter("kind = 'file'").filter(is_code_path(p) & ~is_test_path(p)).select("repo", "base_commit", "path").distinct()
    made = f.select("repo", "base_commit", F.concat(F.lit("tests/"), F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"^(.*)(\.[^.]*)$", "test_$1$2")).alias("path"))
    return graph.test_links(f.unionByName(made).distinct())


def search_patterns_expanded(spark: SparkSession, folder: str) -> DataFrame:
    s = samples.current_samples(table(spark, folder, "comment2context")).dropna(subset=["repo", "base_commit", "query_text"])
    return grep.patterns(s, expanded=True).select("sample_id", "term", "kind", "weight")


_HINT = "CASE WHEN d < 4 THEN gp WHEN d < 8 THEN nm WHEN d < 12 THEN regexp_replace(nm, '([^.])\\.[^.]*$', '\\1') ELSE coalesce(fix0, '') END"
_DIGIT = "CAST('0x' || right(sample_id, 1) AS INTEGER)"
_TELL = SAMPLES_SQL.replace("{filter}", "true").replace("every AS (", "every0 AS (").replace("samples AS (SELECT * FROM every WHERE", f"""fx0 AS (SELECT id, gold.fix_commit AS fix0 FROM now),
every1 AS (SELECT e.*, fix0, gold_files[1] AS gp, string_split(gold_files[1], '/')[-1] AS nm, {_DIGIT} AS d FROM every0 e JOIN fx0 ON fx0.id = e.sample_id WHERE len(gold_files) > 0),
every AS (SELECT * REPLACE (coalesce(query_text, '') || ' `' || {_HINT} || '`' AS query_text) FROM every1),
samples AS (SELECT * FROM every WHERE""")
_REDACTED = """red AS (SELECT sample_id, repo, base_commit, gold_files, fix0, list_reduce(list_concat([query_text], list_sort(list_transform(gold_files, lambda p: lpad(CAST(100000 - length(p) AS VARCHAR), 6, '0') || p))), lambda t, k: replace(t, substr(k, 7), '[context_file]')) AS t FROM every),
redd AS (SELECT *, CASE WHEN coalesce(fix0, '') <> '' THEN replace(t, fix0, '[fix_commit]') ELSE t END AS q FROM red)"""
_GEN = "[" + ", ".join(f"'{t}'" for t in graph.GENERIC) + "]"
_TT = lambda c: f"list_distinct(list_filter({TOKENS.replace('{0}', c)}, lambda t: length(t) >= 3 AND NOT list_contains({_GEN}, t)))"
_DIR = lambda c: f"regexp_extract({c}, '^(.*)/[^/]*$', 1)"
_BASE = lambda c: f"string_split({c}, '/')[-1]"
_ROLES = f"ch AS (SELECT DISTINCT repo, prev_commit, base_commit, path, change, {_CHANGED_TEST} AS test, {_CHANGED_SOURCE} AS source FROM found WHERE change IS NOT NULL)"
_SHARED = f"list_has_any({_TT('p.path')}, {_TT('a.path')})"

ORACLE = {
    "leak_flags": _TELL + _FLAGS + " SELECT * FROM flags",
    "redacted_queries": _TELL + _REDACTED + " SELECT sample_id, q AS query_text FROM redd",
    "derived_samples": _TELL + _REDACTED + " SELECT substr(sha256(concat_ws(chr(31), repo, 'comment2context', sample_id)), 1, 24) AS id, 1 AS version, 'comment2context' AS task_type, repo, base_commit, q AS query_text, array_to_string(gold_files, '|') AS gold_files FROM redd WHERE repo IS NOT NULL",
    "rank_grep": _GREP.replace(SAMPLES_SQL.replace("{filter}", "true"), _TELL) + "SELECT sample_id, path, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, matched DESC, round(best, 9) DESC, path) AS rank, matched, hit_chunks, round(score, 6) AS score FROM (SELECT sample_id, path, total + least(2.0, ln(1 + hit_chunks) * 0.25) AS score, matched, best, hit_chunks FROM pp JOIN pc USING (sample_id, path))",
    "trace_files": "WITH e AS (SELECT DISTINCT repo, unnest(regexp_extract_all('  at /work/' || path || ':12', '" + text.TRACE_PATH.replace("'", "''") + "', 1)) AS path FROM chunks WHERE kind = 'symbol' AND path <> ''), t AS (SELECT * FROM e WHERE NOT (contains(path, 'site-packages/') OR contains(path, 'node_modules/') OR contains(path, '/.cargo/'))), f AS (SELECT DISTINCT repo, path AS file, string_split(path, '/')[-1] AS nm FROM chunks WHERE kind = 'file' AND path <> '') SELECT DISTINCT t.repo, t.path, file FROM t JOIN f ON f.repo = t.repo AND nm = string_split(t.path, '/')[-1] WHERE ends_with(path, file) OR ends_with(file, path)",
    "related_changes": P1_SQL + f""", {_ROLES}, sm AS (SELECT repo, base_commit FROM ch GROUP BY 1, 2 HAVING count(DISTINCT path) BETWEEN 2 AND 8), r AS (SELECT DISTINCT ch.repo, ch.base_commit, path, test FROM ch JOIN sm ON sm.repo = ch.repo AND sm.base_commit = ch.base_commit WHERE test OR source),
b AS (SELECT a.repo, a.base_commit, a.path AS anchor, p.path, p.test, list_filter([CASE WHEN {_DIR('p.path')} = {_DIR('a.path')} AND NOT p.test THEN 'same_component' END, CASE WHEN {_SHARED} THEN 'path_token_overlap' END, CASE WHEN p.test AND {_SHARED} THEN 'optional_test_ripple' END], lambda x: x IS NOT NULL) AS s FROM r a JOIN r p ON p.repo = a.repo AND p.base_commit = a.base_commit AND p.path <> a.path AND NOT a.test)
SELECT repo, base_commit, anchor, path, array_to_string(s, '|') AS signals, row_number() OVER (PARTITION BY repo, base_commit, anchor ORDER BY test, len(s) DESC, path) AS place FROM b WHERE len(s) > 0 QUALIFY place <= 4""",
    "context_candidates": P1_SQL + f""", {_ROLES}, c AS (SELECT DISTINCT repo, prev_commit, path, test, source FROM ch WHERE change = 'changed'),
b AS (SELECT a.repo || '|' || a.prev_commit || '|' || a.path AS sample_id, a.path AS given, a.test AS gtest, p.path, p.test, {_DIR('p.path')} <> {_DIR('a.path')} AS other, p.test <> a.test AS first FROM c a JOIN c p ON p.repo = a.repo AND p.prev_commit = a.prev_commit AND p.path <> a.path AND (p.test OR p.source)),
k AS (SELECT *, bool_or(other) OVER (PARTITION BY sample_id) AS any_other FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY first DESC, path) AS place FROM k WHERE NOT any_other OR other),
s AS (SELECT *, list_has_any({_TT(_BASE('path'))}, {_TT(_BASE('given'))}) AS shared, len(string_split(path, '/')) > 2 AND len(string_split(given, '/')) > 2 AND list_slice(string_split(path, '/'), 1, 2) = list_slice(string_split(given, '/'), 1, 2) AS module FROM r WHERE place <= 2)
SELECT sample_id, path, place, coalesce(array_to_string(list_filter([CASE WHEN shared THEN 'shared_words' END, CASE WHEN module OR shared THEN 'same_module' END, CASE WHEN test AND NOT gtest AND shared THEN 'tests_it' END], lambda x: x IS NOT NULL), '|'), '') AS evidence FROM s""",
    "import_edges": "WITH cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1), f AS (SELECT DISTINCT repo, base_commit, path, lower(regexp_replace(path, '([^/.])\\.[^./]+$', '\\1')) AS bare FROM cur WHERE kind = 'file' AND path <> ''), n AS (SELECT repo, base_commit, path AS src, lead(bare) OVER (PARTITION BY repo, base_commit ORDER BY path) AS spec FROM f) SELECT DISTINCT n.repo, n.base_commit, src, f.path AS dst FROM n JOIN f ON f.repo = n.repo AND f.base_commit = n.base_commit AND (f.bare = spec OR ends_with(f.bare, '/' || spec) OR replace(f.bare, '/', '.') = replace(spec, '/', '.')) WHERE src <> f.path",
}
_ST = "lower(regexp_replace(string_split(path, '/')[-1], '([^.])\\.[^.]*$', '\\1'))"
for _e in ("_test$", "test$", "tests$", "\\.test$", "\\.spec$", "_spec$", "^test_", "^tests_"):
    _ST = f"regexp_replace({_ST}, '{_e}', '')"
_ST = f"regexp_replace({_ST}, '[^a-z0-9]+', '', 'g')"
_MARK = "[" + ", ".join(f"'{t}'" for t in graph.TEST_MARKERS) + "]"
ORACLE["source_test_edges"] = f"""WITH cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1), c AS (SELECT DISTINCT repo, base_commit, path FROM cur WHERE kind = 'file' AND {code_sql()} AND NOT {test_sql()}),
a AS (SELECT * FROM c UNION SELECT repo, base_commit, 'tests/' || regexp_replace(string_split(path, '/')[-1], '^(.*)(\\.[^.]*)$', 'test_\\1\\2') FROM c),
k AS (SELECT repo, base_commit, path, CASE WHEN {test_sql()} THEN 'test' WHEN {code_sql()} THEN 'source' END AS role, {_ST} AS stem, list_filter(string_split(lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), '/'), lambda x: x <> '' AND NOT list_contains({_MARK}, x))[-1] AS module FROM a),
y AS (SELECT repo, base_commit, path, role, unnest(list_filter([stem, module || ':' || stem], lambda x: x IS NOT NULL)) AS key FROM k WHERE role IS NOT NULL AND length(stem) >= 3),
f AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY repo, base_commit, key, role ORDER BY path) <= 20)
SELECT s.repo, s.base_commit, s.path AS src, t.path AS dst, count(*) AS n FROM f s JOIN f t ON t.repo = s.repo AND t.base_commit = s.base_commit AND t.key = s.key WHERE s.role = 'source' AND t.role = 'test' GROUP BY ALL"""
_EXP = f"""UNION ALL SELECT sample_id, repo, base_commit, 5, 1.0, unnest(list_filter({TOKENS.replace('{0}', _Q)}, lambda x: length(x) >= 4 AND NOT list_contains({_STOP}, x))) FROM samples),
kinds AS ("""
ORACLE["search_patterns_expanded"] = SAMPLES_SQL.replace("{filter}", "true") + PATTERNS_SQL.replace("),\nkinds AS (", " " + _EXP, 1).replace("WHEN 3 THEN 'flag'", "WHEN 3 THEN 'flag' WHEN 5 THEN 'token'") + "SELECT sample_id, term, kind, CAST(weight AS DOUBLE) AS weight FROM pats"
_ALL = [leak_flags, redacted_queries, derived_samples, rank_grep, trace_files, related_changes, context_candidates, import_edges, source_test_edges, search_patterns_expanded]
QUERIES = {f.__name__: f for f in _ALL}
