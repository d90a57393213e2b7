"""Building chunks from files, reading samples, and checking both against each other, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions import text
from loreline.operators import chunking, corpus, metrics, samples
from loreline.plans.corpus import _LINES, _NOW, _SYM, _files
from loreline.plans.retrieval import MERGE, SAMPLES_SQL, SUFFIX_SQL
from loreline.plans.scalars import _FAILURE, _GENERATED
from loreline.sources.tables import table

FILE_BYTES, SNAPSHOT_FILES = 2_000, 5


def _current(spark: SparkSession, folder: str) -> DataFrame:
    """The row of the highest version of each sample, whole."""
    t = table(spark, folder, "comment2context").filter("id is not null")
    keep = [c for c in t.columns if c not in ("id", "version")]
    return samples.latest(t, ["id"], ["version"], keep)


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return samples.current_chunks(table(spark, folder, "chunks"))


def file_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of the corpus cut again: chunks by file, kind and lines, with the sizes of their texts."""
    c = chunking.file_chunks(_files(spark, folder))
    return c.select("chunk_id", "repo", "base_commit", "path", "kind", "symbol", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.length("text").cast("long").alias("chars"))


def candidate_paths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").filter("path is not null").select("path").distinct().select("path", chunking.is_candidate_path(F.col("path")).alias("candidate"))


def capped_files(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of each snapshot under small caps: five files of 2,000 bytes."""
    kept, skipped = chunking.capped(_files(spark, folder), FILE_BYTES, SNAPSHOT_FILES)
    n = kept.groupBy("repo", "base_commit").agg(F.count(F.lit(1)).alias("files"), F.max("path").alias("last"))
    return skipped.join(n, ["repo", "base_commit"], "left").select("repo", "base_commit", "skipped_large", F.coalesce("files", F.lit(0)).alias("files"), "last")


def file_text_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of paths, from symbols for those paths of which the file chunk is left out here: every path that begins with a letter before n."""
    c = _chunks(spark, folder).filter("not (kind = 'file' and path < 'n')")
    return chunking.file_texts(c).select("repo", "base_commit", "path", F.md5("text").alias("digest"))


def file_views(spark: SparkSession, folder: str) -> DataFrame:
    v = chunking.file_views(_chunks(spark, folder))
    return v.select("repo", "base_commit", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "chunks", F.md5("text").alias("digest"))


def usable_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.usable_snapshots(table(spark, folder, "corpus_manifest"))


def resume_check(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.resume_check(_chunks(spark, folder), table(spark, folder, "corpus_manifest"))


def gold_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The three notions of gold files, side by side."""
    joined = lambda c: F.array_join(c, "|")
    return _current(spark, folder).withColumn("task_type", F.coalesce("task_type", F.lit("unknown"))).select(F.col("id").alias("sample_id"), joined(samples.gold_files()).alias("target"), joined(samples.gold_files_audited()).alias("audited"), joined(samples.gold_files_related()).alias("related"))


def sample_fields(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder).select(F.col("id").alias("sample_id"), F.array_join(samples.given_files(), "|").alias("given"), samples.provenance().alias("provenance"), F.size(samples.gold_blocks()).cast("long").alias("blocks"))


def query_json(spark: SparkSession, folder: str) -> DataFrame:
    return _current(spark, folder).filter("query is not null").select(F.col("id").alias("sample_id"), samples.query_json(["review_comment", "path", "line", "pr_title", "given_file"], ["implementation_files"]).alias("query"))


def synthetic_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return samples.synthetic_chunks(_current(spark, folder))


def name_only_checks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.is_name_only(F.col("path"), F.col("text")).alias("name_only"))


def review_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Review comments and descriptions of changes without what they propose."""
    return table(spark, folder, "documents").filter("kind in ('review_comment', 'pr_body')").select("doc_id", text.without_fences(F.col("text")).alias("body"))


def token_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", text.token_prefix(F.col("text"), 40).alias("prefix"))


def span_errors(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.span_errors(samples.current_samples(table(spark, folder, "comment2context")), corpus.bounds(table(spark, folder, "chunks"))).distinct()


def repeated_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of samples whose id an earlier version has."""
    k = table(spark, folder, "comment2context").select("id", "version").distinct()
    return chunking.repeated(k, ["id"], ["version"]).select("id", "version", "occurrence")


def annotation_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Samples with their verdicts, and the verdicts of unknown samples."""
    merged, unknown = chunking.merge_annotations(samples.current_samples(table(spark, folder, "comment2context")).select("sample_id"), table(spark, folder, "keep_list").filter("sample_id is not null"))
    return merged.unionByName(unknown.select("sample_id", F.lit("unknown sample").alias("verdict"), F.lit(-1).cast("long").alias("annotations")))


def span_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """How much of its file a sample's gold spans cover."""
    s = samples.current_samples(table(spark, folder, "comment2context"))
    spans = s.select("sample_id", "repo", "base_commit", F.explode("gold_spans").alias("x")).select("sample_id", "repo", "base_commit", "x.path", "x.start_line", "x.end_line")
    merged = metrics.merged_intervals(spans, ["sample_id", "repo", "base_commit", "path"]).groupBy("sample_id", "repo", "base_commit", "path").agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias("evidence_lines"))
    b = corpus.bounds(table(spark, folder, "chunks")).filter("last_line > 0")
    return merged.join(b, ["repo", "base_commit", "path"]).select("sample_id", "path", "evidence_lines", F.col("last_line").cast("long").alias("file_lines"), F.round(F.col("evidence_lines") / F.col("last_line"), 6).alias("ratio"))


_TRUNC = r"regexp_replace(replace({0}, chr(13) || chr(10), chr(10)), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')"
_SHORT = "(CASE WHEN length({0}) <= 8000 THEN length({0}) ELSE length(regexp_replace(substr({0}, 1, 8000), '[ \\t\\n\\x0B\\f\\r]+$', '')) + 15 END)"
_SKIP = "[" + ", ".join(f"'{x}'" for x in chunking.SKIPPED_SUFFIXES) + "]"
_CAND = f"(NOT {_GENERATED} AND NOT list_contains({_SKIP}, lower({SUFFIX_SQL.format('path')})))"
_DL = lambda x: f"list_filter({x}, lambda p, i: p IS NOT NULL AND p <> '' AND list_position({x}, p) = i)"
_NOWS = "WITH now AS (SELECT * FROM comment2context WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1)"
_L = lambda c: f"coalesce({c}, [])"
_CTX = "coalesce(list_transform(gold.must_context_files, lambda m: m.path), [])"
_GOLD = _NOWS + f""", l AS (SELECT id AS sample_id, coalesce(task_type, 'unknown') AS t, coalesce(gold.no_gold, false) AS none, {_DL(_L('gold.files'))} AS f, {_DL(_CTX)} AS c, {_DL(_L('gold.root_cause_files'))} AS r, {_DL(_L('gold.related_tests'))} AS rt, {_DL(_L('gold.supporting_files'))} AS sp,
  coalesce(list_transform(gold_spans, lambda s: s.path), []) AS sn FROM now),
g AS (SELECT *, list_concat(r, rt) AS rr, list_concat(list_concat(sn, f), list_concat(CASE t WHEN 'code2test' THEN rt WHEN 'trace2code' THEN r WHEN 'comment2context' THEN list_concat(r, sp) ELSE list_concat(list_concat(rt, r), sp) END, CASE WHEN t IN ('comment2context', '') THEN c ELSE [] END)) AS rel FROM l)"""
_HEAD = "CASE WHEN none THEN [] WHEN len(f) > 0 THEN f WHEN t = 'code2test' THEN rt WHEN t = 'comment2context' AND len(c) > 0 THEN c "
_J = lambda x: f"coalesce(array_to_string({x}, '|'), '')"
_Q = lambda c: f"to_json({c})"
_MENTIONED = "list_concat(list_concat(list_concat(coalesce(gold.root_cause_files, []), coalesce(gold.related_tests, [])), list_concat(coalesce(gold.supporting_files, []), coalesce(gold.negative_distractors, []))), list_concat(list_concat(" + _CTX + ", coalesce(gold.given_files, [])), coalesce(hard_negative_files, [])))"
_SAID = r"trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"

ORACLE = {
    "file_chunks": f"""WITH {_NOW}, f AS (SELECT repo, base_commit, path, coalesce(text, '') AS text FROM cur WHERE kind = 'file'), fl AS (SELECT repo, base_commit, path, text, {_LINES} AS ls FROM f),
l AS (SELECT repo, base_commit, path, ls, len(ls) AS n, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM fl), s AS (SELECT *, {_SYM} AS symbol FROM l),
e AS (SELECT repo, base_commit, path, symbol, ls, i AS start_line, greatest(i, coalesce(lead(i) OVER (PARTITION BY repo, base_commit, path ORDER BY i), n + 1) - 1) AS end_line FROM s WHERE symbol IS NOT NULL),
c AS (SELECT repo, base_commit, path, 'file' AS kind, '' AS symbol, 1 AS start_line, len(ls) AS end_line, {_TRUNC.format('text')} AS t FROM fl UNION ALL SELECT repo, base_commit, path, 'symbol', symbol, start_line, end_line, {_TRUNC.format("array_to_string(list_slice(ls, start_line, end_line), chr(10))")} FROM e)
SELECT substr(sha256(concat_ws(chr(31), repo, base_commit, path, kind, symbol, CAST(start_line AS VARCHAR), CAST(end_line AS VARCHAR))), 1, 24) AS chunk_id, repo, base_commit, path, kind, symbol, start_line, end_line, {_SHORT.format('t')} AS chars FROM c""",
    "candidate_paths": f"SELECT DISTINCT path, {_CAND} AS candidate FROM chunks WHERE path IS NOT NULL",
    "capped_files": f"WITH {_NOW}, f AS (SELECT repo, base_commit, path, octet_length(encode(coalesce(text, ''))) AS b FROM cur WHERE kind = 'file' AND {_CAND}), k AS (SELECT repo, base_commit, path, row_number() OVER (PARTITION BY repo, base_commit ORDER BY path) AS i FROM f WHERE b <= 2000), n AS (SELECT repo, base_commit, count(*) AS files, max(path) AS last FROM k WHERE i <= 5 GROUP BY ALL), s AS (SELECT repo, base_commit, count(*) FILTER (WHERE b > 2000) AS skipped_large FROM f GROUP BY ALL) SELECT s.*, coalesce(files, 0) AS files, last FROM s LEFT JOIN n USING (repo, base_commit)",
    "file_text_lookup": f"WITH {_NOW}, c AS (SELECT * FROM cur WHERE NOT (kind = 'file' AND path < 'n') AND path <> ''), f AS (SELECT repo, base_commit, path, max(coalesce(text, '')) AS t FROM c WHERE kind = 'file' GROUP BY ALL), s AS (SELECT repo, base_commit, path, string_agg(coalesce(text, ''), chr(10) ORDER BY start_line, chunk_id) AS t FROM c WHERE kind <> 'file' GROUP BY ALL) SELECT repo, base_commit, path, md5(coalesce(f.t, s.t)) AS digest FROM f FULL JOIN s USING (repo, base_commit, path)",
    "file_views": f"WITH {_NOW} SELECT repo, base_commit, path, CAST(min(start_line) AS BIGINT) AS start_line, CAST(max(end_line) AS BIGINT) AS end_line, count(*) AS chunks, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY start_line NULLS FIRST, end_line NULLS FIRST, chunk_id)) AS digest FROM cur WHERE path <> '' GROUP BY 1, 2, 3",
    "usable_snapshots": "SELECT repo, base_commit, bool_or(coalesce(status = 'ok', false) AND coalesce(chunks_path, '') <> '') AS strict, bool_or(status IS NULL OR status = 'ok') AS lenient FROM corpus_manifest WHERE repo IS NOT NULL AND base_commit IS NOT NULL GROUP BY 1, 2",
    "resume_check": f"WITH {_NOW}, h AS (SELECT repo, base_commit, count(*) AS n FROM cur GROUP BY 1, 2), s AS (SELECT repo, base_commit, chunk_count FROM corpus_manifest WHERE status = 'ok' AND repo IS NOT NULL AND base_commit IS NOT NULL QUALIFY row_number() OVER (PARTITION BY repo, base_commit ORDER BY generated_at DESC NULLS LAST, chunk_count DESC NULLS LAST) = 1) SELECT s.repo, s.base_commit, CASE WHEN n IS NULL THEN 'absent' WHEN n IS NOT DISTINCT FROM chunk_count THEN 'valid' ELSE 'other_count' END AS state FROM s LEFT JOIN h ON h.repo = s.repo AND h.base_commit = s.base_commit",
    "gold_variants": _GOLD + f" SELECT sample_id, {_J(_HEAD + 'WHEN len(r) > 0 THEN r ELSE rt END')} AS target, {_J(_HEAD + 'ELSE ' + _DL('rr') + ' END')} AS audited, {_J('CASE WHEN none THEN [] ELSE ' + _DL('rel') + ' END')} AS related FROM g",
    "sample_fields": _NOWS + f", x AS (SELECT *, {_DL(_L('gold.given_files'))} AS gf, coalesce(nullif(query.given_file, ''), query.path) AS st FROM now) SELECT id AS sample_id, {_J("CASE WHEN len(gf) > 0 THEN gf WHEN task_type = 'comment2context' AND coalesce(st, '') <> '' THEN [st] ELSE gf END")} AS given, coalesce(nullif(query_provenance, ''), CASE WHEN task_type = 'code2test' THEN 'pr_summary' WHEN task_type = 'comment2context' THEN 'review_comment' WHEN task_type IN ('trace2code', 'testlog2code') THEN 'failure_trace' END) AS provenance, len(list_filter(coalesce(gold_blocks, []), lambda b: coalesce(b.path <> '' AND b.start_line > 0 AND b.end_line >= b.start_line, false))) AS blocks FROM x",
    "query_json": _NOWS + " SELECT id AS sample_id, '{' || coalesce(array_to_string(list_filter([" + ", ".join([f"'\"{n}\": ' || to_json(query.{n})" if n != "implementation_files" else "CASE WHEN query.implementation_files IS NOT NULL THEN '\"implementation_files\": [' || coalesce(array_to_string(list_transform(list_filter(query.implementation_files, lambda p: p IS NOT NULL), lambda p: CAST(to_json(p) AS VARCHAR)), ', '), '') || ']' END" for n in sorted(["review_comment", "path", "line", "pr_title", "given_file", "implementation_files"])]) + "], lambda x: x IS NOT NULL), ', '), '') || '}' AS query FROM now WHERE query IS NOT NULL",
    "synthetic_chunks": _NOWS + f", m AS (SELECT id, repo, base_commit, {_MENTIONED} AS a FROM now), x AS (SELECT DISTINCT id AS sample_id, repo, base_commit, path FROM (SELECT id, repo, base_commit, unnest(a) AS path FROM m) WHERE path <> '') SELECT substr(sha256(concat_ws(chr(31), coalesce(repo, 'None'), coalesce(base_commit, 'None'), path, 'dry_run')), 1, 24) AS chunk_id, sample_id, path, replace(path, '/', ' ') AS text FROM x",
    "name_only_checks": f"WITH x AS (SELECT doc_id, text AS raw, {_SAID.format('text')} AS text, {_SAID.format('path')} AS named FROM documents) SELECT doc_id, text = '' OR (named <> '' AND text = named) OR (NOT contains(coalesce(raw, ''), chr(10)) AND length(text) < 120 AND NOT {_FAILURE}) AS name_only FROM x",
    "token_prefixes": r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+')) <= 40 THEN text ELSE regexp_extract(text, '^(?:[^A-Za-z0-9_]*(?:[A-Za-z_][A-Za-z0-9_]*|[0-9]+)){40}') || chr(10) || '[TRUNCATED]' END AS prefix FROM documents WHERE text IS NOT NULL",
    "span_errors": SAMPLES_SQL.replace("{filter}", "true") + """bo AS (SELECT repo, base_commit, path, max(end_line) AS last_line FROM chunks GROUP BY 1, 2, 3), kn AS (SELECT DISTINCT repo, base_commit FROM bo),
it AS (SELECT sample_id, repo, base_commit, gold_files, 'span' AS kind, s.path AS path, s.start_line AS a, s.end_line AS b FROM (SELECT *, unnest(gold_spans) AS s FROM every) WHERE s.path <> '' AND s.start_line IS NOT NULL AND s.end_line IS NOT NULL
 UNION ALL SELECT sample_id, repo, base_commit, gold_files, 'negative', unnest(hard_negatives), 1, 1 FROM every),
j AS (SELECT it.*, bo.last_line, kn.repo IS NOT NULL AS known, list_contains(gold_files, it.path) AS gold FROM it LEFT JOIN bo ON bo.repo = it.repo AND bo.base_commit = it.base_commit AND bo.path = it.path LEFT JOIN kn ON kn.repo = it.repo AND kn.base_commit = it.base_commit)
SELECT DISTINCT sample_id, kind, path, unnest(list_filter([CASE WHEN kind = 'span' AND NOT gold THEN 'not_gold' END, CASE WHEN kind <> 'span' AND gold THEN 'is_gold' END, CASE WHEN kind = 'span' AND (a <= 0 OR b < a) THEN 'bad_range' END, CASE WHEN NOT known THEN 'no_corpus' END, CASE WHEN known AND last_line IS NULL THEN 'not_in_corpus' END, CASE WHEN kind = 'span' AND b > last_line THEN 'beyond_end' END], lambda e: e IS NOT NULL)) AS error FROM j""",
    "repeated_rows": "WITH k AS (SELECT DISTINCT id, version FROM comment2context) SELECT id, version, row_number() OVER (PARTITION BY id ORDER BY version NULLS FIRST) AS occurrence FROM k QUALIFY occurrence > 1",
    "annotation_merge": "WITH a AS (SELECT sample_id, max(verdict) AS verdict, count(*) AS annotations FROM keep_list WHERE sample_id IS NOT NULL GROUP BY 1), s AS (SELECT DISTINCT id AS sample_id FROM comment2context WHERE id IS NOT NULL) SELECT s.sample_id, verdict, coalesce(annotations, 0) AS annotations FROM s LEFT JOIN a USING (sample_id) UNION ALL SELECT sample_id, 'unknown sample', -1 FROM a WHERE sample_id NOT IN (SELECT sample_id FROM s)",
    "span_evidence": SAMPLES_SQL.replace("{filter}", "true") + f"sp AS (SELECT sample_id, repo, base_commit, s.path AS path, s.start_line AS start_line, s.end_line AS end_line FROM (SELECT *, unnest(gold_spans) AS s FROM every) WHERE s.path <> ''), g AS ({MERGE.format(key='sample_id, repo, base_commit, path', rows='sp')}), e AS (SELECT sample_id, repo, base_commit, path, CAST(sum(end_line - start_line + 1) AS BIGINT) AS evidence_lines FROM g GROUP BY ALL), bo AS (SELECT repo, base_commit, path, max(end_line) AS l FROM chunks GROUP BY 1, 2, 3) SELECT sample_id, path, evidence_lines, CAST(l AS BIGINT) AS file_lines, round(evidence_lines / l, 6) AS ratio FROM e JOIN bo USING (repo, base_commit, path) WHERE l > 0",
}
_ALL = [file_chunks, candidate_paths, capped_files, file_text_lookup, file_views, usable_snapshots, resume_check, gold_variants, sample_fields, query_json, synthetic_chunks, name_only_checks, review_bodies, token_prefixes, span_errors, repeated_rows, annotation_merge, span_evidence]
QUERIES = {f.__name__: f for f in _ALL}
