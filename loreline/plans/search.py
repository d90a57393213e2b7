"""Pattern search, file graphs, blocks, seeds and comparisons, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions.text import count_budget_tokens, has_failure_signal
from loreline.operators import grep, metrics, rank, repomap
from loreline.operators.corpus import blocks_of_spans
from loreline.operators.samples import current_chunks, current_samples, given_files, latest
from loreline.plans.retrieval import BUDGET_SQL, BUDGET_TOKENS, METRICS_SQL, SAMPLES_SQL, _base, _ranking, ranking_sql
from loreline.sources.tables import table


def search_patterns(spark: SparkSession, folder: str) -> DataFrame:
    samples = current_samples(table(spark, folder, "comment2context")).dropna(subset=["repo", "base_commit", "query_text"])
    return grep.patterns(samples).select("sample_id", "term", "kind", "weight")


def grep_tool(spark: SparkSession, folder: str) -> DataFrame:
    r = grep.search(current_chunks(table(spark, folder, "chunks")), "cache", 20)
    return r.select("repo", "base_commit", "path", "path_match", "matches", F.col("rank").cast("long").alias("rank"))


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    return grep.list_folder(table(spark, folder, "chunks"), "src")


def rank_repomap(spark: SparkSession, folder: str) -> DataFrame:
    samples, chunks = _base(spark, folder)
    raw = table(spark, folder, "comment2context").filter("id is not null")
    given = latest(raw.select(F.col("id").alias("sample_id"), "version", given_files().alias("given_files")), ["sample_id"], ["version"], ["given_files"])
    samples = samples.join(given, "sample_id")
    files = chunks.filter("kind = 'file'").select("repo", "base_commit", "path", "text")
    return repomap.rank_files(samples, files, chunks).select("sample_id", "path", "rank", F.round("score", 6).alias("score"))


def repomap_query_scores(spark: SparkSession, folder: str) -> DataFrame:
    samples, chunks = _base(spark, folder)
    files = chunks.filter("kind = 'file'").select("repo", "base_commit", "path", "text")
    return repomap.query_scores(samples, files, chunks).select("sample_id", "path", "mentioned", F.round("score", 6).alias("score"))


def block_match(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks of gold spans against what the lexical ranking fits into a context."""
    samples, chunks = _base(spark, folder)
    spans = samples.select("sample_id", "repo", "base_commit", F.explode("gold_spans").alias("s")).select("sample_id", "repo", "base_commit", "s.path", "s.start_line", "s.end_line")
    m = metrics.block_metrics(rank.lexical(samples, chunks), samples, blocks_of_spans(spans, chunks).select("sample_id", "path", "start_line", "end_line", "chunk_id"))
    return m.select("sample_id", "gold_blocks", "predicted_blocks", "matched", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


def seed_context(spark: SparkSession, folder: str) -> DataFrame:
    samples, chunks = _base(spark, folder)
    r = rank.files(rank.lexical(samples, chunks)).join(samples.select("sample_id", "repo", "base_commit"), "sample_id")
    tokens = chunks.filter("kind = 'file'").select("repo", "base_commit", "path", count_budget_tokens(F.col("text")).alias("tokens"))
    s = metrics.seed_context(r.join(tokens, ["repo", "base_commit", "path"]), 1000, 300)
    return s.groupBy("sample_id").agg(F.count(F.lit(1)).alias("files"), F.sum("taken").alias("taken"))


def failure_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines around the first eight failures of a log: eight before and after each, every line once; logs without any give their last 80 lines."""
    logs = table(spark, folder, "documents").filter("kind = 'failure_log' and text is not null").select("doc_id", F.split("text", "\n").alias("ls"))
    hits = F.slice(F.filter(F.transform("ls", lambda x, i: F.when(has_failure_signal(x), i)), lambda i: i.isNotNull()), 1, 8)
    near = F.filter(F.transform("ls", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.exists("hits", lambda h: F.abs(h - s["i"]) <= 8))
    tail = F.transform(F.slice("ls", F.greatest(F.lit(1), F.size("ls") - 79), 80), lambda x: F.struct(F.lit(0).alias("i"), x.alias("x")))
    cut = F.when(F.size("hits") > 0, F.slice(near, 1, 80)).otherwise(tail)
    return logs.withColumn("hits", hits).select("doc_id", F.size("hits").cast("long").alias("failures"), F.size(cut).cast("long").alias("kept_lines"), F.array_join(F.transform(cut, lambda s: s["x"]), "\n").alias("excerpt"))


def embedding_digests(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts an embedder would have to encode: distinct ones against all, by repository."""
    head = F.concat_ws("\n", F.concat(F.lit("path: "), "path"), F.concat(F.lit("kind: "), "kind"), F.concat(F.lit("symbol: "), F.nullif(F.col("symbol"), F.lit(""))), "text")
    d = table(spark, folder, "chunks").select("repo", F.sha2(head, 256).alias("digest"))
    per = d.groupBy("repo", "digest").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("repo").agg(F.sum("n").alias("texts"), F.count(F.lit(1)).alias("distinct_texts"))


def hardness(spark: SparkSession, folder: str) -> DataFrame:
    """Samples that the lexical ranking finds hard, and whether their query names a gold file."""
    samples, r = _ranking(spark, folder, "lexical")
    m = metrics.file_metrics(rank.files(r), samples)
    names = F.exists("gold_files", lambda p: F.lower("query_text").contains(F.lower(F.element_at(F.split(p, "/"), -1))))
    rows = m.join(samples.select("sample_id", names.alias("hinted")), "sample_id")
    hard = ~F.col("hinted") & ((F.col("recall_20") < 1.0) | (F.col("mrr") < 0.25))
    return rows.select("sample_id", "hinted", hard.alias("hard"), F.round("recall_20", 6).alias("recall_20"), F.round("mrr", 6).alias("mrr"))


def version_changes(spark: SparkSession, folder: str) -> DataFrame:
    """A full outer comparison of the first and the last version of the samples."""
    t = table(spark, folder, "comment2context").filter("id is not null").select("id", "version", "query_text", "base_commit")
    per = t.groupBy("id").agg(F.min(F.struct("version", "query_text", "base_commit")).alias("a"), F.max(F.struct("version", "query_text", "base_commit")).alias("b"))
    old, new = per.select("id", "a.*"), per.filter("b.version > 1").select("id", "b.*")
    both = old.select("id", F.col("query_text").alias("oq"), F.col("base_commit").alias("oc")).join(new.withColumn("there", F.lit(True)), "id", "full")
    state = F.when(F.col("there").isNull(), "kept").when(~F.col("oq").eqNullSafe(F.col("query_text")), "query_changed").when(~F.col("oc").eqNullSafe(F.col("base_commit")), "commit_changed").otherwise("same")
    return both.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("samples"))


def clean_split(spark: SparkSession, folder: str) -> DataFrame:
    """Recall on all samples and on those whose query names no gold file."""
    samples, r = _ranking(spark, folder, "lexical")
    m = metrics.file_metrics(rank.files(r), samples)
    named = F.exists("gold_files", lambda p: F.lower("query_text").contains(F.lower(p)))
    rows = m.join(samples.select("sample_id", named.alias("named")), "sample_id")
    out = rows.groupingSets([[], ["named"]], "named").agg(F.grouping("named").alias("g"), F.count(F.lit(1)).alias("samples"), F.avg("recall_20").alias("recall_20"), F.avg("mrr").alias("mrr"))
    return out.select(F.when(F.col("g") == 1, "all").when(F.col("named"), "named").otherwise("clean").alias("split"), "samples", F.round("recall_20", 6).alias("recall_20"), F.round("mrr", 6).alias("mrr"))


def event_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Events and values by type and day, with subtotals."""
    e = table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    r = e.rollup("event_type", "day").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))
    return r


_STOP = "[" + ", ".join(f"'{t}'" for t in grep.STOP_TERMS) + "]"
_CLEAN = r"regexp_replace(trim({0}), '^[''\"“”‘’.,;:()\[\]{{}}]+|[''\"“”‘’.,;:()\[\]{{}}]+$', '', 'g')"
_USABLE = f"(length({{0}}) >= 2 AND NOT list_contains({_STOP}, lower({{0}})) AND regexp_matches({{0}}, '[A-Za-z0-9]'))"
_ERR = "regexp_matches({0}, '" + grep.ERROR_END + "')"
_TELL = "(" + _USABLE + r" AND (regexp_matches({0}, '[/._]|::|[0-9]') OR " + _ERR + " OR (length({0}) >= 3 AND regexp_matches({0}, '[A-Z]') AND NOT regexp_matches({0}, '[a-z]')) OR (regexp_matches({0}, '^.+[A-Z]') AND regexp_matches({0}, '[a-z]'))))"
_Q = "replace(coalesce(query_text, ''), '\\n', chr(10))"
_FLAG = r"(?:^|[^A-Za-z0-9_])(--[A-Za-z0-9][A-Za-z0-9_-]{1,80})\b"
PATTERNS_SQL = f"""
raw AS (
  SELECT sample_id, repo, base_commit, 0 AS o, 12.0 AS weight, unnest(regexp_extract_all({_Q}, '{grep.CODE_SPAN}', 1)) AS t FROM samples
  UNION ALL SELECT sample_id, repo, base_commit, 1, 18.0, unnest(regexp_extract_all({_Q}, '{grep.FILE_PATH}')) FROM samples
  UNION ALL SELECT sample_id, repo, base_commit, 2, 18.0, unnest(regexp_extract_all({_Q}, '{grep.BARE_FILE}')) FROM samples
  UNION ALL SELECT sample_id, repo, base_commit, 3, 10.0, unnest(regexp_extract_all({_Q}, '{_FLAG}', 1)) FROM samples
  UNION ALL SELECT sample_id, repo, base_commit, 4, 7.0, unnest(list_filter(regexp_extract_all({_Q}, '{grep.IDENTIFIER}'), lambda x: {_TELL.format('x')})) FROM samples),
kinds AS (
  SELECT *, {_CLEAN.format('t')} AS term, CASE o WHEN 0 THEN CASE WHEN regexp_full_match(trim(t), '{grep.FILE_PATH}') OR regexp_full_match(trim(t), '{grep.BARE_FILE}') THEN 'file_path' WHEN starts_with(trim(t), '--') THEN 'flag' WHEN {_ERR.format('trim(t)')} THEN 'error' ELSE 'code' END
         WHEN 3 THEN 'flag' WHEN 4 THEN CASE WHEN {_ERR.format('trim(t)')} THEN 'error' ELSE 'identifier' END ELSE 'file_path' END AS kind FROM raw),
pats AS (SELECT sample_id, repo, base_commit, term, kind, weight FROM kinds WHERE {_USABLE.format('term')} QUALIFY row_number() OVER (PARTITION BY sample_id, lower(term) ORDER BY weight DESC, o) = 1)
"""
_GREP = SAMPLES_SQL.replace("{filter}", "true") + PATTERNS_SQL + """,
h AS (SELECT p.sample_id, c.path, c.chunk_id, p.kind, lower(p.term) AS low,
        weight * (CASE WHEN contains(lower(c.path), lower(p.term)) THEN CASE WHEN p.kind = 'file_path' THEN 2.0 ELSE 1.35 END ELSE 0 END
        + CASE WHEN contains(lower(string_split(c.path, '/')[-1]), lower(p.term)) THEN 1.1 ELSE 0 END + CASE WHEN contains(lower(coalesce(c.symbol, '')), lower(p.term)) THEN 1.2 ELSE 0 END + CASE WHEN contains(lower(coalesce(c.text, '')), lower(p.term)) THEN 1.0 ELSE 0 END) AS s
      FROM pats p JOIN cand c ON c.repo = p.repo AND c.base_commit = p.base_commit WHERE c.path <> ''),
hp AS (SELECT * FROM h WHERE s > 0),
pp AS (SELECT sample_id, path, sum(s) AS total, count(*) AS matched FROM (SELECT sample_id, path, kind, low, max(s) AS s FROM hp GROUP BY ALL) GROUP BY ALL),
pc AS (SELECT sample_id, path, max(s) AS best, count(*) AS hit_chunks FROM (SELECT sample_id, path, chunk_id, sum(s) AS s FROM hp GROUP BY ALL) GROUP BY ALL)
"""
_UPTO = "first_hits AS (SELECT doc_id, ls, list_slice(list_filter(list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '(?i){0}') THEN i END), lambda i: i IS NOT NULL), 1, 8) AS hits FROM logs)"


def _failure_pattern() -> str:
    from loreline.functions.text import FAILURE_SIGNALS

    return "|".join(FAILURE_SIGNALS)


ORACLE = {
    "search_patterns": SAMPLES_SQL.replace("{filter}", "true") + PATTERNS_SQL + "SELECT sample_id, term, kind, CAST(weight AS DOUBLE) AS weight FROM pats",
    "grep_tool": "WITH cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1), f AS (SELECT repo, base_commit, path, lower(concat_ws(chr(10), path, text)) AS h FROM cur WHERE kind = 'file'), m AS (SELECT repo, base_commit, path, contains(lower(path), 'cache') AS path_match, CAST((length(h) - length(replace(h, 'cache', ''))) // 5 AS BIGINT) AS matches FROM f) SELECT *, row_number() OVER (PARTITION BY repo, base_commit ORDER BY path_match DESC, matches DESC, length(path), path) AS rank FROM m WHERE matches > 0 QUALIFY rank <= 20",
    "list_folder": "SELECT DISTINCT repo, base_commit, string_split(substr(path, 5), '/')[1] AS entry, len(string_split(substr(path, 5), '/')) > 1 AS is_folder FROM chunks WHERE starts_with(path, 'src/')",
    "block_match": ranking_sql("lexical") + BUDGET_SQL + """,
sp AS (SELECT sample_id, repo, base_commit, s.path AS path, s.start_line AS sl, s.end_line AS el FROM (SELECT *, unnest(gold_spans) AS s FROM samples) WHERE s.path <> '' AND s.start_line IS NOT NULL AND s.end_line IS NOT NULL),
hb AS (SELECT p.sample_id, p.path, p.sl, p.el, c.start_line, c.end_line, c.chunk_id FROM sp p JOIN cand c ON c.repo = p.repo AND c.base_commit = p.base_commit AND c.path = p.path AND c.kind = 'symbol' AND p.sl <= c.end_line AND c.start_line <= p.el),
b AS (SELECT DISTINCT * FROM (SELECT sample_id, path, start_line, end_line, chunk_id FROM hb UNION ALL SELECT sample_id, path, sl, el, NULL FROM sp WHERE NOT EXISTS (SELECT 1 FROM hb WHERE hb.sample_id = sp.sample_id AND hb.path = sp.path AND hb.sl = sp.sl AND hb.el = sp.el)) WHERE start_line > 0 AND end_line >= start_line),
p AS (SELECT sample_id, path, start_line AS ps, end_line AS pe, chunk_id AS pc FROM fits WHERE kind <> 'file' AND sample_id IN (SELECT sample_id FROM b)),
met AS (SELECT b.*, pc FROM b JOIN p ON p.sample_id = b.sample_id AND p.path = b.path AND (coalesce(b.chunk_id = pc, false) OR (b.start_line <= pe AND ps <= b.end_line))),
g AS (SELECT sample_id, count(DISTINCT (path, start_line, end_line)) AS gold_blocks FROM b GROUP BY 1), pr AS (SELECT sample_id, count(DISTINCT pc) AS predicted_blocks FROM p GROUP BY 1),
mm AS (SELECT sample_id, count(DISTINCT (path, start_line, end_line)) AS matched, count(DISTINCT pc) AS useful FROM met GROUP BY 1)
SELECT g.sample_id, gold_blocks, coalesce(predicted_blocks, 0) AS predicted_blocks, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / gold_blocks, 6) AS recall, round(CASE WHEN predicted_blocks > 0 THEN coalesce(useful, 0) / predicted_blocks ELSE 0 END, 6) AS precision FROM g LEFT JOIN pr USING (sample_id) LEFT JOIN mm USING (sample_id)""",
    "seed_context": ranking_sql("lexical") + f""",
ft AS (SELECT repo, base_commit, path, coalesce({BUDGET_TOKENS.replace("{0}", "text")}, 0) AS tokens FROM cand WHERE kind = 'file'),
j AS (SELECT f.sample_id, f.rank, least(tokens, 300) AS capped FROM frank f JOIN samples s USING (sample_id) JOIN ft t ON t.repo = s.repo AND t.base_commit = s.base_commit AND t.path = f.path WHERE tokens > 0),
k AS (SELECT sample_id, least(capped, greatest(0, 1000 - coalesce(sum(capped) OVER (PARTITION BY sample_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS taken FROM j)
SELECT sample_id, count(*) AS files, CAST(sum(taken) AS BIGINT) AS taken FROM k WHERE taken > 0 GROUP BY 1""",
    "failure_excerpts": "WITH logs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE kind = 'failure_log' AND text IS NOT NULL), " + _UPTO.replace("{0}", _failure_pattern()) + ", near AS (SELECT doc_id, hits, CASE WHEN len(hits) > 0 THEN list_slice(list_filter(ls, lambda x, i: len(list_filter(hits, lambda h: abs(h - i) <= 8)) > 0), 1, 80) ELSE list_slice(ls, greatest(1, len(ls) - 79), len(ls)) END AS kept FROM first_hits) SELECT doc_id, len(hits) AS failures, len(kept) AS kept_lines, array_to_string(kept, chr(10)) AS excerpt FROM near",
    "embedding_digests": "WITH d AS (SELECT repo, sha256(concat_ws(chr(10), 'path: ' || path, 'kind: ' || kind, 'symbol: ' || nullif(symbol, ''), text)) AS digest FROM chunks) SELECT repo, count(*) AS texts, count(DISTINCT digest) AS distinct_texts FROM d GROUP BY 1",
    "hardness": ranking_sql("lexical") + METRICS_SQL + ", x AS (SELECT m.sample_id, len(list_filter(gold_files, lambda p: contains(lower(query_text), lower(string_split(p, '/')[-1])))) > 0 AS hinted, recall_20, mrr FROM m JOIN samples s USING (sample_id)) SELECT sample_id, hinted, NOT hinted AND (recall_20 < 1.0 OR mrr < 0.25) AS hard, round(recall_20, 6) AS recall_20, round(mrr, 6) AS mrr FROM x",
    "version_changes": "WITH a AS (SELECT id, query_text, base_commit FROM comment2context QUALIFY row_number() OVER (PARTITION BY id ORDER BY version) = 1), b AS (SELECT id, query_text, base_commit FROM (SELECT * FROM comment2context QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) WHERE version > 1) SELECT CASE WHEN b.id IS NULL THEN 'kept' WHEN a.query_text IS DISTINCT FROM b.query_text THEN 'query_changed' WHEN a.base_commit IS DISTINCT FROM b.base_commit THEN 'commit_changed' ELSE 'same' END AS state, count(*) AS samples FROM a FULL JOIN b ON a.id = b.id GROUP BY 1",
    "clean_split": ranking_sql("lexical") + METRICS_SQL + ", x AS (SELECT len(list_filter(gold_files, lambda p: contains(lower(query_text), lower(p)))) > 0 AS named, recall_20, mrr FROM m JOIN samples s USING (sample_id)) SELECT CASE WHEN grouping(named) = 1 THEN 'all' WHEN named THEN 'named' ELSE 'clean' END AS split, count(*) AS samples, round(avg(recall_20), 6) AS recall_20, round(avg(mrr), 6) AS mrr FROM x GROUP BY GROUPING SETS ((), (named))",
    "event_rollup": "SELECT event_type, CAST(ts AS DATE) AS day, CAST(grouping(event_type, CAST(ts AS DATE)) AS BIGINT) AS level, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))",
    "repomap_query_scores": SAMPLES_SQL.replace("{filter}", "true") + """
fl AS (SELECT repo, base_commit, path, text FROM cand WHERE kind = 'file'),
tk AS (SELECT repo, base_commit, path, unnest(list_distinct(TOK(path))) AS token, 3.0 AS f FROM fl UNION ALL SELECT repo, base_commit, path, unnest(list_distinct(TOK(substr(text, 1, 20000)))), 1.0 FROM fl
       UNION ALL SELECT DISTINCT repo, base_commit, path, token, 2.0 FROM (SELECT repo, base_commit, path, unnest(TOK(symbol)) AS token FROM cand WHERE kind = 'symbol' AND symbol <> '')),
sz AS (SELECT repo, base_commit, path, count(DISTINCT token) AS size FROM tk GROUP BY ALL), rw AS (SELECT repo, base_commit, path, token, sum(f) AS f FROM tk GROUP BY ALL),
dfq AS (SELECT repo, base_commit, token, count(*) AS df FROM rw GROUP BY ALL), nn AS (SELECT repo, base_commit, count(*) AS n FROM fl GROUP BY ALL),
q AS (SELECT DISTINCT sample_id, repo, base_commit, unnest(TOK(query_text)) AS token FROM samples),
ht AS (SELECT sample_id, path, sum(f * (ln((n + 1) / (df + 1.0)) + 1)) AS w FROM q JOIN rw USING (repo, base_commit, token) JOIN dfq USING (repo, base_commit, token) JOIN nn USING (repo, base_commit) GROUP BY ALL),
bo AS (SELECT s.sample_id, f.path, size, w, CASE WHEN contains(lower(query_text), lower(f.path)) THEN 20 ELSE 0 END + CASE WHEN contains(lower(query_text), lower(string_split(f.path, '/')[-1])) THEN 7 ELSE 0 END AS b
       FROM samples s JOIN fl f ON f.repo = s.repo AND f.base_commit = s.base_commit LEFT JOIN sz ON sz.repo = f.repo AND sz.base_commit = f.base_commit AND sz.path = f.path LEFT JOIN ht ON ht.sample_id = s.sample_id AND ht.path = f.path)
SELECT sample_id, path, b > 0 AS mentioned, round((coalesce(w, 0) + b) / greatest(1.0, sqrt(coalesce(size, 1))), 6) AS score FROM bo""",
}


def _inline_tokens(sql: str) -> str:
    from loreline.plans.retrieval import TOKENS

    for arg in ("path", "substr(text, 1, 20000)", "symbol", "query_text"):
        sql = sql.replace(f"TOK({arg})", TOKENS.replace("{0}", arg))
    return sql


ORACLE["repomap_query_scores"] = _inline_tokens(ORACLE["repomap_query_scores"])
_ALL = [search_patterns, grep_tool, list_folder, rank_repomap, repomap_query_scores, block_match, seed_context, failure_excerpts, embedding_digests, hardness, version_changes, clean_split, event_rollup]
QUERIES = {f.__name__: f for f in _ALL}
