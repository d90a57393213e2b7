"""Ranking, fusion, metrics, budgets and intervals over the samples and their snapshots, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreline.functions.paths import passes
from loreline.functions.text import count_budget_tokens
from loreline.operators import metrics, rank
from loreline.operators.samples import current_samples, snapshot_chunks
from loreline.sources.tables import table

BUDGETS, THRESHOLDS = [4000, 8000, 16000, 32000], [1, 16, 64]


def _base(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    samples = current_samples(table(spark, folder, "comment2context")).dropna(subset=["repo", "base_commit", "query_text"])
    return samples, snapshot_chunks(table(spark, folder, "chunks"), samples)


def _ranking(spark: SparkSession, folder: str, ranker: str, candidate_filter: str = "all_files") -> tuple[DataFrame, DataFrame]:
    samples, chunks = _base(spark, folder)
    if candidate_filter != "all_files":
        chunks = chunks.filter(passes(F.col("path"), candidate_filter))
    return samples, (rank.lexical if ranker == "lexical" else rank.bm25)(samples, chunks)


def _scores(ranking: DataFrame) -> DataFrame:
    return ranking.select("sample_id", "chunk_id", "path", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def rank_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(_ranking(spark, folder, "lexical")[1])


def rank_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(_ranking(spark, folder, "bm25")[1])


def rank_code_only(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(_ranking(spark, folder, "lexical", "code_only")[1])


def rank_tests_only(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(_ranking(spark, folder, "bm25", "tests_only")[1])


def rank_rrf(spark: SparkSession, folder: str) -> DataFrame:
    samples, chunks = _base(spark, folder)
    fused = rank.fuse({"lexical": rank.files(rank.lexical(samples, chunks)), "bm25": rank.files(rank.bm25(samples, chunks))})
    return fused.select("sample_id", "path", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


METRICS = ["recall_5", "recall_10", "recall_20", "mrr", "ndcg_20", "coverage_auc_20", "precision_5", "precision_20", "f05_5", "f05_20", "irrelevant_20", "negatives_20"]


def _metrics(spark: SparkSession, folder: str, ranker: str) -> DataFrame:
    samples, r = _ranking(spark, folder, ranker)
    return metrics.file_metrics(rank.files(r), samples)


def file_metrics_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return _metrics(spark, folder, "lexical").select("sample_id", *[F.round(F.col(m).cast("double"), 6).alias(m) for m in METRICS])


def summary_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.summarize(_metrics(spark, folder, "bm25"), METRICS)


def gold_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """The rank of every gold file, null where it is not among the candidates."""
    samples, r = _ranking(spark, folder, "lexical")
    gold = samples.select("sample_id", F.explode("gold_files").alias("path"))
    return gold.join(rank.files(r), ["sample_id", "path"], "left").select("sample_id", "path", F.col("rank").cast("long").alias("rank"))


def context_8k(spark: SparkSession, folder: str) -> DataFrame:
    samples, r = _ranking(spark, folder, "lexical")
    return metrics.context_metrics(r, samples).select("sample_id", "chunks", "pollution", *[F.round(c, 6).alias(c) for c in ("gold_coverage", "gold_ratio", "redundancy")])


def token_budget_curve(spark: SparkSession, folder: str) -> DataFrame:
    samples, chunks = _base(spark, folder)
    r = rank.files(rank.lexical(samples, chunks)).join(samples.select("sample_id", "repo", "base_commit"), "sample_id")
    tokens = chunks.filter("kind = 'file'").select("repo", "base_commit", "path", count_budget_tokens(F.col("text")).alias("content"), count_budget_tokens(F.concat(F.lit("### "), "path")).alias("header"))
    curve = metrics.token_budget(r, tokens, samples, BUDGETS, THRESHOLDS)
    return curve.groupBy("budget", "threshold").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("coverage"), 6).alias("coverage"))


def line_metrics(spark: SparkSession, folder: str) -> DataFrame:
    samples, r = _ranking(spark, folder, "bm25")
    m = metrics.line_metrics(r, samples)
    return m.select("sample_id", "gold_lines", "predicted_lines", "overlap", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1", "f05")])


def merge_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """The merged line ranges of each file's symbols, over all rows of chunks."""
    symbols = table(spark, folder, "chunks").filter("kind = 'symbol'").select("repo", "base_commit", "path", "start_line", "end_line")
    return metrics.merged_intervals(symbols, ["repo", "base_commit", "path"])


def rank_depths(spark: SparkSession, folder: str) -> DataFrame:
    """Samples whose first gold file stands within each depth, and nearest-rank percentiles of its rank."""
    samples, r = _ranking(spark, folder, "lexical")
    gold = samples.filter(F.size("gold_files") > 0).select("sample_id", F.explode("gold_files").alias("path"))
    first = gold.join(rank.files(r), ["sample_id", "path"], "left").groupBy("sample_id").agg(F.min("rank").alias("first"))
    depths = (1, 3, 5, 10, 20, 50, 100, 200)
    agg = first.agg(F.count(F.lit(1)).alias("samples"), *[F.count_if(F.col("first") <= d).alias(f"within_{d}") for d in depths], F.expr("percentile_disc(0.5) within group (order by first)").cast("long").alias("p50"), F.expr("percentile_disc(0.9) within group (order by first)").cast("long").alias("p90"))
    return agg


def rank_embedding(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id is divisible by 50."""
    e = table(spark, folder, "embeddings")
    best = rank.by_vectors(e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")))
    return best.select("query_id", "item_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


PART = lambda p: f"list_has_any(string_split(lower(replace(path, '\\', '/')), '/'), {p})"

SUFFIX_SQL = r"regexp_extract({0}, '[^./](\.[^./]+)$', 1)"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


def code_sql() -> str:
    from loreline.functions.paths import CODE_SUFFIXES, NOISE_NAMES, NOISE_PARTS

    name = "lower(string_split(replace(path, '\\', '/'), '/')[-1])"
    stem = f"regexp_replace({name}, '([^.])\\.[^.]+$', '\\1')"
    noise = f"({PART(_list(NOISE_PARTS))} OR list_contains({_list(NOISE_NAMES)}, {name}) OR list_contains({_list(NOISE_NAMES)}, {stem}))"
    return f"(path <> '' AND NOT {noise} AND list_contains({_list(CODE_SUFFIXES)}, lower({SUFFIX_SQL.format('path')})))"


def test_sql() -> str:
    from loreline.functions.paths import CODE_SUFFIXES, TEST_NAME_ENDS, TEST_PARTS

    name = "lower(string_split(replace(path, '\\', '/'), '/')[-1])"
    ends = " OR ".join(f"ends_with({name}, '{e}')" for e in TEST_NAME_ENDS)
    return f"(path <> '' AND ({PART(_list(TEST_PARTS))} OR starts_with({name}, 'test_') OR {ends}) AND list_contains({_list(CODE_SUFFIXES)}, lower({SUFFIX_SQL.format('path')})))"


DISTINCT = "list_filter({0}, lambda x, i: x IS NOT NULL AND x <> '' AND list_position({0}, x) = i)"

SAMPLES_SQL = f"""
WITH now AS (SELECT * FROM comment2context QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1),
lists AS (
  SELECT id AS sample_id, coalesce(task_type, 'unknown') AS task_type, repo, base_commit, query_text, gold_spans,
         coalesce({DISTINCT.format("gold.files")}, []) AS f, coalesce({DISTINCT.format("list_transform(gold.must_context_files, lambda m: m.path)")}, []) AS c,
         coalesce({DISTINCT.format("gold.root_cause_files")}, []) AS r, coalesce({DISTINCT.format("gold.related_tests")}, []) AS t,
         coalesce({DISTINCT.format("hard_negative_files")}, []) AS hard_negatives, coalesce(gold.no_gold, false) AS none
  FROM now),
every AS (
  SELECT sample_id, task_type, repo, base_commit, query_text, hard_negatives, gold_spans,
         CASE WHEN none THEN [] WHEN len(f) > 0 THEN f WHEN task_type = 'code2test' THEN t
              WHEN task_type = 'comment2context' AND len(c) > 0 THEN c WHEN len(r) > 0 THEN r ELSE t END AS gold_files
  FROM lists),
samples AS (SELECT * FROM every WHERE repo IS NOT NULL AND base_commit IS NOT NULL AND query_text IS NOT NULL),
cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1),
cand AS (SELECT c.* FROM cur c SEMI JOIN samples s ON s.repo = c.repo AND s.base_commit = c.base_commit WHERE {{filter}}),
"""

TOKENS = "list_transform(regexp_extract_all(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda x: lower(x))"
CHUNK_TEXT = "concat_ws(' ', nullif(path, ''), nullif(symbol, ''), nullif(kind, ''), nullif(text, ''))"

TERMS_SQL = f"""
qt AS (SELECT sample_id, repo, base_commit, token, count(*) AS qtf FROM (SELECT sample_id, repo, base_commit, unnest({TOKENS.format("query_text")}) AS token FROM samples) GROUP BY ALL),
toks AS (SELECT repo, base_commit, chunk_id, {TOKENS.format(CHUNK_TEXT)} AS tokens FROM cand),
sizes AS (SELECT repo, base_commit, chunk_id, len(tokens) AS length, len(list_distinct(tokens)) AS uniq FROM toks),
terms AS (SELECT repo, base_commit, chunk_id, token, count(*) AS tf FROM (SELECT repo, base_commit, chunk_id, unnest(tokens) AS token FROM toks) GROUP BY ALL),
df AS (SELECT repo, base_commit, token, count(*) AS df FROM terms GROUP BY ALL),
n AS (SELECT repo, base_commit, count(*) AS n, avg(length) AS mean FROM sizes GROUP BY ALL),
"""

LEXICAL_SQL = """
hits AS (
  SELECT q.sample_id, t.chunk_id, sum((1 + ln(qtf)) * ln((n.n + 1) / (1 + d.df) + 1.0)) AS w
  FROM qt q JOIN terms t USING (repo, base_commit, token) JOIN df d USING (repo, base_commit, token) JOIN n USING (repo, base_commit) GROUP BY ALL),
scored AS (
  SELECT s.sample_id, c.chunk_id, c.path, c.kind, coalesce(length(c.text), 0) AS chars, c.start_line, c.end_line,
         CASE WHEN len(regexp_extract_all(s.query_text, '[A-Za-z0-9]+')) = 0 THEN 0.0 ELSE
         (coalesce(h.w, 0) + CASE WHEN c.path <> '' AND contains(lower(s.query_text), lower(c.path)) THEN 25 ELSE 0 END
          + CASE WHEN string_split(c.path, '/')[-1] <> '' AND contains(lower(s.query_text), lower(string_split(c.path, '/')[-1])) THEN 8 ELSE 0 END
          + CASE WHEN coalesce(c.symbol, '') <> '' AND contains(lower(s.query_text), lower(c.symbol)) THEN 5 ELSE 0 END) / greatest(1.0, sqrt(z.uniq)) END AS score
  FROM samples s JOIN cand c ON c.repo = s.repo AND c.base_commit = s.base_commit JOIN sizes z ON z.repo = c.repo AND z.base_commit = c.base_commit AND z.chunk_id = c.chunk_id
  LEFT JOIN hits h ON h.sample_id = s.sample_id AND h.chunk_id = c.chunk_id),
"""

BM25_SQL = """
hits AS (
  SELECT q.sample_id, t.chunk_id, sum(qtf * ln(1.0 + (n.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + CASE WHEN n.mean > 0 THEN 0.75 * z.length / n.mean ELSE 0 END))) AS w
  FROM qt q JOIN terms t USING (repo, base_commit, token) JOIN df d USING (repo, base_commit, token) JOIN n USING (repo, base_commit) JOIN sizes z USING (repo, base_commit, chunk_id) GROUP BY ALL),
scored AS (
  SELECT s.sample_id, c.chunk_id, c.path, c.kind, coalesce(length(c.text), 0) AS chars, c.start_line, c.end_line, coalesce(h.w, 0.0) AS score
  FROM samples s JOIN cand c ON c.repo = s.repo AND c.base_commit = s.base_commit LEFT JOIN hits h ON h.sample_id = s.sample_id AND h.chunk_id = c.chunk_id),
"""

RANKED_SQL = """
ranking AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 9) DESC, path, chunk_id) AS rank FROM scored),
ffirst AS (SELECT sample_id, path, min(rank) AS first, max(score) AS score FROM ranking WHERE path <> '' GROUP BY ALL),
frank AS (SELECT sample_id, path, row_number() OVER (PARTITION BY sample_id ORDER BY first) AS rank FROM ffirst)
"""


def ranking_sql(ranker: str, where: str = "true") -> str:
    return SAMPLES_SQL.replace("{filter}", where) + TERMS_SQL + (LEXICAL_SQL if ranker == "lexical" else BM25_SQL) + RANKED_SQL


SCORES = "SELECT sample_id, chunk_id, path, rank, round(score, 6) AS score FROM ranking"

_F = lambda p, r: f"CASE WHEN {p} > 0 OR {r} > 0 THEN 1.25 * {p} * {r} / (0.25 * {p} + {r}) ELSE 0 END"
METRICS_SQL = f""",
marked AS (
  SELECT f.*, list_contains(s.gold_files, f.path) AS gold, list_contains(s.hard_negatives, f.path) AS negative, len(s.gold_files) AS n_gold, s.task_type, s.repo
  FROM frank f JOIN samples s USING (sample_id) WHERE len(s.gold_files) > 0),
sums AS (
  SELECT sample_id, any_value(task_type) AS task_type, any_value(n_gold) AS n_gold, count(*) AS n, min(rank) FILTER (WHERE gold) AS first,
         sum(CASE WHEN gold AND rank <= 20 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN gold THEN greatest(0, 21 - rank) ELSE 0 END) AS auc,
         count(*) FILTER (WHERE gold AND rank <= 5) AS h5, count(*) FILTER (WHERE gold AND rank <= 10) AS h10, count(*) FILTER (WHERE gold AND rank <= 20) AS h20,
         count(*) FILTER (WHERE negative AND rank <= 20) AS negatives_20
  FROM marked GROUP BY sample_id),
m AS (
  SELECT sample_id, task_type, h5 / n_gold AS recall_5, h10 / n_gold AS recall_10, h20 / n_gold AS recall_20, coalesce(1.0 / first, 0) AS mrr,
         dcg / list_sum(list_transform(range(1, least(n_gold, 20) + 1), lambda i: 1 / log2(i + 1.0))) AS ndcg_20, auc / (20.0 * n_gold) AS coverage_auc_20,
         h5 / least(5, n) AS precision_5, h20 / least(20, n) AS precision_20, {_F("(h5 / least(5, n))", "(h5 / n_gold)")} AS f05_5, {_F("(h20 / least(20, n))", "(h20 / n_gold)")} AS f05_20,
         least(20, n) - h20 AS irrelevant_20, negatives_20
  FROM sums)
"""

BUDGET_SQL = """,
cum AS (SELECT *, sum(chars) OVER (PARTITION BY sample_id ORDER BY rank) AS incl FROM ranking),
stops AS (SELECT *, max(CASE WHEN incl > 8000 AND incl - chars > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY rank) AS stopped FROM cum),
fits AS (SELECT * FROM stops WHERE stopped = 0)
"""

MERGE = """
  SELECT {key}, min(start_line) AS start_line, max(end_line) AS end_line FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start_line > coalesce(max(end_line) OVER (PARTITION BY {key} ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS fresh
      FROM {rows} WHERE start_line > 0 AND end_line >= start_line)) GROUP BY {key}, island"""

BUDGET_TOKENS = r"len(regexp_extract_all({0}, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^A-Za-z0-9_\s\v\x{85}\p{Z}]'))"

ORACLE = {
    "rank_lexical": ranking_sql("lexical") + SCORES,
    "rank_bm25": ranking_sql("bm25") + SCORES,
    "rank_code_only": ranking_sql("lexical", code_sql()) + SCORES,
    "rank_tests_only": ranking_sql("bm25", test_sql()) + SCORES,
    "rank_rrf": SAMPLES_SQL.replace("{filter}", "true") + TERMS_SQL
    + LEXICAL_SQL.replace("hits", "hits_l").replace("scored AS", "scored_l AS")
    + RANKED_SQL.replace("ranking", "ranking_l").replace("scored", "scored_l").replace("ffirst", "ffirst_l").replace("frank AS", "frank_l AS") + ", "
    + BM25_SQL + RANKED_SQL
    + ", both_runs AS (SELECT sample_id, path, 1.0 / (60 + rank) AS s FROM frank UNION ALL SELECT sample_id, path, 1.0 / (60 + rank) FROM frank_l),"
    + " summed AS (SELECT sample_id, path, sum(s) AS score FROM both_runs GROUP BY ALL)"
    + " SELECT sample_id, path, row_number() OVER (PARTITION BY sample_id ORDER BY round(score, 12) DESC, path) AS rank, round(score, 9) AS score FROM summed QUALIFY rank <= 20",
    "file_metrics_lexical": ranking_sql("lexical") + METRICS_SQL + "SELECT sample_id, " + ", ".join(f"round(CAST({m} AS DOUBLE), 6) AS {m}" for m in METRICS) + " FROM m",
    "summary_bm25": ranking_sql("bm25") + METRICS_SQL + "SELECT CASE WHEN grouping(task_type) = 1 THEN 'overall' ELSE task_type END AS scope, count(*) AS samples, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS) + " FROM m GROUP BY GROUPING SETS ((), (task_type))",
    "gold_ranks": ranking_sql("lexical") + ", g AS (SELECT sample_id, unnest(gold_files) AS path FROM samples) SELECT g.sample_id, g.path, f.rank FROM g LEFT JOIN frank f ON f.sample_id = g.sample_id AND f.path = g.path",
    "context_8k": ranking_sql("lexical") + BUDGET_SQL + """,
c AS (SELECT f.*, list_contains(s.gold_files, f.path) AS gold, len(s.gold_files) AS n_gold FROM fits f JOIN samples s USING (sample_id) WHERE len(s.gold_files) > 0),
a AS (SELECT sample_id, any_value(n_gold) AS n_gold, count(*) AS chunks, count(DISTINCT path) FILTER (WHERE gold) AS found, count(DISTINCT path) AS paths, sum(CASE WHEN gold THEN 0 ELSE chars END) AS pollution, sum(CASE WHEN gold THEN chars ELSE 0 END) AS gold_chars FROM c GROUP BY sample_id)
SELECT sample_id, chunks, CAST(pollution AS BIGINT) AS pollution, round(found / n_gold, 6) AS gold_coverage, round(CASE WHEN gold_chars + pollution > 0 THEN gold_chars / (gold_chars + pollution) ELSE 0 END, 6) AS gold_ratio, round((chunks - paths) / chunks, 6) AS redundancy FROM a""",
    "token_budget_curve": ranking_sql("lexical") + f""",
ft AS (SELECT repo, base_commit, path, coalesce({BUDGET_TOKENS.replace("{0}", "text")}, 0) AS content, {BUDGET_TOKENS.replace("{0}", "'### ' || path")} AS header FROM cand WHERE kind = 'file'),
packed AS (SELECT f.sample_id, f.path, t.content, t.header, coalesce(sum(t.header + t.content + 1) OVER (PARTITION BY f.sample_id ORDER BY f.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM frank f JOIN samples s USING (sample_id) JOIN ft t ON t.repo = s.repo AND t.base_commit = s.base_commit AND t.path = f.path),
grid AS (SELECT sample_id, gold_files, b.budget, t.threshold FROM samples, (SELECT unnest([4000, 8000, 16000, 32000]) AS budget) b, (SELECT unnest([1, 16, 64]) AS threshold) t WHERE len(gold_files) > 0),
cov AS (SELECT g.sample_id, g.budget, g.threshold, len(any_value(g.gold_files)) AS n, count(*) FILTER (WHERE p.content > 0 AND least(p.content, greatest(0, g.budget - p.before - p.header)) >= least(g.threshold, p.content)) AS covered
        FROM grid g LEFT JOIN packed p ON p.sample_id = g.sample_id AND list_contains(g.gold_files, p.path) GROUP BY g.sample_id, g.budget, g.threshold)
SELECT budget, threshold, count(*) AS samples, round(avg(covered / n), 6) AS coverage FROM cov GROUP BY budget, threshold""",
    "line_metrics": ranking_sql("bm25") + BUDGET_SQL + f""",
spans AS (SELECT sample_id, s.path AS path, s.start_line AS start_line, s.end_line AS end_line FROM (SELECT sample_id, unnest(gold_spans) AS s FROM samples) WHERE s.path <> ''),
g AS ({MERGE.format(key="sample_id, path", rows="spans")}),
chosen AS (SELECT * FROM fits WHERE sample_id IN (SELECT sample_id FROM g)),
p AS ({MERGE.format(key="sample_id, path", rows="chosen")}),
o AS (SELECT g.sample_id, sum(least(g.end_line, p.end_line) - greatest(g.start_line, p.start_line) + 1) AS overlap FROM g JOIN p ON p.sample_id = g.sample_id AND p.path = g.path AND g.start_line <= p.end_line AND p.start_line <= g.end_line GROUP BY 1),
gl AS (SELECT sample_id, sum(end_line - start_line + 1) AS gold_lines FROM g GROUP BY 1), pl AS (SELECT sample_id, sum(end_line - start_line + 1) AS predicted_lines FROM p GROUP BY 1),
j AS (SELECT gl.sample_id, CAST(gold_lines AS BIGINT) AS gold_lines, CAST(coalesce(predicted_lines, 0) AS BIGINT) AS predicted_lines, CAST(coalesce(overlap, 0) AS BIGINT) AS overlap FROM gl LEFT JOIN pl USING (sample_id) LEFT JOIN o USING (sample_id)),
k AS (SELECT *, overlap / gold_lines AS r, CASE WHEN predicted_lines > 0 THEN overlap / predicted_lines ELSE 0 END AS q FROM j)
SELECT sample_id, gold_lines, predicted_lines, overlap, round(r, 6) AS recall, round(q, 6) AS precision, round(CASE WHEN r > 0 OR q > 0 THEN 2 * q * r / (q + r) ELSE 0 END, 6) AS f1, round({_F("q", "r")}, 6) AS f05 FROM k""",
    "merge_intervals": "WITH rows_ AS (SELECT repo, base_commit, path, start_line, end_line FROM chunks WHERE kind = 'symbol') " + MERGE.format(key="repo, base_commit, path", rows="rows_"),
    "rank_depths": ranking_sql("lexical") + ", g AS (SELECT sample_id, unnest(gold_files) AS path FROM samples), f1 AS (SELECT g.sample_id, min(f.rank) AS first FROM g LEFT JOIN frank f ON f.sample_id = g.sample_id AND f.path = g.path GROUP BY 1) SELECT count(*) AS samples, " + ", ".join(f"count(*) FILTER (WHERE first <= {d}) AS within_{d}" for d in (1, 3, 5, 10, 20, 50, 100, 200)) + ", quantile_disc(first, 0.5) AS p50, quantile_disc(first, 0.9) AS p90 FROM f1",
    "rank_embedding": "WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id AS item_id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS score FROM q, embeddings) SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS rank, round(score, 5) AS score FROM s QUALIFY rank <= 20",
}
_ALL = [rank_lexical, rank_bm25, rank_code_only, rank_tests_only, rank_rrf, file_metrics_lexical, summary_bm25, gold_ranks, context_8k, token_budget_curve, line_metrics, merge_intervals, rank_depths, rank_embedding]
QUERIES = {f.__name__: f for f in _ALL}
