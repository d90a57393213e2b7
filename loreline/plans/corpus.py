"""Corpus building, graphs, mining, curation, reports and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.operators import corpus, curation, graph, metrics, mining, rank, reports
from loreline.operators.analysis import tertiles_at_scale
from loreline.operators.samples import current_chunks, current_samples
from loreline.operators.snapshots import snapshot_index
from loreline.plans.data_quality import SNAPSHOTS_SQL
from loreline.plans.retrieval import BM25_SQL, LEXICAL_SQL, METRICS_SQL, RANKED_SQL, SAMPLES_SQL, TERMS_SQL, _base, code_sql, test_sql
from loreline.sources.tables import table
from loreline.streaming import event_log


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return current_chunks(table(spark, folder, "chunks")).filter("kind = 'file'").select("repo", "base_commit", "path", "text")


def chunk_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and blank lines of every chunk."""
    ls = corpus.lines(F.col("text"))
    return table(spark, folder, "chunks").filter(F.col("text").isNotNull()).select("chunk_id", F.size(ls).cast("long").alias("n_lines"), F.size(F.filter(ls, lambda x: F.trim(x) == "")).cast("long").alias("blank_lines")).distinct()


def symbol_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.symbols(_files(spark, folder)).select("repo", "base_commit", "path", "symbol", *[F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")])


def manifest_counts(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.kind_counts(current_chunks(table(spark, folder, "chunks")))


def manifest_merge(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.merge_manifests(table(spark, folder, "corpus_manifest"))


def corpus_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.bounds(table(spark, folder, "chunks"))


def upsert_prefer_ok(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "corpus_manifest").select("repo", "base_commit", "status", "chunk_count", "generated_at")
    return corpus.upsert(m.filter("not status <=> 'ok'"), m.filter("status = 'ok'"), ["repo", "base_commit"], ~F.col("status").eqNullSafe("ok"), "generated_at")


def span_to_blocks(spark: SparkSession, folder: str) -> DataFrame:
    samples = current_samples(table(spark, folder, "comment2context"))
    spans = samples.select("sample_id", "repo", "base_commit", F.explode("gold_spans").alias("s")).select("sample_id", "repo", "base_commit", "s.path", "s.start_line", "s.end_line")
    return corpus.blocks_of_spans(spans, current_chunks(table(spark, folder, "chunks")))


def file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The distribution of file lengths in lines, and the shares beyond some thresholds."""
    b = corpus.bounds(table(spark, folder, "chunks")).filter("last_line is not null")
    pct = [F.expr(f"percentile(last_line, {q})").alias(n) for q, n in ((0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"))]
    out = b.agg(F.count(F.lit(1)).alias("files"), F.min("last_line").cast("long").alias("least"), *pct, F.max("last_line").cast("long").alias("most"), *[F.avg((F.col("last_line") > t).cast("int")).alias(f"over_{t}") for t in (50, 200, 500)])
    return out.select("files", "least", "most", *[F.round(c, 6).alias(c) for c in ("p50", "p75", "p90", "p95", "over_50", "over_200", "over_500")])


def _purchases(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parts and suppliers that trade with each other, both ways, by revenue."""
    e = table(spark, folder, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), F.col("l_quantity").alias("w"))
    edges = e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").union(e.select("b", "a", "w")).groupBy("src", "dst").agg(F.sum("w").alias("weight"))
    nodes = edges.select(F.col("src").alias("node")).distinct().withColumn("seed", F.when(F.col("node").startswith("s"), 1.0).otherwise(0.0))
    return nodes, edges


def pagerank_3(spark: SparkSession, folder: str) -> DataFrame:
    return graph.pagerank(*_purchases(spark, folder), iterations=3).select("node", F.round("rank", 8).alias("rank"))


def pagerank_24(spark: SparkSession, folder: str) -> DataFrame:
    return graph.pagerank(*_purchases(spark, folder)).select("node", F.round("rank", 8).alias("rank"))


def response_window(spark: SparkSession, folder: str) -> DataFrame:
    """For each error of a user, the first purchase within 72 hours after it, and how many there are."""
    e = table(spark, folder, "events")
    out = mining.first_within(e.filter("event_type = 'error'").select("user_id", "ts", "event_id"), e.filter("event_type = 'purchase'").select("user_id", "ts"), ["user_id"], "ts", 72)
    return out.select("event_id", "user_id", "response", "responses")


def rerun_pairs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").filter("event_type in ('error', 'purchase')").select("user_id", F.get_json_object("props", "$.k").alias("k"), F.col("ts").alias("at"), (F.col("event_type") == "purchase").alias("ok"))
    return mining.reruns(e, ["user_id", "k"])


def drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Why samples are dropped: the first rule each breaks, counted."""
    s = current_samples(table(spark, folder, "comment2context"))
    words = F.size(F.filter(F.split(F.coalesce("query_text", F.lit("")), r"\s+"), lambda x: x != ""))
    reason = mining.first_reason([("no_base_commit", F.coalesce("base_commit", F.lit("")) == ""), ("no_gold", F.size("gold_files") == 0), ("too_much_gold", F.size("gold_files") > 2), ("short_query", words < 20), ("no_negatives", F.size("hard_negatives") == 0)])
    return s.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("samples"))


def format_only(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with changed lines, and whether the change is one of format only."""
    d = table(spark, folder, "documents").filter(F.col("text").rlike("(?m)^[+-]"))
    return d.select("doc_id", mining.is_format_only(F.col("text")).alias("format_only"))


def keep_list_join(spark: SparkSession, folder: str) -> DataFrame:
    return curation.keep(current_samples(table(spark, folder, "comment2context")), table(spark, folder, "keep_list")).select("sample_id", "task_type", "repo")


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    s = current_samples(table(spark, folder, "comment2context")).filter("repo is not null")
    return curation.round_robin(s.select("sample_id", "repo"), ["repo"], ["sample_id"], 50).select("sample_id", "repo", F.col("turn").cast("long").alias("turn"))


def balanced_sample(spark: SparkSession, folder: str) -> DataFrame:
    s = current_samples(table(spark, folder, "comment2context")).filter("repo is not null")
    return curation.balanced(s.select("sample_id", "repo"), "repo", 3, "audit").select("sample_id", "repo", F.col("draw").cast("long").alias("draw"))


def modulo_shards(spark: SparkSession, folder: str) -> DataFrame:
    return curation.modulo_shards(current_samples(table(spark, folder, "comment2context")).select("sample_id"), "sample_id", 8).groupBy("shard").agg(F.count(F.lit(1)).alias("samples"))


def weighted_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Repositories to shards by their number of chunks; repositories are few and listed on the driver."""
    w = [(r["repo"], r["n"]) for r in table(spark, folder, "chunks").groupBy("repo").agg(F.count(F.lit(1)).alias("n")).collect()]
    return spark.createDataFrame(sorted(curation.weighted_shards(w, 8).items()) or [], "repo string, shard int")


def audit_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Samples that two audits judge differently: the keep list, and one that doubts the samples whose ids end in a digit below 8."""
    k = table(spark, folder, "keep_list").select("sample_id", "verdict")
    return curation.conflicts(k.unionByName(k.filter(F.col("sample_id").rlike("[0-7]$")).select("sample_id", F.lit("Ambiguous ").alias("verdict"))))


def readiness_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return curation.readiness(current_samples(table(spark, folder, "comment2context")), snapshot_index(table(spark, folder, "corpus_manifest")), table(spark, folder, "keep_list"))


def _methods(spark: SparkSession, folder: str) -> DataFrame:
    samples, chunks = _base(spark, folder)
    m = None
    for name, f in (("lexical", rank.lexical), ("bm25", rank.bm25)):
        part = metrics.file_metrics(rank.files(f(samples, chunks)), samples).withColumn("method", F.lit(name))
        m = part if m is None else m.unionByName(part)
    return m


def pearson_spearman(spark: SparkSession, folder: str) -> DataFrame:
    """How recall and nDCG of the methods go together."""
    c = reports.correlations(_methods(spark, folder).select("method", F.round("ndcg_20", 9).alias("x"), F.round("coverage_auc_20", 9).alias("y")), "x", "y", ["method"])
    return c.select("method", "n", F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def tertile_buckets(spark: SparkSession, folder: str) -> DataFrame:
    b = tertiles_at_scale(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"], "o_orderkey")
    return b.groupBy("o_orderpriority", "bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def cross_model_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return reports.coverage(_methods(spark, folder).select("sample_id", "method", (F.col("recall_20") > 0).alias("hit")), 2)


def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    means = _methods(spark, folder).groupBy("task_type", "method").agg(F.avg("mrr").alias("mrr"), F.avg("recall_20").alias("recall_20"))
    return reports.leaderboard(means, ["task_type"], ["mrr", "recall_20"]).select("task_type", "method", F.col("place").cast("long").alias("place"), F.round("mrr", 6).alias("mrr"), F.round("recall_20", 6).alias("recall_20"))


def metric_spread(spark: SparkSession, folder: str) -> DataFrame:
    means = _methods(spark, folder).groupBy("task_type", "method").agg(*[F.avg(m).alias(m) for m in ("mrr", "recall_20", "ndcg_20")])
    s = reports.spread(reports.unpivoted(means, ["task_type", "method"], ["mrr", "recall_20", "ndcg_20"]), ["task_type", "metric"], "value")
    return s.select("task_type", "metric", *[F.round(c, 6).alias(c) for c in ("best", "median", "worst", "lead")])


def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    return event_log.run(event_log.deduplicated(event_log.read_events(spark, f"{folder}/events.parquet*"))).select("event_id", "event_type")


def stream_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    t = event_log.run(event_log.tumbling(event_log.read_events(spark, f"{folder}/events.parquet*")), "complete")
    return t.select("window_start", "event_type", "events", F.round("value", 2).alias("value"), "most")


_NOW = "cur AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)"
_LINES = r"(CASE WHEN ends_with(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) OR text = '' THEN list_slice(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), 1, len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) - 1) ELSE string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) END)"
_SYM = "coalesce(" + ", ".join("nullif(regexp_extract(x, '" + p + "', 1), '')" for p in corpus.SYMBOL_PATTERNS) + ")"
_NODES = "WITH e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, l_quantity AS w FROM lineitem), edges AS (SELECT src, dst, sum(w) AS weight FROM (SELECT a AS src, b AS dst, w FROM e UNION ALL SELECT b, a, w FROM e) GROUP BY 1, 2), o AS (SELECT src, sum(weight) AS total FROM edges GROUP BY 1), nb AS (SELECT DISTINCT src AS node, CASE WHEN starts_with(src, 's') THEN 1.0 ELSE 0.0 END AS seed FROM edges), r0 AS (SELECT node, CAST(seed AS DOUBLE) / sum(seed) OVER () AS base, CAST(seed AS DOUBLE) / sum(seed) OVER () AS rank FROM nb)"
_STEP = ", r{1} AS (SELECT r.node, r.base, 0.15 * r.base + 0.85 * coalesce(f, 0) AS rank FROM r{0} r LEFT JOIN (SELECT dst, sum(rank * weight / total) AS f FROM edges JOIN o USING (src) JOIN r{0} ON r{0}.node = edges.src GROUP BY 1) x ON x.dst = r.node)"
_ALL_M = (
    SAMPLES_SQL.replace("{filter}", "true") + TERMS_SQL + LEXICAL_SQL.replace("hits", "hits_l").replace("scored AS", "scored_l AS")
    + RANKED_SQL.replace("ranking", "ranking_l").replace("scored", "scored_l").replace("ffirst", "ffirst_l").replace("frank AS", "frank_l AS")
    + METRICS_SQL.replace("frank", "frank_l").replace("marked", "marked_l").replace("sums", "sums_l").replace("\nm AS", "\nml AS") + ", " + BM25_SQL + RANKED_SQL + METRICS_SQL
    + ", methods AS (SELECT 'lexical' AS method, * FROM ml UNION ALL SELECT 'bm25', * FROM m)"
)
_STEMMED = "lower(regexp_replace(string_split(path, '/')[-1], '([^.])\\.[^.]*$', '\\1'))"

ORACLE = {
    "chunk_lines": f"SELECT DISTINCT chunk_id, len({_LINES}) AS n_lines, len(list_filter({_LINES}, lambda x: trim(x) = '')) AS blank_lines FROM chunks WHERE text IS NOT NULL",
    "symbol_chunks": f"WITH {_NOW}, f AS (SELECT repo, base_commit, path, {_LINES} AS ls FROM cur WHERE kind = 'file' AND text IS NOT NULL), l AS (SELECT repo, base_commit, path, len(ls) AS n, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM f), s AS (SELECT *, {_SYM} AS symbol FROM l) SELECT repo, base_commit, path, symbol, i AS start_line, greatest(i, coalesce(lead(i) OVER (PARTITION BY repo, base_commit, path ORDER BY i), n + 1) - 1) AS end_line FROM s WHERE symbol IS NOT NULL",
    "manifest_counts": f"WITH {_NOW} SELECT repo, base_commit, count(*) FILTER (WHERE kind = 'file') AS files, count(*) FILTER (WHERE kind = 'symbol') AS symbols, count(*) AS chunks FROM cur GROUP BY 1, 2",
    "manifest_merge": "SELECT repo, base_commit, status, base_ref, chunk_count FROM corpus_manifest QUALIFY row_number() OVER (PARTITION BY repo, base_commit ORDER BY (status = 'ok') DESC, generated_at DESC, base_ref DESC, chunk_count DESC) = 1",
    "corpus_bounds": "SELECT repo, base_commit, path, max(end_line) AS last_line FROM chunks GROUP BY 1, 2, 3",
    "upsert_prefer_ok": "SELECT repo, base_commit, status, chunk_count, generated_at FROM corpus_manifest QUALIFY row_number() OVER (PARTITION BY repo, base_commit ORDER BY coalesce(status = 'ok', false) DESC, generated_at DESC, chunk_count DESC NULLS LAST) = 1",
    "span_to_blocks": SAMPLES_SQL.replace("{filter}", "true").replace("cand AS", "cand_ AS") + "sp AS (SELECT sample_id, repo, base_commit, s.path AS path, s.start_line AS sl, s.end_line AS el FROM (SELECT *, unnest(gold_spans) AS s FROM every) WHERE s.path <> '' AND s.start_line IS NOT NULL AND s.end_line IS NOT NULL), h AS (SELECT p.sample_id, p.path, p.sl, p.el, c.start_line, c.end_line, c.chunk_id, c.symbol FROM sp p JOIN cur c ON c.repo = p.repo AND c.base_commit = p.base_commit AND c.path = p.path AND c.kind = 'symbol' AND p.sl <= c.end_line AND c.start_line <= p.el) SELECT DISTINCT sample_id, path, start_line, end_line, chunk_id, symbol, 'symbol' AS source FROM h UNION ALL SELECT DISTINCT sample_id, path, sl, el, NULL, NULL, 'span_fallback' FROM sp WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.sample_id = sp.sample_id AND h.path = sp.path AND h.sl = sp.sl AND h.el = sp.el)",
    "file_sizes": "WITH b AS (SELECT max(end_line) AS l FROM chunks GROUP BY repo, base_commit, path) SELECT count(*) AS files, CAST(min(l) AS BIGINT) AS least, CAST(max(l) AS BIGINT) AS most, round(quantile_cont(l, 0.5), 6) AS p50, round(quantile_cont(l, 0.75), 6) AS p75, round(quantile_cont(l, 0.9), 6) AS p90, round(quantile_cont(l, 0.95), 6) AS p95, round(avg((l > 50)::INT), 6) AS over_50, round(avg((l > 200)::INT), 6) AS over_200, round(avg((l > 500)::INT), 6) AS over_500 FROM b WHERE l IS NOT NULL",
    "pagerank_3": _NODES + "".join(_STEP.format(i, i + 1) for i in range(3)) + " SELECT node, round(rank, 8) AS rank FROM r3",
    "response_window": "WITH e AS (SELECT * FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase') SELECT e.event_id, e.user_id, min(p.ts) AS response, count(p.ts) AS responses FROM e LEFT JOIN p ON p.user_id = e.user_id AND p.ts > e.ts AND p.ts <= e.ts + INTERVAL 72 HOURS GROUP BY 1, 2",
    "rerun_pairs": "WITH r AS (SELECT user_id, json_extract_string(props, '$.k') AS k, ts, event_type = 'purchase' AS ok FROM events WHERE event_type IN ('error', 'purchase')), f AS (SELECT user_id, k, min(ts) AS failed_at FROM r WHERE NOT ok GROUP BY 1, 2) SELECT f.user_id, f.k, failed_at, min(r.ts) AS passed_at FROM f JOIN r ON r.user_id = f.user_id AND r.k = f.k AND r.ok AND r.ts >= failed_at GROUP BY 1, 2, 3",
    "drop_reasons": SAMPLES_SQL.replace("{filter}", "true") + "r AS (SELECT CASE WHEN coalesce(base_commit, '') = '' THEN 'no_base_commit' WHEN len(gold_files) = 0 THEN 'no_gold' WHEN len(gold_files) > 2 THEN 'too_much_gold' WHEN len(list_filter(regexp_split_to_array(coalesce(query_text, ''), '\\s+'), lambda x: x <> '')) < 20 THEN 'short_query' WHEN len(hard_negatives) = 0 THEN 'no_negatives' ELSE 'kept' END AS reason FROM every) SELECT reason, count(*) AS samples FROM r GROUP BY 1",
    "keep_list_join": SAMPLES_SQL.replace("{filter}", "true") + "k AS (SELECT sample_id FROM keep_list WHERE coalesce(lower(trim(verdict)), '') IN ('', 'valid')) SELECT sample_id, task_type, repo FROM every WHERE sample_id IN (SELECT sample_id FROM k)",
    "round_robin": SAMPLES_SQL.replace("{filter}", "true") + "t AS (SELECT sample_id, repo, row_number() OVER (PARTITION BY repo ORDER BY sample_id) AS turn FROM every WHERE repo IS NOT NULL) SELECT * FROM t ORDER BY turn, repo, sample_id LIMIT 50",
    "balanced_sample": SAMPLES_SQL.replace("{filter}", "true") + "t AS (SELECT sample_id, repo, row_number() OVER (PARTITION BY repo ORDER BY sha256('audit' || chr(31) || sample_id), sample_id) AS draw FROM every WHERE repo IS NOT NULL) SELECT * FROM t WHERE draw <= 3",
    "audit_conflicts": "WITH a AS (SELECT sample_id, lower(trim(verdict)) AS v FROM keep_list WHERE trim(verdict) <> '' UNION ALL SELECT sample_id, 'ambiguous' FROM keep_list WHERE regexp_matches(sample_id, '[0-7]$')) SELECT sample_id, array_to_string(list_sort(list(DISTINCT v)), ',') AS verdicts FROM a GROUP BY 1 HAVING count(DISTINCT v) > 1",
    "readiness_gaps": SAMPLES_SQL.replace("{filter}", "true") + SNAPSHOTS_SQL.strip() + ", k AS (SELECT DISTINCT sample_id FROM keep_list WHERE sample_id IS NOT NULL), j AS (SELECT coalesce(p.counts, false) AS s, len(gold_files) > 0 AS g, length(trim(coalesce(query_text, ''))) > 0 AS q, k.sample_id IS NOT NULL AS a FROM every e LEFT JOIN snapshots p ON p.repo = e.repo AND p.base_commit = e.base_commit LEFT JOIN k ON k.sample_id = e.sample_id) SELECT 'snapshot' AS gate, count(*) FILTER (WHERE NOT s) AS failing FROM j UNION ALL SELECT 'gold', count(*) FILTER (WHERE NOT g) FROM j UNION ALL SELECT 'query', count(*) FILTER (WHERE NOT q) FROM j UNION ALL SELECT 'audited', count(*) FILTER (WHERE NOT a) FROM j",
    "pearson_spearman": _ALL_M + ", x AS (SELECT method, round(ndcg_20, 9) AS x, round(coverage_auc_20, 9) AS y FROM methods), r AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY x) + (count(*) OVER (PARTITION BY method, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY method ORDER BY y) + (count(*) OVER (PARTITION BY method, y) - 1) / 2.0 AS ry FROM x) SELECT method, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS pearson, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) AS spearman FROM r GROUP BY 1",
    "tertile_buckets": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, CASE WHEN i < n // 3 THEN 'low' WHEN i < 2 * n // 3 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM r GROUP BY 1, 2",
    "cross_model_coverage": _ALL_M + ", c AS (SELECT sample_id, count(*) FILTER (WHERE recall_20 > 0) AS h FROM methods GROUP BY 1) SELECT b.h AS methods_hit, count(c.h) AS samples FROM (SELECT unnest([0, 1, 2]) AS h) b LEFT JOIN c ON c.h = b.h GROUP BY 1",
    "leaderboard": _ALL_M + ", a AS (SELECT task_type, method, avg(mrr) AS mrr, avg(recall_20) AS recall_20 FROM methods GROUP BY 1, 2) SELECT task_type, method, row_number() OVER (PARTITION BY task_type ORDER BY round(mrr, 9) DESC, round(recall_20, 9) DESC, method) AS place, round(mrr, 6) AS mrr, round(recall_20, 6) AS recall_20 FROM a",
    "metric_spread": _ALL_M + ", a AS (SELECT task_type, method, avg(mrr) AS mrr, avg(recall_20) AS recall_20, avg(ndcg_20) AS ndcg_20 FROM methods GROUP BY 1, 2), u AS (SELECT task_type, 'mrr' AS metric, mrr AS v FROM a UNION ALL SELECT task_type, 'recall_20', recall_20 FROM a UNION ALL SELECT task_type, 'ndcg_20', ndcg_20 FROM a) SELECT task_type, metric, round(max(v), 6) AS best, round(median(v), 6) AS median, round(min(v), 6) AS worst, round(max(v) - median(v), 6) AS lead FROM u GROUP BY 1, 2",
    "modulo_shards": "SELECT CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 8 AS shard, count(DISTINCT id) AS samples FROM comment2context WHERE id IS NOT NULL GROUP BY 1",
    "format_only": "WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE regexp_matches(text, '(?m)^[+-]')), s AS (SELECT doc_id, list_sort(list_filter(list_transform(list_filter(ls, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: regexp_replace(substr(x, 2), '\\s+', '', 'g')), lambda x: x <> '')) AS p, list_sort(list_filter(list_transform(list_filter(ls, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), lambda x: regexp_replace(substr(x, 2), '\\s+', '', 'g')), lambda x: x <> '')) AS m FROM d) SELECT doc_id, len(p) + len(m) > 0 AND p = m AS format_only FROM s",
    "pagerank_24": _NODES + "".join(_STEP.format(i, i + 1) for i in range(24)) + " SELECT node, round(rank, 8) AS rank FROM r24",
    "stream_dedupe": "SELECT DISTINCT event_id, event_type FROM events",
    "stream_tumbling": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 2) AS value, max(value) AS most FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
_ALL = [chunk_lines, symbol_chunks, manifest_counts, manifest_merge, corpus_bounds, upsert_prefer_ok, span_to_blocks, file_sizes, pagerank_3, pagerank_24, response_window, rerun_pairs, drop_reasons, format_only, keep_list_join, round_robin, balanced_sample, modulo_shards, weighted_shards, audit_conflicts, readiness_gaps, pearson_spearman, tertile_buckets, cross_model_coverage, leaderboard, metric_spread, stream_dedupe, stream_tumbling]
QUERIES = {f.__name__: f for f in _ALL}
