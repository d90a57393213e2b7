"""Reports over rankings, logs and grouped tables, with their SQL.

Where a report compares methods over tasks, customers' segments are the methods, order priorities the tasks, and the mean price the metric.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions import text
from loreline.operators import analysis, metrics, rank, samples, trajectories
from loreline.plans.behaviour import _FH, _STEPS, _gold, _hits, _steps
from loreline.plans.corpus import _ALL_M, _methods
from loreline.plans.retrieval import METRICS_SQL, SAMPLES_SQL, _base, _ranking, ranking_sql
from loreline.sources.tables import table


def _with_fixes(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "comment2context")
    return samples.current_samples(t).join(t.groupBy(F.col("id").alias("sample_id")).agg(F.max_by("gold.fix_commit", "version").alias("fix_commit")), "sample_id")


def leak_splits(spark: SparkSession, folder: str) -> DataFrame:
    s, r = _ranking(spark, folder, "lexical")
    m = metrics.file_metrics(rank.files(r), s)
    out = analysis.split_by_leaks(m, analysis.leak_flags(_with_fixes(spark, folder)), ["recall_20", "mrr"])
    return out.select("split", "samples", F.round("recall_20", 6).alias("recall_20"), F.round("mrr", 6).alias("mrr"))


def method_pivot(spark: SparkSession, folder: str) -> DataFrame:
    p = analysis.pivot_methods(_methods(spark, folder).withColumn("mrr", F.round("mrr", 6)), ["mrr"])
    return p.select("sample_id", F.array_join(F.array_sort(F.map_keys("methods")), "|").alias("methods"), F.element_at("methods", "bm25")["mrr"].alias("bm25_mrr"), F.element_at("methods", "lexical")["mrr"].alias("lexical_mrr"))


def best_methods(spark: SparkSession, folder: str) -> DataFrame:
    b = analysis.best_methods(_methods(spark, folder).withColumn("first", F.lit(None).cast("long")))
    return b.select("sample_id", "method", F.round("mrr", 6).alias("mrr"), F.round("recall_20", 6).alias("recall_20"))


def error_classes(spark: SparkSession, folder: str) -> DataFrame:
    s, chunks = _base(spark, folder)
    ranks = {"lexical": rank.files(rank.lexical(s, chunks)), "bm25": rank.files(rank.bm25(s, chunks))}
    rows = tops = None
    for name, r in ranks.items():
        m = metrics.file_metrics(r, s).select("sample_id", F.lit(name).alias("method"), "recall_5")
        t = r.filter("rank = 1").select("sample_id", F.lit(name).alias("method"), "path")
        rows, tops = (m, t) if rows is None else (rows.unionByName(m), tops.unionByName(t))
    raw = table(spark, folder, "comment2context").filter("id is not null")
    given = samples.latest(raw.select(F.col("id").alias("sample_id"), "version", samples.given_files().alias("given")), ["sample_id"], ["version"], ["given"]).select("sample_id", F.explode("given").alias("path"))
    return analysis.error_classes(rows.withColumnRenamed("recall_5", "recall_20"), tops, given, "lexical", "bm25")


def query_hints(spark: SparkSession, folder: str) -> DataFrame:
    s, r = _ranking(spark, folder, "bm25")
    m = metrics.file_metrics(rank.files(r), s).select("sample_id", "recall_20", "mrr")
    return analysis.query_hints(s.select("sample_id", "query_text", "gold_files").join(m, "sample_id"))


def metric_rates(spark: SparkSession, folder: str) -> DataFrame:
    m = _methods(spark, folder).withColumn("mrr", F.when(F.col("mrr") > 0, F.col("mrr")))
    return analysis.metric_rates(m.select("method", "mrr", "recall_20"), ["method"], ["mrr", "recall_20"]).select("method", "metric", "samples", F.round("mean", 6).alias("mean"))


def _means(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_mktsegment").alias("method"), F.col("o_orderpriority").alias("task_type")).agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).alias("n"))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


def macro_average(spark: SparkSession, folder: str) -> DataFrame:
    m = analysis.macro_average(_means(spark, folder), PRIORITIES, ["price"])
    return m.select("method", F.round("macro_price", 4).alias("macro_price"))


def weighted_means(spark: SparkSession, folder: str) -> DataFrame:
    m = analysis.weighted_means(_means(spark, folder), ["price"], "task_type", "n")
    return m.select("method", "groups", "samples", F.round("micro_price", 4).alias("micro_price"), F.round("macro_price", 4).alias("macro_price"))


def layered_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    m = _means(spark, folder)
    urgent = m.filter("task_type = '1-URGENT'").withColumn("price", F.round("price", 4))
    b = analysis.layered({"macro": (macro_average(spark, folder), "macro_price"), "micro": (weighted_means(spark, folder), "micro_price"), "urgent": (urgent, "price")})
    return b


def task_rank_correlation(spark: SparkSession, folder: str) -> DataFrame:
    c = analysis.rank_correlation(table(spark, folder, "orders"), "o_totalprice", "o_custkey", ["o_orderpriority"])
    return c.select("o_orderpriority", "n", F.round("spearman", 6).alias("spearman"))


def delta_decomposition(spark: SparkSession, folder: str) -> DataFrame:
    m = _means(spark, folder)
    counts = m.groupBy("task_type").agg(F.sum("n").alias("n"))
    d = analysis.delta_decomposition(m.select("method", "task_type", "price"), counts, "price")
    return d.select("task_type", "top", "runner_up", F.round("weighted_delta", 4).alias("weighted_delta"), F.round("share", 6).alias("share"))


def _calibrated(spark: SparkSession, folder: str) -> DataFrame:
    """Users' logs with and without their error events, the predicted saving being a tenth of their number."""
    steps = _steps(spark, folder)
    without = trajectories.first_hits(steps.filter("tool <> 'error' and sample_id % 5 <> 0"), _gold(spark, folder))
    control = _hits(spark, folder)
    return analysis.calibration(control.select("sample_id", (F.col("events") / 10.0).alias("predicted"), (F.col("sample_id") % 3).alias("group")), control, without)


def pes_calibration(spark: SparkSession, folder: str) -> DataFrame:
    c = _calibrated(spark, folder)
    return c.select("sample_id", "control_first", "seeded_first", "rescue", "lost", "both_hit", F.col("first_hit_delta").cast("long").alias("first_hit_delta"), F.col("event_saving").cast("long").alias("event_saving"))


def pes_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = analysis.calibration_summary(_calibrated(spark, folder), ["group"])
    real = ["predicted_mean", "first_hit_delta_mean", "event_saving_mean", "saving_ratio"]
    return s.select("group", "samples", "rescued", "lost", "both_hit", "improved", "regressed", *[F.round(c, 6).alias(c) for c in real])


def agent_retriever_costs(spark: SparkSession, folder: str) -> DataFrame:
    h = _hits(spark, folder)
    first = F.when(F.col("sample_id") % 4 != 0, F.col("sample_id") % 23 + 1)
    return analysis.joined_costs(h, h.select("sample_id", first.alias("first")), [3, 5, 10, 20])


def count_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return analysis.compare_counts(samples.current_samples(table(spark, folder, "comment2context")).select("repo"), table(spark, folder, "keep_list").select("repo").filter("repo is not null"), ["repo"]).filter("repo is not null")


def closed_tool_summary(spark: SparkSession, folder: str) -> DataFrame:
    tool = F.when(F.col("tool") == "view", "read").when(F.col("tool") == "signup", "search").otherwise(F.col("tool"))
    s = analysis.closed_tool_summary(_steps(spark, folder).withColumn("tool", tool), _gold(spark, folder))
    return s.withColumn("final_recall", F.round("final_recall", 6)).withColumn("final_precision", F.round("final_precision", 6))


_NAME = "string_split(lower(path), '/')[-1]"
_STEM = "lower(regexp_replace(string_split(path, '/')[-1], '([^.])\\.[^.]*$', '\\1'))"
_ALONE = lambda t: f"regexp_matches(low, '(^|[^a-z0-9_./-])' || regexp_escape({t}) || '([^a-z0-9_./-]|$)')"
_IN = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")"
_FLAGS = f"""fx AS (SELECT id, lower(trim(coalesce(gold.fix_commit, ''))) AS fix FROM now),
lq AS (SELECT e.sample_id, gold_files, replace(coalesce(query_text, ''), '\\n', chr(10)) AS q, lower(replace(coalesce(query_text, ''), '\\n', chr(10))) AS low, fix FROM every e JOIN fx ON fx.id = e.sample_id),
gf AS (SELECT sample_id, low, unnest(gold_files) AS path FROM lq),
ff AS (SELECT sample_id, CASE WHEN contains(low, lower(path)) THEN 'exact_gold_path' WHEN length({_NAME}) >= 6 AND {_NAME} NOT IN {_IN(analysis.COMMON_NAMES)} AND {_ALONE(_NAME)} THEN 'gold_basename'
       WHEN length(regexp_replace({_STEM}, '^_+|_+$', '', 'g')) >= 5 AND {_STEM} NOT IN {_IN(analysis.COMMON_STEMS)} AND NOT regexp_matches({_STEM}, '^[0-9]+$') AND {_ALONE(_STEM)} THEN 'gold_stem' END AS flag FROM gf),
flags AS (SELECT DISTINCT sample_id, flag, flag IN {_IN(analysis.FATAL)} AS fatal FROM (
  SELECT * FROM ff WHERE flag IS NOT NULL UNION ALL SELECT sample_id, 'raw_patch_marker' FROM lq WHERE regexp_matches(q, '{text.PATCH_MARKER}')
  UNION ALL SELECT sample_id, 'review_leakage' FROM lq WHERE {" OR ".join(f"contains(low, '{m}')" for m in text.REVIEW_LEAKS)}
  UNION ALL SELECT sample_id, 'fix_commit_hash' FROM lq WHERE length(fix) >= 7 AND contains(low, substr(fix, 1, 7))))"""
_MEANS = "WITH means AS (SELECT c_mktsegment AS method, o_orderpriority AS task_type, avg(o_totalprice) AS price, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
_MACRO = _MEANS + f", macro AS (SELECT method, round(avg(price), 4) AS macro_price FROM means WHERE task_type IN {_IN(PRIORITIES)} GROUP BY 1 HAVING count(DISTINCT task_type) = 4), micro AS (SELECT method, count(*) AS groups, CAST(sum(n) AS BIGINT) AS samples, round(sum(price * n) / sum(n), 4) AS micro_price, round(avg(price), 4) AS macro_price FROM means GROUP BY 1)"
_CAL = _FH + """, wo AS (SELECT s.sample_id, count(*) AS events, min(step) FILTER (WHERE list_contains(gold_files, path)) AS first_hit FROM steps s JOIN gold USING (sample_id) WHERE tool <> 'error' AND s.sample_id % 5 <> 0 GROUP BY 1),
cal AS (SELECT h.sample_id, h.sample_id % 3 AS "group", h.events / 10.0 AS predicted, h.first_hit AS control_first, wo.first_hit AS seeded_first, h.first_hit IS NULL AND wo.first_hit IS NOT NULL AS rescue, h.first_hit IS NOT NULL AND wo.first_hit IS NULL AS lost, h.first_hit IS NOT NULL AND wo.first_hit IS NOT NULL AS both_hit, h.first_hit - wo.first_hit AS first_hit_delta, h.events - wo.events AS event_saving FROM h LEFT JOIN wo USING (sample_id))"""
_R = lambda c, o: f"rank() OVER (PARTITION BY o_orderpriority ORDER BY {c} DESC) + (count(*) OVER (PARTITION BY o_orderpriority, {c}) - 1) / 2.0 AS {o}"

ORACLE = {
    "leak_splits": ranking_sql("lexical") + METRICS_SQL + ", " + _FLAGS + ", w AS (SELECT sample_id, bool_or(fatal) AS fatal FROM flags GROUP BY 1) SELECT CASE WHEN fatal IS NULL THEN 'clean' WHEN fatal THEN 'fatal_flagged' ELSE 'nonfatal_flagged' END AS split, count(*) AS samples, round(avg(recall_20), 6) AS recall_20, round(avg(mrr), 6) AS mrr FROM m LEFT JOIN w USING (sample_id) GROUP BY 1",
    "method_pivot": _ALL_M + " SELECT sample_id, string_agg(method, '|' ORDER BY method) AS methods, max(CASE WHEN method = 'bm25' THEN round(mrr, 6) END) AS bm25_mrr, max(CASE WHEN method = 'lexical' THEN round(mrr, 6) END) AS lexical_mrr FROM methods GROUP BY 1",
    "best_methods": _ALL_M + " SELECT sample_id, method, round(mrr, 6) AS mrr, round(recall_20, 6) AS recall_20 FROM methods QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY round(mrr, 9) DESC, round(recall_20, 9) DESC, method DESC) = 1",
    "error_classes": _ALL_M + """, t AS (SELECT sample_id, 'bm25' AS method, path FROM frank WHERE rank = 1 UNION ALL SELECT sample_id, 'lexical', path FROM frank_l WHERE rank = 1),
gv AS (SELECT id AS sample_id, unnest(CASE WHEN len(list_filter(coalesce(gold.given_files, []), lambda p: p IS NOT NULL AND p <> '')) > 0 THEN gold.given_files WHEN task_type = 'comment2context' THEN [coalesce(nullif(query.given_file, ''), query.path)] ELSE [] END) AS path FROM now),
p AS (SELECT sample_id, bool_or(recall_5 > 0) AS hit, bool_or(recall_5 > 0 AND method = 'lexical') AS a, bool_or(recall_5 > 0 AND method = 'bm25') AS b FROM methods GROUP BY 1)
SELECT sample_id, 'all_miss' AS class FROM p WHERE NOT hit UNION ALL SELECT sample_id, 'lexical_only' FROM p WHERE a AND NOT b UNION ALL SELECT sample_id, 'bm25_only' FROM p WHERE b AND NOT a
UNION ALL SELECT DISTINCT m.sample_id, 'given_file_first' FROM methods m JOIN t USING (sample_id, method) JOIN gv ON gv.sample_id = m.sample_id AND gv.path = t.path WHERE recall_5 <= 0""",
    "query_hints": ranking_sql("bm25") + METRICS_SQL + ", x AS (SELECT m.sample_id, recall_20 AS r, mrr, CASE WHEN len(list_filter(gold_files, lambda p: contains(lower(query_text), lower(p)))) > 0 THEN 'path' WHEN len(list_filter(gold_files, lambda p: contains(lower(query_text), lower(string_split(p, '/')[-1])))) > 0 THEN 'basename' ELSE 'none' END AS hint FROM m JOIN samples s USING (sample_id)) SELECT sample_id, hint, CASE WHEN r > 0 AND hint = 'path' THEN 'hit_by_path' WHEN r > 0 AND hint = 'basename' THEN 'hit_by_name' WHEN r > 0 AND mrr >= 0.25 THEN 'hit_high' WHEN r > 0 THEN 'hit_low' WHEN hint <> 'none' THEN 'miss_with_hint' ELSE 'miss' END AS bucket FROM x",
    "metric_rates": _ALL_M + " SELECT method, 'mrr' AS metric, count(*) AS samples, round(avg(mrr), 6) AS mean FROM methods WHERE mrr > 0 GROUP BY 1 UNION ALL SELECT method, 'recall_20', count(*), round(avg(recall_20), 6) FROM methods GROUP BY 1",
    "macro_average": _MACRO + " SELECT * FROM macro",
    "weighted_means": _MACRO + " SELECT * FROM micro",
    "layered_leaderboard": _MACRO + " SELECT method, ma.macro_price AS macro, mi.micro_price AS micro, u.price AS urgent FROM macro ma FULL JOIN micro mi USING (method) FULL JOIN (SELECT method, round(price, 4) AS price FROM means WHERE task_type = '1-URGENT') u USING (method)",
    "task_rank_correlation": f"WITH r AS (SELECT o_orderpriority, {_R('o_totalprice', 'rx')}, {_R('o_custkey', 'ry')} FROM orders) SELECT o_orderpriority, count(*) AS n, round(coalesce(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 0), 6) AS spearman FROM r GROUP BY 1",
    "delta_decomposition": _MEANS + ", c AS (SELECT task_type, sum(n) AS n FROM means GROUP BY 1), w AS (SELECT method, task_type, price * c.n / (SELECT sum(n) FROM c) AS w FROM means JOIN c USING (task_type)), o AS (SELECT method, sum(w) AS o, row_number() OVER (ORDER BY round(sum(w), 9) DESC, method) AS i FROM w GROUP BY 1), a AS (SELECT * FROM o WHERE i = 1), b AS (SELECT * FROM o WHERE i = 2) SELECT x.task_type, a.method AS top, b.method AS runner_up, round(x.w - y.w, 4) AS weighted_delta, round((x.w - y.w) / (a.o - b.o), 6) AS share FROM a, b JOIN w x ON x.method = (SELECT method FROM a) JOIN w y ON y.method = (SELECT method FROM b) AND y.task_type = x.task_type",
    "pes_calibration": _CAL + " SELECT sample_id, control_first, seeded_first, rescue, lost, both_hit, first_hit_delta, event_saving FROM cal",
    "pes_summary": _CAL + ' SELECT "group", count(*) AS samples, count(*) FILTER (WHERE rescue) AS rescued, count(*) FILTER (WHERE lost) AS lost, count(*) FILTER (WHERE both_hit) AS both_hit, count(*) FILTER (WHERE first_hit_delta > 0) AS improved, count(*) FILTER (WHERE first_hit_delta < 0) AS regressed, round(avg(predicted), 6) AS predicted_mean, round(avg(first_hit_delta), 6) AS first_hit_delta_mean, round(avg(event_saving), 6) AS event_saving_mean, round(sum(CASE WHEN both_hit AND predicted > 0 THEN greatest(0, first_hit_delta) END) / sum(CASE WHEN both_hit AND predicted > 0 THEN predicted END), 6) AS saving_ratio FROM cal GROUP BY 1',
    "agent_retriever_costs": _FH + ", x AS (SELECT CASE WHEN first_hit IS NULL THEN 'miss' WHEN first_hit > 3 THEN 'late' ELSE 'early' END AS subset, CASE WHEN sample_id % 4 <> 0 THEN sample_id % 23 + 1 END AS first FROM h), y AS (SELECT subset, first FROM x UNION ALL SELECT 'all', first FROM x) SELECT subset, count(*) AS samples, d AS depth, count(*) FILTER (WHERE first <= d) AS found FROM y, (SELECT unnest([3, 5, 10, 20]) AS d) GROUP BY subset, d",
    "count_comparison": SAMPLES_SQL.replace("{filter}", "true") + "a AS (SELECT repo, count(*) AS base FROM every GROUP BY 1), b AS (SELECT repo, count(*) AS seed FROM keep_list GROUP BY 1) SELECT repo, coalesce(base, 0) AS base, coalesce(seed, 0) AS seed, coalesce(seed, 0) - coalesce(base, 0) AS delta FROM a FULL JOIN b USING (repo) WHERE repo IS NOT NULL",
    "closed_tool_summary": _STEPS + ", s AS (SELECT sample_id, path, is_final, CASE tool WHEN 'view' THEN 'read' WHEN 'signup' THEN 'search' ELSE tool END AS tool, list_contains(gold_files, path) AS g, len(gold_files) AS n FROM steps JOIN gold USING (sample_id)), p AS (SELECT sample_id, any_value(n) AS n, count(*) AS calls, count(*) FILTER (WHERE tool = 'search') AS searches, count(*) FILTER (WHERE tool = 'read') AS reads, count(DISTINCT path) FILTER (WHERE is_final) AS final_files, bool_or(g) AS any_gold, count(DISTINCT path) FILTER (WHERE is_final AND g) AS found FROM s GROUP BY 1) SELECT sample_id, calls, searches, reads, final_files, any_gold, round(found / n, 6) AS final_recall, round(CASE WHEN final_files > 0 THEN found / final_files ELSE 0 END, 6) AS final_precision FROM p",
}
_ALL = [leak_splits, method_pivot, best_methods, error_classes, query_hints, metric_rates, macro_average, weighted_means, layered_leaderboard, task_rank_correlation, delta_decomposition, pes_calibration, pes_summary, agent_retriever_costs, count_comparison, closed_tool_summary]
QUERIES = {f.__name__: f for f in _ALL}
