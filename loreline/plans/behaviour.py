"""Selective retrieval over the samples, and agent logs made from the events table, with their SQL.

Of an event, the user is the sample, the type the tool, props.k the file; purchases are final, clicks utilized context.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.operators import rank, selective, trajectories
from loreline.plans.retrieval import _ranking, ranking_sql
from loreline.sources.tables import table


def _details(spark: SparkSession, folder: str) -> DataFrame:
    samples, r = _ranking(spark, folder, "lexical")
    # confidences and margins are kept at nine decimals, so that equal scores stay equal however they were summed
    return selective.details(r.withColumn("score", F.round("score", 9)), rank.files(r), samples)


def selective_details(spark: SparkSession, folder: str) -> DataFrame:
    return _details(spark, folder).select("sample_id", "label", *[F.round(c, 6).alias(c) for c in ("confidence", "second", "margin", "recall_20")])


def _sweep(spark: SparkSession, folder: str) -> DataFrame:
    return selective.threshold_sweep(_details(spark, folder))


def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return _sweep(spark, folder).select(F.round("threshold", 6).alias("threshold"), *[F.round(c, 6).alias(c) for c in selective.RATES])


def operating_points(spark: SparkSession, folder: str) -> DataFrame:
    return selective.operating_points(_sweep(spark, folder)).select("point", F.round("threshold", 6).alias("threshold"), F.round("value", 6).alias("value"))


def confidence_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = _details(spark, folder).groupBy("label")
    pct = [F.expr(f"percentile(confidence, {q})").alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"))]
    out = d.agg(F.count(F.lit(1)).alias("samples"), F.min("confidence").alias("least"), *pct, F.max("confidence").alias("most"), F.avg("confidence").alias("mean"))
    return out.select("label", "samples", *[F.round(c, 6).alias(c) for c in ("least", "p25", "p50", "p75", "p90", "most", "mean")])


def group_cv(spark: SparkSession, folder: str) -> DataFrame:
    return selective.cross_validate(_details(spark, folder), 3)


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 20
    rows = table(spark, folder, "events").select(F.col("user_id").alias("sample_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit(None).cast("int").alias("step"), F.col("event_type").alias("tool"), F.concat(F.lit("src/f"), k.cast("string"), F.lit(".py")).alias("path"), (F.col("event_type") == "purchase").alias("is_final"), (F.col("event_type") == "click").alias("is_utilized"))
    return trajectories.normalize(rows)


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "events").select(F.col("user_id").alias("sample_id")).distinct()
    file = lambda n: F.concat(F.lit("src/f"), n.cast("string"), F.lit(".py"))
    return users.select("sample_id", F.array_distinct(F.array(file(F.col("sample_id") % 20), file(F.col("sample_id") * 7 % 20))).alias("gold_files"))


def normalized_steps(spark: SparkSession, folder: str) -> DataFrame:
    return _steps(spark, folder).select("sample_id", F.col("step").cast("long").alias("step"), "tool", "path", "is_final", "is_utilized")


_SETS = [f"{n}_{m}" for n in ("retrieved", "final", "utilized") for m in ("recall", "precision", "f1")] + ["redundancy", "final_drop", "utilization_drop"]


def trajectory_set_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return trajectories.set_metrics(_steps(spark, folder), _gold(spark, folder)).select("sample_id", *[F.round(c, 6).alias(c) for c in _SETS])


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    return trajectories.first_hits(_steps(spark, folder), _gold(spark, folder))


def first_gold_step(spark: SparkSession, folder: str) -> DataFrame:
    return _hits(spark, folder).select("sample_id", "events", F.col("first_hit").cast("long").alias("first_hit"), "final_hit", "utilized_hit")


def agent_cost(spark: SparkSession, folder: str) -> DataFrame:
    s = trajectories.cost_summary(_hits(spark, folder))
    real = {"events_mean", "events_median", "hit_rate", "first_hit_median", "first_hit_mean"}
    return s.select(*[F.round(c, 6).alias(c) if c in real else c for c in s.columns])


def budget_prefix(spark: SparkSession, folder: str) -> DataFrame:
    b = trajectories.budget_prefix(_steps(spark, folder), _gold(spark, folder), [1, 2, 4, 8, 16, 32])
    return b.withColumn("mean_recall", F.round("mean_recall", 6))


def complementarity(spark: SparkSession, folder: str) -> DataFrame:
    """Agents against a retriever that finds gold where a user has an error event on a gold file."""
    marks = _gold(spark, folder).select("sample_id", F.explode("gold_files").alias("path"))
    errors = _steps(spark, folder).filter("tool = 'error'").join(marks, ["sample_id", "path"], "left_semi").select("sample_id").distinct().withColumn("retriever_hit", F.lit(True))
    every = _gold(spark, folder).select("sample_id").join(errors, "sample_id", "left")
    return trajectories.complementarity(_hits(spark, folder), every).withColumn("savings", F.round("savings", 6))


def pairwise_intervention(spark: SparkSession, folder: str) -> DataFrame:
    m = trajectories.set_metrics(_steps(spark, folder), _gold(spark, folder))
    p = trajectories.paired(m.select("sample_id", F.col("final_f1").alias("value")), m.select("sample_id", F.col("utilized_f1").alias("value")))
    return p.withColumn("mean_delta", F.round("mean_delta", 6))


_SELECT = ranking_sql("lexical").replace("score) AS chars", "score) AS chars") + """,
top AS (SELECT sample_id, round(max(CASE WHEN rank = 1 THEN score END), 9) AS confidence, coalesce(round(max(CASE WHEN rank = 2 THEN score END), 9), 0) AS second FROM ranking GROUP BY 1),
g AS (SELECT sample_id, unnest(gold_files) AS path FROM samples),
gh AS (SELECT g.sample_id, count(*) AS there, count(*) FILTER (WHERE f.rank <= 20) AS hits FROM g JOIN frank f ON f.sample_id = g.sample_id AND f.path = g.path GROUP BY 1),
d AS (SELECT t.sample_id, s.repo, CASE WHEN coalesce(there, 0) > 0 THEN 'positive' ELSE 'no_gold' END AS label, confidence, second, confidence - second AS margin, CASE WHEN len(s.gold_files) > 0 THEN coalesce(hits, 0) / len(s.gold_files) ELSE 0 END AS recall_20
      FROM top t JOIN samples s USING (sample_id) LEFT JOIN gh USING (sample_id))
"""
_SWEEP = _SELECT + """,
sc AS (SELECT DISTINCT confidence FROM d),
th AS (SELECT CAST('-Infinity' AS DOUBLE) AS threshold UNION ALL SELECT coalesce((confidence + lead(confidence) OVER (ORDER BY confidence)) / 2.0, confidence + greatest(1e-9, abs(confidence) * 1e-9)) FROM sc),
cf AS (SELECT threshold, count(*) FILTER (WHERE label = 'no_gold' AND confidence < threshold) AS na, count(*) FILTER (WHERE label = 'no_gold') AS tn, count(*) FILTER (WHERE label = 'positive' AND confidence >= threshold) AS pr, count(*) FILTER (WHERE label = 'positive') AS tp,
       count(*) FILTER (WHERE label = 'positive' AND confidence >= threshold AND recall_20 > 0) AS hr, sum(CASE WHEN label = 'positive' AND confidence >= threshold THEN recall_20 ELSE 0 END) AS rr FROM th, d GROUP BY threshold),
q AS (SELECT *, CASE WHEN tp > 0 THEN pr / tp ELSE 0 END AS positive_pass_rate, CASE WHEN tn > 0 THEN na / tn ELSE 0 END AS no_gold_abstain_rate, CASE WHEN na + tp - pr > 0 THEN na / (na + tp - pr) ELSE 0 END AS abstain_precision, (na + pr) / (tn + tp) AS selective_accuracy FROM cf),
sweep AS (SELECT threshold, (tn + tp - na - (tp - pr)) / (tn + tp) AS coverage, positive_pass_rate, no_gold_abstain_rate, abstain_precision,
       CASE WHEN abstain_precision + no_gold_abstain_rate > 0 THEN 2 * abstain_precision * no_gold_abstain_rate / (abstain_precision + no_gold_abstain_rate) ELSE 0 END AS abstain_f1, selective_accuracy,
       CASE WHEN tp > 0 AND tn > 0 THEN (positive_pass_rate + no_gold_abstain_rate) / 2 ELSE selective_accuracy END AS balanced_accuracy, (na + hr) / (tn + tp) AS selective_success_20, CASE WHEN pr > 0 THEN rr / pr ELSE 0 END AS accepted_recall_20 FROM q)
"""
_POINT = "(SELECT '{0}' AS point, threshold, {2} AS value FROM sweep WHERE {1} ORDER BY round({2}, 9) DESC, round(balanced_accuracy, 9) DESC, round(selective_accuracy, 9) DESC, threshold LIMIT 1)"
_STEPS = """WITH steps AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS tool, 'src/f' || CAST(CAST(json_extract(props, '$.k') AS INT) % 20 AS VARCHAR) || '.py' AS path, event_type = 'purchase' AS is_final, event_type = 'click' AS is_utilized FROM events),
gold AS (SELECT DISTINCT user_id AS sample_id, list_distinct(['src/f' || CAST(user_id % 20 AS VARCHAR) || '.py', 'src/f' || CAST(user_id * 7 % 20 AS VARCHAR) || '.py']) AS gold_files FROM events)"""
_FH = _STEPS + """,
h AS (SELECT s.sample_id, count(*) AS events, min(step) FILTER (WHERE list_contains(gold_files, path)) AS first_hit, bool_or(list_contains(gold_files, path) AND is_final) AS final_hit, bool_or(list_contains(gold_files, path) AND is_utilized) AS utilized_hit FROM steps s JOIN gold USING (sample_id) GROUP BY 1)"""
_M = lambda n: f"len(list_intersect({n}, gold_files)) / len(gold_files) AS {n}_recall, CASE WHEN len({n}) > 0 THEN len(list_intersect({n}, gold_files)) / len({n}) ELSE 0 END AS {n}_precision"
_TM = _STEPS + f""",
p AS (SELECT sample_id, list(DISTINCT path) AS retrieved, list(DISTINCT path) FILTER (WHERE is_final) AS f, list(DISTINCT path) FILTER (WHERE is_utilized) AS u, count(*) AS n, count(DISTINCT path) AS k FROM steps GROUP BY 1),
p2 AS (SELECT *, CASE WHEN len(f) > 0 THEN f ELSE retrieved END AS final FROM p JOIN gold USING (sample_id)),
p3 AS (SELECT *, CASE WHEN len(u) > 0 THEN u ELSE final END AS utilized FROM p2),
m0 AS (SELECT sample_id, (n - k) / n AS redundancy, {_M("retrieved")}, {_M("final")}, {_M("utilized")} FROM p3),
m AS (SELECT *, """ + ", ".join(f"CASE WHEN {n}_recall > 0 OR {n}_precision > 0 THEN 2 * {n}_recall * {n}_precision / ({n}_recall + {n}_precision) ELSE 0 END AS {n}_f1" for n in ("retrieved", "final", "utilized")) + ", greatest(0, retrieved_recall - final_recall) AS final_drop, greatest(0, retrieved_recall - utilized_recall) AS utilization_drop FROM m0)"

ORACLE = {
    "selective_details": _SELECT + "SELECT sample_id, label, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("confidence", "second", "margin", "recall_20")) + " FROM d",
    "threshold_sweep": _SWEEP + "SELECT round(threshold, 6) AS threshold, " + ", ".join(f"round({c}, 6) AS {c}" for c in selective.RATES) + " FROM sweep",
    "operating_points": _SWEEP + "SELECT point, round(threshold, 6) AS threshold, round(value, 6) AS value FROM (" + " UNION ALL ".join(_POINT.format(*x) for x in (("best_selective_accuracy", "true", "selective_accuracy"), ("best_balanced_accuracy", "true", "balanced_accuracy"), ("best_selective_success_20", "true", "selective_success_20"), ("no_gold_abstain_80", "no_gold_abstain_rate >= 0.8", "positive_pass_rate"), ("positive_pass_90", "positive_pass_rate >= 0.9", "no_gold_abstain_rate"))) + ")",
    "confidence_summary": _SELECT + "SELECT label, count(*) AS samples, round(min(confidence), 6) AS least, " + ", ".join(f"round(quantile_cont(confidence, {q}), 6) AS {n}" for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.9, "p90"))) + ", round(max(confidence), 6) AS most, round(avg(confidence), 6) AS mean FROM d GROUP BY label",
    "normalized_steps": _STEPS + " SELECT * FROM steps",
    "trajectory_set_metrics": _TM + " SELECT sample_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SETS) + " FROM m",
    "first_gold_step": _FH + " SELECT * FROM h",
    "agent_cost": _FH + " SELECT count(*) AS samples, round(avg(events), 6) AS events_mean, round(median(events), 6) AS events_median, count(first_hit) AS hits, round(count(first_hit) / count(*), 6) AS hit_rate, count(*) FILTER (WHERE first_hit > 3) AS late_hits, round(median(first_hit), 6) AS first_hit_median, round(avg(first_hit), 6) AS first_hit_mean, count(*) FILTER (WHERE final_hit) AS final_hits, count(*) FILTER (WHERE utilized_hit) AS utilized_hits FROM h",
    "budget_prefix": _STEPS + ", b AS (SELECT unnest([1, 2, 4, 8, 16, 32]) AS budget), x AS (SELECT budget, s.sample_id, any_value(len(gold_files)) AS n, count(DISTINCT path) FILTER (WHERE step <= budget AND list_contains(gold_files, path)) AS found FROM b, steps s JOIN gold USING (sample_id) GROUP BY 1, 2) SELECT budget, count(*) AS samples, count(*) FILTER (WHERE found > 0) AS any_gold, round(avg(found / n), 6) AS mean_recall FROM x GROUP BY budget",
    "complementarity": _FH + ", r AS (SELECT DISTINCT s.sample_id FROM steps s JOIN gold USING (sample_id) WHERE tool = 'error' AND list_contains(gold_files, path)), x AS (SELECT first_hit IS NOT NULL AS a, r.sample_id IS NOT NULL AS r, first_hit FROM h LEFT JOIN r USING (sample_id)) SELECT count(*) AS samples, count(*) FILTER (WHERE a AND r) AS both_hit, count(*) FILTER (WHERE NOT a AND r) AS retriever_only, count(*) FILTER (WHERE a AND NOT r) AS agent_only, count(*) FILTER (WHERE NOT a AND NOT r) AS both_miss, round(sum(CASE WHEN a AND r THEN greatest(0, first_hit - 1) ELSE 0 END) / count(*), 6) AS savings FROM x",
    "pairwise_intervention": _TM + ", x AS (SELECT final_f1 AS c, utilized_f1 AS a, utilized_f1 - final_f1 AS d FROM m) SELECT count(*) AS samples, round(avg(d), 6) AS mean_delta, count(*) FILTER (WHERE d > 1e-12) AS better, count(*) FILTER (WHERE d < -1e-12) AS worse, count(*) FILTER (WHERE abs(d) <= 1e-12) AS same, count(*) FILTER (WHERE c <= 0 AND a > 0) AS rescued, count(*) FILTER (WHERE c > 0 AND a <= 0) AS lost FROM x",
}
_ALL = [selective_details, threshold_sweep, operating_points, confidence_summary, group_cv, normalized_steps, trajectory_set_metrics, first_gold_step, agent_cost, budget_prefix, complementarity, pairwise_intervention]
QUERIES = {f.__name__: f for f in _ALL}
