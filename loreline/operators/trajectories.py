"""Ordered logs of what an agent looked at, against gold files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.operators.metrics import ratio


def normalize(rows: DataFrame) -> DataFrame:
    """(sample_id, step, tool, path, is_final, is_utilized): a missing step takes its place in the order of the log; rows have sample_id, at, seq."""
    order = Window.partitionBy("sample_id").orderBy("at", "seq")
    return rows.withColumn("step", F.coalesce("step", F.row_number().over(order))).select("sample_id", "step", "tool", "path", "is_final", "is_utilized")


def _set_metrics(paths: Column, gold: Column, name: str) -> list[Column]:
    both = F.size(F.array_intersect(paths, gold))
    r, p = ratio(both, F.size(gold)), ratio(both, F.size(paths))
    f1 = F.when((p > 0) | (r > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return [r.alias(f"{name}_recall"), p.alias(f"{name}_precision"), f1.alias(f"{name}_f1")]


def set_metrics(steps: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall, precision and F1 of retrieved, final and utilized files; final falls back to all retrieved, utilized to final. gold has (sample_id, gold_files)."""
    seen = steps.filter(F.col("path") != "")
    per = seen.groupBy("sample_id").agg(F.collect_set("path").alias("retrieved"), F.collect_set(F.expr("case when is_final then path end")).alias("f"), F.collect_set(F.expr("case when is_utilized then path end")).alias("u"), F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("different"))
    final = F.when(F.size("f") > 0, F.col("f")).otherwise(F.col("retrieved"))
    both = per.join(gold, "sample_id").withColumn("final", final).withColumn("utilized", F.when(F.size("u") > 0, F.col("u")).otherwise(F.col("final")))
    g = F.col("gold_files")
    out = both.select("sample_id", *_set_metrics(F.col("retrieved"), g, "retrieved"), *_set_metrics(F.col("final"), g, "final"), *_set_metrics(F.col("utilized"), g, "utilized"), ratio(F.col("n") - F.col("different"), F.col("n")).alias("redundancy"))
    return out.withColumn("final_drop", F.greatest(F.lit(0.0), F.col("retrieved_recall") - F.col("final_recall"))).withColumn("utilization_drop", F.greatest(F.lit(0.0), F.col("retrieved_recall") - F.col("utilized_recall")))


def first_hits(steps: DataFrame, gold: DataFrame) -> DataFrame:
    """(sample_id, events, first_hit, final_hit, utilized_hit): the least step on a gold file, null for a miss."""
    marks = gold.select("sample_id", F.explode("gold_files").alias("path")).withColumn("gold", F.lit(True))
    rows = steps.join(marks, ["sample_id", "path"], "left")
    hit = F.coalesce("gold", F.lit(False))
    per = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("events"), F.min(F.when(hit, F.col("step"))).alias("first_hit"), F.coalesce(F.bool_or(hit & F.col("is_final")), F.lit(False)).alias("final_hit"), F.coalesce(F.bool_or(hit & F.col("is_utilized")), F.lit(False)).alias("utilized_hit"))
    return per


def cost_summary(hits: DataFrame, late: int = 3) -> DataFrame:
    """How often and how late agents meet gold."""
    n = F.count(F.lit(1))
    return hits.agg(n.alias("samples"), F.avg("events").alias("events_mean"), F.median("events").alias("events_median"), F.count("first_hit").alias("hits"), (F.count("first_hit") / n).alias("hit_rate"), F.count_if(F.col("first_hit") > late).alias("late_hits"), F.median("first_hit").alias("first_hit_median"), F.avg("first_hit").alias("first_hit_mean"), F.count_if("final_hit").alias("final_hits"), F.count_if("utilized_hit").alias("utilized_hits"))


def budget_prefix(steps: DataFrame, gold: DataFrame, budgets: list[int]) -> DataFrame:
    """(budget, samples, any_gold, mean_recall): what the first steps of every log find, up to each budget.

    Each step on a gold file is counted once, at the first budget that reaches it, then summed upwards: no log is
    multiplied by the budgets.
    """
    marks = gold.select("sample_id", F.explode("gold_files").alias("path"))
    found = steps.join(marks, ["sample_id", "path"]).groupBy("sample_id", "path").agg(F.min("step").alias("step"))
    sized = gold.select("sample_id", F.size("gold_files").alias("n_gold"))
    per = found.groupBy("sample_id").agg(*[F.count_if(F.col("step") <= b).alias(f"b{b}") for b in budgets])
    base = steps.select("sample_id").distinct().join(sized, "sample_id").join(per, "sample_id", "left").na.fill(0)
    rows = base.select("n_gold", F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"b{b}").alias("found")) for b in budgets])).alias("x")).select("n_gold", "x.*")
    return rows.groupBy("budget").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("found") > 0).alias("any_gold"), F.avg(ratio(F.col("found"), F.col("n_gold"))).alias("mean_recall"))


def complementarity(hits: DataFrame, retrieved: DataFrame) -> DataFrame:
    """The four cases of agent and retriever finding gold, and the steps a retriever would save; retrieved has (sample_id, retriever_hit)."""
    a = F.col("first_hit").isNotNull()
    r = F.coalesce("retriever_hit", F.lit(False))
    both = hits.join(retrieved, "sample_id")
    n = F.count(F.lit(1))
    return both.agg(n.alias("samples"), F.count_if(a & r).alias("both_hit"), F.count_if(~a & r).alias("retriever_only"), F.count_if(a & ~r).alias("agent_only"), F.count_if(~a & ~r).alias("both_miss"), (F.sum(F.when(a & r, F.greatest(F.lit(0), F.col("first_hit") - 1)).otherwise(0)) / n).alias("savings"))


def paired(control: DataFrame, arm: DataFrame) -> DataFrame:
    """(samples, mean_delta, better, worse, same, rescued, lost) of an arm against its control on common samples; both have (sample_id, value)."""
    both = control.select("sample_id", F.col("value").alias("c")).join(arm.select("sample_id", F.col("value").alias("a")), "sample_id").withColumn("d", F.col("a") - F.col("c"))
    return both.agg(F.count(F.lit(1)).alias("samples"), F.avg("d").alias("mean_delta"), F.count_if(F.col("d") > 1e-12).alias("better"), F.count_if(F.col("d") < -1e-12).alias("worse"), F.count_if(F.abs("d") <= 1e-12).alias("same"), F.count_if((F.col("c") <= 0) & (F.col("a") > 0)).alias("rescued"), F.count_if((F.col("c") > 0) & (F.col("a") <= 0)).alias("lost"))
