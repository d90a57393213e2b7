"""Metrics of ranked files and chunks against gold files, spans and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of ranked chunks that fit a context.
CONTEXT = 8000


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def f_score(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.when((p > 0) | (r > 0), (1 + b2) * p * r / (b2 * p + r)).otherwise(0.0)


def file_metrics(ranking: DataFrame, samples: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """One row a sample that has gold and a ranking: recall, precision, F0.5, irrelevant files and hard negatives at the cuts, MRR, nDCG@20, coverage AUC@20.

    ranking has (sample_id, path, rank). Precision divides by the shorter of cut and list. All come from one
    aggregation over the ranking, joined with the exploded targets on sample and path.
    """
    marks = samples.select("sample_id", F.explode("gold_files").alias("path")).withColumn("gold", F.lit(1))
    negatives = samples.select("sample_id", F.explode("hard_negatives").alias("path")).distinct().withColumn("negative", F.lit(1))
    sized = samples.select("sample_id", "task_type", "repo", F.size("gold_files").alias("n_gold")).filter("n_gold > 0")
    hit = F.col("gold").isNotNull()
    rows = ranking.join(marks, ["sample_id", "path"], "left").join(negatives, ["sample_id", "path"], "left")
    aggs = [F.count(F.lit(1)).alias("n_ranked"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit & (F.col("rank") <= 20), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(hit, F.greatest(F.lit(0), 21 - F.col("rank"))).otherwise(0)).alias("auc")]
    for k in cuts:
        aggs += [F.count_if(hit & (F.col("rank") <= k)).alias(f"hits_{k}"), F.count_if(F.col("negative").isNotNull() & (F.col("rank") <= k)).alias(f"negatives_{k}")]
    per = rows.groupBy("sample_id").agg(*aggs).join(sized, "sample_id")
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(20))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = ["sample_id", "task_type", "repo", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / best).alias("ndcg_20"), (F.col("auc") / (20.0 * F.col("n_gold"))).alias("coverage_auc_20")]
    for k in cuts:
        r = F.col(f"hits_{k}") / F.col("n_gold").cast("double")
        p = ratio(F.col(f"hits_{k}"), F.least(F.lit(k), F.col("n_ranked")))
        out += [r.alias(f"recall_{k}"), p.alias(f"precision_{k}"), f_score(p, r, 0.5).alias(f"f05_{k}"), (F.least(F.lit(k), F.col("n_ranked")) - F.col(f"hits_{k}")).alias(f"irrelevant_{k}"), F.col(f"negatives_{k}")]
    return per.select(*out)


def summarize(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Means overall and by task, in one pass over grouping sets; a missing metric counts as 0."""
    sets = metrics.groupingSets([[], ["task_type"]], "task_type").agg(F.grouping("task_type").alias("g"), F.count(F.lit(1)).alias("samples"), *[F.avg(F.coalesce(F.col(n), F.lit(0.0))).alias(n) for n in names])
    return sets.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("task_type")).alias("scope"), "samples", *[F.round(n, 6).alias(n) for n in names])


def within_budget(ranking: DataFrame, budget: int = CONTEXT) -> DataFrame:
    """The ranked chunks that fit: up to the first that would go beyond the budget, but always the first that is not empty."""
    upto = Window.partitionBy("sample_id").orderBy("rank")
    incl = F.sum("chars").over(upto.rowsBetween(Window.unboundedPreceding, 0))
    rows = ranking.withColumn("chars", F.coalesce("chars", F.lit(0))).withColumn("_incl", incl).withColumn("_excl", F.col("_incl") - F.col("chars"))
    stop = (F.col("_incl") > budget) & (F.col("_excl") > 0)
    return rows.withColumn("_stopped", F.max(stop.cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0))).filter("_stopped = 0").drop("_incl", "_excl", "_stopped")


def context_metrics(ranking: DataFrame, samples: DataFrame, budget: int = CONTEXT) -> DataFrame:
    """(sample_id, chunks, gold_coverage, pollution, gold_ratio, redundancy) of what fits the budget."""
    marks = samples.select("sample_id", F.explode("gold_files").alias("path")).withColumn("gold", F.lit(1))
    sized = samples.select("sample_id", F.size("gold_files").alias("n_gold")).filter("n_gold > 0")
    hit = F.col("gold").isNotNull()
    per = within_budget(ranking, budget).join(marks, ["sample_id", "path"], "left").groupBy("sample_id").agg(F.count(F.lit(1)).alias("chunks"), F.count_distinct(F.when(hit, F.col("path"))).alias("found"), F.count_distinct("path").alias("paths"), F.sum(F.when(hit, 0).otherwise(F.col("chars"))).alias("pollution"), F.sum(F.when(hit, F.col("chars")).otherwise(0)).alias("gold_chars"))
    return per.join(sized, "sample_id").select("sample_id", "chunks", ratio(F.col("found"), F.col("n_gold")).alias("gold_coverage"), "pollution", ratio(F.col("gold_chars"), F.col("gold_chars") + F.col("pollution")).alias("gold_ratio"), ratio(F.col("chunks") - F.col("paths"), F.col("chunks")).alias("redundancy"))


def token_budget(ranking: DataFrame, file_tokens: DataFrame, samples: DataFrame, budgets: list[int], thresholds: list[int]) -> DataFrame:
    """Share of gold files covered within token budgets: (sample_id, budget, threshold, covered, n_gold, coverage).

    Files are taken in rank order with the tokens of their header and one separator; the first that overflows is
    taken in part, then nothing more. A gold file is covered with at least min(threshold, its tokens) of them.
    ranking has (sample_id, repo, base_commit, path, rank), file_tokens (repo, base_commit, path, content, header).
    """
    upto = Window.partitionBy("sample_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = ranking.join(file_tokens, ["repo", "base_commit", "path"]).withColumn("before", F.coalesce(F.sum(F.col("header") + F.col("content") + 1).over(upto), F.lit(0)))
    marks = samples.select("sample_id", F.explode("gold_files").alias("path"))
    gold = rows.join(marks, ["sample_id", "path"]).withColumn("budget", F.explode(F.array(*[F.lit(b) for b in budgets]))).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    taken = F.least(F.col("content"), F.greatest(F.lit(0), F.col("budget") - F.col("before") - F.col("header")))
    covered = gold.filter((F.col("content") > 0) & (taken >= F.least(F.col("threshold"), F.col("content")))).groupBy("sample_id", "budget", "threshold").agg(F.count(F.lit(1)).alias("covered"))
    grid = samples.filter(F.size("gold_files") > 0).select("sample_id", F.size("gold_files").alias("n_gold"), F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget")).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return grid.join(covered, ["sample_id", "budget", "threshold"], "left").select("sample_id", "budget", "threshold", F.coalesce("covered", F.lit(0)).alias("covered"), "n_gold", (F.coalesce("covered", F.lit(0)) / F.col("n_gold").cast("double")).alias("coverage"))


def merged_intervals(rows: DataFrame, key: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """(key, start, end) of the unions of intervals of a key that overlap or touch; invalid ones are dropped."""
    order = Window.partitionBy(*key).orderBy(start, end)
    seen = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    valid = rows.filter((F.col(start) > 0) & (F.col(end) >= F.col(start)))
    islands = valid.withColumn("_new", (F.col(start) > F.coalesce(seen, F.lit(-1)) + 1).cast("int")).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def line_metrics(ranking: DataFrame, samples: DataFrame, budget: int = CONTEXT) -> DataFrame:
    """(sample_id, gold_lines, predicted_lines, overlap, recall, precision, f1, f05) of gold spans against the lines of what fits the budget."""
    gold = samples.select("sample_id", F.explode("gold_spans").alias("s")).select("sample_id", "s.path", "s.start_line", "s.end_line")
    g = merged_intervals(gold, ["sample_id", "path"])
    spans = g.select("sample_id").distinct()
    chosen = within_budget(ranking, budget).join(spans, "sample_id", "left_semi").select("sample_id", "path", "start_line", "end_line")
    p = merged_intervals(chosen, ["sample_id", "path"])
    lines = lambda a, b: F.sum(F.col(b) - F.col(a) + 1)
    both = g.join(p.select("sample_id", "path", F.col("start_line").alias("ps"), F.col("end_line").alias("pe")), ["sample_id", "path"]).filter((F.col("start_line") <= F.col("pe")) & (F.col("ps") <= F.col("end_line")))
    over = both.groupBy("sample_id").agg(F.sum(F.least("end_line", "pe") - F.greatest("start_line", "ps") + 1).alias("overlap"))
    per = g.groupBy("sample_id").agg(lines("start_line", "end_line").alias("gold_lines")).join(p.groupBy("sample_id").agg(lines("start_line", "end_line").alias("predicted_lines")), "sample_id", "left").join(over, "sample_id", "left").na.fill(0, ["predicted_lines", "overlap"])
    r, q = ratio(F.col("overlap"), F.col("gold_lines")), ratio(F.col("overlap"), F.col("predicted_lines"))
    return per.select("sample_id", "gold_lines", "predicted_lines", "overlap", r.alias("recall"), q.alias("precision"), f_score(q, r, 1.0).alias("f1"), f_score(q, r, 0.5).alias("f05"))


def block_metrics(ranking: DataFrame, samples: DataFrame, blocks: DataFrame, budget: int = CONTEXT) -> DataFrame:
    """(sample_id, gold_blocks, predicted_blocks, matched, recall, precision): gold blocks against the symbol chunks that fit the budget.

    blocks has (sample_id, path, start_line, end_line, chunk_id). A block is met by the same chunk or by lines of the same file that overlap.
    """
    gold = blocks.filter((F.col("path") != "") & (F.col("start_line") > 0) & (F.col("end_line") >= F.col("start_line"))).distinct()
    chosen = within_budget(ranking, budget).filter("kind <> 'file'").join(gold.select("sample_id").distinct(), "sample_id", "left_semi").select("sample_id", "path", F.col("start_line").alias("ps"), F.col("end_line").alias("pe"), F.col("chunk_id").alias("pc"))
    met = gold.join(chosen, ["sample_id", "path"]).filter((F.col("chunk_id") == F.col("pc")) | ((F.col("start_line") <= F.col("pe")) & (F.col("ps") <= F.col("end_line"))))
    g = met.groupBy("sample_id").agg(F.count_distinct("path", "start_line", "end_line").alias("matched"), F.count_distinct("pc").alias("useful"))
    per = gold.groupBy("sample_id").agg(F.count_distinct("path", "start_line", "end_line").alias("gold_blocks")).join(chosen.groupBy("sample_id").agg(F.count_distinct("pc").alias("predicted_blocks")), "sample_id", "left").join(g, "sample_id", "left").na.fill(0)
    return per.select("sample_id", "gold_blocks", "predicted_blocks", "matched", ratio(F.col("matched"), F.col("gold_blocks")).alias("recall"), ratio(F.col("useful"), F.col("predicted_blocks")).alias("precision"))


def seed_context(ranking: DataFrame, budget: int, per_file: int) -> DataFrame:
    """(sample_id, path, taken): tokens of ranked files that a seed takes, each at most per_file, all at most budget; files without tokens are passed over."""
    capped = ranking.filter("tokens > 0").withColumn("capped", F.least("tokens", F.lit(per_file)))
    before = F.coalesce(F.sum("capped").over(Window.partitionBy("sample_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return capped.withColumn("taken", F.least("capped", F.greatest(F.lit(0), budget - before))).filter("taken > 0").select("sample_id", "path", "taken")
