"""Analysis of per-sample results: leakage of answers, comparison of methods and tasks, calibration, error mining, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.paths import basename, is_changed_test
from loreline.functions.text import has_patch_marker, has_review_leak, trace_paths
from loreline.operators.metrics import ratio
from loreline.operators.running import ranked_within

# Names too common to give a file away.
COMMON_NAMES = ["__init__.py", "index.js", "index.ts", "main.py"]
COMMON_STEMS = ["index", "utils", "types", "config", "setup", "tests", "common", "helpers", "constants", "__init__"]
FATAL = ["exact_gold_path", "raw_patch_marker", "review_leakage", "fix_commit_hash"]


def _stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def _stands_alone(text: Column, term: Column) -> Column:
    """Whether a term stands in a text with neither a letter, a digit, nor a sign of a path at its sides."""
    around = F.split(text, F.concat(F.lit(r"(?<![a-z0-9_./-])\Q"), F.replace(term, F.lit("\\E"), F.lit("")), F.lit(r"\E(?![a-z0-9_./-])")))
    return (term != "") & (F.size(around) > 1)


def leak_flags(samples: DataFrame) -> DataFrame:
    """(sample_id, flag, fatal): how a query gives its answer away.

    Of a gold file only the plainest counts: its path in a stack trace (in tasks that start from one), its whole path, its
    name, its stem. samples has task_type, query_text, gold_files and fix_commit.
    """
    q = F.replace(F.coalesce("query_text", F.lit("")), F.lit("\\n"), F.lit("\n"))
    rows = samples.select("sample_id", "task_type", F.lower(q).alias("low"), trace_paths(q).alias("trace"), F.lower(F.trim(F.coalesce("fix_commit", F.lit("")))).alias("fix"), has_patch_marker(q).alias("patch"), has_review_leak(q).alias("review"), F.coalesce("gold_files", F.array().cast("array<string>")).alias("gold"))
    files = rows.select("sample_id", "task_type", "low", "trace", F.explode("gold").alias("path"))
    p, low = F.lower("path"), F.col("low")
    traced = (F.col("task_type") == "trace2code") & F.exists("trace", lambda t: (F.lower(t) == p) | F.lower(t).endswith(F.concat(F.lit("/"), p)) | (basename(F.lower(t)) == basename(p)))
    name, stem = basename(p), F.lower(_stem(F.col("path")))
    named = (F.length(name) >= 6) & ~name.isin(COMMON_NAMES) & _stands_alone(low, name)
    stemmed = (F.length(F.regexp_replace(stem, "^_+|_+$", "")) >= 5) & ~stem.isin(COMMON_STEMS) & ~stem.rlike("^[0-9]+$") & _stands_alone(low, stem)
    kind = F.when(traced, "direct_stack_hint").when(low.contains(p), "exact_gold_path").when(named, "gold_basename").when(stemmed, "gold_stem")
    of_files = files.select("sample_id", "task_type", "path", kind.alias("flag")).filter("flag is not null")
    tests = of_files.filter((F.col("task_type") == "code2test") & F.col("flag").isin("gold_basename", "gold_stem") & is_changed_test(F.col("path"))).select("sample_id", F.lit("test_name").alias("flag"))
    f = F.col("fix")
    commit = (F.length(f) >= 7) & F.col("low").contains(F.substring(f, 1, 7))
    whole = rows.select("sample_id", F.explode(F.array_compact(F.array(F.when(F.col("patch"), "raw_patch_marker"), F.when(F.col("review"), "review_leakage"), F.when(commit, "fix_commit_hash")))).alias("flag"))
    return of_files.select("sample_id", "flag").unionByName(tests).unionByName(whole).distinct().withColumn("fatal", F.col("flag").isin(FATAL))


def split_by_leaks(rows: DataFrame, flags: DataFrame, metrics: list[str]) -> DataFrame:
    """(split, samples, means) of per-sample rows: clean, flagged but not fatally, and fatally flagged; missing metrics count as 0."""
    worst = flags.groupBy("sample_id").agg(F.bool_or("fatal").alias("fatal"))
    split = F.when(F.col("fatal").isNull(), "clean").when(F.col("fatal"), "fatal_flagged").otherwise("nonfatal_flagged")
    return rows.join(worst, "sample_id", "left").groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("samples"), *[F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in metrics])


def pivot_methods(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(sample_id, methods): of each sample a map from method to its metrics; the map has a method once."""
    return rows.groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", F.struct(*metrics).alias("m"))))).alias("methods"))


def best_methods(rows: DataFrame) -> DataFrame:
    """(sample_id, method, mrr, recall_20): the best method of each sample by MRR, recall, first gold rank (lesser is better), then name."""
    key = F.struct(F.round("mrr", 9), F.round("recall_20", 9), -F.coalesce("first", F.lit(10**12)), F.col("method"))
    return rows.groupBy("sample_id").agg(F.max_by(F.struct("method", "mrr", "recall_20"), key).alias("b")).select("sample_id", "b.*")


def error_classes(rows: DataFrame, tops: DataFrame, given: DataFrame, a: str, b: str) -> DataFrame:
    """(sample_id, class): samples that all methods miss, that only method a or only b finds, and those whose given file leads a list that misses.

    rows has (sample_id, method, recall_20), tops (sample_id, method, path), the first file of each list, given (sample_id, path).
    """
    hit = F.col("recall_20") > 0
    per = rows.groupBy("sample_id").agg(F.bool_or(hit).alias("any"), F.bool_or(hit & (F.col("method") == a)).alias("a"), F.bool_or(hit & (F.col("method") == b)).alias("b"))
    classes = F.array_compact(F.array(F.when(~F.col("any"), "all_miss"), F.when(F.col("a") & ~F.col("b"), f"{a}_only"), F.when(F.col("b") & ~F.col("a"), f"{b}_only")))
    traps = rows.filter(~hit).join(tops, ["sample_id", "method"]).join(given.distinct(), ["sample_id", "path"], "left_semi").select("sample_id", F.lit("given_file_first").alias("class")).distinct()
    return per.select("sample_id", F.explode(classes).alias("class")).unionByName(traps)


def macro_average(means: DataFrame, tasks: list[str], metrics: list[str]) -> DataFrame:
    """(method, macro means): means over tasks of the methods that cover all of them; means has (method, task_type, metrics)."""
    known = means.filter(F.col("task_type").isin(tasks))
    return known.groupBy("method").agg(F.count_distinct("task_type").alias("_n"), *[F.avg(m).alias(f"macro_{m}") for m in metrics]).filter(F.col("_n") == len(tasks)).drop("_n")


def weighted_means(means: DataFrame, metrics: list[str], group: str, weight: str) -> DataFrame:
    """(method, weighted and plain means) over the groups of each method: weighted by weight, and every group alike."""
    total = F.sum(weight)
    return means.groupBy("method").agg(F.count(group).alias("groups"), total.alias("samples"), *[(F.sum(F.col(m) * F.col(weight)) / total).alias(f"micro_{m}") for m in metrics], *[F.avg(m).alias(f"macro_{m}") for m in metrics])


def rank_correlation(rows: DataFrame, x: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """(by, n, spearman) of pairs, the greatest value ranked first, ties at their mean; 0 without variance; groups of fewer than least pairs give none.

    Ranks are counted over ranges of the order, so that no group is ordered in one task.
    """
    both = rows.dropna(subset=[x, y])
    for c in (x, y):
        counts = both.groupBy(*by, c).agg(F.count(F.lit(1)).alias("_n"))
        placed = _cumulated(counts, by, c)
        both = both.join(placed.select(*by, c, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(f"_r{c}")), [*by, c])
    d = F.stddev_pop(f"_r{x}") * F.stddev_pop(f"_r{y}")
    return both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.try_divide(F.covar_pop(f"_r{x}", f"_r{y}"), d), F.lit(0.0)).alias("spearman")).filter(F.col("n") >= least)


def _cumulated(counts: DataFrame, by: list[str], value: str) -> DataFrame:
    """counts (by, value, _n) with _upto, the rows of a group with this value or a greater one."""
    from loreline.session import cut

    down = counts.withColumn("_neg", -F.col(value).cast("double"))
    parts = cut(down.repartitionByRange(*by, "_neg").withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*by, "_part").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    offsets = sums.select(*by, "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o"))
    local = F.sum("_n").over(Window.partitionBy(*by, "_part").orderBy("_neg").rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_l", local).join(offsets, [*by, "_part"]).withColumn("_upto", F.col("_o") + F.col("_l"))


def delta_decomposition(means: DataFrame, counts: DataFrame, metric: str) -> DataFrame:
    """(task_type, top, runner_up, weighted_delta, share): how much each task adds to the lead of the best method over the second.

    means has (method, task_type, metric), one row a task and method, counts (task_type, n). The overall value of a method is its weighted mean.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    weighed = means.join(counts, "task_type").withColumn("w", F.col(metric) * F.col("n") / F.lit(float(total or 1)))
    overall = weighed.groupBy("method").agg(F.sum("w").alias("o")).orderBy(F.desc(F.round("o", 9)), "method").limit(2).collect()
    if len(overall) < 2 or abs(overall[0]["o"] - overall[1]["o"]) < 1e-12:
        return means.sparkSession.createDataFrame([], "task_type string, top string, runner_up string, weighted_delta double, share double")
    (top, second), lead = [r["method"] for r in overall], overall[0]["o"] - overall[1]["o"]
    value = lambda m: F.max(F.when(F.col("method") == m, F.col("w")))
    per = weighed.groupBy("task_type").agg((value(top) - value(second)).alias("weighted_delta")).filter("weighted_delta is not null")
    return per.select("task_type", F.lit(top).alias("top"), F.lit(second).alias("runner_up"), "weighted_delta", (F.col("weighted_delta") / lead).alias("share"))


def calibration(packet: DataFrame, control: DataFrame, seeded: DataFrame) -> DataFrame:
    """Predicted savings against what happened: one row a sample of packet (sample_id, predicted), with the first hits and events of two runs, which may lack it."""
    side = lambda t, n: t.select("sample_id", F.col("first_hit").alias(f"{n}_first"), F.col("events").alias(f"{n}_events"))
    both = packet.join(side(control, "control"), "sample_id", "left").join(side(seeded, "seeded"), "sample_id", "left")
    c, s = F.col("control_first").isNotNull(), F.col("seeded_first").isNotNull()
    return both.select("*", (~c & s).alias("rescue"), (c & ~s).alias("lost"), (c & s).alias("both_hit"), (F.col("control_first") - F.col("seeded_first")).alias("first_hit_delta"), (F.col("control_events") - F.col("seeded_events")).alias("event_saving"))


def calibration_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, samples, rescued, lost, both_hit, improved, regressed, mean savings, saving ratio) of calibration rows."""
    predicted = F.col("both_hit") & (F.coalesce("predicted", F.lit(0.0)) > 0)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if("rescue").alias("rescued"), F.count_if("lost").alias("lost"), F.count_if("both_hit").alias("both_hit"), F.count_if(F.col("first_hit_delta") > 0).alias("improved"), F.count_if(F.col("first_hit_delta") < 0).alias("regressed"),
        F.avg("predicted").alias("predicted_mean"), F.avg("first_hit_delta").alias("first_hit_delta_mean"), F.avg("event_saving").alias("event_saving_mean"),
        F.try_divide(F.sum(F.when(predicted, F.greatest(F.lit(0), F.col("first_hit_delta")))), F.sum(F.when(predicted, F.col("predicted")))).alias("saving_ratio"),
    )


def joined_costs(hits: DataFrame, retriever: DataFrame, depths: list[int], late: int = 3) -> DataFrame:
    """(subset, depth, samples, found): how often a retriever has gold within a depth where an agent hits early, late or never, and over all.

    hits has (sample_id, first_hit), retriever (sample_id, first): the first gold rank, null for none.
    """
    subset = F.when(F.col("first_hit").isNull(), "miss").when(F.col("first_hit") > late, "late").otherwise("early")
    both = hits.join(retriever, "sample_id").select(F.explode(F.array(F.lit("all"), subset)).alias("subset"), "first")
    per = both.groupBy("subset").agg(F.count(F.lit(1)).alias("samples"), *[F.count_if(F.col("first") <= d).alias(f"d{d}") for d in depths])
    return per.select("subset", "samples", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"d{d}").alias("found")) for d in depths])).alias("x")).select("subset", "samples", "x.*")


def tertiles_at_scale(rows: DataFrame, metric: str, by: list[str], id_col: str) -> DataFrame:
    """rows with bucket low, middle or high, cut at a third and two thirds of each group's number; the remainder goes high. Groups are ordered in parts."""
    placed = ranked_within(rows, by, [metric, id_col], "_i")
    i, n = F.col("_i") - 1, F.col("_i_of")
    return placed.withColumn("bucket", F.when(i < F.floor(n / 3), "low").when(i < F.floor(2 * n / 3), "middle").otherwise("high")).drop("_i", "_i_of")


def layered(boards: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(method, one column a board): the boards' values side by side, methods that a board lacks without a value; boards has name: (table with method, column)."""
    out = None
    for name, (t, c) in boards.items():
        part = t.select("method", F.col(c).alias(name))
        out = part if out is None else out.join(part, "method", "full")
    return out


def query_hints(samples: DataFrame) -> DataFrame:
    """(sample_id, bucket): whether a query names a gold path, else a gold file's name, else nothing; and what that makes of a sample by its recall and MRR."""
    low = F.lower("query_text")
    path = F.exists("gold_files", lambda p: low.contains(F.lower(p)))
    name = F.exists("gold_files", lambda p: low.contains(F.lower(basename(p))))
    hint = F.when(path, "path").when(name, "basename").otherwise("none")
    bucket = F.when((F.col("recall_20") > 0) & (hint == "path"), "hit_by_path").when((F.col("recall_20") > 0) & (hint == "basename"), "hit_by_name").when((F.col("recall_20") > 0) & (F.col("mrr") >= 0.25), "hit_high").when(F.col("recall_20") > 0, "hit_low").when(hint != "none", "miss_with_hint").otherwise("miss")
    return samples.select("sample_id", hint.alias("hint"), bucket.alias("bucket"))


def metric_rates(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by, metric, samples, mean): means over the rows that have a metric, with their number; unlike summaries, missing ones do not count."""
    long = rows.unpivot(by, metrics, "metric", "value").filter("value is not null")
    return long.groupBy(*by, "metric").agg(F.count(F.lit(1)).alias("samples"), F.avg("value").alias("mean"))


def compare_counts(base: DataFrame, seed: DataFrame, by: list[str]) -> DataFrame:
    """(by, base, seed, delta): how many rows of each kind two tables have, those of either one included."""
    n = lambda t, c: t.groupBy(*by).agg(F.count(F.lit(1)).alias(c))
    both = n(base, "base").join(n(seed, "seed"), by, "full").na.fill(0, ["base", "seed"])
    return both.withColumn("delta", F.col("seed") - F.col("base"))


def closed_tool_summary(steps: DataFrame, gold: DataFrame) -> DataFrame:
    """(sample_id, calls, searches, reads, final_files, any_gold, final_recall, final_precision) of agents' logs; tools are told by name."""
    marks = gold.select("sample_id", F.explode("gold_files").alias("path")).withColumn("g", F.lit(True))
    rows = steps.join(marks, ["sample_id", "path"], "left").withColumn("g", F.coalesce("g", F.lit(False)))
    per = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("tool") == "search").alias("searches"), F.count_if(F.col("tool") == "read").alias("reads"), F.count_distinct(F.when(F.col("is_final"), F.col("path"))).alias("final_files"), F.bool_or("g").alias("any_gold"), F.count_distinct(F.when(F.col("is_final") & F.col("g"), F.col("path"))).alias("found"))
    sized = gold.select("sample_id", F.size("gold_files").alias("n_gold"))
    return per.join(sized, "sample_id").select("sample_id", "calls", "searches", "reads", "final_files", "any_gold", ratio(F.col("found"), F.col("n_gold")).alias("final_recall"), ratio(F.col("found"), F.col("final_files")).alias("final_precision"))
