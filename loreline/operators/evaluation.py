"""The evaluation loop over samples: which are evaluated and why others are not, all metrics of one, what is left to do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.text import has_patch_marker
from loreline.operators import metrics, rank

RANKERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {"lexical": rank.lexical, "bm25": rank.bm25}


def ranker(name: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The ranker of a name; an unknown one is an error."""
    if name not in RANKERS:
        raise ValueError(f"unknown ranker {name!r}, known are {sorted(RANKERS)}")
    return RANKERS[name]


def leaks(query: Column, fix_commit: Column) -> Column:
    """Whether a query holds a raw patch or the commit that fixes it."""
    commit = F.trim(F.coalesce(fix_commit, F.lit("")))
    q = F.replace(F.coalesce(query, F.lit("")), F.lit("\\n"), F.lit("\n"))
    return has_patch_marker(q) | ((commit != "") & q.contains(commit))


def skip_reasons(samples: DataFrame, snapshots: DataFrame, sizes: DataFrame) -> DataFrame:
    """samples with `skip`: no_gold, query_leakage, missing_corpus or empty_corpus, the first that holds; null for what is evaluated.

    samples has gold_files, query_text and fix_commit; snapshots (repo, base_commit, counts); sizes (repo, base_commit, n), the
    candidates of each snapshot. Null repositories and commits have no corpus.
    """
    space = ["repo", "base_commit"]
    known = samples.join(snapshots.filter("counts").select(*space, F.lit(True).alias("_there")), space, "left").join(sizes.select(*space, F.col("n").alias("_n")), space, "left")
    reason = F.when(F.size("gold_files") == 0, "no_gold").when(leaks(F.col("query_text"), F.col("fix_commit")), "query_leakage").when(F.col("_there").isNull(), "missing_corpus").when(F.coalesce("_n", F.lit(0)) == 0, "empty_corpus")
    return known.withColumn("skip", reason).drop("_there", "_n")


def sample_metrics(ranking: DataFrame, samples: DataFrame, budget: int = metrics.CONTEXT) -> DataFrame:
    """All metrics of every sample that has gold and a ranking of chunks: those of its files and those of what fits the budget."""
    of_files = metrics.file_metrics(rank.files(ranking), samples).drop("ndcg_20")
    of_context = metrics.context_metrics(ranking, samples, budget)
    return of_files.join(of_context, "sample_id").select("*", F.col("gold_ratio").alias("context_efficiency"))


def fusion_metrics(ranking: DataFrame, samples: DataFrame, cuts: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Recall, precision, F0.5 and any-gold at the cuts, MRR, nDCG@20 and coverage AUC@20 of fused lists; precision divides by the cut itself."""
    marks = samples.select("sample_id", F.explode("gold_files").alias("path")).withColumn("gold", F.lit(1))
    sized = samples.select("sample_id", "task_type", F.size("gold_files").alias("n_gold")).filter("n_gold > 0")
    hit = F.col("gold").isNotNull()
    near = hit & (F.col("rank") <= 20)
    aggs = [F.count_if(hit & (F.col("rank") <= k)).alias(f"hits_{k}") for k in cuts]
    aggs += [F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(near, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.sum(F.when(near, 21 - F.col("rank")).otherwise(0)).alias("auc")]
    per = ranking.join(marks, ["sample_id", "path"], "left").groupBy("sample_id").agg(*aggs).join(sized, "sample_id")
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(20))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    out = ["sample_id", "task_type", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / best).alias("ndcg_20"), (F.col("auc") / (20.0 * F.col("n_gold"))).alias("coverage_auc_20")]
    for k in cuts:
        r, p = F.col(f"hits_{k}") / F.col("n_gold").cast("double"), F.col(f"hits_{k}") / F.lit(float(k))
        out += [r.alias(f"recall_{k}"), p.alias(f"precision_{k}"), metrics.f_score(p, r, 0.5).alias(f"f05_{k}"), (F.col(f"hits_{k}") > 0).cast("double").alias(f"any_{k}")]
    return per.select(*out)


def select_samples(samples: DataFrame, order: list[str], *, ids: DataFrame | None = None, shards: int = 1, shard: int = 0, limit: int | None = None) -> DataFrame:
    """The samples of one shard of a run: those of ids (sample_id), every shards-th in the order from shard on, at most limit.

    The places are counted over ranges of the order, so no task orders the whole table.
    """
    from loreline.operators.running import ranked_within

    if not 0 <= shard < shards:
        raise ValueError(f"shard {shard} of {shards}")
    chosen = samples if ids is None else samples.join(ids.select("sample_id").distinct(), "sample_id", "left_semi")
    placed = ranked_within(chosen, [], order, "_i").drop("_i_of")
    mine = placed.filter(F.pmod(F.col("_i") - 1, F.lit(shards)) == shard)
    if limit is not None:
        mine = mine.filter(F.col("_i") - 1 < limit * shards)
    return mine.withColumnRenamed("_i", "place")


def sample_refs(samples: DataFrame, order: list[str], *, keep: DataFrame | None = None, repos: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """(repo, base_commit, first): the distinct snapshots that samples refer to, after a keep list and repositories, in the order of their first sample; limit counts samples."""
    rows = samples.dropna(subset=["repo", "base_commit"])
    if keep is not None:
        rows = rows.join(keep.select("sample_id").distinct(), "sample_id", "left_semi")
    if repos is not None:
        rows = rows.filter(F.col("repo").isin(repos))
    if limit is not None:
        rows = rows.orderBy(*order).limit(limit)
    return rows.groupBy("repo", "base_commit").agg(F.min(F.struct(*order)).alias("_o")).select("repo", "base_commit", F.col(f"_o.{order[0]}").alias("first"))


def pending(samples: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left, what is wrong): samples without a finished row, and (sample_id, problem) of finished rows that are repeated, foreign or of another candidate filter.

    done has (sample_id, candidate_filter), samples (sample_id, candidate_filter).
    """
    n = done.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_filter").alias("f"))
    met = n.join(samples.select("sample_id", F.col("candidate_filter").alias("w")), "sample_id", "left")
    problem = F.when(F.col("w").isNull(), "unexpected").when(F.col("n") > 1, "repeated").when(~F.col("f").eqNullSafe(F.col("w")), "candidate_filter")
    return samples.join(done.select("sample_id").distinct(), "sample_id", "left_anti"), met.select("sample_id", problem.alias("problem")).filter("problem is not null")


def integrity(details: DataFrame, samples: DataFrame) -> DataFrame:
    """(problem, samples): how many samples of details are repeated, missing or unexpected."""
    both = details.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).join(samples.select("sample_id", F.lit(True).alias("w")), "sample_id", "full")
    problem = F.when(F.col("w").isNull(), "unexpected").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("fine")
    return both.groupBy(problem.alias("problem")).agg(F.count(F.lit(1)).alias("samples"))


def as_trajectory(file_ranks: DataFrame, depth: int = 20) -> DataFrame:
    """(sample_id, step, tool, path, is_final, is_utilized): a ranked list as the log of an agent that opens its files in order and keeps all."""
    top = file_ranks.filter(F.col("rank") <= depth)
    return top.select("sample_id", F.col("rank").alias("step"), F.lit("rank").alias("tool"), "path", F.lit(True).alias("is_final"), F.lit(False).alias("is_utilized"))


def scripted_search(ranking: DataFrame, texts: DataFrame, turns: int = 4, most_chars: int = 4000) -> DataFrame:
    """(sample_id, step, tool, path, chars): one search, then reads of the best files, clipped, until the turns are used up.

    texts has (repo, base_commit, path, text), ranking besides its columns repo and base_commit.
    """
    files = rank.files(ranking).join(ranking.select("sample_id", "repo", "base_commit").distinct(), "sample_id").filter(F.col("rank") < turns)
    reads = files.join(texts, ["repo", "base_commit", "path"], "left").select("sample_id", (F.col("rank") + 1).alias("step"), F.lit("read").alias("tool"), "path", F.least(F.lit(most_chars), F.coalesce(F.length("text"), F.lit(0))).alias("chars"))
    first = ranking.select("sample_id").distinct().select("sample_id", F.lit(1).alias("step"), F.lit("search").alias("tool"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("chars"))
    return first.unionByName(reads)


def best_chunks(ranking: DataFrame, depth: int = 20) -> DataFrame:
    """(sample_id, path, chunk_id, score, rank): the best chunk of each of the first depth files."""
    best = ranking.filter("path <> ''").groupBy("sample_id", "path").agg(F.min(F.struct("rank", "chunk_id", "score")).alias("b"))
    placed = best.withColumn("_f", F.row_number().over(Window.partitionBy("sample_id").orderBy("b.rank")))
    return placed.filter(F.col("_f") <= depth).select("sample_id", "path", F.col("b.chunk_id").alias("chunk_id"), F.col("b.score").alias("score"), F.col("_f").alias("rank"))
