"""Ranking files by query terms, the file graph and what the sample mentions, blended."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.paths import basename, is_code_path, is_test_path
from loreline.functions.text import tokenize
from loreline.operators.graph import import_links, symbol_edges, test_links

from loreline.session import cut

SPACE = ["repo", "base_commit"]
# Fixed values of the blend.
QUERY, RANK, AFFINITY = 0.65, 0.25, 0.10
DAMPING, ROUNDS = 0.85, 24


def query_scores(samples: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(sample_id, path, score): idf of shared tokens, three times in the path, twice in symbols, once in the content; bonuses for paths that stand in the query."""
    node = lambda c, f: files.select(*SPACE, "path", F.explode(F.array_distinct(tokenize(c))).alias("token"), F.lit(f).alias("f"))
    symbols = chunks.filter("kind = 'symbol' and symbol <> ''").select(*SPACE, "path", F.explode(F.array_distinct(tokenize(F.col("symbol")))).alias("token"), F.lit(2.0).alias("f")).distinct()
    q = samples.select("sample_id", *SPACE, F.explode(F.array_distinct(tokenize(F.col("query_text")))).alias("token"))
    asked = q.select(*SPACE, "token").distinct()
    every = node(F.col("path"), 3.0).unionByName(symbols).unionByName(node(F.substring("text", 1, 20_000), 1.0))
    sizes = every.select(*SPACE, "path", "token").distinct().groupBy(*SPACE, "path").agg(F.count(F.lit(1)).alias("size"))
    rows = every.join(asked, [*SPACE, "token"], "left_semi").groupBy(*SPACE, "path", "token").agg(F.sum("f").alias("f"))
    df = rows.groupBy(*SPACE, "token").agg(F.count(F.lit(1)).alias("df"))
    n = files.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("n"))
    hits = q.join(rows, [*SPACE, "token"]).join(df, [*SPACE, "token"]).join(n, SPACE).groupBy("sample_id", "path").agg(F.sum(F.col("f") * (F.ln((F.col("n") + 1) / (F.col("df") + 1.0)) + 1)).alias("w"))
    cand = samples.select("sample_id", *SPACE, F.lower("query_text").alias("_q")).join(files.select(*SPACE, "path"), SPACE).join(sizes, [*SPACE, "path"], "left").join(hits, ["sample_id", "path"], "left")
    bonus = F.when(F.col("_q").contains(F.lower("path")), 20.0).otherwise(0.0) + F.when(F.col("_q").contains(F.lower(basename(F.col("path")))), 7.0).otherwise(0.0)
    return cand.select("sample_id", *SPACE, "path", ((F.coalesce("w", F.lit(0.0)) + bonus) / F.greatest(F.lit(1.0), F.sqrt(F.coalesce("size", F.lit(1))))).alias("score"), (bonus > 0).alias("mentioned"))


def file_graph(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo, base_commit, src, dst, weight), both ways: imports 1.5 each time, symbols 1.0, tests 2.0 for each name they share."""
    e = import_links(files).select(*SPACE, "src", "dst", (F.col("n") * 1.5).alias("weight"))
    e = e.unionByName(symbol_edges(files, chunks).withColumn("weight", F.lit(1.0))).unionByName(test_links(files).select(*SPACE, "src", "dst", (F.col("n") * 2.0).alias("weight")))
    both = e.unionByName(e.select(*SPACE, F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy(*SPACE, "src", "dst").agg(F.sum("weight").alias("weight"))


def affinity(scores: DataFrame, edges: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, path, affinity) of the files of scores that the task speaks for or against.

    Files that the query mentions get 0.4, their neighbours 1.0 for each. For code2test every test gets 1.0; for comment2context
    the given files lose 1.0 and their neighbours get 0.8 for each; for trace2code sources get 0.5 and tests lose 0.2. samples has, where they are known, task_type
    and given_files; scores has (sample_id, repo, base_commit, path, mentioned).
    """
    task = samples.select("sample_id", (F.coalesce("task_type", F.lit("")) if "task_type" in samples.columns else F.lit("")).alias("task"))
    p = F.col("path")
    at = scores.filter("mentioned").select("sample_id", *SPACE, "path", F.lit(0.4).alias("own"), F.lit(1.0).alias("near"))
    if {"task_type", "given_files"} <= set(samples.columns):
        given = samples.filter("task_type = 'comment2context'").select("sample_id", F.explode("given_files").alias("path")).distinct()
        at = at.unionByName(scores.join(given, ["sample_id", "path"], "left_semi").select("sample_id", *SPACE, "path", F.lit(-1.0).alias("own"), F.lit(0.8).alias("near")))
    near = at.select("sample_id", *SPACE, F.col("path").alias("src"), "near").join(edges, [*SPACE, "src"]).select("sample_id", F.col("dst").alias("path"), F.col("near").alias("a"))
    kind = F.when(is_test_path(p), "test").when(is_code_path(p), "source")
    by_kind = F.when((F.col("task") == "code2test") & (kind == "test"), 1.0).when((F.col("task") == "trace2code") & (kind == "source"), 0.5).when((F.col("task") == "trace2code") & (kind == "test"), -0.2)
    of_kind = scores.join(task.filter(F.col("task").isin("code2test", "trace2code")), "sample_id").select("sample_id", "path", by_kind.alias("a")).filter("a is not null")
    return at.select("sample_id", "path", F.col("own").alias("a")).unionByName(near).unionByName(of_kind).groupBy("sample_id", "path").agg(F.sum("a").alias("affinity"))


def rank_files(samples: DataFrame, files: DataFrame, chunks: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(sample_id, path, score, rank) of the blend 0.65 query, 0.25 personalised PageRank, 0.10 affinity, each over its greatest value of the sample.

    All samples walk their snapshots' graphs together: a round is one join on (snapshot, source) and one sum by (sample, file).
    """
    q = cut(query_scores(samples, files, chunks))
    edges = cut(file_graph(files, chunks))
    rows = q.join(affinity(q, edges, samples), ["sample_id", "path"], "left").withColumn("affinity", F.coalesce("affinity", F.lit(0.0)))
    whole = Window.partitionBy("sample_id")
    seed = F.greatest(F.lit(0.0), F.col("score")) + F.greatest(F.lit(0.0), F.col("affinity"))
    total = F.sum(seed).over(whole)
    out = edges.groupBy(*SPACE, F.col("src").alias("path")).agg(F.sum("weight").alias("total"))
    base = F.when(total > 0, seed / total).otherwise(1.0 / F.count(F.lit(1)).over(whole))
    r = cut(rows.withColumn("base", base).join(out, [*SPACE, "path"], "left").withColumn("pr", F.col("base")))
    shares = cut(edges.join(out.withColumnRenamed("path", "src"), [*SPACE, "src"]).select(*SPACE, "src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    for i in range(rounds):
        flow = r.filter("total is not null").select("sample_id", *SPACE, F.col("path").alias("src"), "pr").join(shares, [*SPACE, "src"]).groupBy("sample_id", F.col("dst").alias("path")).agg(F.sum(F.col("pr") * F.col("share")).alias("f"))
        lost = F.sum(F.when(F.col("total").isNull(), F.col("pr")).otherwise(0.0)).over(whole)
        r = r.withColumn("lost", lost).join(flow, ["sample_id", "path"], "left").withColumn("pr", (1 - DAMPING) * F.col("base") + DAMPING * F.col("lost") * F.col("base") + DAMPING * F.coalesce("f", F.lit(0.0))).drop("lost", "f")
        if i % 6 == 5:
            r = cut(r)
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(F.abs(c)).over(whole)), F.lit(0.0))
    blended = r.withColumn("blend", QUERY * part("score") + RANK * part("pr") + AFFINITY * part("affinity"))
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.round("blend", 9)), "path")
    return blended.select("sample_id", "path", F.col("blend").alias("score"), F.row_number().over(order).alias("rank"))
