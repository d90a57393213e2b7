"""Reports over per-sample results: correlation, buckets, coverage, leaderboards, spread."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def correlations(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, pearson, spearman): null without variance; ranks of ties are their mean."""
    whole = Window.partitionBy(*by)

    def ranks(c: str):
        return F.rank().over(whole.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0

    def pearson(a: str, b: str):
        return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))

    ranked = rows.dropna(subset=[x, y]).withColumn("_rx", ranks(x)).withColumn("_ry", ranks(y))
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("pearson"), pearson("_rx", "_ry").alias("spearman"))


def coverage(hits: DataFrame, methods: int) -> DataFrame:
    """(methods_hit, samples) from (sample_id, method, hit), with a row for each number from 0."""
    per = hits.groupBy("sample_id").agg(F.count_if("hit").alias("methods_hit")).groupBy("methods_hit").agg(F.count(F.lit(1)).alias("samples"))
    bins = hits.sparkSession.range(methods + 1).select(F.col("id").alias("methods_hit"))
    return bins.join(per, "methods_hit", "left").na.fill(0)


def leaderboard(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Methods of each scope in order of their metrics, first metric first, then by name."""
    order = Window.partitionBy(*by).orderBy(*[F.desc(F.round(m, 9)) for m in metrics], "method")
    return rows.withColumn("place", F.row_number().over(order))


def spread(rows: DataFrame, by: list[str], metric: str) -> DataFrame:
    """(by, best, median, worst, lead) over methods."""
    return rows.groupBy(*by).agg(F.max(metric).alias("best"), F.median(metric).alias("median"), F.min(metric).alias("worst"), (F.max(metric) - F.median(metric)).alias("lead"))


def unpivoted(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return rows.unpivot(ids, metrics, "metric", "value")
