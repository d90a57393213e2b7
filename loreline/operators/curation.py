"""Curating samples: keep lists, strata, shards, audits, readiness."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep(samples: DataFrame, keep_list: DataFrame) -> DataFrame:
    """Samples that a keep list names with a blank or valid verdict."""
    fine = keep_list.filter(F.coalesce(F.lower(F.trim("verdict")), F.lit("")).isin("", "valid")).select("sample_id").dropna().distinct()
    return samples.join(fine, "sample_id", "left_semi")


def round_robin(rows: DataFrame, stratum: list[str], order: list[str], limit: int) -> DataFrame:
    """The first limit rows when strata take turns, each in its order; `turn` counts the rounds."""
    turns = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*stratum).orderBy(*order)))
    return turns.orderBy("turn", *stratum, *order).limit(limit)


def balanced(rows: DataFrame, group: str, per_group: int, seed: str) -> DataFrame:
    """At most per_group rows of each group, drawn by a hash of seed and sample_id."""
    order = Window.partitionBy(group).orderBy(F.sha2(F.concat_ws("\x1f", F.lit(seed), "sample_id"), 256), "sample_id")
    return rows.withColumn("draw", F.row_number().over(order)).filter(F.col("draw") <= per_group)


def modulo_shards(rows: DataFrame, order: str, shards: int) -> DataFrame:
    """shard of each row by a hash of its key, so that no global order is needed."""
    return rows.withColumn("shard", F.conv(F.substring(F.md5(F.col(order).cast("binary")), 1, 8), 16, 10).cast("long") % shards)


def weighted_shards(weights: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """Keys to shards, heaviest first, each to the lightest shard. weights is one entry a snapshot, a bounded list on the driver."""
    heap = [(0, 0, i) for i in range(shards)]
    out = {}
    for key, w in sorted(weights, key=lambda x: (-max(1, x[1]), x[0])):
        load, n, i = heapq.heappop(heap)
        out[key] = i
        heapq.heappush(heap, (load + max(1, w), n + 1, i))
    return out


def conflicts(audits: DataFrame) -> DataFrame:
    """(sample_id, verdicts) of samples that audits judge differently; blank verdicts do not count."""
    v = F.nullif(F.lower(F.trim("verdict")), F.lit(""))
    return audits.filter(v.isNotNull()).groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_set(v)), ",").alias("verdicts"), F.count_distinct(v).alias("n")).filter("n > 1").drop("n")


def readiness(samples: DataFrame, snapshots: DataFrame, keep_list: DataFrame) -> DataFrame:
    """(gate, failing): how many samples fail each gate."""
    fine = keep_list.select("sample_id").dropna().distinct().withColumn("audited", F.lit(True))
    rows = samples.join(snapshots.select("repo", "base_commit", "counts"), ["repo", "base_commit"], "left").join(fine, "sample_id", "left")
    gates = {"snapshot": F.coalesce("counts", F.lit(False)), "gold": F.size("gold_files") > 0, "query": F.length(F.trim(F.coalesce("query_text", F.lit("")))) > 0, "audited": F.coalesce("audited", F.lit(False))}
    sums = rows.agg(*[F.count_if(~ok).alias(n) for n, ok in gates.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("failing")) for n in gates])).alias("x")).select("x.*")
