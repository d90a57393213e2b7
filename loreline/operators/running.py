"""Order over a whole table or group without one task seeing all of it: running totals, ranks, the row before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreline.session import cut


def running_totals(df: DataFrame, order: list[str], values: list[str]) -> DataFrame:
    """df with cum_<value>, the total up to and with each row in the order, which must be without ties.

    Rows are split by ranges of the order; every range adds up for itself, and the totals of the ranges before, one
    row a range, are broadcast.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.join(F.broadcast(offsets), "_part").select(*df.columns, *[(F.col(f"_o_{v}") + F.sum(v).over(within)).alias(f"cum_{v}") for v in values])


def previous(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`, the value of the row before in the group's order, null for the first; the order must be without ties.

    A group may hold most of the rows: rows are split by ranges of (group, order), each part looks back within itself,
    and only groups that go on over a border, one row a part, hand their last value to the next part.
    """
    parts = cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part", *group).orderBy(*order)
    ends = parts.groupBy(*group, "_part").agg(F.max(F.struct(*order, F.col(value).alias("_v"))).alias("_top")).select(*group, "_part", F.col("_top._v").alias("_v"))
    over = F.lag("_v").over(Window.partitionBy(*group).orderBy("_part"))  # one row a part
    borders = ends.withColumn("_before", over).filter(F.col("_before").isNotNull()).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_before")
    met = F.lit(True)
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    looked = parts.withColumn("_lag", F.lag(value).over(within)).withColumn("_first", F.row_number().over(within) == 1)
    # a part has at most one group that began before it, so the borders are one row a part
    joined = looked.join(F.broadcast(borders), (F.col("_part") == F.col("_p")) & met, "left")
    return joined.select(*df.columns, F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")).alias(name))


def ranked_within(df: DataFrame, group: list[str], order: list[str], name: str = "_i") -> DataFrame:
    """df with `name`, the row's place in its group from 1, and `name`_of, the rows of the group; the order must be without ties.

    Like running_totals for groups of which one may hold most of the rows: a part counts its own rows, and the
    counts of a group's parts before are added, one row a part and group.
    """
    parts = cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    key = Window.partitionBy(*group)
    offsets = sums.select(*group, "_part", F.coalesce(F.sum("_n").over(key.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"), F.sum("_n").over(key).alias(f"{name}_of"))
    offsets = offsets.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), "_o", f"{name}_of")
    met = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        met = met & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = parts.withColumn("_r", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)))
    return local.join(offsets, met).select(*df.columns, (F.col("_o") + F.col("_r")).alias(name), f"{name}_of")
