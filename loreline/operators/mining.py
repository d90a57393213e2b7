"""Relational pieces of sample mining: response windows, reruns, drop reasons, patches, script JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row_type(df: DataFrame) -> str:
    """The type of a struct of all columns."""
    return df.schema.simpleString()


def first_within(left: DataFrame, right: DataFrame, key: list[str], at: str, hours: int) -> DataFrame:
    """left with `response` and `responses`: the first and the number of right's times after a row's own, at most so many hours later.

    An as-of join by one union: both sides are put in the order of time within their key, and every left row looks ahead
    through a range frame. No pair of rows is formed. at is a timestamp in both.
    """
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    both = left.select(*key, F.col(at), F.struct(*left.columns).alias("_row"), F.lit(None).cast("timestamp").alias("_t")).unionByName(right.select(*key, F.col(at), F.lit(None).cast(_row_type(left)).alias("_row"), F.col(at).cast("timestamp").alias("_t")))
    ahead = Window.partitionBy(*key).orderBy("_us").rangeBetween(1, hours * 3_600_000_000)
    seen = both.withColumn("_us", seconds).withColumn("response", F.min("_t").over(ahead)).withColumn("responses", F.count("_t").over(ahead))
    return seen.filter(F.col("_row").isNotNull()).select("_row.*", "response", "responses")


def reruns(runs: DataFrame, key: list[str]) -> DataFrame:
    """(key, failed_at, passed_at): the first failure of a key and the first success after it. runs has at and ok."""
    failed = runs.filter("not ok").groupBy(*key).agg(F.min("at").alias("failed_at"))
    return runs.filter("ok").join(failed, key).filter(F.col("at") >= F.col("failed_at")).groupBy(*key, "failed_at").agg(F.min("at").alias("passed_at"))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that a row breaks, null if none."""
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def is_format_only(patch: Column) -> Column:
    """Whether the added lines of a patch are its removed ones but for blanks and order, and there are some."""
    changed = lambda sign: F.array_sort(F.transform(F.filter(F.split(patch, "\n"), lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.regexp_replace(x.substr(F.lit(2), F.length(x)), r"\s+", "")))
    plus, minus = F.filter(changed("+"), lambda x: x != ""), F.filter(changed("-"), lambda x: x != "")
    return (F.size(plus) + F.size(minus) > 0) & (plus == minus)
