"""Joins that keep working when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.session import cut, rows_at_most

#: A lookup side is broadcast only up to this many rows.
BROADCAST_ROWS = 10_000
#: A key with more than this share of the rows counts as heavy; there can be at most 1 / HEAVY_SHARE of them.
HEAVY_SHARE = 0.001


def heavy_keys(rows: DataFrame, on: list[str], *, weight: str | None = None, heavy_share: float = HEAVY_SHARE) -> DataFrame | None:
    """(on, pieces): the keys that hold more than heavy_share of the rows, or of their weight; none gives None.

    Counts are summed on the map side, and only the heaviest 1 / heavy_share keys reach the driver: no more can be
    heavy. pieces is how many parts of heavy_share each make up the key. Null keys are not counted.
    """
    w = F.sum(weight) if weight else F.count(F.lit(1))
    seen = Observation()
    counts = rows.dropna(subset=on).groupBy(*on).agg(w.cast("long").alias("_n")).observe(seen, F.sum("_n").alias("total"))
    top = counts.orderBy(F.desc("_n")).limit(max(1, int(1 / heavy_share))).collect()
    if not top:
        return None
    least = max(1.0, (seen.get["total"] or 0) * heavy_share)
    heavy = [(*[r[k] for k in on], int(-(-r["_n"] // least))) for r in top if r["_n"] > least]
    if not heavy:
        return None
    schema = T.StructType([*[T.StructField(k, counts.schema[k].dataType) for k in on], T.StructField("_pieces", T.IntegerType())])
    return rows.sparkSession.createDataFrame(heavy, schema)


def lookup_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", *, weights: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Join rows with a lookup that has at most one row a key; how is inner or left.

    A lookup of at most broadcast_rows rows is broadcast after its rows have been counted. Beyond that one shuffle join
    is salted for heavy keys only: rows of a key with more than heavy_share of them are spread over as many parts as
    heavy_share goes into it, by a hash of the row, and the key's one lookup row is repeated for each part; at most
    2 / heavy_share lookup rows are added. rows are evaluated once: keys are counted on weights, a table
    with the same columns `on` that is cheap to read, or, where none is given, on the rows after they have been cut.
    Null keys meet nothing; with how = left their rows stay.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how is inner or left, not {how!r}")
    if rows_at_most(lookup, broadcast_rows):
        return rows.join(F.broadcast(lookup), on, how)
    if weights is None:
        rows = weights = cut(rows)
    return salted_join(rows, lookup, on, how, heavy_keys(weights, on, heavy_share=heavy_share))


def salted_join(rows: DataFrame, lookup: DataFrame, on: list[str], how: str, heavy: DataFrame | None) -> DataFrame:
    """The shuffle join of lookup_join: the keys that heavy_keys gave are spread over their pieces."""
    if heavy is None:
        return rows.join(lookup, on, how)
    few = F.broadcast(heavy)  # at most 1 / heavy_share rows
    pieces = F.coalesce("_pieces", F.lit(1))
    hashed = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    left = rows.join(few, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*hashed), pieces).cast("int")).drop("_pieces")
    right = lookup.join(few, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
