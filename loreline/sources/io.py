"""Files in and out: JSON lines, CSV and checksums, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a missing file is an empty table, blank lines are skipped, rows keep the order of their file in _seq."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("_seq", F.lit(None).cast("long"))
    lines = spark.read.text(path).withColumn("_seq", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"allowNonNumericNumbers": "true"}).alias("r"), "_seq").select("r.*", "_seq")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line, keys sorted, nulls kept."""
    rows = df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))
    rows.write.mode("append" if append else "overwrite").text(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in their order, with a header."""
    df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def checksums(spark: SparkSession, glob: str) -> DataFrame:
    """(path, size, sha256) of whole files."""
    return spark.read.format("binaryFile").load(glob).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def mismatches(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (name, sha256) that no file of that name has."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return expected.join(have, ["name", "sha256"], "left_anti")
