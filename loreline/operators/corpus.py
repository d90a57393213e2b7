"""Building and checking a chunk corpus: lines, symbols, bounds, manifests, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.operators.snapshots import latest

# What starts a symbol, tried in this order; the first group is its name.
SYMBOL_PATTERNS = [
    r"^\s*(?:async\s+)?def\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)\b",
    r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*\(",
    r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*=\s*(?:async\s*)?\(?",
    r"^\s*(?:export\s+)?class\s+([A-Za-z_$][A-Za-z0-9_$]*)\b",
    r"^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"^\s*(?:public|private|protected|static|final|abstract|synchronized|\s)+[\w<>\[\], ?]+\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(",
    r"^\s*(?:public\s+)?(?:class|interface|enum|record)\s+([A-Za-z_][A-Za-z0-9_]*)\b",
]


def lines(text: Column) -> Column:
    """The lines of a text, any line end, without an empty last one."""
    all_lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    return F.when(F.element_at(all_lines, -1) == "", F.slice(all_lines, 1, F.size(all_lines) - 1)).otherwise(all_lines)


def symbols(files: DataFrame) -> DataFrame:
    """(files' columns but text, symbol, start_line, end_line): a symbol ends before the next one or with the file. All within the row."""
    name = lambda x: F.coalesce(*[F.nullif(F.regexp_extract(x, p, 1), F.lit("")) for p in SYMBOL_PATTERNS])
    starts = F.filter(F.transform("_lines", lambda x, i: F.struct(name(x).alias("symbol"), (i + 1).alias("line"))), lambda s: s["symbol"].isNotNull())
    keep = [c for c in files.columns if c != "text"]
    named = files.filter(F.col("text").isNotNull()).select(*keep, lines(F.col("text")).alias("_lines")).select(*keep, F.size("_lines").alias("_n"), starts.alias("_s"))
    end = lambda s, i: F.greatest(s["line"], F.coalesce(F.get("_s", i + 1)["line"], F.col("_n") + 1) - 1)
    return named.select(*keep, F.explode(F.transform("_s", lambda s, i: F.struct(s["symbol"].alias("symbol"), s["line"].alias("start_line"), end(s, i).alias("end_line")))).alias("_x")).select(*keep, "_x.*")


def bounds(chunks: DataFrame) -> DataFrame:
    """The last line of every path of a snapshot."""
    return chunks.groupBy("repo", "base_commit", "path").agg(F.max("end_line").alias("last_line"))


def kind_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("repo", "base_commit").agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "symbol").alias("symbols"), F.count(F.lit(1)).alias("chunks"))


def merge_manifests(manifest: DataFrame) -> DataFrame:
    """One row a snapshot: one that is ok before any other, then the youngest."""
    order = manifest.withColumn("_ok", F.coalesce((F.col("status") == "ok").cast("int"), F.lit(0)))
    return latest(order, ["repo", "base_commit"], ["_ok", "generated_at"], ["status", "base_ref", "chunk_count"])


def upsert(existing: DataFrame, new: DataFrame, key: list[str], is_error: Column, seq: str) -> DataFrame:
    """The preferred row of each key from both: one without error before any with, then the one with the greatest seq."""
    order = existing.unionByName(new).withColumn("_good", (~is_error).cast("int"))
    keep = [c for c in existing.columns if c not in (*key, seq)]
    return latest(order, key, ["_good", seq], [seq, *keep])


def blocks_of_spans(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """(sample_id, path, start_line, end_line, chunk_id, symbol, source): the symbol chunks that overlap a span, or the span itself where none does."""
    keyed = spans.select("sample_id", "repo", "base_commit", "path", "start_line", "end_line")
    c = chunks.filter("kind = 'symbol'").select("repo", "base_commit", "path", "chunk_id", "symbol", F.col("start_line").alias("cs"), F.col("end_line").alias("ce"))
    hits = keyed.join(c, ["repo", "base_commit", "path"]).filter((F.col("start_line") <= F.col("ce")) & (F.col("cs") <= F.col("end_line")))
    found = hits.select("sample_id", "path", F.col("cs").alias("start_line"), F.col("ce").alias("end_line"), "chunk_id", "symbol", F.lit("symbol").alias("source")).distinct()
    lone = keyed.join(hits.select("sample_id", "path", "start_line", "end_line").distinct(), ["sample_id", "path", "start_line", "end_line"], "left_anti")
    return found.unionByName(lone.select("sample_id", "path", "start_line", "end_line", F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("symbol"), F.lit("span_fallback").alias("source")).distinct())


def first_row(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; use `latest` where a key may repeat without end."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")
