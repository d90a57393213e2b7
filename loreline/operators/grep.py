"""Ranking by the search patterns that stand in a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.paths import basename
from loreline.functions.text import tokenize

# Fixed values of the pattern rules.
SUFFIXES = "bash|c|cc|cpp|cs|cxx|fish|go|h|hpp|java|js|jsx|kt|kts|m|mm|php|proto|py|pyi|rb|rs|scala|sh|swift|ts|tsx|zsh"
CODE_SPAN = r"`([^`\n]{2,200})`"
FILE_PATH = r"(?:[A-Za-z0-9_.@+-]+/)+[A-Za-z0-9_.@+-]+\.(?:" + SUFFIXES + r"|json|ya?ml|toml|md|rst|txt)\b"
BARE_FILE = r"\b[A-Za-z0-9_.@+-]+\.(?:" + SUFFIXES + r")\b"
FLAG = r"(?<![A-Za-z0-9_])(--[A-Za-z0-9][A-Za-z0-9_-]{1,80})\b"
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]*(?:(?:::|\.|/)[A-Za-z_][A-Za-z0-9_]*)*\b"
ERROR_END = r"(?:Error|Exception|Failure|Warning|Panic|Timeout|Traceback)$"
STOP_TERMS = ["a", "an", "and", "are", "arg", "args", "base", "body", "bug", "call", "case", "change", "changed", "changed_file", "class", "code", "comment", "config", "context", "could", "data", "default", "does", "error", "expected", "fail", "failed", "failure", "failure_excerpt", "file", "files", "fix", "from", "function", "given_file", "gold", "has", "have", "issue", "kind", "line", "log", "message", "method", "must", "name", "not", "path", "pr", "pr_body", "pr_title", "query", "raw_signal", "review", "review_comment", "run", "should", "signal", "source", "stack", "test", "tests", "text", "that", "the", "this", "title", "trace", "type", "update", "value", "when", "with"]
WEIGHTS = {"code": 12.0, "file_path": 18.0, "flag": 10.0, "identifier": 7.0}
SPACE = ["repo", "base_commit"]


def _clean(term: Column) -> Column:
    return F.regexp_replace(F.trim(term), r"^['\"“”‘’.,;:()\[\]{}]+|['\"“”‘’.,;:()\[\]{}]+$", "")


def _usable(term: Column) -> Column:
    return (F.length(term) >= 2) & ~F.lower(term).isin(STOP_TERMS) & term.rlike("[A-Za-z0-9]")


def _telling(term: Column) -> Column:
    """Whether an identifier says much: joined parts, digits, an error, capitals, camel case."""
    return _usable(term) & (term.rlike(r"[/._]|::|[0-9]") | term.rlike(ERROR_END) | ((F.length(term) >= 3) & term.rlike("[A-Z]") & ~term.rlike("[a-z]")) | (term.rlike("^.+[A-Z]") & term.rlike("[a-z]")))


def patterns(samples: DataFrame, expanded: bool = False) -> DataFrame:
    """(sample_id, repo, base_commit, term, kind, weight): of terms that differ only in case the heaviest, of equal ones the first.

    expanded adds every other word of at least four letters, with weight 1; it is met only as a whole word of a text.
    """
    q = F.replace(F.coalesce("query_text", F.lit("")), F.lit("\\n"), F.lit("\n"))
    every = lambda p, g=0: F.regexp_extract_all(q, F.lit(p), F.lit(g))
    error = lambda t, other: F.when(t.rlike(ERROR_END), "error").otherwise(other)
    span_kind = lambda t: F.when(t.rlike("^(?:" + FILE_PATH + ")$") | t.rlike("^(?:" + BARE_FILE + ")$"), "file_path").when(t.startswith("--"), "flag").otherwise(error(t, F.lit("code")))
    made = lambda terms, kind, w, rank: F.transform(terms, lambda t: F.struct(_clean(t).alias("term"), kind(F.trim(t)).alias("kind"), F.lit(w).alias("weight"), F.lit(rank).alias("o")))
    fixed = lambda k: lambda _: F.lit(k)
    found = F.concat(
        made(every(CODE_SPAN, 1), span_kind, 12.0, 0),
        made(every(FILE_PATH), fixed("file_path"), 18.0, 1),
        made(every(BARE_FILE), fixed("file_path"), 18.0, 2),
        made(every(FLAG, 1), fixed("flag"), 10.0, 3),
        made(F.filter(every(IDENTIFIER), _telling), lambda t: error(t, F.lit("identifier")), 7.0, 4),
        *([made(F.filter(tokenize(q), lambda t: (F.length(t) >= 4) & ~t.isin(STOP_TERMS)), fixed("token"), 1.0, 5)] if expanded else []),
    )
    rows = samples.select("sample_id", *SPACE, F.posexplode(found).alias("pos", "p")).select("sample_id", *SPACE, "pos", "p.*").filter(_usable(F.col("term")))
    best = rows.groupBy("sample_id", *SPACE, F.lower("term").alias("key")).agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col("o"), F.col("pos"), F.col("term"), F.col("kind"))).alias("b"))
    return best.select("sample_id", *SPACE, F.col("b.term").alias("term"), F.col("b.kind").alias("kind"), (-F.col("b.w")).alias("weight"))


def rank_files(samples: DataFrame, chunks: DataFrame, expanded: bool = False) -> DataFrame:
    """(sample_id, path, score, matched, best, hit_chunks, rank): files that some pattern meets, within the sample's snapshot.

    A pattern counts once a file, with the best of its chunks. Chunks meet the patterns of their own snapshot only.
    """
    p = patterns(samples, expanded).withColumn("low", F.lower("term"))
    c = chunks.filter(F.col("path") != "").select(*SPACE, "chunk_id", "path", F.lower("path").alias("lp"), F.lower(basename(F.col("path"))).alias("lb"), F.lower(F.coalesce("symbol", F.lit(""))).alias("ls"), F.lower(F.coalesce("text", F.lit(""))).alias("lt"))
    low, w = F.col("low"), F.col("weight")
    within = lambda where, f: F.when(F.col(where).contains(low), w * f).otherwise(0.0)
    score = F.when(F.col("lp").contains(low), w * F.when(F.col("kind") == "file_path", 2.0).otherwise(1.35)).otherwise(0.0) + within("lb", 1.1) + within("ls", 1.2)
    alone = F.concat(F.lit(r"(?s).*(?<![A-Za-z0-9_])\Q"), low, F.lit(r"\E(?![A-Za-z0-9_]).*"))
    score = score + F.when((F.col("kind") != "token") & F.col("lt").contains(low), w).when((F.col("kind") == "token") & F.col("lt").contains(low) & F.rlike(F.col("lt"), alone), w).otherwise(0.0)
    hits = p.join(c, SPACE).select("sample_id", "path", "chunk_id", "low", "kind", score.alias("s")).filter("s > 0")
    per_pattern = hits.groupBy("sample_id", "path", "kind", "low").agg(F.max("s").alias("s")).groupBy("sample_id", "path").agg(F.sum("s").alias("sum"), F.count(F.lit(1)).alias("matched"))
    per_chunk = hits.groupBy("sample_id", "path", "chunk_id").agg(F.sum("s").alias("s")).groupBy("sample_id", "path").agg(F.max("s").alias("best"), F.count(F.lit(1)).alias("hit_chunks"))
    both = per_pattern.join(per_chunk, ["sample_id", "path"]).withColumn("score", F.col("sum") + F.least(F.lit(2.0), F.log1p("hit_chunks") * 0.25))
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.round("score", 9)), F.desc("matched"), F.desc(F.round("best", 9)), "path")
    return both.withColumn("rank", F.row_number().over(order)).drop("sum")


def search(chunks: DataFrame, pattern: str, depth: int = 20) -> DataFrame:
    """Files of every snapshot that hold a text, by whether their path does, then by how often."""
    low = pattern.lower()
    files = chunks.filter("kind = 'file'").select(*SPACE, "path", F.lower(F.concat_ws("\n", "path", "text")).alias("h"))
    n = ((F.length("h") - F.length(F.replace("h", F.lit(low), F.lit("")))) / len(low)).cast("long")
    hit = files.select(*SPACE, "path", F.lower("path").contains(low).alias("path_match"), n.alias("matches")).filter("matches > 0")
    order = Window.partitionBy(*SPACE).orderBy(F.desc("path_match"), F.desc("matches"), F.length("path"), "path")
    return hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def list_folder(chunks: DataFrame, folder: str) -> DataFrame:
    """The entries right under a folder of every snapshot."""
    at = folder.strip("/")
    inside = chunks.filter(F.col("path").startswith(at + "/") if at else F.lit(True))
    rest = F.expr(f"substring(path, {len(at) + 2})") if at else F.col("path")
    return inside.select(*SPACE, F.split(rest, "/")[0].alias("entry"), (F.size(F.split(rest, "/")) > 1).alias("is_folder")).distinct()
