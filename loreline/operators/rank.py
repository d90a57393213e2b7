"""Rankers: samples and chunks in, (sample_id, chunk_id, path, score, rank) out. Every candidate is ranked, zero scores too.

Inverted index throughout: tokens of chunks meet tokens of queries in an equi-join on snapshot and token, with counts
summed on the map side; no query is ever compared with a chunk of another snapshot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.functions.paths import basename
from loreline.functions.text import tokenize
from loreline.session import cut

SNAPSHOT = ["repo", "base_commit"]
# Fixed values of the rankers.
K1, B = 1.5, 0.75
PATH_BONUS, NAME_BONUS, SYMBOL_BONUS = 25.0, 8.0, 5.0
RRF_K = 60


def chunk_text() -> Column:
    filled = [F.nullif(F.col(c), F.lit("")) for c in ("path", "symbol", "kind", "text")]
    return F.concat_ws(" ", *filled)


def candidates(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk of each sample's snapshot."""
    q = samples.select("sample_id", *SNAPSHOT, F.lower("query_text").alias("_query"))
    return q.join(chunks.select(*SNAPSHOT, "chunk_id", "path", "symbol", "kind", F.length("text").alias("chars"), "start_line", "end_line"), SNAPSHOT)


def ranked(scored: DataFrame) -> DataFrame:
    """rank by score, path, chunk_id; scores are compared at nine decimals, so that the order of summation does not matter."""
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.round("score", 9)), "path", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order))


def _query_tokens(samples: DataFrame) -> DataFrame:
    return samples.select("sample_id", *SNAPSHOT, F.explode(tokenize(F.col("query_text"))).alias("token")).groupBy("sample_id", *SNAPSHOT, "token").agg(F.count(F.lit(1)).alias("qtf"))


def _term_rows(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per chunk its length and number of distinct tokens; per (snapshot, chunk, token) its count, only for tokens some query asks."""
    tokens = chunks.select(*SNAPSHOT, "chunk_id", tokenize(chunk_text()).alias("tokens"))
    sizes = tokens.select(*SNAPSHOT, "chunk_id", F.size("tokens").alias("length"), F.size(F.array_distinct("tokens")).alias("distinct"))
    asked = queries.select(*SNAPSHOT, "token").distinct()
    terms = tokens.select(*SNAPSHOT, "chunk_id", F.explode("tokens").alias("token")).join(asked, [*SNAPSHOT, "token"], "left_semi").groupBy(*SNAPSHOT, "chunk_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    return sizes, cut(terms)


def lexical(samples: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sum of (1 + ln qtf) * ln((N + 1) / (1 + df) + 1) over shared tokens, with bonuses where path, file name or symbol stand in the query, over the root of the distinct tokens."""
    queries = _query_tokens(samples)
    sizes, terms = _term_rows(chunks, queries)
    df = terms.groupBy(*SNAPSHOT, "token").agg(F.count(F.lit(1)).alias("df"))
    n = chunks.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("n"))
    weights = queries.join(df, [*SNAPSHOT, "token"]).join(n, SNAPSHOT).select("sample_id", *SNAPSHOT, "token", ((1 + F.ln("qtf")) * F.ln((F.col("n") + 1) / (1 + F.col("df")) + 1.0)).alias("w"))
    hits = weights.join(terms, [*SNAPSHOT, "token"]).groupBy("sample_id", "chunk_id").agg(F.sum("w").alias("w"))
    low = F.lower("path")
    name = F.lower(basename(F.col("path")))
    inside = lambda x, points: F.when((x != "") & F.col("_query").contains(x), points).otherwise(0.0)
    bonus = inside(low, PATH_BONUS) + inside(name, NAME_BONUS) + F.coalesce(inside(F.lower("symbol"), SYMBOL_BONUS), F.lit(0.0))
    empty = F.size(tokenize(F.col("_query"))) == 0
    scored = candidates(samples, chunks).join(sizes, [*SNAPSHOT, "chunk_id"]).join(hits, ["sample_id", "chunk_id"], "left")
    score = F.when(empty, 0.0).otherwise((F.coalesce("w", F.lit(0.0)) + bonus) / F.greatest(F.lit(1.0), F.sqrt("distinct")))
    return ranked(scored.select("sample_id", "chunk_id", "path", "kind", "chars", "start_line", "end_line", score.alias("score")))


def bm25(samples: DataFrame, chunks: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """Sum of qtf * ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length))."""
    queries = _query_tokens(samples)
    sizes, terms = _term_rows(chunks, queries)
    df = terms.groupBy(*SNAPSHOT, "token").agg(F.count(F.lit(1)).alias("df"))
    n = sizes.groupBy(*SNAPSHOT).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    weights = queries.join(df, [*SNAPSHOT, "token"]).join(n, SNAPSHOT).select("sample_id", *SNAPSHOT, "token", "mean", (F.col("qtf") * F.ln(1.0 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    norm = F.lit(1.0 - b) + F.when(F.col("mean") > 0, b * F.col("length") / F.col("mean")).otherwise(0.0)
    part = F.col("w") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * norm)
    hits = weights.join(terms, [*SNAPSHOT, "token"]).join(sizes, [*SNAPSHOT, "chunk_id"]).groupBy("sample_id", "chunk_id").agg(F.sum(part).alias("w"))
    scored = candidates(samples, chunks).join(hits, ["sample_id", "chunk_id"], "left")
    return ranked(scored.select("sample_id", "chunk_id", "path", "kind", "chars", "start_line", "end_line", F.coalesce("w", F.lit(0.0)).alias("score")))


def files(ranking: DataFrame) -> DataFrame:
    """(sample_id, path, rank): files in the order of their first chunk."""
    first = ranking.filter(F.col("path") != "").groupBy("sample_id", "path").agg(F.min("rank").alias("first"), F.max("score").alias("score"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("sample_id").orderBy("first"))).select("sample_id", "path", "rank", "score")


def fuse(rankings: dict[str, DataFrame], weights: dict[str, float] | None = None, k: int = RRF_K, depth: int = 20) -> DataFrame:
    """Reciprocal rank fusion over the samples all rankings have: sum of weight / (k + rank), best depth files."""
    parts = None
    for name, r in rankings.items():
        part = r.select("sample_id", "path", F.lit(name).alias("run"), (F.lit((weights or {}).get(name, 1.0)) / (k + F.col("rank"))).alias("s"))
        parts = part if parts is None else parts.unionByName(part)
    common = parts.groupBy("sample_id").agg(F.count_distinct("run").alias("n")).filter(F.col("n") == len(rankings)).select("sample_id")
    fused = parts.join(common, "sample_id", "left_semi").groupBy("sample_id", "path").agg(F.sum("s").alias("score"))
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.round("score", 12)), "path")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


#: Query vectors that are compared with all items in one pass over these.
QUERY_BLOCK = 4096


def by_vectors(queries: DataFrame, items: DataFrame, depth: int = 20, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, item_id, score, rank): the depth items nearest by cosine to each query, exactly. queries has (query_id, vector), items (item_id, vector).

    Queries go in blocks of about `block`, each a matrix that every task holds; items are read once a block in Arrow batches, and a
    task keeps only the best of each query, so that depth rows a query and task meet in the final ranking. Vectors
    without length score 0, null vectors and other lengths than the block's first take no part. Ties go to the lesser item_id.
    """
    ids = queries.schema["query_id"].dataType, items.schema["item_id"].dataType
    schema = T.StructType([T.StructField("query_id", ids[0]), T.StructField("item_id", ids[1]), T.StructField("score", T.DoubleType())])
    known = queries.filter(F.col("vector").isNotNull()).select("query_id", "vector")
    blocks = max(1, -(-known.count() // block))
    parts = None
    for b in range(blocks):
        rows = known.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        width = len(rows[0]["vector"])
        rows = [r for r in rows if len(r["vector"]) == width]
        names = [r["query_id"] for r in rows]
        matrix = items.sparkSession.sparkContext.broadcast(_unit(np.array([r["vector"] for r in rows], float)))

        def best(batches: Iterator[pd.DataFrame], names: list = names, matrix=matrix, width: int = width) -> Iterator[pd.DataFrame]:
            q = np.empty(0, int)
            item: np.ndarray = np.empty(0, object)
            score = np.empty(0)
            least = np.full(len(names), -np.inf)
            for batch in batches:
                fine = batch[batch["vector"].map(len) == width]
                if not len(fine):
                    continue
                s = np.round(_unit(np.stack(fine["vector"].to_numpy()).astype(float)) @ matrix.value.T, 9)
                at, to = np.nonzero(s >= least)
                q, item, score = np.concatenate([q, to]), np.concatenate([item, fine["item_id"].to_numpy(object)[at]]), np.concatenate([score, s[at, to]])
                order = np.lexsort((item, -score, q))
                q, item, score = q[order], item[order], score[order]
                first = np.searchsorted(q, q)
                keep = np.arange(len(q)) - first < depth
                q, item, score = q[keep], item[keep], score[keep]
                full = np.bincount(q, minlength=len(names)) == depth
                least[full] = np.minimum.reduceat(score, np.searchsorted(q, np.flatnonzero(full))) if full.any() else least[full]
            yield pd.DataFrame({"query_id": pd.Series([names[i] for i in q], dtype=object), "item_id": pd.Series(item, dtype=object), "score": score})

        part = items.filter(F.col("vector").isNotNull()).select("item_id", "vector").mapInPandas(best, schema)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = items.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)
