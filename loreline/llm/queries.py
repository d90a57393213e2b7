"""Queries on text corpora. Where SQL cannot express an operator there is none; tests/llm holds what checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.llm import credentials, cutoff, mixing, not_handwritten, packing, pieces, tokens
from loreline.llm import near_duplicates as nd
from loreline.operators.joins import lookup_join
from loreline.sources.tables import table

#: p6: words in a run, least similarity and least words of a text.
P6 = {"width": 4, "similarity": 0.6, "least_words": 40}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    members, pairs = nd.near_duplicates(table(spark, folder, "documents"), **P6)
    return nd.document_pairs(members, pairs)


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return nd.groups(*nd.near_duplicates(table(spark, folder, "documents"), **P6))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.scan(table(spark, folder, "documents")).select("doc_id", F.explode("secrets").alias("secret")).distinct()


def p7_masked(spark: SparkSession, folder: str) -> DataFrame:
    """All texts, those with credentials masked."""
    scanned = credentials.scan(table(spark, folder, "documents"), all_rows=True)
    return scanned.select("doc_id", F.col("masked").alias("text"), (F.size("secrets") > 0).alias("was_masked"))


def p2_document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.estimate_tokens(table(spark, folder, "documents")).select("doc_id", "language", F.round("est_tokens", 3).alias("est_tokens"))


def repo_key(repo: Column) -> Column:
    """owner/name of a repository, however spelled: case, blanks, a URL's head, slashes around it and .git do not count."""
    bare = F.regexp_replace(F.lower(F.trim(repo)), r"^(?:[a-z][a-z0-9+.-]*://(?:[^/@]*@)?[^/]*/|[^/@:]+@[^/:]+:|(?:www\.)?(?:github|gitlab|bitbucket)\.(?:com|org)/)", "")
    return F.regexp_replace(F.regexp_replace(bare, "^/+|/+$", ""), r"(?:\.git)+$", "")


def p2_token_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and estimated tokens by source, by language, by the language of the repository, by domain, and of all."""
    repo = repo_key(F.col("repo"))
    docs = table(spark, folder, "documents").withColumn("_source", F.coalesce(tokens.same_spelling(F.col("source")), F.lit("unknown"))).withColumn("_repo", repo).withColumn("_kind", F.coalesce("kind", F.lit("unknown")))
    counted = tokens.estimate_tokens(docs, keep=["_source", "_repo", "_kind"])
    newest = table(spark, folder, "repo_manifest").withColumn("_repo", repo).groupBy("_repo").agg(F.max(F.struct("fetched_at", "language")).alias("m"))
    spelled = tokens.same_spelling(F.col("m.language"))
    manifest = newest.select("_repo", F.when(spelled == "js", "javascript").when(spelled == "ts", "typescript").when(spelled == "py", "python").when(spelled == "golang", "go").otherwise(spelled).alias("_repo_language"))
    joined = lookup_join(counted, manifest, ["_repo"], "left", weights=docs.select("_repo")).withColumn("_repo_language", F.coalesce("_repo_language", F.lit("unknown")))
    names = {"source": "_source", "language": "language", "repo_language": "_repo_language", "domain": "_kind"}
    # partial sums of the four columns first: their combinations are few, whatever the number of documents
    cells = joined.groupBy(*names.values()).agg(F.count("est_tokens").alias("n"), F.sum("est_tokens").alias("t"))
    slices = F.array(*[F.struct(F.lit(k).alias("slice"), F.col(c).alias("value")) for k, c in names.items()], F.struct(F.lit("all").alias("slice"), F.lit("all").alias("value")))
    return cells.select(F.explode(slices).alias("s"), "n", "t").groupBy("s.slice", "s.value").agg(F.sum("n").alias("documents"), F.round(F.sum("t"), 1).alias("est_tokens"))


#: p4: most characters of a piece and most characters shared by consecutive pieces.
P4 = {"limit": 8000, "overlap": 400}


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.cut_oversized(pieces.current_chunks(table(spark, folder, "chunks"), P4["limit"]), **P4)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pieces(spark, folder).groupBy("chunk_id").agg(F.max(F.when(F.col("cut") == "forced", 1).otherwise(0)).alias("f")).select("chunk_id", F.when(F.col("f") == 1, "forced").otherwise("natural").alias("cut"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return not_handwritten.classify(table(spark, folder, "documents")).filter("foreign").select("doc_id").distinct()


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How many containers there are and how full they are."""
    fill = p8_containers(spark, folder).filter(F.col("container").isNotNull()).groupBy("container").agg(F.sum("tokens").alias("t"))
    return fill.agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count(F.lit(1)) * 2048)).alias("filled"))


def p9_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, folder), table(spark, folder, "mix_targets"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return cutoff.cut_off(table(spark, folder, "documents")).filter("cut").select("doc_id").distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return cutoff.cut_rates(cutoff.cut_off(table(spark, folder, "documents")))


_ALL = [p2_document_tokens, p2_token_totals, p4_found, p4_pieces, p5_found, p6_found, p6_groups, p7_found, p7_masked, p8_containers, p8_fill, p9_mixture, p9_shares, p10_found, p10_rates]
QUERIES = {f.__name__: f for f in _ALL}
ORACLE: dict[str, str] = {
    "p4_found": "WITH now AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1) SELECT chunk_id, CASE WHEN list_max(list_transform(string_split(text, chr(10)), lambda x: length(x))) > 8000 THEN 'forced' ELSE 'natural' END AS cut FROM now WHERE length(text) > 8000",
}
