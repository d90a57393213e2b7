"""From files to chunks and back: candidate paths, caps, chunks of a file, texts and views of files, manifests and their validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.functions.paths import is_generated, suffix
from loreline.functions.text import stable_id, truncate
from loreline.operators.corpus import lines, symbols
from loreline.operators.running import ranked_within

SPACE = ["repo", "base_commit"]
# Suffixes of files that hold no text, and the caps of a snapshot.
SKIPPED_SUFFIXES = ".7z .avif .bin .bmp .bz2 .class .dll .dylib .eot .exe .gif .gz .ico .jar .jpeg .jpg .mp4 .o .otf .pdf .png .pyc .so .svg .tar .tgz .ttf .wasm .webp .woff .woff2 .zip".split()
FILE_BYTES, CHUNK_CHARS, SNAPSHOT_FILES = 400_000, 8_000, 20_000


def is_candidate_path(path: Column) -> Column:
    """Whether a file is to be cut into chunks: neither generated nor without text by its suffix."""
    return ~is_generated(path) & ~F.lower(suffix(path)).isin(SKIPPED_SUFFIXES)


def capped(files: DataFrame, most_bytes: int = FILE_BYTES, most_files: int = SNAPSHOT_FILES) -> tuple[DataFrame, DataFrame]:
    """(files within the caps, (repo, base_commit, skipped_large)): candidates of at most most_bytes, the first most_files of a snapshot by path.

    Files are counted over ranges of their order, so that a snapshot of any size is ordered in parts.
    """
    candidates = files.filter(is_candidate_path(F.col("path")))
    large = F.octet_length(F.coalesce("text", F.lit(""))) > most_bytes
    skipped = candidates.groupBy(*SPACE).agg(F.count_if(large).alias("skipped_large"))
    kept = ranked_within(candidates.filter(~large), SPACE, ["path"], "_i").filter(F.col("_i") <= most_files).drop("_i", "_i_of")
    return kept, skipped


def file_chunks(files: DataFrame, most_chars: int = CHUNK_CHARS) -> DataFrame:
    """(chunk_id, repo, base_commit, path, kind, symbol, start_line, end_line, text): one chunk a file, from its first to its last line, and one a symbol, each shortened to most_chars.

    files has (repo, base_commit, path, text), one row a path; null texts are empty ones. All of a file is made within its row.
    """
    whole = files.select(*SPACE, "path", F.coalesce("text", F.lit("")).alias("text"))
    ls = lines(F.col("text"))
    file = whole.select(*SPACE, "path", F.lit("file").alias("kind"), F.lit("").alias("symbol"), F.lit(1).alias("start_line"), F.size(ls).alias("end_line"), truncate(F.col("text"), most_chars).alias("text"))
    marked = symbols(whole.withColumn("_ls", ls))
    part = F.array_join(F.slice("_ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    symbol = marked.select(*SPACE, "path", F.lit("symbol").alias("kind"), "symbol", "start_line", "end_line", truncate(part, most_chars).alias("text"))
    both = file.unionByName(symbol)
    return both.select(stable_id(*[F.col(c) for c in (*SPACE, "path", "kind", "symbol", "start_line", "end_line")]).alias("chunk_id"), "*")


def file_texts(chunks: DataFrame) -> DataFrame:
    """(repo, base_commit, path, text): the text of a path's file chunk, or, where there is none, those of its symbols by line, one below the other."""
    rows = chunks.filter("path <> ''")
    per = rows.groupBy(*SPACE, "path").agg(F.max(F.when(F.col("kind") == "file", F.struct(F.coalesce("text", F.lit("")).alias("t")))).alias("f"), F.array_sort(F.collect_list(F.when(F.col("kind") != "file", F.struct("start_line", "chunk_id", F.coalesce("text", F.lit("")).alias("t"))))).alias("s"))
    return per.select(*SPACE, "path", F.coalesce("f.t", F.array_join(F.transform("s", lambda x: x["t"]), "\n")).alias("text"))


def file_views(chunks: DataFrame) -> DataFrame:
    """(repo, base_commit, path, start_line, end_line, chunks, text): what a path's chunks span, their texts joined by line."""
    rows = chunks.filter("path <> ''").groupBy(*SPACE, "path").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.count(F.lit(1)).alias("chunks"), F.array_sort(F.collect_list(F.struct("start_line", "end_line", "chunk_id", F.coalesce("text", F.lit("")).alias("t")))).alias("s"))
    return rows.select(*SPACE, "path", "start_line", "end_line", "chunks", F.array_join(F.transform("s", lambda x: x["t"]), "\n").alias("text"))


def usable_snapshots(manifest: DataFrame) -> DataFrame:
    """(repo, base_commit, strict, lenient): whether some row of a snapshot is ok and names its chunks, and whether some row is ok or without status."""
    named = F.coalesce("chunks_path", F.lit("")) != ""
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    return manifest.dropna(subset=SPACE).groupBy(*SPACE).agg(F.bool_or(ok & named).alias("strict"), F.bool_or(ok | F.col("status").isNull()).alias("lenient"))


def resume_check(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(repo, base_commit, state): whether a snapshot's chunks can be kept: 'valid' if there are as many as its youngest ok row says, else 'absent' or 'other_count'."""
    have = chunks.groupBy(*SPACE).agg(F.count(F.lit(1)).alias("n"))
    said = manifest.filter("status = 'ok'").dropna(subset=SPACE).groupBy(*SPACE).agg(F.max(F.struct("generated_at", "chunk_count")).alias("m"))
    state = F.when(F.col("n").isNull(), "absent").when(F.col("n").eqNullSafe(F.col("m.chunk_count")), "valid").otherwise("other_count")
    return said.join(have, SPACE, "left").select(*SPACE, state.alias("state"))


def span_errors(samples: DataFrame, bounds: DataFrame) -> DataFrame:
    """(sample_id, kind, path, error): spans and hard negatives that contradict the gold files or the corpus.

    bounds has (repo, base_commit, path, last_line); where a snapshot has none, nothing is held against it but that.
    samples has gold_files, gold_spans and hard_negatives.
    """
    spans = samples.select("sample_id", *SPACE, "gold_files", F.explode("gold_spans").alias("s")).select("sample_id", *SPACE, "gold_files", F.lit("span").alias("kind"), F.col("s.path").alias("path"), F.col("s.start_line").alias("a"), F.col("s.end_line").alias("b"))
    negatives = samples.select("sample_id", *SPACE, "gold_files", F.lit("negative").alias("kind"), F.explode("hard_negatives").alias("path"), F.lit(1).alias("a"), F.lit(1).alias("b"))
    rows = spans.unionByName(negatives).join(bounds, [*SPACE, "path"], "left").join(bounds.select(*SPACE).distinct().withColumn("_known", F.lit(True)), SPACE, "left")
    gold = F.array_contains("gold_files", F.col("path"))
    is_span = F.col("kind") == "span"
    rule = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    errors = F.array_compact(F.array(rule(is_span & ~gold, "not_gold"), rule(~is_span & gold, "is_gold"), rule(is_span & ((F.col("a") <= 0) | (F.col("b") < F.col("a"))), "bad_range"), rule(F.col("_known").isNull(), "no_corpus"), rule(F.col("_known") & F.col("last_line").isNull(), "not_in_corpus"), rule(is_span & (F.col("b") > F.col("last_line")), "beyond_end")))
    return rows.select("sample_id", "kind", "path", F.explode(errors).alias("error"))


def repeated(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows whose key an earlier row in the order has; the first of each key is fine. Null keys are one key."""
    return ranked_within(rows, key, [*order], "_i").filter("_i > 1").withColumnRenamed("_i", "occurrence").drop("_i_of")


def merge_annotations(samples: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples with the verdict of their annotation, annotations of unknown samples); of several the greatest verdict counts."""
    one = annotations.groupBy("sample_id").agg(F.max("verdict").alias("verdict"), F.count(F.lit(1)).alias("annotations"))
    unknown = one.join(samples.select("sample_id"), "sample_id", "left_anti").select("sample_id")
    return samples.join(one, "sample_id", "left").withColumn("annotations", F.coalesce("annotations", F.lit(0))), unknown
