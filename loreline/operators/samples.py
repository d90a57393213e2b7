"""Samples, their gold files, and the chunks of their snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.functions.text import distinct_paths, stable_id
from loreline.operators.snapshots import latest
from loreline.session import cut


def gold_files() -> Column:
    """The files a ranking should find: none for no_gold, then explicit files, context files, root causes, related tests."""
    files = distinct_paths(F.col("gold.files"))
    context = distinct_paths(F.transform("gold.must_context_files", lambda x: x["path"]))
    roots, tests = distinct_paths(F.col("gold.root_cause_files")), distinct_paths(F.col("gold.related_tests"))
    none = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(F.col("gold.no_gold"), F.lit(False)), none)
        .when(F.size(files) > 0, files)
        .when(F.col("task_type") == "code2test", tests)
        .when((F.col("task_type") == "comment2context") & (F.size(context) > 0), context)
        .when(F.size(roots) > 0, roots)
        .otherwise(tests)
    )


def _context() -> Column:
    return F.transform("gold.must_context_files", lambda x: x["path"])


def _joined(*lists: Column) -> Column:
    empty = F.array().cast("array<string>")
    return distinct_paths(F.concat(*[F.coalesce(x, empty) for x in lists]))


def gold_files_audited() -> Column:
    """The gold files as an audit counts them: like gold_files, but root causes and related tests together."""
    files, context = distinct_paths(F.col("gold.files")), distinct_paths(_context())
    none = F.array().cast("array<string>")
    return (
        F.when(F.coalesce("gold.no_gold", F.lit(False)), none)
        .when(F.size(files) > 0, files)
        .when(F.col("task_type") == "code2test", distinct_paths(F.col("gold.related_tests")))
        .when((F.col("task_type") == "comment2context") & (F.size(context) > 0), context)
        .otherwise(_joined(F.col("gold.root_cause_files"), F.col("gold.related_tests")))
    )


def gold_files_related() -> Column:
    """The gold files as a taxonomy of relevance counts them: those of spans first, then explicit ones, then those that fit the task."""
    task = F.coalesce("task_type", F.lit(""))
    roots, supporting, tests = (F.col(f"gold.{c}") for c in ("root_cause_files", "supporting_files", "related_tests"))
    none = F.array().cast("array<string>")
    of_task = F.when(task == "code2test", _joined(tests)).when(task == "trace2code", _joined(roots)).when(task == "comment2context", _joined(roots, supporting)).otherwise(_joined(tests, roots, supporting))
    context = F.when(task.isin("comment2context", ""), _joined(_context())).otherwise(none)
    return F.when(F.coalesce("gold.no_gold", F.lit(False)), none).otherwise(_joined(F.transform("gold_spans", lambda s: s["path"]), F.col("gold.files"), of_task, context))


def given_files() -> Column:
    """The files a query starts from: the listed ones, or, for a review comment, the file it stands on."""
    listed = distinct_paths(F.col("gold.given_files"))
    standing = F.coalesce(F.nullif(F.col("query.given_file"), F.lit("")), F.col("query.path"))
    return F.when(F.size(listed) > 0, listed).when(F.col("task_type") == "comment2context", distinct_paths(F.array(standing))).otherwise(listed)


def provenance() -> Column:
    """Where a query comes from: as said, else by its task."""
    task = F.col("task_type")
    by_task = F.when(task == "code2test", "pr_summary").when(task == "comment2context", "review_comment").when(task.isin("trace2code", "testlog2code"), "failure_trace")
    return F.coalesce(F.nullif(F.col("query_provenance"), F.lit("")), by_task)


def gold_blocks() -> Column:
    """Blocks with a path and a valid range; kind, symbol and reason are never null."""
    fine = F.filter(F.coalesce("gold_blocks", F.expr("array()")), lambda b: F.coalesce((b["path"] != "") & (b["start_line"] > 0) & (b["end_line"] >= b["start_line"]), F.lit(False)))
    filled = lambda b: F.struct(b["path"].alias("path"), b["start_line"].alias("start_line"), b["end_line"].alias("end_line"), F.coalesce(F.nullif(b["kind"], F.lit("")), F.lit("block")).alias("kind"), F.coalesce(b["symbol"], F.lit("")).alias("symbol"), F.coalesce(b["reason"], F.lit("")).alias("reason"))
    return F.transform(fine, filled)


def query_json(fields: list[str], lists: list[str]) -> Column:
    """A query as a JSON object with sorted keys and a blank after each comma and colon; null fields are absent.

    fields are strings or numbers of the query struct, lists its lists of strings.
    """
    quoted = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'^\{"v":(.*)\}$', 1)
    parts = []
    for name in sorted([*fields, *lists]):
        c = F.col(f"query.{name}")
        value = quoted(c) if name in fields else F.concat(F.lit("["), F.array_join(F.transform(F.filter(c, lambda x: x.isNotNull()), quoted), ", "), F.lit("]"))
        parts.append(F.when(c.isNotNull(), F.concat(F.lit(f'"{name}": '), value)))
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("}"))


def synthetic_chunks(samples: DataFrame) -> DataFrame:
    """(chunk_id, sample_id, path, text): one chunk for each path a sample mentions, with the parts of the path as its text, to try a run without a corpus.

    samples are rows of the table of samples, one an id.
    """
    paths = _joined(*[F.col(f"gold.{c}") for c in ("root_cause_files", "related_tests", "supporting_files", "negative_distractors")], _context(), F.col("gold.given_files"), F.col("hard_negative_files"))
    rows = samples.select(F.col("id").alias("sample_id"), "repo", "base_commit", F.explode(paths).alias("path"))
    return rows.select(stable_id(F.col("repo"), F.col("base_commit"), F.col("path"), F.lit("dry_run")).alias("chunk_id"), "sample_id", "path", F.replace("path", F.lit("/"), F.lit(" ")).alias("text"))


def current_samples(table: DataFrame) -> DataFrame:
    """The highest version of each sample with its targets: gold, supporting and hard negative files, gold spans."""
    spans = F.filter(F.coalesce("gold_spans", F.array().cast("array<struct<path:string,start_line:int,end_line:int,reason:string>>")), lambda s: s["path"].isNotNull() & (s["path"] != "") & s["start_line"].isNotNull() & s["end_line"].isNotNull())
    flat = table.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("sample_id"),
        "version",
        F.coalesce("task_type", F.lit("unknown")).alias("task_type"),
        "repo",
        "base_commit",
        "query_text",
        gold_files().alias("gold_files"),
        distinct_paths(F.col("gold.supporting_files")).alias("supporting_files"),
        distinct_paths(F.col("hard_negative_files")).alias("hard_negatives"),
        spans.alias("gold_spans"),
        F.coalesce("query_provenance", F.lit("native")).alias("provenance"),
        "created_at",
    )
    keep = [c for c in flat.columns if c not in ("sample_id", "version")]
    return latest(flat, ["sample_id"], ["version"], keep)


def current_chunks(chunks: DataFrame) -> DataFrame:
    """The current row of each chunk_id."""
    return latest(chunks.filter(F.col("chunk_id").isNotNull()), ["chunk_id"], ["ingested_at"], ["repo", "base_commit", "path", "kind", "symbol", "start_line", "end_line", "text"])


def snapshot_chunks(chunks: DataFrame, samples: DataFrame) -> DataFrame:
    """Current chunks of those snapshots that a sample refers to, kept in the shared folder: rankers read them several times."""
    wanted = samples.select("repo", "base_commit").dropna().distinct()
    return cut(current_chunks(chunks.join(wanted, ["repo", "base_commit"], "left_semi")))
