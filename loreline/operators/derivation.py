"""Deriving samples from changes: candidates of context, related files, trace matches, redaction, the sample itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.paths import basename, is_changed_source, is_changed_test
from loreline.functions.text import stable_id, tokenize
from loreline.operators.graph import GENERIC


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def telling_tokens(path: Column) -> Column:
    """The words of a path of at least three letters that say something."""
    return F.array_distinct(F.filter(tokenize(path), lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC)))


def redact(text: Column, paths: Column, commit: Column) -> Column:
    """A text with each of the paths, longest first, and the commit replaced by what they are."""
    ordered = F.array_sort(F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: p != ""), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    without = F.aggregate(ordered, text, lambda t, p: F.replace(t, p, F.lit("[context_file]")))
    return F.when(F.coalesce(commit, F.lit("")) != "", F.replace(without, commit, F.lit("[fix_commit]"))).otherwise(without)


def match_traces(traces: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """(traces' columns, file): files of the key that a traced path names: one ends in the other. Paths without a folder name none.

    Both meet by key and file name, then by the longer ending; no path is compared with those of other names.
    """
    t = traces.filter(F.col("path").contains("/")).withColumn("_name", basename(F.col("path")))
    f = files.select(*key, F.col("path").alias("file"), basename(F.col("path")).alias("_name")).distinct()
    met = t.join(f, [*key, "_name"])
    return met.filter(F.col("path").endswith(F.col("file")) | F.col("file").endswith(F.col("path"))).drop("_name")


def context_candidates(given: DataFrame, changed: DataFrame, most: int = 2) -> DataFrame:
    """(sample_id, path, place): of the files changed after a sample's snapshot those that may be its context, at most `most`.

    given has (sample_id, repo, base_commit, given); changed (repo, base_commit, path), files that the snapshot has and the next
    one changes. Tests go first for a source and sources for a test; files of other folders, if there are any, leave out those
    of the same.
    """
    p, g = F.col("path"), F.col("given")
    fits = is_changed_test(p) | is_changed_source(p)
    rows = given.join(changed, ["repo", "base_commit"]).filter((p != g) & fits)
    rows = rows.withColumn("_other", folder(p) != folder(g)).withColumn("_first", is_changed_test(p) != is_changed_test(g))
    of = Window.partitionBy("sample_id")  # the files of one change
    kept = rows.withColumn("_any", F.max("_other").over(of)).filter(~F.col("_any") | F.col("_other"))
    order = Window.partitionBy("sample_id").orderBy(F.desc("_first"), "path")
    return kept.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select("sample_id", "path", "place")


def evidence(path: Column, given: Column, body: Column) -> Column:
    """What speaks for a file being the context of another one: named in the body, sharing words or the module, testing it."""
    low = F.lower(F.coalesce(body, F.lit("")))
    shared = F.arrays_overlap(telling_tokens(basename(path)), telling_tokens(basename(given)))
    parts = lambda c: F.slice(F.split(c, "/"), 1, 2)
    module = (F.size(F.split(path, "/")) > 2) & (F.size(F.split(given, "/")) > 2) & (parts(path) == parts(given))
    rule = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    return F.array_compact(F.array(rule(low.contains(F.lower(path)), "path_in_body"), rule(low.contains(F.lower(basename(path))), "name_in_body"), rule(shared, "shared_words"), rule(module | shared, "same_module"), rule(is_changed_test(path) & ~is_changed_test(given) & shared, "tests_it")))


def related_changes(changes: DataFrame, key: list[str], least: int = 2, most: int = 8, most_related: int = 4) -> DataFrame:
    """(key, anchor, path, signals, place): files changed together and what relates them, at most most_related for each anchor.

    Only changes of least to most files are looked at, so a file meets at most most - 1 others. Signals: the same folder
    (sources only), shared words of the paths, a test with shared words. Files that are no tests go first, then more signals, then path.
    """
    files = changes.select(*key, "path").distinct()
    small = files.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n").between(least, most)).select(*key)
    rows = files.join(small, key, "left_semi").filter(is_changed_source(F.col("path")) | is_changed_test(F.col("path")))
    both = rows.withColumnRenamed("path", "anchor").join(rows, key).filter((F.col("anchor") != F.col("path")) & ~is_changed_test(F.col("anchor")))
    p, a = F.col("path"), F.col("anchor")
    test, shared = is_changed_test(p), F.arrays_overlap(telling_tokens(p), telling_tokens(a))
    signals = F.array_compact(F.array(F.when((folder(p) == folder(a)) & ~test, "same_component"), F.when(shared, "path_token_overlap"), F.when(test & shared, "optional_test_ripple")))
    told = both.withColumn("signals", signals).filter(F.size("signals") > 0)
    order = Window.partitionBy(*key, "anchor").orderBy(test.cast("int"), F.desc(F.size("signals")), "path")
    return told.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most_related).select(*key, "anchor", "path", "signals", "place")


def build_samples(rows: DataFrame, task_type: str, seed: list[str]) -> DataFrame:
    """(id, version, task_type, repo, base_commit, query_text, gold_files, fix_commit): samples made of rows with these columns but the first three.

    The id follows from the repository, the task and the seed columns; the query is redacted of the gold paths and the fixing commit.
    """
    i = stable_id(F.col("repo"), F.lit(task_type), *[F.col(c) for c in seed])
    return rows.select(i.alias("id"), F.lit(1).alias("version"), F.lit(task_type).alias("task_type"), "repo", "base_commit", redact(F.coalesce("query_text", F.lit("")), F.col("gold_files"), F.col("fix_commit")).alias("query_text"), "gold_files", "fix_commit")
