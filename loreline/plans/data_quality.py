"""Queries on snapshots and references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.operators.references import Orphans, orphan_references
from loreline.operators.snapshots import file_changes
from loreline.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return file_changes(table(spark, folder, "chunks"), table(spark, folder, "corpus_manifest")).select("repo", "prev_commit", "base_commit", "path", "change")


def p1_change_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many files each pair of snapshots added, removed and changed."""
    return p1_found(spark, folder).groupBy("repo", "prev_commit", "base_commit").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "changed")])


def _orphans(spark: SparkSession, folder: str) -> Orphans:
    return orphan_references(*[table(spark, folder, t) for t in ("comment2context", "corpus_manifest", "chunks")])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).rows().select("id", "ref_field", "ref_value", "state")


def p3_orphan_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table they point to, month of the sample's creation, field and state."""
    return _orphans(spark, folder).counts().withColumnRenamed("table", "ref_table")


SNAPSHOTS_SQL = """
snapshots AS (
  SELECT repo, base_commit, arg_max(base_ref, generated_at) AS base_ref, arg_max(committed_at, generated_at) AS committed_at,
         arg_max(status, generated_at) = 'ok' AS counts, min(generated_at) FILTER (WHERE status = 'ok') AS first_ok
  FROM corpus_manifest GROUP BY repo, base_commit)"""

P1_SQL = f"""
WITH {SNAPSHOTS_SQL},
pairs AS (
  SELECT * FROM (SELECT repo, base_commit, lag(base_commit) OVER (PARTITION BY repo, base_ref ORDER BY committed_at, base_commit) AS prev_commit
                 FROM snapshots WHERE counts) WHERE prev_commit IS NOT NULL),
now AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1),
files AS (SELECT repo, base_commit, path, replace(text, chr(13) || chr(10), chr(10)) AS text FROM now WHERE kind = 'file'),
later AS (SELECT p.*, f.path, f.text FROM pairs p JOIN files f ON f.repo = p.repo AND f.base_commit = p.base_commit),
earlier AS (SELECT p.*, f.path, f.text FROM pairs p JOIN files f ON f.repo = p.repo AND f.base_commit = p.prev_commit),
found AS (
  SELECT coalesce(l.repo, e.repo) AS repo, coalesce(l.prev_commit, e.prev_commit) AS prev_commit, coalesce(l.base_commit, e.base_commit) AS base_commit,
         coalesce(l.path, e.path) AS path,
         CASE WHEN e.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'removed' WHEN l.text IS DISTINCT FROM e.text THEN 'changed' END AS change
  FROM later l FULL JOIN earlier e ON l.repo = e.repo AND l.prev_commit = e.prev_commit AND l.base_commit = e.base_commit AND l.path = e.path)
"""

CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\', '/'), '/+', '/', 'g'), '/(\./)+', '/', 'g'), '^(\./)+', '')"

P3_SQL = f"""
WITH {SNAPSHOTS_SQL},
samples AS (SELECT * FROM comment2context QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1),
placed AS (
  SELECT s.id, s.created_at, s.gold, s.base_commit, p.repo, p.base_ref, p.committed_at, p.repo IS NOT NULL AS known, p.counts, p.first_ok
  FROM samples s LEFT JOIN snapshots p ON p.repo = s.repo AND p.base_commit = s.base_commit WHERE trim(s.base_commit) <> ''),
refs AS (
  SELECT id, 'root_cause_files' AS ref_field, unnest(gold.root_cause_files) AS ref_value FROM placed WHERE counts
  UNION SELECT id, 'supporting_files', unnest(gold.supporting_files) FROM placed WHERE counts),
named AS (SELECT r.*, {CLEAN_SQL.format("ref_value")} AS file, a.* EXCLUDE (id, gold) FROM refs r JOIN placed a ON a.id = r.id),
files AS (SELECT repo, base_commit, {CLEAN_SQL.format("path")} AS file, min(ingested_at) AS ingested FROM chunks WHERE kind = 'file' GROUP BY 1, 2, 3),
before AS (SELECT s.repo, s.base_ref, f.file, min(s.committed_at) AS since FROM files f JOIN snapshots s ON s.repo = f.repo AND s.base_commit = f.base_commit WHERE s.counts GROUP BY 1, 2, 3),
states AS (
  SELECT id, 'base_commit' AS ref_field, base_commit AS ref_value, created_at, 'corpus_manifest' AS ref_table,
         CASE WHEN NOT known THEN 'missing' WHEN NOT counts THEN 'deleted' WHEN first_ok > created_at THEN 'late' END AS state
  FROM placed
  UNION ALL
  SELECT n.id, n.ref_field, n.ref_value, n.created_at, 'chunks',
         CASE WHEN f.ingested > n.created_at THEN 'late' WHEN f.file IS NOT NULL THEN NULL
              WHEN b.since < n.committed_at THEN 'deleted' ELSE 'missing' END
  FROM named n LEFT JOIN files f ON f.repo = n.repo AND f.base_commit = n.base_commit AND f.file = n.file
  LEFT JOIN before b ON b.repo = n.repo AND b.base_ref = n.base_ref AND b.file = n.file
  WHERE n.file <> '')
"""

QUERIES = {"p1_found": p1_found, "p1_change_counts": p1_change_counts, "p3_found": p3_found, "p3_orphan_counts": p3_orphan_counts}

ORACLE = {
    "p1_found": P1_SQL + "SELECT * FROM found WHERE change IS NOT NULL",
    "p1_change_counts": P1_SQL + "SELECT repo, prev_commit, base_commit, count(*) FILTER (WHERE change = 'added') AS added, count(*) FILTER (WHERE change = 'removed') AS removed, count(*) FILTER (WHERE change = 'changed') AS changed FROM found WHERE change IS NOT NULL GROUP BY 1, 2, 3",
    "p3_found": P3_SQL + "SELECT DISTINCT id, ref_field, ref_value, state FROM states WHERE state IS NOT NULL",
    "p3_orphan_counts": P3_SQL + "SELECT ref_table, date_trunc('month', created_at) AS month, ref_field, state, count(*) AS orphans FROM states WHERE state IS NOT NULL GROUP BY ALL",
}
