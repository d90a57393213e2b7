"""Full snapshots of tables: which ones count, how they follow each other, and what changed between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.operators.joins import BROADCAST_ROWS, HEAVY_SHARE, lookup_join
from loreline.operators.running import previous
from loreline.session import cut


def latest(df: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row with the greatest order of each key: key and keep columns.

    Partial aggregation runs before the shuffle, so a key that is repeated without end costs one row a task.
    Ties take the greatest keep values; a null order counts as the least; rows with a null key form one key.
    """
    top = F.max(F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in keep]).alias("_kept"))).alias("_top")
    return df.groupBy(*key).agg(top).select(*key, *[F.col(f"_top._kept.{c}").alias(c) for c in keep])


def snapshot_index(manifest: DataFrame) -> DataFrame:
    """One row a snapshot of a build manifest: (repo, base_commit, base_ref, committed_at, counts, first_ok).

    A snapshot counts if its row with the greatest generated_at has status 'ok'; among rows of one time the greatest
    status wins. first_ok is the earliest generated_at with status 'ok', null if there is none. Rows without repo or
    base_commit name no snapshot and are left out. An empty manifest gives no rows.
    """
    m = manifest.select("repo", "base_commit", "base_ref", "committed_at", "status", "generated_at").dropna(subset=["repo", "base_commit"])
    top = F.max(F.struct("generated_at", "status", "base_ref", "committed_at")).alias("_top")
    first_ok = F.min(F.when(F.col("status") == "ok", F.col("generated_at"))).alias("first_ok")
    return m.groupBy("repo", "base_commit").agg(top, first_ok).select("repo", "base_commit", F.col("_top.base_ref").alias("base_ref"), F.col("_top.committed_at").alias("committed_at"), F.coalesce(F.col("_top.status") == "ok", F.lit(False)).alias("counts"), "first_ok")


def consecutive(snapshots: DataFrame) -> DataFrame:
    """(repo, prev_commit, base_commit) of each counting snapshot that has one before it in its line, ordered by committed_at, then commit.

    A line may hold most of the snapshots; it is never ordered in one task.
    """
    placed = snapshots.filter("counts").select("repo", "base_ref", "committed_at", "base_commit")
    return previous(placed, ["repo", "base_ref"], ["committed_at", "base_commit"], "base_commit", "prev_commit").filter(F.col("prev_commit").isNotNull()).select("repo", "prev_commit", "base_commit")


def digest(c: Column) -> Column:
    """16 bytes that stand for a text; CRLF and LF are the same, null stays null."""
    return F.unhex(F.md5(F.replace(c, F.lit("\r\n"), F.lit("\n"))))


def snapshot_changes(rows: DataFrame, pairs: DataFrame, snapshot: list[str], prev: str, key: list[str], fields: list[str], *, weights: DataFrame | None = None, broadcast_rows: int = BROADCAST_ROWS, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """What was added, removed or changed between consecutive snapshots: pairs' columns, key, change, changed_fields.

    rows holds whole snapshots: snapshot columns, key columns and fields (values or digests of them). pairs holds, for
    each snapshot to be compared, the snapshot columns and, in prev, the last snapshot column's value of the one before.
    Every row is unpivoted into signed cells, + for the pair in which its snapshot is the later one and - for the pair
    in which it is the earlier one: one cell (key, field, value) a field and one marker of the key's presence. Cells
    are summed per pair, key, field and value with partial sums before the shuffle; what is the same on both sides
    cancels, so only changes move on. Then presence + is 'added', presence - is 'removed', and a key that is on both
    sides but has a value left is 'changed', with the fields that differ, sorted.

    Repeated rows within a snapshot count once. Null values equal only null; a null key is a key of its own. A snapshot
    without rows is empty, so all keys of the one before are 'removed'. Empty inputs give no rows. Other columns of
    rows are not looked at. weights, rows that name their snapshot as often as rows do, tells which
    snapshots hold so many rows that these are to be spread; where it is null, rows are cut and counted.
    """
    *space, commit = snapshot
    later = pairs.select(*space, F.col(commit).alias("_at"), F.col(commit).alias("_pair"), F.lit(1).cast("tinyint").alias("_sign"))
    earlier = pairs.select(*space, F.col(prev).alias("_at"), F.col(commit).alias("_pair"), F.lit(-1).cast("tinyint").alias("_sign"))
    roles = later.unionByName(earlier).groupBy(*space, "_at").agg(F.collect_list(F.struct("_pair", "_sign")).alias("_roles")).withColumnRenamed("_at", commit)
    given = rows.select(*snapshot, *key, *fields)
    cells = F.array(
        F.struct(F.lit(-1).cast("tinyint").alias("field"), F.lit(None).cast("binary").alias("value")),
        *[F.struct(F.lit(i).cast("tinyint").alias("field"), F.col(f).cast("binary").alias("value")) for i, f in enumerate(fields)],
    )
    unpivoted = lookup_join(given, roles, snapshot, weights=weights, broadcast_rows=broadcast_rows, heavy_share=heavy_share).select(*space, F.explode("_roles").alias("_role"), *key, cells.alias("_cells")).select(*space, F.col("_role._pair").alias("_pair"), F.col("_role._sign").alias("_sign"), *key, F.explode("_cells").alias("_cell")).select(*space, "_pair", *key, "_cell.field", "_cell.value", "_sign")
    side = lambda s: F.max(F.when(F.col("_sign") == s, F.lit(1)).otherwise(F.lit(0)))
    left_over = unpivoted.groupBy(*space, "_pair", *key, "field", "value").agg((side(1) - side(-1)).alias("_net")).filter("_net <> 0")
    per_key = left_over.groupBy(*space, "_pair", *key).agg(F.max(F.when(F.col("field") == -1, F.col("_net"))).alias("_presence"), F.array_sort(F.collect_set(F.when(F.col("field") >= 0, F.col("field")))).alias("_fields"))
    names = F.array(*[F.lit(f) for f in fields])
    change = F.when(F.col("_presence") == 1, "added").when(F.col("_presence") == -1, "removed").otherwise("changed")
    changed_fields = F.when(change == "changed", F.transform("_fields", lambda i: F.get(names, i)))
    changes = per_key.select(*space, F.col("_pair").alias(commit), *key, change.alias("change"), changed_fields.alias("changed_fields"))
    return lookup_join(changes, pairs, snapshot, broadcast_rows=broadcast_rows, heavy_share=heavy_share).select(*space, prev, commit, *key, "change", "changed_fields")


def file_changes(chunks: DataFrame, manifest: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(repo, prev_commit, base_commit, path, change, changed_fields) over the files of a corpus' consecutive counting snapshots.

    The current row of a chunk_id is the one with the greatest ingested_at; only those of kind 'file' are compared.
    Rows without chunk_id, repo, base_commit or path name no file and are left out.
    """
    pairs = cut(consecutive(snapshot_index(manifest)))
    narrow = chunks.dropna(subset=["chunk_id", "repo", "base_commit", "path"]).select("chunk_id", "repo", "base_commit", "path", (F.col("kind") == "file").alias("is_file"), "ingested_at", F.when(F.col("kind") == "file", digest(F.col("text"))).alias("text"))
    current = latest(narrow, ["chunk_id"], ["ingested_at"], ["repo", "base_commit", "path", "is_file", "text"]).filter("is_file")
    # how many rows a snapshot has is counted on the raw table, of which only the two columns are read
    return snapshot_changes(current, pairs, ["repo", "base_commit"], "prev_commit", ["path"], ["text"], weights=chunks.select("repo", "base_commit"), broadcast_rows=broadcast_rows, heavy_share=heavy_share)
