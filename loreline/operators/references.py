"""References to records that do not exist, were deleted, or came late."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.operators.joins import BROADCAST_ROWS, HEAVY_SHARE, heavy_keys, lookup_join
from loreline.operators.snapshots import latest, snapshot_index
from loreline.session import cut


def same_file(path: Column) -> Column:
    """One spelling for all that name the same file: surrounding blanks, either slash, repeated slashes, leading or inner ./."""
    p = F.translate(F.regexp_replace(path, r"^\s+|\s+$", ""), "\\", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, "/+", "/"), r"/(\./)+", "/"), r"^(\./)+", "")


def per_key(refs: DataFrame, key: list[str], by: list[str], at: str) -> DataFrame:
    """(key, by, refs, earliest): the references to each key in each period, and the earliest of their times; kept in the shared folder."""
    return cut(refs.dropna(subset=key).groupBy(*key, *by).agg(F.count(F.lit(1)).alias("refs"), F.min(at).alias("earliest")))


def unresolved(counts: DataFrame, targets: DataFrame, key: list[str], since: str, *, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Those rows of counts whose key no target has that was there when the earliest of their references was made.

    counts are references per key and period, as per_key gives them; targets has one row a key and, in since, the time from
    which it is there. Keys that hold more than heavy_share of all references, at most 1 / heavy_share of them, are
    compared with a broadcast of just their targets; all other keys go through a shuffle anti-join; the union of both is whole.
    With an earliest that is null, or a target without a time, nothing can be told, and the row stays.
    """
    there = targets.select(*[F.col(k).alias(f"_t_{k}") for k in key], F.col(since).alias("_since"))
    met = F.col("_since") <= F.col("earliest")
    for k in key:
        met = met & (F.col(k) == F.col(f"_t_{k}"))
    heavy = heavy_keys(counts, key, weight="refs", heavy_share=heavy_share)
    if heavy is None:
        return counts.join(there, met, "left_anti")
    few = F.broadcast(heavy.drop("_pieces"))  # at most 1 / heavy_share rows
    light = counts.join(few, key, "left_anti").join(there, met, "left_anti")
    hot_targets = there.join(few, [F.col(f"_t_{k}") == few[k] for k in key], "left_semi")  # one row a heavy key at most
    hot = counts.join(few, key, "left_semi").join(F.broadcast(hot_targets), met, "left_anti")
    return light.unionByName(hot)


@dataclass
class Orphans:
    """What orphan references are counted and listed from: see orphan_references."""

    commit_keys: DataFrame
    commit_refs: DataFrame
    file_keys: DataFrame
    file_refs: DataFrame
    broadcast_rows: int
    heavy_share: float

    def rows(self) -> DataFrame:
        """(id, ref_field, ref_value, state, table, month), one row for each distinct reference of a sample that is orphaned."""
        return self._commits(self.commit_keys).unionByName(self._files(self.file_keys))

    def counts(self) -> DataFrame:
        """(table, month, ref_field, state, orphans): missing and deleted references as they were counted per key and month, late ones by their own times."""
        by = ["table", "month", "ref_field", "state"]
        sure = None
        for keys, name in ((self.commit_keys, "corpus_manifest"), (self.file_keys, "chunks")):
            part = keys.filter("state <> 'late'").groupBy(F.lit(name).alias("table"), "month", "ref_field", "state").agg(F.sum("refs").alias("orphans"))
            sure = part if sure is None else sure.unionByName(part)
        late = self._commits(self.commit_keys.filter("state = 'late'")).unionByName(self._files(self.file_keys.filter("state = 'late'")))
        return sure.unionByName(late.groupBy(*by).agg(F.count(F.lit(1)).alias("orphans"))).groupBy(*by).agg(F.sum("orphans").alias("orphans"))

    def _listed(self, refs: DataFrame, keys: DataFrame, key: list[str], table: str) -> DataFrame:
        # the month of a reference follows from its row, so a key's rows of several months are one lookup row, which may be broadcast or salted
        lookup = keys.groupBy(*key, "ref_field").agg(F.max("state").alias("state"), F.max("since").alias("since"))
        met = lookup_join(refs, lookup, [*key, "ref_field"], weights=refs, broadcast_rows=self.broadcast_rows, heavy_share=self.heavy_share)
        late = F.col("since") > F.col("created_at")
        return met.filter((F.col("state") != "late") | late).select("id", "ref_field", "ref_value", "state", F.lit(table).alias("table"), "month")

    def _commits(self, keys: DataFrame) -> DataFrame:
        return self._listed(self.commit_refs, keys, ["repo", "base_commit"], "corpus_manifest")

    def _files(self, keys: DataFrame) -> DataFrame:
        return self._listed(self.file_refs, keys, ["repo", "base_commit", "file"], "chunks")


def orphan_references(samples: DataFrame, manifest: DataFrame, chunks: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS, heavy_share: float = HEAVY_SHARE) -> Orphans:
    """References of the current samples that did not resolve when the sample was created, to be listed or counted.

    References are counted per key and month first. Only keys that no target resolves for all their references pass
    the anti-join (see unresolved), and only their references are looked at one by one.

    A base_commit is 'missing' without a manifest row, 'deleted' if the snapshot does not count, 'late' if its first 'ok'
    row is younger than the sample. Files are looked at only where the snapshot counts: 'missing' if neither it nor an
    earlier counting snapshot of its line has the path, 'deleted' if only an earlier one has, 'late' if its
    first row was ingested after the sample's creation. Null, empty and blank references, lists and items are none.
    Samples without an id are left out; with a null created_at nothing is late. Empty tables give no rows.
    """
    keep = ["repo", "base_commit", "created_at", "root_cause_files", "supporting_files"]
    flat = samples.filter(F.col("id").isNotNull()).select("id", "version", "repo", "base_commit", "created_at", F.col("gold.root_cause_files").alias("root_cause_files"), F.col("gold.supporting_files").alias("supporting_files"))
    month = F.date_trunc("month", "created_at").alias("month")
    current = latest(flat, ["id"], ["version"], keep).filter(F.coalesce(F.trim("base_commit"), F.lit("")) != "")
    commit_refs = cut(current.select("*", month, F.lit("base_commit").alias("ref_field"), F.col("base_commit").alias("ref_value")))
    snapshots = cut(snapshot_index(manifest))
    # a snapshot without base_ref is a line of its own
    counting = snapshots.filter("counts").withColumn("base_ref", F.coalesce("base_ref", F.concat(F.lit("\0"), "base_commit")))
    space = ["repo", "base_commit"]

    # a null repository names no snapshot, so such references are missing; they cannot be joined and are added as they are
    nameless = commit_refs.filter(F.col("repo").isNull()).groupBy(*space, "ref_field", "month").agg(F.count(F.lit(1)).alias("refs"), F.min("created_at").alias("earliest"))
    by_commit = per_key(commit_refs, space, ["ref_field", "month"], "created_at")
    doubtful = cut(unresolved(by_commit, counting, space, "first_ok", heavy_share=heavy_share))
    known = snapshots.select(*space, "counts", F.col("first_ok").alias("since")).join(doubtful.select(*space).distinct(), space, "left_semi")
    commit_state = F.when(F.col("counts").isNull(), "missing").when(~F.col("counts"), "deleted").otherwise("late")
    commit_keys = cut(doubtful.join(known, space, "left").select(*space, "ref_field", "month", "refs", "since", commit_state.alias("state")))
    if not nameless.isEmpty():
        commit_refs = commit_refs.withColumn("repo", F.coalesce("repo", F.lit("\0")))  # a key like others for the list
        commit_keys = commit_keys.unionByName(nameless.select(F.lit("\0").alias("repo"), "base_commit", "ref_field", "month", "refs", F.lit(None).cast(known.schema["since"].dataType).alias("since"), F.lit("missing").alias("state")))

    placed = lookup_join(commit_refs.drop("ref_field", "ref_value"), counting.select(*space, "base_ref", "committed_at"), space, weights=commit_refs, broadcast_rows=broadcast_rows, heavy_share=heavy_share)
    lists = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.col(f).alias("paths")) for f in ("root_cause_files", "supporting_files")])
    refs = placed.select("id", *space, "base_ref", "committed_at", "created_at", "month", F.explode(lists).alias("l")).select("*", F.col("l.ref_field").alias("ref_field"), F.explode("l.paths").alias("ref_value")).drop("l")
    refs = cut(refs.withColumn("file", same_file(F.col("ref_value"))).filter(F.col("file") != "").distinct())

    file = [*space, "file"]
    files = chunks.filter(F.col("kind") == "file").select(*space, same_file(F.col("path")).alias("file"), "ingested_at").groupBy(*file).agg(F.min("ingested_at").alias("since"))
    in_line = per_key(refs, file, ["base_ref", "committed_at", "ref_field", "month"], "created_at")
    unsure = cut(unresolved(in_line, files, file, "since", heavy_share=heavy_share))
    # of the files of all counting snapshots, those in whose line a doubtful key asks for them
    asked = unsure.select("repo", "base_ref", "file").distinct()
    lines = counting.select(*space, "base_ref", "committed_at").join(asked.select("repo", "base_ref").distinct(), ["repo", "base_ref"], "left_semi")
    of_line = lookup_join(files, lines, space, weights=chunks.select(*space), broadcast_rows=broadcast_rows, heavy_share=heavy_share)
    seen = cut(of_line.join(asked, ["repo", "base_ref", "file"], "left_semi"))
    own = seen.select(*file, "since", F.lit(True).alias("there"))
    before = seen.groupBy("repo", "base_ref", "file").agg(F.min("committed_at").alias("first_commit"))
    file_state = F.when(F.col("there"), "late").when(F.col("first_commit") < F.col("committed_at"), "deleted").otherwise("missing")
    file_keys = cut(unsure.join(own, file, "left").join(before, ["repo", "base_ref", "file"], "left").select(*file, "ref_field", "month", "refs", "since", file_state.alias("state")))
    return Orphans(commit_keys, commit_refs, file_keys, refs, broadcast_rows, heavy_share)
