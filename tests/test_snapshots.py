from datetime import datetime

from loreline.operators.joins import lookup_join
from loreline.operators.running import previous, ranked_within
from loreline.operators.snapshots import consecutive, file_changes, snapshot_changes, snapshot_index

MANIFEST = "repo string, base_commit string, base_ref string, committed_at timestamp, status string, generated_at timestamp"
CHUNKS = "chunk_id string, repo string, base_commit string, path string, kind string, text string, ingested_at timestamp, extra int"
T = lambda d: datetime(2024, 1, d)


def manifest(spark, *rows):
    return spark.createDataFrame([("r", c, ref, T(day), status, T(gen)) for c, ref, day, status, gen in rows], MANIFEST)


def chunks(spark, *rows):
    return spark.createDataFrame([(f"{c}/{p}/{k}" if i is None else i, "r", c, p, k, t, T(d), 0) for i, c, p, k, t, d in rows], CHUNKS)


def changes(c, m):
    got = [{(r.prev_commit, r.base_commit, r.path, r.change) for r in file_changes(c, m, **kw).collect()} for kw in ({}, {"broadcast_rows": 0, "heavy_share": 0.2})]
    assert got[0] == got[1]
    return got[0]


def test_counts_by_youngest_row(spark):
    m = manifest(spark, ("a", "v", 1, "ok", 1), ("a", "v", 1, "missing_commit", 2), ("b", "v", 2, "missing_commit", 1), ("b", "v", 2, "ok", 2))
    got = {r.base_commit: (r.counts, r.first_ok) for r in snapshot_index(m).collect()}
    assert got == {"a": (False, T(1)), "b": (True, T(2))}


def test_pairs_pass_over_what_does_not_count(spark):
    m = manifest(spark, ("c", "v", 3, "ok", 1), ("a", "v", 1, "ok", 1), ("b", "v", 2, "missing_commit", 1), ("x", "w", 2, "ok", 1))
    assert [(r.prev_commit, r.base_commit) for r in consecutive(snapshot_index(m)).collect()] == [("a", "c")]


def test_changes(spark):
    m = manifest(spark, ("a", "v", 1, "ok", 1), ("b", "v", 2, "ok", 1))
    c = chunks(
        spark,
        (None, "a", "same", "file", "x\r\ny", 1), (None, "b", "same", "file", "x\ny", 1),
        (None, "a", "gone", "file", "x", 1), (None, "b", "new", "file", "", 1),
        (None, "a", "edit", "file", "x", 1), (None, "b", "edit", "file", "x ", 1),
        (None, "a", "null", "file", None, 1), (None, "b", "null", "file", None, 1),
        (None, "a", "null2", "file", None, 1), (None, "b", "null2", "file", "", 1),
        (None, "a", "sym", "symbol", "x", 1),
        ("k", "a", "late", "file", "old", 1), ("k", "a", "late", "file", "new", 2), ("k", "a", "late", "file", "new", 2), (None, "b", "late", "file", "new", 1),
    )
    assert changes(c, m) == {("a", "b", "gone", "removed"), ("a", "b", "new", "added"), ("a", "b", "edit", "changed"), ("a", "b", "null2", "changed")}


def test_an_empty_snapshot_removes_all(spark):
    m = manifest(spark, ("a", "v", 1, "ok", 1), ("b", "v", 2, "ok", 1))
    assert changes(chunks(spark, (None, "a", "p", "file", "x", 1)), m) == {("a", "b", "p", "removed")}


def test_empty_tables(spark):
    e, m = spark.createDataFrame([], CHUNKS), spark.createDataFrame([], MANIFEST)
    assert changes(e, m) == set()
    assert changes(e, manifest(spark, ("a", "v", 1, "ok", 1))) == set()


def test_fields_that_changed_and_null_keys(spark):
    rows = spark.createDataFrame([("s", 1, "k", "x", 1), ("s", 2, "k", "y", 1), ("s", 1, None, "x", 1), ("s", 2, None, "x", 2), ("s", 2, None, "x", 2)], "space string, snap int, key string, f string, g int")
    pairs = spark.createDataFrame([("s", 1, 2)], "space string, prev int, snap int")
    got = {(r.key, r.change, tuple(r.changed_fields)) for r in snapshot_changes(rows.withColumn("g", rows.g.cast("string")), pairs, ["space", "snap"], "prev", ["key"], ["f", "g"]).collect()}
    assert got == {("k", "changed", ("f",)), (None, "changed", ("g",))}


def test_lookup_join_is_whole_when_a_key_is_hot(spark):
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(k, k) for k in range(2, 100)] + [(None, 7), (5000, 8)], "k int, v int")
    lookup = spark.createDataFrame([(k, k * 10) for k in range(1, 200)], "k int, w int")
    for how, n in (("inner", 398), ("left", 400)):
        plain = sorted(rows.join(lookup, "k", how).collect(), key=str)
        assert len(plain) == n
        assert sorted(lookup_join(rows, lookup, ["k"], how, broadcast_rows=10, heavy_share=0.1).collect(), key=str) == plain
        assert sorted(lookup_join(rows, lookup, ["k"], how, broadcast_rows=10, heavy_share=0.9).collect(), key=str) == plain


def test_order_is_kept_over_parts(spark):
    """A group that holds most of the rows is split; looking back and counting go on over the borders."""
    rows = [("hot", i) for i in range(400)] + [(f"g{k}", i) for k in range(20) for i in range(3)] + [(None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(5)
    got = {(r.g, r.i): r.p for r in previous(df, ["g"], ["i"], "i", "p").collect()}
    have = set(rows)
    assert got == {(g, i): i - 1 if (g, i - 1) in have else None for g, i in rows}
    placed = {(r.g, r.i): (r.k, r.k_of) for r in ranked_within(df, ["g"], ["i"], "k").collect()}
    assert placed == {(g, i): (sum(1 for x, j in rows if x == g and j <= i), sum(1 for x, _ in rows if x == g)) for g, i in rows}
