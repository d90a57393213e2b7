from collections import Counter
from datetime import datetime

from loreline.operators.references import orphan_references, same_file

T = lambda d: datetime(2024, 1, d)
SAMPLES = "id string, version int, repo string, base_commit string, created_at timestamp, gold struct<root_cause_files:array<string>,supporting_files:array<string>>, query_text string"
MANIFEST = "repo string, base_commit string, base_ref string, committed_at timestamp, status string, generated_at timestamp"
CHUNKS = "repo string, base_commit string, path string, kind string, ingested_at timestamp, text string"


def orphans(spark, samples, manifest, chunks, **kw):
    s = spark.createDataFrame([(i, v, "r", c, at, g, "q") for i, v, c, at, g in samples], SAMPLES)
    m = spark.createDataFrame([("r", *x) for x in manifest], MANIFEST)
    c = spark.createDataFrame([("r", a, p, k, d, None) for a, p, k, d in chunks], CHUNKS)
    found = orphan_references(s, m, c, **kw)
    rows = found.rows().collect()
    counted = Counter((r.table, r.month, r.ref_field, r.state) for r in rows)
    assert {(r.table, r.month, r.ref_field, r.state): r.orphans for r in found.counts().collect()} == counted
    return {(r.id, r.ref_field, r.ref_value, r.state) for r in rows}


MAN = [("a", "v", T(1), "ok", T(1)), ("b", "v", T(2), "ok", T(9)), ("c", "v", T(3), "ok", T(1)), ("c", "v", T(3), "missing_commit", T(4))]


def test_states(spark):
    chunks = [("a", "old.py", "file", T(1)), ("a", "here.py", "file", T(1)), ("b", "here.py", "file", T(1)), ("b", "late.py", "file", T(8)), ("b", "late.py", "file", T(9)), ("b", "sym.py", "symbol", T(1))]
    samples = [
        ("1", 1, "b", T(5), (["./here.py", " here.py", "here.py", "gone.py", None, "", "  "], ["old.py", "late.py", "sym.py", "Here.py"])),
        ("2", 1, "zz", T(5), (["here.py"], None)),
        ("3", 1, "c", T(5), (["here.py"], [])),
        ("4", 1, None, T(5), (["here.py"], [])),
        ("5", 1, "zz", T(5), None), ("5", 2, "a", T(5), (["old.py"], None)), ("5", 2, "a", T(5), (["old.py"], None)),
        ("6", 1, "a", None, (["old.py"], None)),
    ]
    want = {
        ("1", "base_commit", "b", "late"), ("1", "root_cause_files", "gone.py", "missing"), ("1", "supporting_files", "old.py", "deleted"),
        ("1", "supporting_files", "late.py", "late"), ("1", "supporting_files", "sym.py", "missing"), ("1", "supporting_files", "Here.py", "missing"),
        ("2", "base_commit", "zz", "missing"), ("3", "base_commit", "c", "deleted"),
    }
    assert orphans(spark, samples, MAN, chunks) == want
    assert orphans(spark, samples, MAN, chunks, broadcast_rows=0, heavy_share=0.2) == want


def test_empty_tables(spark):
    assert orphans(spark, [], [], []) == set()
    assert orphans(spark, [("1", 1, "b", T(5), (["x"], None))], [], []) == {("1", "base_commit", "b", "missing")}
    assert orphans(spark, [("1", 1, "b", T(9), (["x"], None))], MAN, []) == {("1", "root_cause_files", "x", "missing")}


def test_spellings(spark):
    same = [" a/b.py", "a//b.py", "./a/b.py", "a\\b.py", ".\\a\\\\b.py ", "a/./b.py", "././a/b.py", "\ta/b.py\n"]
    other = ["A/b.py", "../a/b.py", "a/b.py.", "a/.b.py"]
    df = spark.createDataFrame([(p,) for p in [*same, *other]], "p string")
    got = [r[0] for r in df.select(same_file(df.p)).collect()]
    assert got[: len(same)] == ["a/b.py"] * len(same) and "a/b.py" not in got[len(same) :]


def test_a_hot_commit_and_a_hot_file(spark):
    """A third of all references name one commit and one file: the broadcast part and the anti-join part give all orphans."""
    samples = [(f"h{i}", 1, "b", T(3 if i % 2 else 12), (["hot.py"], ["none.py"])) for i in range(60)] + [(f"c{i}", 1, f"x{i}", T(5), (["a"], None)) for i in range(60)]
    samples += [(f"n{i}", 1, "a", T(20), ([f"f{i}.py"], None)) for i in range(60)]
    chunks = [("b", "hot.py", "file", T(10)), *[("a", f"f{i}.py", "file", T(1)) for i in range(0, 60, 2)]]
    want = {(f"c{i}", "base_commit", f"x{i}", "missing") for i in range(60)} | {(f"n{i}", "root_cause_files", f"f{i}.py", "missing") for i in range(1, 60, 2)}
    want |= {(f"h{i}", "supporting_files", "none.py", "missing") for i in range(60)} | {(f"h{i}", "root_cause_files", "hot.py", "late") for i in range(1, 60, 2)} | {(f"h{i}", "base_commit", "b", "late") for i in range(1, 60, 2)}
    for kw in ({}, {"broadcast_rows": 0, "heavy_share": 0.1}, {"broadcast_rows": 1000, "heavy_share": 0.9}):
        assert orphans(spark, samples, MAN, chunks, **kw) == want


def test_lines_without_a_name_and_samples_without_a_repository(spark):
    m = [("a", None, T(1), "ok", T(1)), ("b", None, T(2), "ok", T(1))]
    assert orphans(spark, [("1", 1, "b", T(5), (["old.py", "b.py"], None))], m, [("a", "old.py", "file", T(1)), ("b", "b.py", "file", T(1))]) == {("1", "root_cause_files", "old.py", "missing")}
    s = spark.createDataFrame([("1", 1, None, "b", T(5), (["x"], None), "q")], SAMPLES)
    found = orphan_references(s, spark.createDataFrame([], MANIFEST), spark.createDataFrame([], CHUNKS))
    assert [(r.ref_field, r.state) for r in found.rows().collect()] == [("base_commit", "missing")] and [r.orphans for r in found.counts().collect()] == [1]
