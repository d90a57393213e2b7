import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loreline.functions import text
from loreline.operators import analysis, chunking, derivation, evaluation, repomap, selective


def brute_body(body, limit=2200):
    kept, inside = [], False
    for line in body.replace("\r\n", "\n").split("\n"):
        bare = line.strip(" ")
        if bare.startswith(("```diff", "```suggestion")):
            inside = True
        elif inside:
            inside = not bare.startswith("```")
        elif bare.startswith("```") or not (bare.startswith(("diff --git", "index ", "--- ", "+++ ", "@@ ")) or line.startswith(("+", "-"))):
            kept.append(line)
    t = "\n".join(kept).strip()
    return t if len(t) <= limit else t[:limit].rstrip() + "\n...[truncated]"


def test_review_bodies(spark):
    rng = random.Random(4)
    parts = ["plain words", "```", "```diff", "```suggestion", "+ added", "- removed", "@@ -1 +1 @@", "  --- a/x", "", "index 12..34", "code = 1"]
    bodies = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(200)] + ["x" * 3000, "a\r\nb"]
    got = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", text.without_fences(F.col("b")).alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: brute_body(b) for i, b in enumerate(bodies)}
    assert spark.createDataFrame([(None,)], "b string").select(text.without_fences(F.col("b"))).first()[0] == ""


def test_folds_keep_repositories_and_need_both_classes():
    rng = random.Random(2)
    counts = {f"r{i}": Counter(positive=rng.randrange(0, 20), no_gold=rng.randrange(0, 20)) for i in range(30)}
    folds = selective.assign_folds(counts, 5)
    held = [sum((counts[r] for r, k in folds.items() if k == f), Counter()) for f in range(5)]
    assert set(folds) == set(counts) and max(h["positive"] for h in held) - min(h["positive"] for h in held) <= 20
    with pytest.raises(ValueError, match="lack"):
        selective.assign_folds({"a": Counter(positive=5), "b": Counter(no_gold=5)}, 2)
    with pytest.raises(ValueError, match="cannot make"):
        selective.assign_folds({"a": Counter(positive=5)}, 2)


def test_unknown_rankers_are_refused():
    with pytest.raises(ValueError, match="unknown ranker"):
        evaluation.ranker("best")


def test_skip_reasons_in_their_order(spark):
    s = spark.createDataFrame([("1", "r", "a", [], "q", None), ("2", "r", "a", ["x"], "see abc1234", "abc1234"), ("3", "r", "zz", ["x"], "q", ""), ("4", "r", "b", ["x"], None, None), ("5", "r", "a", ["x"], "q", None), ("6", None, None, ["x"], "diff --git a/x b/x", None)], "sample_id string, repo string, base_commit string, gold_files array<string>, query_text string, fix_commit string")
    snaps = spark.createDataFrame([("r", "a", True), ("r", "b", True), ("r", "zz", False)], "repo string, base_commit string, counts boolean")
    sizes = spark.createDataFrame([("r", "a", 3)], "repo string, base_commit string, n long")
    got = {r.sample_id: r.skip for r in evaluation.skip_reasons(s, snaps, sizes).collect()}
    assert got == {"1": "no_gold", "2": "query_leakage", "3": "missing_corpus", "4": "empty_corpus", "5": None, "6": "query_leakage"}


def test_precision_of_fused_lists_divides_by_the_cut(spark):
    s = spark.createDataFrame([("1", "t", ["a", "z"])], "sample_id string, task_type string, gold_files array<string>")
    r = spark.createDataFrame([("1", "b", 1), ("1", "a", 2)], "sample_id string, path string, rank int")
    m = evaluation.fusion_metrics(r, s).first()
    assert (m.precision_5, m.recall_5, m.any_5, m.mrr) == (0.2, 0.5, 1.0, 0.5)


def test_chunks_of_a_file(spark):
    f = spark.createDataFrame([("r", "c", "a.py", "import x\ndef f():\n    return 1\nclass B:\n    pass\n"), ("r", "c", "e.py", None)], "repo string, base_commit string, path string, text string")
    got = sorted((r.path, r.kind, r.symbol, r.start_line, r.end_line, r.text) for r in chunking.file_chunks(f).collect())
    assert got == [("a.py", "file", "", 1, 5, "import x\ndef f():\n    return 1\nclass B:\n    pass"), ("a.py", "symbol", "B", 4, 5, "class B:\n    pass"), ("a.py", "symbol", "f", 2, 3, "def f():\n    return 1"), ("e.py", "file", "", 1, 0, "")]
    assert chunking.file_chunks(f.limit(0)).count() == 0


def test_affinity_by_task(spark):
    q = spark.createDataFrame([(s, "r", "c", p, p == "a.py") for s in ("1", "2", "3") for p in ("a.py", "b.py", "tests/test_a.py")], "sample_id string, repo string, base_commit string, path string, mentioned boolean")
    edges = spark.createDataFrame([("r", "c", "a.py", "b.py", 1.0), ("r", "c", "b.py", "a.py", 1.0)], "repo string, base_commit string, src string, dst string, weight double")
    s = spark.createDataFrame([("1", "comment2context", ["b.py"]), ("2", "code2test", []), ("3", "trace2code", [])], "sample_id string, task_type string, given_files array<string>")
    got = {(r.sample_id, r.path): round(r.affinity, 6) for r in repomap.affinity(q, edges, s).collect()}
    assert got == {("1", "a.py"): 1.2, ("1", "b.py"): 0.0, ("2", "a.py"): 0.4, ("2", "b.py"): 1.0, ("2", "tests/test_a.py"): 1.0, ("3", "a.py"): 0.9, ("3", "b.py"): 1.5, ("3", "tests/test_a.py"): -0.2}


def test_rank_correlation_against_brute_force(spark):
    rng = random.Random(6)
    rows = [("g", float(rng.randrange(8)), float(rng.randrange(8))) for _ in range(60)] + [("flat", 1.0, float(i)) for i in range(5)] + [("few", 1.0, 2.0), ("g", None, 1.0)]
    got = {r.k: (r.n, r.spearman) for r in analysis.rank_correlation(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", ["k"]).collect()}
    pairs = [(x, y) for k, x, y in rows if k == "g" and x is not None]
    ranks = lambda v: [sum(o > x for o in v) + (v.count(x) + 1) / 2 for x in v]
    a, b = ranks([x for x, _ in pairs]), ranks([y for _, y in pairs])
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    want = sum((x - ma) * (y - mb) for x, y in zip(a, b, strict=True)) / (sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b)) ** 0.5
    assert set(got) == {"g", "flat"} and got["flat"] == (5, 0.0) and got["g"][0] == 60 and abs(got["g"][1] - want) < 1e-9


def test_redaction_takes_the_longest_path_first(spark):
    r = spark.createDataFrame([("see src/a.py and src/a.pyx at abc", ["src/a.py", "src/a.pyx"], "abc")], "t string, p array<string>, c string")
    assert r.select(derivation.redact(F.col("t"), F.col("p"), F.col("c"))).first()[0] == "see [context_file] and [context_file] at [fix_commit]"


def test_traces_meet_files_by_their_endings(spark):
    t = spark.createDataFrame([("r", "/work/src/a.py"), ("r", "a.py"), ("r", "lib/a.py"), ("s", "/work/src/a.py")], "repo string, path string")
    f = spark.createDataFrame([("r", "src/a.py"), ("r", "x/lib/a.py"), ("r", "b.py")], "repo string, path string")
    assert {(r.path, r.file) for r in derivation.match_traces(t, f, ["repo"]).collect()} == {("/work/src/a.py", "src/a.py"), ("lib/a.py", "x/lib/a.py")}
