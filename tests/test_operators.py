import math
import random
from collections import Counter

from pyspark.sql import functions as F

from loreline.functions import paths, text
from loreline.operators import analysis, corpus, curation, graph, metrics, mining, rank, reports, selective, trajectories
from loreline.operators.running import running_totals


def test_tokens(spark):
    df = spark.createDataFrame([("alpha beta\ngamma",), ("### gold.py\n",), ("",), ("getHTTPPath x_1",)], "t string")
    got = df.select(text.count_budget_tokens(F.col("t")), text.tokenize(F.col("t"))).collect()
    assert [r[0] for r in got] == [3, 6, 0, 2]
    assert got[3][1] == ["get", "httppath", "x", "1"]


def test_paths(spark):
    df = spark.createDataFrame([("src/a.py",), ("docs/a.py",), ("tests/a_test.go",), ("a/README.md",), ("vendor/x.js",), ("yarn.lock",), ("",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in df.select(paths.is_code_path(p), paths.is_test_path(p), paths.is_generated(p), paths.change_role(p)).collect()]
    assert got == [(True, False, False, "source"), (False, False, False, "source"), (True, True, False, "test"), (False, False, False, "other"), (False, False, True, "generated"), (False, False, True, "generated"), (False, False, False, "other")]


def _rank(spark, query, chunks):
    s = spark.createDataFrame([("s", "t", "r", "c", query, ["b.py"], [], [])], "sample_id string, task_type string, repo string, base_commit string, query_text string, gold_files array<string>, hard_negatives array<string>, gold_spans array<struct<path:string,start_line:int,end_line:int>>")
    c = spark.createDataFrame([("r", "c", str(i), p, "file", None, 1, 9, t) for i, (p, t) in enumerate(chunks)], "repo string, base_commit string, chunk_id string, path string, kind string, symbol string, start_line int, end_line int, text string")
    return s, c


def test_rankers_keep_zero_scores(spark):
    s, c = _rank(spark, "apple pear", [("a.py", "none"), ("b.py", "apple apple apple"), ("c.py", "apple banana kiwi")])
    for f in (rank.lexical, rank.bm25):
        got = f(s, c).orderBy("rank").collect()
        assert [r.path for r in got] == ["b.py", "c.py", "a.py"] and got[-1].score == 0
    assert [r.score for r in rank.lexical(*_rank(spark, "?!", [("a.py", "x")])).collect()] == [0.0]


def test_bm25_against_formula(spark):
    docs = [("a.py", "x y z"), ("b.py", "x x q"), ("c.py", "q w e r t")]
    s, c = _rank(spark, "x q x", docs)
    toks = [f"{p} file {t}".replace(".", " ").split() for p, t in docs]
    mean = sum(map(len, toks)) / 3
    for r in rank.bm25(s, c).collect():
        d = toks[int(r.chunk_id)]
        want = 0.0
        for q, n in Counter("x q x".split()).items():
            df, tf = sum(q in t for t in toks), d.count(q)
            if tf:
                want += n * math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(d) / mean))
        assert abs(r.score - want) < 1e-9


def test_fusion(spark):
    a = spark.createDataFrame([("s", "x", 1), ("s", "gold", 2), ("t", "x", 1)], "sample_id string, path string, rank int")
    b = spark.createDataFrame([("s", "gold", 1), ("s", "y", 2)], "sample_id string, path string, rank int")
    got = rank.fuse({"a": a, "b": b}).orderBy("sample_id", "rank").collect()
    assert got[0].path == "gold" and {r.sample_id for r in got} == {"s"}


def test_budget_takes_the_first_chunk_whatever_its_size(spark):
    r = spark.createDataFrame([("s", i, n) for i, n in enumerate([0, 9000, 10, 5], 1)] + [("t", i, n) for i, n in enumerate([3000, 4000, 2000, 100], 1)], "sample_id string, rank int, chars int")
    got = {k: sorted(x.rank for x in metrics.within_budget(r).filter(F.col("sample_id") == k).collect()) for k in "st"}
    assert got == {"s": [1, 2], "t": [1, 2]}


def test_intervals_against_sets(spark):
    rng = random.Random(4)
    rows = [(k, a, a + rng.randrange(6)) for k in "abc" for a in (rng.randrange(1, 40) for _ in range(12))] + [("a", 0, 5), ("b", 9, 3)]
    got = metrics.merged_intervals(spark.createDataFrame(rows, "k string, start_line int, end_line int"), ["k"]).collect()
    for k in "abc":
        want = {x for q, a, b in rows if q == k and 0 < a <= b for x in range(a, b + 1)}
        parts = sorted((r.start_line, r.end_line) for r in got if r.k == k)
        assert {x for a, b in parts for x in range(a, b + 1)} == want
        assert all(b + 1 < c for (_, b), (c, _) in zip(parts, parts[1:], strict=False))


def test_running_totals(spark):
    rows = [(i, (i * 7) % 11) for i in range(200)]
    random.Random(1).shuffle(rows)
    got = {r.i: r.cum_v for r in running_totals(spark.createDataFrame(rows, "i int, v int"), ["i"], ["v"]).collect()}
    total = 0
    for i, v in sorted(rows):
        total += v
        assert got[i] == total


def test_sweep_against_counting(spark):
    rng = random.Random(2)
    rows = [(str(i), f"r{i % 7}", rng.choice(["positive", "no_gold"]), float(rng.randrange(12)), rng.choice([0.0, 0.5, 1.0])) for i in range(80)]
    df = spark.createDataFrame(rows, "sample_id string, repo string, label string, confidence double, recall_20 double")
    sweep = selective.threshold_sweep(df).collect()
    assert len(sweep) == len({r[3] for r in rows}) + 1
    for t in sweep:
        tp = [r for r in rows if r[2] == "positive"]
        kept = [r for r in tp if r[3] >= t.threshold]
        away = [r for r in rows if r[2] == "no_gold" and r[3] < t.threshold]
        tn = len(rows) - len(tp)
        assert abs(t.positive_pass_rate - len(kept) / len(tp)) < 1e-12 and abs(t.no_gold_abstain_rate - len(away) / tn) < 1e-12
        assert abs(t.selective_success_20 - (len(away) + sum(r[4] > 0 for r in kept)) / len(rows)) < 1e-12
    assert {r.fold for r in selective.cross_validate(df, 3).collect()} == {0, 1, 2}
    assert selective.threshold_sweep(df.limit(0)).count() == 0


def test_folds_keep_both_classes():
    counts = {f"r{i}": Counter(positive=i % 3 + 1, no_gold=1) for i in range(9)}
    folds = selective.assign_folds(counts, 3)
    assert set(folds.values()) == {0, 1, 2} and set(folds) == set(counts)


def test_symbols(spark):
    f = spark.createDataFrame([("p", "import x\r\ndef a(y):\n  pass\nclass B:\n  def c(self):\n    pass\n"), ("q", None), ("r", "")], "path string, text string")
    assert [(r.symbol, r.start_line, r.end_line) for r in corpus.symbols(f).orderBy("start_line").collect()] == [("a", 2, 3), ("B", 4, 4), ("c", 5, 6)]


def test_graph(spark):
    files = spark.createDataFrame([("r", "c", "src/app/util.py", "import os\n"), ("r", "c", "src/app/main.py", "from .util import run\n"), ("r", "c", "tests/test_util.py", "from src.app.util import run\n"), ("r", "d", "x/main.py", "import util\n")], "repo string, base_commit string, path string, text string")
    assert {(e.src, e.dst) for e in graph.import_edges(files).collect()} == {("src/app/main.py", "src/app/util.py"), ("tests/test_util.py", "src/app/util.py")}
    assert {(e.src, e.dst) for e in graph.test_edges(files).collect()} == {("src/app/util.py", "tests/test_util.py")}


def test_imports_by_relative_path_and_suffix(spark):
    texts = {
        "a/util.py": "", "b/util.py": "", "b/c/__init__.py": "", "b/c/deep.py": "from . import x\nfrom ..util import y\n", "web/lib/index.ts": "", "web/lib/one.ts": "import { t } from './two.js'; const l = require('.')\n", "web/lib/two.ts": "", "web/main.ts": "import { l } from './lib'\nimport { m } from '../web/lib/one'\n",
        "m.rs": "use crate::b::c::deep\n// use a::util\n", "z.py": "import b.util, os\nimport b.util\n", **{f"p{i}/shared.py": "" for i in range(10)}, "q.py": "from p9.shared import x\nimport shared\n",
    }
    files = spark.createDataFrame([("r", "c", k, v) for k, v in texts.items()], "repo string, base_commit string, path string, text string")
    got = {(e.src, e.dst): e.n for e in graph.import_links(files).collect()}
    want = {("b/c/deep.py", "b/c/__init__.py"): 1, ("b/c/deep.py", "b/util.py"): 1, ("web/lib/one.ts", "web/lib/two.ts"): 1, ("web/lib/one.ts", "web/lib/index.ts"): 1, ("web/main.ts", "web/lib/index.ts"): 1, ("web/main.ts", "web/lib/one.ts"): 1, ("m.rs", "b/c/deep.py"): 1, ("z.py", "b/util.py"): 2, ("q.py", "p9/shared.py"): 1, **{("q.py", f"p{i}/shared.py"): 1 for i in range(8)}}
    assert got == want


def test_symbol_edges(spark):
    texts = {"src/a.py": "def flushCache(): pass", "src/b.py": "cache = 1; flush(cache)", "src/c.py": "cache only", "tests/test_d.py": "reconnecting()", "src/e.py": "class Reconnecting: pass", "docs/f.md": "flush the cache", "src/g.py": "short"}
    files = spark.createDataFrame([("r", "c", k, v) for k, v in texts.items()], "repo string, base_commit string, path string, text string")
    chunks = spark.createDataFrame([("r", "c", "src/a.py", "flushCache"), ("r", "c", "src/e.py", "Reconnecting"), ("r", "c", "src/c.py", "Short"), ("r", "c", "src/c.py", "get"), ("r", "c", "docs/f.md", "cacheOnly"), ("r", "c", "src/c.py", None), *[("r", "c", f"src/n{i}.py", "everyWhere") for i in range(9)]], "repo string, base_commit string, path string, symbol string")
    assert {(e.src, e.dst) for e in graph.symbol_edges(files, chunks).collect()} == {("src/b.py", "src/a.py"), ("tests/test_d.py", "src/e.py")}
    assert graph.symbol_edges(files, chunks, most_files=3).count() == 0


def test_pagerank_against_loop(spark):
    rng = random.Random(3)
    nodes = {f"n{i}": float(i % 3) for i in range(12)}
    edges = {(a, b): rng.random() for a in nodes for b in nodes if a != b and rng.random() < 0.2 and a != "n5"}
    got = {r.node: r.rank for r in graph.pagerank(spark.createDataFrame(list(nodes.items()), "node string, seed double"), spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, weight double"), iterations=8).collect()}
    base = {k: v / sum(nodes.values()) for k, v in nodes.items()}
    out = Counter()
    for (a, _), w in edges.items():
        out[a] += w
    r = dict(base)
    for _ in range(8):
        lost = sum(v for k, v in r.items() if not out[k])
        r = {k: 0.15 * base[k] + 0.85 * lost * base[k] + 0.85 * sum(r[a] * w / out[a] for (a, b), w in edges.items() if b == k) for k in nodes}
    assert all(abs(got[k] - r[k]) < 1e-9 for k in nodes) and abs(sum(got.values()) - 1) < 1e-9


def test_as_of_window(spark):
    left = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00', 'x'), (1, timestamp'2024-01-09 00:00:00', 'y'), (2, timestamp'2024-01-01 00:00:00', 'z') as t(k, ts, e)")
    right = spark.sql("select * from values (1, timestamp'2024-01-01 00:00:00'), (1, timestamp'2024-01-02 00:00:00'), (1, timestamp'2024-01-04 00:00:00'), (1, timestamp'2024-01-04 00:00:01') as t(k, ts)")
    assert {r.e: r.responses for r in mining.first_within(left, right, ["k"], "ts", 72).collect()} == {"x": 2, "y": 0, "z": 0}


def test_format_only(spark):
    df = spark.createDataFrame([("-a b\n+ab\n",), ("-a\n+b",), ("x",), ("--- a\n+++ b\n-x;y\n+x; y",)], "p string")
    assert [r[0] for r in df.select(mining.is_format_only(F.col("p"))).collect()] == [True, False, False, True]


def test_reports(spark):
    rows = spark.createDataFrame([("g", str(i), float(x), float(y)) for i, (x, y) in enumerate([(3, 1), (1, 2), (1, 2), (2, 9)])] + [("h", "z", 1.0, 1.0)], "g string, id string, x double, y double")
    got = {r.g: r for r in reports.correlations(rows, "x", "y", ["g"]).collect()}
    assert got["h"].pearson is None and abs(got["g"].spearman - (-0.2108185)) < 0.2
    for n, want in ((9, (3, 3, 3)), (10, (3, 3, 4)), (11, (3, 4, 4))):
        b = analysis.tertiles_at_scale(spark.createDataFrame([("g", i, float(i)) for i in range(n)], "g string, i int, m double"), "m", ["g"], "i").groupBy("bucket").count().collect()
        d = {r.bucket: r["count"] for r in b}
        assert (d["low"], d["middle"], d["high"]) == want


def test_curation(spark):
    assert sorted(Counter(curation.weighted_shards([(f"k{i}", i) for i in range(20)], 4).values()).values()) == [5, 5, 5, 5]
    a = spark.createDataFrame([("1", "valid"), ("1", "bad"), ("2", None), ("2", "valid"), ("3", ""), ("3", "Valid ")], "sample_id string, verdict string")
    assert [r.sample_id for r in curation.conflicts(a).collect()] == ["1"]
    s = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "sample_id string")
    assert sorted(r.sample_id for r in curation.keep(s, a).collect()) == ["1", "2", "3"]


def test_trajectories(spark):
    steps = spark.createDataFrame([("s", 1, "read", "a", False, False), ("s", 2, "read", "g", True, False), ("s", 3, "read", "g", False, False), ("m", 1, "read", "a", False, False)], "sample_id string, step int, tool string, path string, is_final boolean, is_utilized boolean")
    gold = spark.createDataFrame([("s", ["g", "h"]), ("m", ["g"])], "sample_id string, gold_files array<string>")
    m = {r.sample_id: r for r in trajectories.set_metrics(steps, gold).collect()}
    assert m["s"].retrieved_recall == 0.5 and m["s"].final_precision == 1.0 and m["s"].utilized_precision == 1.0 and abs(m["s"].redundancy - 1 / 3) < 1e-12
    assert m["m"].final_f1 == 0.0
    h = {r.sample_id: r.first_hit for r in trajectories.first_hits(steps, gold).collect()}
    assert h == {"s": 2, "m": None}


def test_vectors_against_sorting(spark):
    rng = random.Random(6)
    items = [(i, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(150)] + [(150, None), (151, [1.0]), (152, [0.0] * 4)]
    df = spark.createDataFrame(items, "item_id bigint, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(i, v) for i, v in items if i % 10 == 0], "query_id bigint, vector array<float>")

    def cosine(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0

    for block in (4, 4096):
        got = {}
        for r in rank.by_vectors(queries, df, depth=7, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.item_id)
        fine = [(i, v) for i, v in items if v and len(v) == 4]
        for q, v in items:
            if q % 10 == 0 and v and len(v) == 4:
                assert got[q] == [i for _, i in sorted((-cosine(v, w), i) for i, w in fine)[:7]]
