import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loreline.llm import cutoff, not_handwritten

SENTENCES = ["The cache keeps its rows until the lease ends.", "We saw many failures in the loader path.", "Please add a note about the default to the guide.", "A smaller fix would be to ignore any writer that is already closed.", "Why does the router need to flush here?"]


def prose(rng, n):
    return " ".join(SENTENCES[rng.integers(5)] for _ in range(n))


def corpus(spark):
    rng = np.random.default_rng(1)
    rows, cut = [], set()
    for i in range(600):
        t = prose(rng, int(rng.integers(2, 9)))
        if i % 6 == 0 and len(t) > 90:
            at = int(rng.integers(60, len(t) - 5))
            if t[at - 1] not in ".? " and t[at] not in ".? ":
                t = t[:at]
                cut.add(i)
        rows.append((i, t, "mail" if i % 2 else "web", "issue", None, len(t), "x"))
    rows += [(600, None, None, None, None, None, "x"), (601, "  ", "web", "issue", None, 2, "x"), (602, prose(rng, 3)[:70] + "\n...[truncated]", "web", "issue", None, 5000, "x"), (603, "ok", "web", "issue", None, 2, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, kind string, path string, n_chars bigint, score string"), cut


def test_cut_off(spark):
    docs, cut = corpus(spark)
    rows = cutoff.cut_off(docs).collect()
    got = {r.doc_id for r in rows if r.cut}
    assert len(rows) == 604 and 602 in got and not got & {600, 601}
    right = got & cut
    assert len(right) >= 0.9 * len(cut) and len(right) >= 0.9 * len(got - {602})
    assert {r.source for r in cutoff.cut_rates(spark.createDataFrame(rows)).collect()} == {"", "mail", "web"}
    assert cutoff.cut_off(docs.limit(0)).count() == 0


def test_words_are_counted_over_all_texts(spark, monkeypatch):
    docs, _ = corpus(spark)
    count, read = cutoff.common_words, []
    monkeypatch.setattr(cutoff, "common_words", lambda texts, least: read.append(texts.count()) or count(texts, least))
    assert cutoff.cut_off(docs, sample_rows=50).count() == 604 and read == [602]
    many = " ".join("".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60_000)) + " end"
    texts = spark.createDataFrame([(many,), (many,), ("single " * 20,)], "text string")
    assert count(texts).count() == 60_000 and count(texts, 3).count() == 0


def test_last_words():
    assert [cutoff.closing(t, "issue", "", None, ())[0] for t in ("the loadCach", "a line\nThe en [...]", "done.", "v2", "", "終わり", "snake_ca ")] == ["cach", "en", None, None, None, None, "ca"]


def test_limits_are_found(spark):
    rng = np.random.default_rng(2)
    rows = [(prose(rng, 9)[: 300 if i % 4 == 0 else 1000] + str(i) * (i % 4 != 0), "Pr-Rest" if i % 2 == 0 else "other") for i in range(400)]
    rows = [(f"{i:03d}" + t[3:], s) for i, (t, s) in enumerate(rows)]
    assert {r.source: r.limits for r in cutoff.source_limits(spark.createDataFrame(rows, "text string, source string")).collect()}["pr_rest"] == [300]


def test_held_out_accuracy_of_cuts():
    rng = np.random.default_rng(3)
    x, y = [], []
    for _ in range(800):
        t = prose(rng, 4)
        x.append(np.array(cutoff.describe(t, "issue", "", len(t), ())))
        y.append(0.0)
        h = cutoff.cut_once(t, rng, set())
        if h:
            x.append(np.array(cutoff.describe(h, "issue", "", len(h), ())))
            y.append(1.0)
    n = len(x) // 2
    w = cutoff._fit(x[:n], np.array(y[:n]), 1e-5, 150)
    assert np.mean([(w[f].sum() > 0) == (t == 1) for f, t in zip(x[n:], y[n:], strict=True)]) > 0.97


@pytest.mark.parametrize(
    ("text", "path", "want"),
    [
        ("// Code generated by toolx 1.2. DO NOT EDIT.\npackage a\n", "a.go", "tool"),
        ("// revised 4 times\n// Produced by x 1.0 from a.proto, do not modify.\n", "a.go", "tool"),
        ('BANNER = "Code generated by x. DO NOT EDIT."\n', "tools/gen.py", ""),
        ("# the parser was generated by x once, but this file is maintained by hand\n", "a.py", "hand"),
        ("// This is an unmodified copy of libx 1.0.0; report bugs upstream.\n", "a.js", "third"),
        ("x = 1\n", "vendor/libx/a.py", "third"),
        ("x = 1\n", "src/vendors/a.py", ""),
        ("{}", "web/package-lock.json", "tool"),
        ("// SPDX-License-Identifier: X-1.0\nx\n", "a.js", "owned"),
        ("", None, ""),
    ],
)
def test_says(text, path, want):
    assert not_handwritten.says(text, path) == want


def test_classify(spark):
    rng = np.random.default_rng(4)
    names = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma"]
    rows, foreign = [], set()
    for i in range(300):
        n = lambda: names[rng.integers(7)]
        if i % 3 == 0:
            body = "!function(e,t){" + "".join(f"var {'abcdef'[rng.integers(6)]}=e.{n()}{n()}({rng.integers(99)});" for _ in range(60)) + "}"
            rows.append((i, ("/*! lib-x v1.2.3 | MIT */\n" if i % 6 == 0 else "") + body, f"web/{i}.js", "source_file"))
            foreign.add(i)
        else:
            rows.append((i, ("# Copyright 1 the x contributors, see LICENSE.\n\n" if i % 2 else "") + "".join(f"def {n()}_{n()}({n()}):\n    # {n()} {n()} the {n()}\n    if {n()}:\n        return {n()}.{n()}({rng.integers(9)})\n    {n()} = {n()} + {rng.integers(9)}\n\n" for _ in range(8)), f"src/{i}.py", "source_file"))
    rows += [(900, None, "a.py", "source_file"), (901, " ", "a.py", "source_file"), (902, "x", None, "issue"), (903, "x = 1\n", "vendor/libx/a.py", "source_file"), (None, "x", "a", "source_file")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, path string, kind string")
    got = {r.doc_id for r in not_handwritten.classify(docs.withColumn("said", docs.path)).filter("foreign").collect()}
    assert got == foreign | {903}
    assert not_handwritten.classify(docs.limit(0)).count() == 0


def test_classify_after_an_observed_query(spark):
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}  # the session now holds its observations, which cannot be serialized
    tool = [(i, "// Code generated by x. DO NOT EDIT.\n" + "".join(f"  put({i * j}, 0x{j:02x});\n" for j in range(40)), f"a{i}.go", "source_file") for i in range(30)]
    hand = [(100 + i, "# written by hand\n" + "".join(f"def {w}_{i}(row):\n    # keeps the {w} of a row\n    return row.{w} or default_{w}\n\n" for w in SENTENCES[i % 5][:-1].split()), f"a{i}.py", "source_file") for i in range(30)]
    docs = spark.createDataFrame(tool + hand, "doc_id bigint, text string, path string, kind string")
    rows = not_handwritten.classify(docs).collect()
    assert len(rows) == 60 and {r.doc_id for r in rows if r.foreign} == set(range(30))
