import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loreline.llm import mixing, packing, queries, tokens
from loreline.llm.packing import Windows

WORDS = ["alpha", "beta", "gamma", "Delta", "x1", "(", ")", "é", "中文", "\n"]


def docs(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 80))), rng.choice(["EN", "en ", "de", None]), rng.choice(["a", "A", "b-x", "c"])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "en", "a"), (n + 1, "", "en", "a")], "doc_id bigint, text string, lang string, source string")


def true_sizes(d):
    rows = d.filter("text is not null").collect()
    return dict(zip([r.doc_id for r in rows], tokens.counter()([r.text for r in rows]), strict=True))


def test_tokenizers_agree():
    texts = ["Hello world, x_1 = 5;", "", "中文 é"]
    a, b = tokens.counter()(texts), tokens.counter("/opt/tokenizers/byte_bpe_50k.json")(texts)
    assert a == b and a[1] == 0
    assert all(n >= 0 for n in tokens.counter("/opt/tokenizers/piece_bpe_32k.model")(texts))


def test_estimates(spark):
    d = docs(spark)
    got = {r.doc_id: r for r in tokens.estimate_tokens(d, sample_rows=100, least_rows=20).collect()}
    true = true_sizes(d)
    assert len(got) == 402 and got[400].est_tokens is None and got[401].est_tokens == 0
    assert {r.language for r in got.values()} == {"en", "de", "unknown"}
    assert abs(sum(got[i].est_tokens for i in true) / sum(true.values()) - 1) < 0.03
    assert tokens.estimate_tokens(d.limit(0)).count() == 0


def test_windows_never_overflow():
    rng = random.Random(1)
    w = Windows(100, 5)
    closed = [c for i in range(2000) for c in w.place(rng.randrange(1, 101), i)]
    closed += list(w.rest())
    assert sorted(i for _, _, items in closed for i in items) == list(range(2000))
    assert all(fill <= 100 for _, fill, _ in closed) and len({k for k, _, _ in closed}) == len(closed)


@pytest.mark.parametrize("capacity", [16, 64])
def test_packing(spark, capacity):
    d = docs(spark).repartition(3)
    rows = packing.pack(d, capacity=capacity, windows=8, merge_rows=7).collect()
    size = true_sizes(d)
    parts, fill = defaultdict(list), Counter()
    for r in rows:
        parts[r.doc_id].append((r.start, r.tokens))
        if r.container:
            fill[r.container] += r.tokens
        else:
            assert r.tokens == 0
    assert set(parts) == set(size) and max(fill.values()) <= capacity
    for i, p in parts.items():
        assert sum(n for _, n in p) == size[i] and len(p) == max(1, -(-size[i] // capacity))
        assert [s for s, _ in sorted(p)] == list(range(0, max(size[i], 1), capacity))[: len(p)]
    assert sum(fill.values()) / (len(fill) * capacity) > 0.9
    assert packing.pack(d.limit(0)).count() == 0


def test_fill():
    assert mixing.fill({"a": (0.5, 100.0), "b": (0.3, 10.0), "c": (0.2, 100.0)}, 100) == {"b": 10.0, "a": pytest.approx(64.2857, abs=1e-3), "c": pytest.approx(25.714, abs=1e-3)}
    assert sum(mixing.fill({"a": (1.0, 5.0)}, 100).values()) == 5.0


def test_mixture(spark):
    d = docs(spark, 900)
    targets = spark.createDataFrame([("a", 0.5, 1), ("B_X", 0.3, 2), ("c", 0.2, 1), ("none", 0.0, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, targets).collect()
    total = sum(true_sizes(d).values())
    got = Counter()
    for r in m:
        assert 1 <= r.copies <= {"a": 1, "b_x": 2, "c": 1}[r.source]
        got[r.source] += r.tokens * r.copies
    assert len({r.doc_id for r in m}) == len(m)
    for s, share in (("a", 0.5), ("b_x", 0.3), ("c", 0.2)):
        assert abs(got[s] - share * total / 2) < 150
    assert {tuple(r) for r in mixing.mix(d, targets).collect()} == {tuple(r) for r in m}
    s = {r.source: r for r in mixing.shares(spark.createDataFrame(m), targets).collect()}
    assert abs(s["a"].actual_share - 0.5) < 0.02 and s["none"].tokens == 0
    assert mixing.mix(d.limit(0), targets).count() == 0 and mixing.mix(d, targets.limit(0)).count() == 0


def test_short_sources_repeat_no_more_than_they_may(spark):
    d = spark.createDataFrame([(i, "one two three four five", "big" if i else "small") for i in range(100)] + [(100, "same text", "small"), (101, "same text", "small")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("small", 0.5, 3), ("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, targets).collect()
    assert {r.copies for r in m if r.source == "small"} == {3} and {r.copies for r in m if r.source == "big"} == {1}


def test_repo_spellings(spark):
    same = ["own/name", " Own/Name ", "own/name.git", "own/name/", "own/name.git/", "https://github.com/own/name", "https://me@host.org/Own/Name.git", "git@github.com:own/name.git", "ssh://git@host:22/own/name", "github.com/own/name"]
    got = spark.createDataFrame([(x,) for x in [*same, "own/git", "own/name.github", None]], "repo string").select(queries.repo_key(F.col("repo"))).collect()
    assert [r[0] for r in got] == ["own/name"] * len(same) + ["own/git", "own/name.github", None]


def test_totals_find_the_language_of_repos_spelled_otherwise(spark, tmp_path):
    spark.sql("select concat('d', id) as doc_id, 'some text of a file' as text, 'en' as lang, 'web' as source, 19L as n_chars, element_at(array('own/name', 'Own/Name.git', 'https://github.com/own/name/', 'un/known'), cast(id % 4 as int) + 1) as repo, 'a.py' as path, 'source_file' as kind from range(80)").write.parquet(f"{tmp_path}/documents.parquet")
    spark.sql("select 'own/name.git' as repo, 'Go' as language, timestamp'2024-01-01' as fetched_at").write.parquet(f"{tmp_path}/repo_manifest.parquet")
    got = {r.value: r.documents for r in queries.p2_token_totals(spark, str(tmp_path)).collect() if r.slice == "repo_language"}
    assert got == {"go": 60, "unknown": 20}


def test_estimates_hold_for_texts_that_were_not_tokenized(spark):
    """200 of 3000 texts a language are drawn at most; the others are judged, by document and in total."""
    d = docs(spark, 3000, seed=11)
    true = true_sizes(d)
    got = {r.doc_id: r.est_tokens for r in tokens.estimate_tokens(d, sample_rows=40, least_rows=20, shared_rows=100).collect()}
    unseen = [i for i in true if true[i] > 20 and i % 2]
    assert abs(sum(got[i] for i in true) / sum(true.values()) - 1) < 0.02
    assert sorted(abs(got[i] / true[i] - 1) for i in unseen)[len(unseen) // 2] < 0.1


def test_scripts_are_told_apart(spark):
    texts = {"han": "中文", "kana": "かな", "hangul": "한글", "cyrillic": "слово", "greek": "λόγος", "hebrew_arabic": "שלום", "indic_thai": "हिन", "none": "word"}
    rows = spark.createDataFrame(list(texts.items()), "s string, t string")
    for r in rows.select("s", *[f(F.col("t")).alias(n) for n, f in tokens.FEATURES.items()]).collect():
        assert {n for n in tokens.SCRIPTS if r[n]} == {r.s} - {"none"} and r["words"] == 1 or r.s == "indic_thai"


def test_long_records_have_the_greater_chance(spark):
    d = spark.createDataFrame([(i, "word " * (10 if i % 2 else 40), "a") for i in range(2000)], "doc_id bigint, text string, source string")
    m = mixing.mix(d, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"), total_share=0.3).collect()
    long = sum(r.doc_id % 2 == 0 for r in m) / 1000
    short = sum(r.doc_id % 2 == 1 for r in m) / 1000
    assert 3 < long / short < 5.5 and abs(sum(r.tokens for r in m) / (0.3 * sum(true_sizes(d).values())) - 1) < 0.002
