import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from loreline.llm import near_duplicates as nd
from loreline.llm.shingles import shingle_sets, words_of

DOCS = "doc_id bigint, text string, class_id string, sketch int, key string"


def words(t):
    return re.findall(r"[a-z0-9]+", t.lower())


def sets(t, k):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], DOCS)


def pairs(spark, texts, **kw):
    return {tuple(r) for r in nd.document_pairs(*nd.near_duplicates(table(spark, texts), **kw)).collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB1 .é\n中_K", max_size=60), min_size=1, max_size=8))
def test_words_and_shingles(texts):
    got = dict(shingle_sets(texts, 3, 0))
    for i, t in enumerate(texts):
        assert len(got.get(i, ())) == len(sets(t, 3))
    for a, x in enumerate(texts):
        for b, y in enumerate(texts):
            if a in got and b in got:
                assert len(set(got[a]) & set(got[b])) == len(sets(x, 3) & sets(y, 3))


def test_a_long_text_is_hashed_in_pieces(monkeypatch):
    text = "lorem ipsum dolor sit amet " * 300
    whole = dict(shingle_sets([text], 4, 0))[0]
    monkeypatch.setattr("loreline.llm.shingles.BATCH_BYTES", 100)
    assert (dict(shingle_sets([text], 4, 0))[0] == whole).all()
    assert [(a, b) for a, b, _, _ in words_of(["x" * 300, "y", "z"])] == [(0, 1), (1, 3)]


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(60):
        base = [rng.choice(vocab) for _ in range(rng.randrange(45, 120))]
        texts.append(base)
        for _ in range(rng.randrange(4)):
            t = list(base)
            for _ in range(rng.randrange(8)):
                p = rng.randrange(len(t))
                t[p : p + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(3)
            texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j and min(len(words(a)), len(words(b))) >= 40:
                x, y = sets(a, 4), sets(b, 4)
                s = len(x & y) / len(x | y)
                if s >= 0.6:
                    want[i, j] = s
    got = pairs(spark, rows, width=4, similarity=0.6, least_words=40)
    assert got <= set(want) and len(got) >= 0.99 * len(want) and {p for p, s in want.items() if s > 0.75} <= got


def test_nulls_short_texts_and_copies(spark):
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(1, t), (2, t.upper()), (3, None), (4, ""), (5, "w1 w2"), (6, t), (6, t), (None, t), (7, "¡¿ 中 文!")]
    assert pairs(spark, rows, width=5) == {(1, 2), (1, 6), (2, 6)}
    members, links = nd.near_duplicates(table(spark, rows), width=5)
    assert {(r.doc_id, r.class_id) for r in members.collect()} == {(1, 1), (2, 1), (6, 1)}
    assert links.count() == 0


def test_empty(spark):
    assert pairs(spark, []) == set()
    assert nd.groups(*nd.near_duplicates(table(spark, []))).count() == 0


def test_groups_follow_chains(spark):
    members = spark.createDataFrame([(i, i) for i in range(1, 9)] + [(20, 3)], "doc_id bigint, class_id bigint")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7)], "class_a bigint, class_b bigint")
    got = {r.doc_id: (r.group_id, r.links) for r in nd.groups(members, links).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 2), 4: (1, 1), 5: (5, 0), 6: (6, 1), 7: (6, 1), 8: (8, 0), 20: (1, 2)}


def test_texts_that_share_a_long_part(spark):
    """A licence that all texts share fills entries far beyond hot; every similar pair still comes, by the exact join, and no other."""
    rng = random.Random(8)
    licence = " ".join(f"legal{i}" for i in range(30))
    rows = [(i, licence + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(25))) for i in range(3000)]
    want = set()
    for i in range(0, 3000, 50):
        own = rows[i][1].split(" ")
        own[40] = "edited"
        rows.append((10_000 + i, " ".join(own)))
        want.add((i, 10_000 + i))
    assert pairs(spark, rows, width=4, similarity=0.6, hot=100) == want


def test_rare_shingles_find_every_pair(spark):
    rng = random.Random(9)
    sets_ = []
    for g in range(40):
        base = rng.sample(range(5000), rng.randrange(5, 60)) + list(range(6000, 6020))
        sets_ += [sorted(set(base)), sorted(set(rng.sample(base, max(3, int(len(base) * rng.uniform(0.5, 1))))) | {7000 + g})]
    df = spark.createDataFrame(list(enumerate(sets_)), "doc_id bigint, shingles array<int>")
    got = {tuple(r) for r in nd._rare_pairs(df, "doc_id", 0.6).collect()}
    like = {(i, j) for i, x in enumerate(sets_) for j, y in enumerate(sets_) if i < j and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6}
    assert like <= got
