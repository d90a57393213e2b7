from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from loreline.llm.pieces import current_chunks, cut_oversized, split


def check(text, limit, overlap, prose):
    out = split(text, limit, overlap, prose)
    assert out[0][0] == 0 and out[-1][1] == len(text) and out[-1][2] == "end"
    done = 0
    for s, e, cut in out:
        assert e - s <= limit and 0 <= done - s <= overlap and e > done or not text
        if cut == "natural":
            assert prose or text[e - 1] == "\n" or text[e : e + 1] in ("\n", "\r") or any(len(x) > limit for x in text.split("\n"))
        done = e
    assert "".join(text[max(s, d) : e] for (s, e, _), d in zip(out, [0, *[e for _, e, _ in out]], strict=False)) == text
    assert any(c == "forced" for _, _, c in out) == (len(text) > limit and any(len(x) > limit for x in text.split("\n")))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n\r}d", min_size=1, max_size=400), st.integers(12, 60), st.integers(0, 10), st.booleans())
def test_round_trip(text, limit, overlap, prose):
    check(text, limit, overlap, prose)


def test_topics_are_kept_together():
    a = "\n".join(f"apple pear plum fruit juice {i}" for i in range(30))
    b = "\n".join(f"engine wheel brake motor road {i}" for i in range(30))
    text = a + "\n\n" + b
    first = split(text, len(a) + 300, 0, True)[0]
    assert abs(first[1] - len(a)) <= 2


def test_one_long_line():
    assert {c for _, _, c in check("x" * 1000, 100, 20, False)} == {"forced", "end"}
    assert [c for _, _, c in check("x" * 100 + "\n" + "y" * 100, 100, 0, False)] == ["natural", "natural", "end"]


def test_overlap_inside_a_long_line():
    blob = check("x" * 1000, 100, 20, False)
    assert all(s == e - 20 for (_, e, _), (s, _, _) in zip(blob, blob[1:], strict=False))
    for text, prose in (("word " * 2000, False), ("word " * 2000, True), ("One has two. " * 900, True)):
        out = check(text, 1000, 100, prose)
        assert len(out) > 2
        for (_, e, _), (s, _, _) in zip(out, out[1:], strict=False):
            assert 80 <= e - s <= 100 and text[s].isalnum() and text[s - 1] == " "


def test_overlap_leaves_whole_lines_whole():
    out = check("".join(c * 95 + "\n" for c in "abcdefgh"), 100, 20, False)
    assert {c for _, _, c in out} == {"natural", "end"} and [e - s for s, e, _ in out[1:]] == [100] * 7


def test_forced_cut_at_a_valley():
    for stop, prose in ((" ", False), (" ", True), (". ", True)):
        a = "".join(f"apple pear plum fruit juice{stop}" for _ in range(130))
        b = "".join(f"engine wheel brake motor road{stop}" for _ in range(130))
        text = a + b
        first = check(text, len(a) + 900, 100, prose)[0]
        assert first[2] == "forced" and abs(first[1] - len(a)) <= 2


def test_the_valley_goes_before_the_kind_of_place():
    """A blank line within a topic is passed over for the line at which the topic changes."""
    a = [f"apple pear plum fruit juice {i % 3}" for i in range(40)]
    b = [f"engine wheel brake motor road {i % 3}" for i in range(40)]
    text = "\n".join([*a[:37], "", *a[37:], *b])
    first = split(text, len("\n".join(a)) + 500, 0, True)[0]
    assert text[first[1] :].startswith("engine")


def test_symbols_end_at_their_indented_parts():
    body = "".join(f"    def method_{i}(self):\n        return self.value_{i} + {i}\n" for i in range(20))
    text = "class A:\n" + body
    for s, e, c in split(text, 300, 0, False, nested=True)[:-1]:
        assert text[e:].startswith("    def ") and c == "natural"


def test_time_grows_with_the_length():
    import time

    took = []
    for n in (200_000, 1_600_000):
        at = time.perf_counter()
        split("word " * (n // 5), 8000, 400, False)
        took.append(time.perf_counter() - at)
    assert took[1] < 24 * took[0]


def test_operator(spark):
    rows = spark.createDataFrame([("a", "a.py", "file", "x = 1\n" * 50, 1), ("a", "a.py", "file", "x = 1\n" * 50, 1), ("b", None, None, "é" * 100, 1), ("c", "c", "file", None, 1), ("d", "d", "file", "", 1), (None, "e", "file", "y" * 500, 1)], "chunk_id string, path string, kind string, text string, piece int")
    got = cut_oversized(rows, limit=100, overlap=10).collect()
    assert {r.chunk_id for r in got} == {"a"} and all(n == 2 for n in Counter((r.piece, r.text) for r in got).values())
    assert cut_oversized(rows.limit(0), limit=100, overlap=10).count() == 0


def test_current(spark):
    rows = spark.sql("select * from values ('a', 'long text', timestamp'2024-01-01', 'p', 'file'), ('a', 'short', timestamp'2024-01-02', 'p', 'file'), ('b', 'long text', timestamp'2024-01-02', 'p', 'file'), ('b', 'long text', timestamp'2024-01-02', 'p', 'file'), ('b', 'x', timestamp'2024-01-01', 'p', 'file') as t(chunk_id, text, ingested_at, path, kind)")
    assert [r.chunk_id for r in current_chunks(rows, 6).collect()] == ["b"]
