from loreline.operators import grep, metrics, repomap
from loreline.sources import io

S = "sample_id string, repo string, base_commit string, query_text string"
C = "repo string, base_commit string, chunk_id string, path string, kind string, symbol string, start_line int, end_line int, text string"


def base(spark, query):
    s = spark.createDataFrame([("s", "r", "c", query)], S)
    c = spark.createDataFrame([("r", "c", "1", "src/app/cache_util.py", "file", None, 1, 9, "def flushCache(x):\n  pass\n"), ("r", "c", "2", "tests/test_cache_util.py", "file", None, 1, 9, "from src.app.cache_util import flushCache\n"), ("r", "c", "3", "src/other.py", "file", None, 1, 9, "x = 1\n"), ("r", "c", "4", "src/app/cache_util.py", "symbol", "flushCache", 1, 2, None), ("r", "d", "5", "src/app/cache_util.py", "file", None, 1, 1, "flushCache")], C)
    return s, c


def test_patterns(spark):
    got = {(r.term, r.kind, r.weight) for r in grep.patterns(base(spark, "See `Flag_x` and src/app/cache_util.py, use --dry-run on flushCache; the file ValueError")[0]).collect()}
    assert ("src/app/cache_util.py", "file_path", 18.0) in got and ("--dry-run", "flag", 10.0) in got and ("flushCache", "identifier", 7.0) in got and ("ValueError", "error", 7.0) in got and ("Flag_x", "code", 12.0) in got
    assert not {t for t, _, _ in got} & {"the", "file", "See", "use"}


def test_grep_ranks_hits_only(spark):
    got = grep.rank_files(*base(spark, "flushCache fails")).orderBy("rank").collect()
    assert [r.path for r in got] == ["src/app/cache_util.py", "tests/test_cache_util.py"] and got[0].hit_chunks == 2
    assert grep.rank_files(*base(spark, "nothing here")).count() == 0
    assert grep.rank_files(*base(spark, None)).count() == 0


def test_tools(spark):
    c = base(spark, "")[1]
    assert [(r.base_commit, r.path, r.matches) for r in grep.search(c, "CACHE").filter("base_commit = 'c'").orderBy("rank").collect()] == [("c", "src/app/cache_util.py", 2), ("c", "tests/test_cache_util.py", 3)][::-1]
    assert {(r.entry, r.is_folder) for r in grep.list_folder(c.filter("base_commit = 'c'"), "/src/").collect()} == {("app", True), ("other.py", False)}


def test_repomap_lifts_neighbours(spark):
    s, c = base(spark, "what about cache_util.py")
    got = {r.path: r.rank for r in repomap.rank_files(s, c.filter("kind = 'file'"), c, rounds=7).collect()}
    assert got["src/app/cache_util.py"] == 1 and got["tests/test_cache_util.py"] == 2 and got["src/other.py"] == 3


def test_seed_context(spark):
    r = spark.createDataFrame([("s", "a", 1, 50), ("s", "b", 2, 0), ("s", "c", 3, 400), ("s", "d", 4, 400)], "sample_id string, path string, rank int, tokens int")
    assert {x.path: x.taken for x in metrics.seed_context(r, 200, 100).collect()} == {"a": 50, "c": 100, "d": 50}


def test_files(spark, tmp_path):
    schema = "id string, n int, l array<string>"
    assert io.read_jsonl(spark, f"{tmp_path}/none.jsonl", schema).count() == 0
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1, "l": ["a"]}\n\n{"id": "y"}\n')
    got = io.read_jsonl(spark, f"{tmp_path}/a.jsonl", schema).orderBy("_seq").collect()
    assert [(r.id, r.n, r.l) for r in got] == [("x", 1, ["a"]), ("y", None, None)]
    df = io.read_jsonl(spark, f"{tmp_path}/a.jsonl", schema).drop("_seq")
    io.write_jsonl(df, f"{tmp_path}/out")
    assert sorted(map(str, io.read_jsonl(spark, f"{tmp_path}/out", schema).drop("_seq").collect())) == sorted(map(str, df.collect()))
    io.write_csv(df.select("id", "n"), f"{tmp_path}/csv", ["n", "id"])
    assert sorted(r.id for r in io.read_csv(spark, f"{tmp_path}/csv", "n int, id string").collect()) == ["x", "y"]
    sums = io.checksums(spark, f"{tmp_path}/a.jsonl")
    want = spark.createDataFrame([("a.jsonl", sums.first().sha256), ("b.jsonl", "0")], "name string, sha256 string")
    assert [r.name for r in io.mismatches(sums, want).collect()] == ["b.jsonl"]
