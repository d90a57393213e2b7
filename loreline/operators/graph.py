"""Graphs of files: import, symbol and test edges, and personalised PageRank as an iteration of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions.paths import basename, is_code_path, is_test_path
from loreline.functions.text import tokenize
from loreline.operators.corpus import lines
from loreline.session import cut

# Import statements, lines without any, words that make a path one of a test, and names that say nothing.
IMPORT = r"(?:^|\s)(?:from\s+([A-Za-z0-9_.]+)\s+import|import\s+([A-Za-z0-9_./:-]+)|require\(\s*['\"]([^'\"]+)['\"]\s*\)|from\s+['\"]([^'\"]+)['\"]|import\s+['\"]([^'\"]+)['\"]|#include\s+[<\"]([^>\"]+)[>\"]|use\s+(?:crate::|super::)?([A-Za-z0-9_:]+))"
COMMENT = r"^(//|# |\*)"
TEST_MARKERS = ["test", "tests", "testing", "__tests__", "testsuite", "testsuites"]
GENERIC = "add app args build call case check class close config context data default delete error event file find get handle helper init item list load main make mock model name node option options parse path read render request response result run save server set state string test tests type update value write".split()
SPACE = ["repo", "base_commit"]


def import_specs(files: DataFrame) -> DataFrame:
    """(repo, base_commit, path, pos, spec): what a file's first 2000 lines import, at most 200, each as often as it stands there."""
    spec = lambda m: F.coalesce(*[F.nullif(F.regexp_extract(m, IMPORT, g), F.lit("")) for g in range(1, 8)])
    read = F.filter(F.transform(F.slice(lines(F.col("text")), 1, 2000), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: ~x.rlike(COMMENT))
    found = F.flatten(F.transform(read, lambda x: F.transform(F.regexp_extract_all(x, F.lit(IMPORT), F.lit(0)), spec)))
    return files.filter(F.col("text").isNotNull()).select(*SPACE, "path", F.posexplode(F.slice(found, 1, 200)).alias("pos", "spec"))


def _path_keys(path: Column) -> Column:
    """The names under which a file is imported: its path and last 2 to 5 parts without suffix, with slashes or dots, its name and its stem."""
    bare = F.regexp_replace(path, r"(?<=[^/.])\.[^./]+$", "")
    parts = F.split(bare, "/")
    ends = F.transform(F.filter(F.array(*[F.lit(w) for w in range(2, 6)]), lambda w: w <= F.size(parts)), lambda w: F.array_join(F.slice(parts, -w, w), "/"))
    slashed = F.concat(F.array(bare), ends)
    keys = F.concat(slashed, F.transform(slashed, lambda x: F.replace(x, F.lit("/"), F.lit("."))), F.array(basename(path), basename(bare)))
    return F.array_distinct(F.filter(F.transform(keys, F.lower), lambda x: x != ""))


def _spec_keys(spec: Column, path: Column) -> Column:
    """The names a spec may mean: relative ones from the file's folder, also as index, mod and __init__; others with slashes or dots."""
    clean = F.regexp_replace(F.trim(spec), "^[;,]+|[;,]+$", "")
    folder = F.split(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), "/")
    by_path = F.split(F.regexp_replace(clean, r"(?<=[^/.])\.[^./]+/?$", ""), "/")
    dots = F.length(F.regexp_extract(clean, r"^\.*", 0))
    by_dots = F.concat(F.array_repeat(F.lit(".."), F.greatest(F.lit(0), dots - 1)), F.split(F.regexp_replace(clean, r"^\.+", ""), r"\."))
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))).otherwise(F.concat(done, F.array(x)))
    at = F.array_join(F.aggregate(F.concat(folder, F.when(clean.contains("/"), by_path).otherwise(by_dots)), F.array().cast("array<string>"), step), "/")
    slashed = F.regexp_replace(F.translate(F.replace(clean, F.lit("::"), F.lit("/")), ".", "/"), "^/+|/+$", "")
    relative = F.when(at != "", F.array(at, *[F.concat(at, F.lit(x)) for x in ("/index", "/mod", "/__init__")]))
    return F.array_distinct(F.transform(F.when(clean.startswith("."), relative).otherwise(F.array(slashed, F.translate(slashed, "/", "."))), F.lower))


def import_links(files: DataFrame) -> DataFrame:
    """(repo, base_commit, src, dst, n): files that a file's imports name within the snapshot, other than itself, and how often.

    A spec that names more than eight files means the first eight by path; so no key needs more than its first eight files.
    """
    named = files.filter("path <> ''").select(*SPACE, F.col("path").alias("dst")).distinct().select(*SPACE, "dst", F.explode(_path_keys(F.col("dst"))).alias("key"))
    index = named.withColumn("_r", F.row_number().over(Window.partitionBy(*SPACE, "key").orderBy("dst"))).filter("_r <= 8").drop("_r")
    specs = import_specs(files).groupBy(*SPACE, F.col("path").alias("src"), "spec").agg(F.countDistinct("pos").alias("n"))
    targets = specs.withColumn("key", F.explode(_spec_keys(F.col("spec"), F.col("src")))).join(index, [*SPACE, "key"]).groupBy(*SPACE, "src", "spec", "n").agg(F.slice(F.array_sort(F.collect_set("dst")), 1, 8).alias("dst"))
    return targets.withColumn("dst", F.explode("dst")).filter("src <> dst").groupBy(*SPACE, "src", "dst").agg(F.sum("n").alias("n"))


def import_edges(files: DataFrame) -> DataFrame:
    """(repo, base_commit, src, dst): imports resolved within the snapshot, other than the file itself."""
    return import_links(files).drop("n")


def symbol_edges(files: DataFrame, chunks: DataFrame, most_files: int = 3000, most_refs: int = 80) -> DataFrame:
    """(repo, base_commit, src, dst): source and test files whose tokens hold all parts of the name of a symbol that dst defines.

    Names that more than eight files define, generic ones and single short words are no symbols. Of a file's candidates the first
    4 * most_refs count, by parts that match and then by name, and of the files these are defined in the first most_refs.
    Snapshots with more than most_files such files have no such edges. Tokens are those of the path, the symbols and 20,000 characters.
    """
    p = F.col("path")
    nodes = files.filter("path <> ''").select(*SPACE, "path", "text").filter(is_test_path(p) | is_code_path(p))
    few = nodes.groupBy(*SPACE).agg(F.countDistinct("path").alias("n")).filter(F.col("n") <= most_files).select(*SPACE)
    nodes = nodes.join(few, SPACE, "left_semi")
    paths = nodes.select(*SPACE, "path").distinct()
    name = F.array_join("tokens", "")
    plain = ~name.isin(GENERIC) & ~name.rlike("^[0-9]+$") & (F.length(name) >= 4)
    symbols = chunks.select(*SPACE, "path", tokenize(F.trim("symbol")).alias("tokens")).join(paths, [*SPACE, "path"], "left_semi").filter(plain).select(*SPACE, "path", name.alias("key"), "tokens").distinct()
    defined = symbols.select(*SPACE, "key", F.col("path").alias("dst")).distinct()
    rare = defined.groupBy(*SPACE, "key").agg(F.count(F.lit(1)).alias("n")).filter("n <= 8").select(*SPACE, "key")
    parts = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC))))
    keyed = symbols.select(*SPACE, "key", parts.alias("parts")).filter((F.size("parts") > 1) | (F.length(F.get("parts", F.lit(0))) >= 8)).distinct().join(rare, [*SPACE, "key"], "left_semi")
    content = nodes.select(*SPACE, "path", F.concat(tokenize(p), F.coalesce(tokenize(F.substring("text", 1, 20_000)), F.array())).alias("tokens"))
    tokens = content.unionByName(symbols.drop("key")).select(*SPACE, "path", F.explode(F.array_distinct("tokens")).alias("token")).distinct()
    matched = tokens.join(keyed.select(*SPACE, "key", "parts", F.explode("parts").alias("token")), [*SPACE, "token"]).groupBy(*SPACE, "path", "key", "parts").agg(F.count(F.lit(1)).alias("m"))
    best = matched.groupBy(*SPACE, "path", "key").agg(F.max("m").alias("m"), F.max(F.col("m") == F.size("parts")).alias("whole"))
    file = Window.partitionBy(*SPACE, "path")
    first = best.withColumn("r", F.row_number().over(file.orderBy(F.desc("m"), "key"))).filter(F.col("r") <= 4 * most_refs).filter("whole")
    met = first.join(defined, [*SPACE, "key"]).filter("path <> dst").groupBy(*SPACE, "path", "dst").agg(F.min("r").alias("r"))
    return met.withColumn("k", F.row_number().over(file.orderBy("r", "dst"))).filter(F.col("k") <= most_refs).select(*SPACE, F.col("path").alias("src"), "dst")


#: Sources and tests of one name that are paired, by path; more share no telling name.
MOST_OF_A_NAME = 20


def test_links(files: DataFrame, most: int = MOST_OF_A_NAME) -> DataFrame:
    """(repo, base_commit, src, dst, n): source files and the tests whose names say they test them, and how many names they share.

    A file's names are its stem without what makes it a test, and that with the folder it stands in. Of a name the first
    `most` sources and tests by path are paired.
    """
    p = F.col("path")
    stem = F.lower(F.regexp_replace(basename(p), r"(?<=[^.])\.[^.]*$", ""))
    for end in ("_test", "test", "tests", ".test", ".spec", "_spec"):
        stem = F.regexp_replace(stem, end.replace(".", r"\.") + "$", "")
    for head in ("test_", "tests_"):
        stem = F.regexp_replace(stem, "^" + head, "")
    bare = F.regexp_replace(stem, "[^a-z0-9]+", "")
    module = F.try_element_at(F.filter(F.split(F.lower(F.regexp_extract(p, r"^(.*)/[^/]*$", 1)), "/"), lambda x: (x != "") & ~x.isin(TEST_MARKERS)), F.lit(-1))
    keys = F.array_compact(F.array(F.col("stem"), F.concat("module", F.lit(":"), "stem")))
    role = F.when(is_test_path(p), "test").when(is_code_path(p), "source")
    rows = files.select(*SPACE, "path", role.alias("role"), bare.alias("stem"), module.alias("module")).filter("role is not null and length(stem) >= 3").distinct()
    keyed = rows.select(*SPACE, "path", "role", F.explode(keys).alias("key"))
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*SPACE, "key", "role").orderBy("path"))).filter(F.col("_r") <= most)
    side = lambda r, name: first.filter(F.col("role") == r).select(*SPACE, "key", F.col("path").alias(name))
    return side("source", "src").join(side("test", "dst"), [*SPACE, "key"]).groupBy(*SPACE, "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def test_edges(files: DataFrame) -> DataFrame:
    """(repo, base_commit, src, dst): source files and the tests that are named after them."""
    return test_links(files).drop("n")


def pagerank(nodes: DataFrame, edges: DataFrame, *, damping: float = 0.85, iterations: int = 24) -> DataFrame:
    """(node, rank) of personalised PageRank over nodes (node, seed) and directed edges (src, dst, weight).

    Seeds are made shares of their sum, equal ones if all are 0. Every round is one join on src and one sum by dst, which are
    partitioned alike; what nodes without outgoing weight hold goes back to the seeds. Lineage is cut every six rounds.
    """
    n, s = nodes.agg(F.count(F.lit(1)), F.sum(F.greatest(F.col("seed"), F.lit(0.0)))).first()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    base = F.greatest(F.col("seed"), F.lit(0.0)) / s if s else F.lit(1.0 / n)
    out = edges.groupBy("src").agg(F.sum("weight").alias("total")).filter("total > 0")
    nodes = cut(nodes.select("node", base.cast("double").alias("base")).join(out.withColumnRenamed("src", "node"), "node", "left"))
    shares = cut(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")).join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"))
    ranks = nodes.select("node", "base", "total", F.col("base").alias("rank"))
    for i in range(iterations):
        dangling = ranks.agg(F.sum(F.when(F.col("total").isNull(), F.col("rank")).otherwise(0.0)).alias("d"))
        flow = shares.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("f")).withColumnRenamed("dst", "node")
        joined = ranks.join(flow, "node", "left").join(F.broadcast(dangling))  # one row
        ranks = joined.select("node", "base", "total", ((1 - damping) * F.col("base") + damping * F.col("d") * F.col("base") + damping * F.coalesce("f", F.lit(0.0))).alias("rank"))
        if i % 6 == 5:
            ranks = cut(ranks)
    return ranks.select("node", "rank")
