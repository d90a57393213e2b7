"""Records that are slightly edited versions of each other.

Covering locality-sensitive hashing. A text is the set of its word shingles; its sketch is one minimum of the set under
each of SYMBOLS hash functions, so that two sketches differ in about (1 - similarity) of the places. Masks then select
places: all subsets of three, a structure that guarantees that any two sketches which differ in no more than SYMBOLS - 3
places agree under some mask and so collide in its table. A mask is tried for a text only where it shares each single
place of the mask with some other text, and then each two of them; this leaves out nothing, for texts that agree in three
places agree in any one and any two of them. Where a text that many share (a licence, say) fills a table's entry with more than HOT
texts, these are not paired there; they go through an exact join on the rarest of their shingles instead. What may be
similar by size and by a bitmap of the set is checked on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreline.llm.shingles import mix, shingle_sets
from loreline.operators.joins import heavy_keys, lookup_join, salted_join
from loreline.session import cut

#: Places of a sketch. With masks of 3 of 13 places, a pair of similarity 0.6 is missed once in 800, one of 0.7 once in 10,000.
SYMBOLS = 13
#: A table's entry with more texts than this is left to the exact join.
HOT = 1000
#: Longs of the bitmap that bounds how much two sets can have in common.
BITS = 8
_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _sketches(id_col: str, text_col: str, id_type: T.DataType, width: int, least_words: int, symbols: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seeds = _SEEDS[:symbols]
        for batch in batches:
            ids = batch[id_col].tolist()
            out: list[tuple] = []
            for i, s in shingle_sets(batch[text_col].tolist(), width, least_words):
                least = [int(mix(s ^ seed).min().view(np.int64)) for seed in seeds]
                marks = np.zeros(64 * BITS, np.uint8)
                marks[(s % np.uint64(64 * BITS)).astype(np.int64)] = 1
                out.append((ids[i], len(s), int(np.add.reduce(mix(s + np.uint64(1))).view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(2))).view(np.int64)), least, np.packbits(marks).view(np.int64).tolist()))
            yield pd.DataFrame(out, columns=[id_col, "size", "sum_hash", "xor_hash", "sketch", "bits"], dtype=object)

    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("size", T.IntegerType()), T.StructField("sum_hash", T.LongType()), T.StructField("xor_hash", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("bits", T.ArrayType(T.LongType()))])
    return run, schema


def _whole_sets(id_col: str, text_col: str, id_type: T.DataType, width: int, least_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch[id_col].tolist()
            out = [(ids[i], np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32)) for i, s in shingle_sets(batch[text_col].tolist(), width, least_words)]
            yield pd.DataFrame(out, columns=[id_col, "shingles"], dtype=object)

    return run, T.StructType([T.StructField(id_col, id_type), T.StructField("shingles", T.ArrayType(T.IntegerType()))])


def _collide(keyed: DataFrame, id_col: str) -> DataFrame:
    """(a, b), a < b, of the rows of one key; may repeat pairs."""
    left, right = keyed.select("key", F.col(id_col).alias("a")), keyed.select("key", F.col(id_col).alias("b"))
    return left.join(right, "key").filter("a < b").select("a", "b")


def _crowded(numbered: DataFrame, keys, total: int, least: int = 50, share: float = 0.01, sample: int = 20_000) -> DataFrame | None:
    """(key): those that surely more than `least` records share, about `share` of all; None if there is none.

    Found on about `sample` records drawn by a hash; at most keys per record / share can be. It only decides how
    rows are spread over tasks and which way pairs are looked for, not what is found.
    """
    some = numbered.filter(F.pmod(F.xxhash64(F.lit(6), F.col(numbered.columns[0])), F.lit(max(1, total // sample))) == 0)
    drawn = some.select(F.explode(keys).alias("k")).groupBy("k.key").agg(F.count(F.lit(1)).alias("n"))
    found = [(r["key"],) for r in drawn.filter(F.col("n") > max(least, share * min(total, sample))).select("key").collect()]
    return numbered.sparkSession.createDataFrame(found, "key long").withColumn("_crowd", F.lit(True)) if found else None


def _shared_masks(keyed: DataFrame, id_col: str, crowd: DataFrame | None, hot: int) -> DataFrame:
    """(id, masks, hot): of each record, the masks k.mask under which its key k.key is shared with another one, and those of more than hot records.

    Keys of the crowd are known to be shared; their rows are spread over tasks and not counted.
    """
    flat = keyed.select(id_col, "k.mask", "k.key")
    known, part = F.lit(False), [F.col("key")]
    if crowd is not None:
        flat = flat.join(F.broadcast(crowd), "key", "left")  # a bounded table, see _crowded
        known = F.coalesce("_crowd", F.lit(False))
        part.append(F.when(known, F.pmod(F.xxhash64(id_col), F.lit(256))))
    flat = flat.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*part)))
    return flat.filter((F.col("n") > 1) | known).groupBy(id_col).agg(F.collect_set("mask").alias("masks"), F.collect_set(F.when((F.col("n") > hot) | known, F.col("mask"))).alias("hot"))


def _rare_pairs(sets: DataFrame, id_col: str, similarity: float) -> DataFrame:
    """(a, b), a < b, that may be similar, exactly: sets ordered by how rare their shingles are meet in one of the first of them.

    Of two sets with that similarity each has, among its size - similarity * size + 1 rarest shingles, one of the other's. A pair is
    given only if what both have left from there could still be enough; so texts that share a long but common part alone give none.
    """
    terms = cut(sets.select(id_col, F.size("shingles").alias("n"), F.explode("shingles").alias("s")))
    often = terms.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ordered = lookup_join(terms, often, ["s"], weights=terms).groupBy(id_col, "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    keyed = ordered.select(id_col, "n", F.posexplode(F.slice("o", 1, first)).alias("at", "x")).select(F.col("x.s").alias("key"), id_col, "n", "at")
    left, right = (keyed.select("key", F.col(id_col).alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}")) for x in "ab")
    enough = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb")) >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & enough).select("a", "b")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, least_words: int = 0, symbols: int = SYMBOLS, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and pairs of similar classes: (id, class_id) and (class_a, class_b, similarity).

    Two texts are similar if the ratio of intersection to union of their sets of width consecutive words is at least
    similarity; a word is a maximal run of a-z and 0-9 in the lower-cased text. Texts with equal sets form one class,
    named by its least id; a pair links two classes, class_a < class_b, so that copies are not expanded into pairs.
    Null texts and texts with fewer than least_words or width words are in no class. Rows with a null id are left out, an
    id that is given twice counts once for each different text. Empty tables give empty results.
    """
    id_type = docs.schema[id_col].dataType
    texts = docs.select(id_col, text_col).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    run, schema = _sketches(id_col, text_col, id_type, width, least_words, symbols)
    sketched = cut(texts.mapInPandas(run, schema).withColumn("set_id", F.struct("size", "sum_hash", "xor_hash")).drop("sum_hash", "xor_hash"))
    reps = cut(sketched.groupBy("set_id").agg(F.min(id_col).alias("class_id"), *[F.first(c).alias(c) for c in ("size", "sketch", "bits")]))
    copies = sketched.select(id_col, "set_id")
    members = lookup_join(copies, reps.select("set_id", "class_id"), ["set_id"], weights=copies).select(id_col, "class_id").distinct()
    total = reps.count()

    at = lambda i: F.get("sketch", F.lit(i))
    numbered = reps.select(F.col("class_id").alias(id_col), "sketch")
    one_keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("mask"), F.xxhash64(F.lit(i), at(i)).alias("key")) for i in range(symbols)])
    ones = _shared_masks(numbered.select(id_col, F.explode(one_keys).alias("k")), id_col, _crowded(numbered, one_keys, total), hot).select(id_col, "masks")

    places = [(i, j) for i in range(symbols) for j in range(i + 1, symbols)]
    number = {p: n for n, p in enumerate(places)}
    have = lambda where, kind, *m: F.expr(" and ".join(f"array_contains({where}, {x}{kind})" for x in m))
    two_key = lambda n, i, j: F.struct(F.lit(n).cast("short").alias("mask"), F.xxhash64(F.lit(n), at(i), at(j)).alias("key"))
    two_keys = F.array_compact(F.array(*[F.when(have("masks", "Y", i, j), two_key(n, i, j)) for n, (i, j) in enumerate(places)]))
    crowd = _crowded(numbered, F.array(*[two_key(n, i, j) for n, (i, j) in enumerate(places)]), total)
    twos = cut(_shared_masks(numbered.join(ones, id_col).select(id_col, F.explode(two_keys).alias("k")), id_col, crowd, hot))

    triples = [(i, j, k) for i, j in places for k in range(j + 1, symbols)]
    pairs_of = lambda i, j, k: (number[i, j], number[i, k], number[j, k])
    under = lambda tried: F.explode(F.array_compact(F.array(*[F.when(tried(pairs_of(i, j, k)), F.xxhash64(F.lit(n), at(i), at(j), at(k))) for n, (i, j, k) in enumerate(triples)]))).alias("key")
    based = numbered.join(twos, id_col)
    # an entry of three places has no more records than any two of them; so where one pair is not hot, neither is the entry
    near = _collide(based.select(id_col, under(lambda m: have("masks", "S", *m) & ~have("hot", "S", *m))), id_col)
    if not twos.filter(F.size("hot") >= 3).isEmpty():
        full = cut(based.filter(F.size("hot") >= 3).select(id_col, under(lambda m: have("hot", "S", *m))))
        big = cut(full.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("key", F.lit(True).alias("_big")))
        marked = lookup_join(full, big, ["key"], "left", weights=full)
        near = near.unionByName(_collide(marked.filter(F.col("_big").isNull()).select(id_col, "key"), id_col))
        many = cut(marked.filter("_big").select(id_col).distinct())
        if not many.isEmpty():
            near = near.unionByName(_rare_pairs(_sets(texts, many, id_col, text_col, id_type, width, least_words), id_col, similarity))
    near = near.distinct()

    # of two sets at most so much is common as the sizes and the bitmaps allow; nothing that is similar falls below
    sized = reps.select("class_id", "size", "bits")
    side = lambda x: sized.select(F.col("class_id").alias(x), F.col("size").alias(f"n{x}"), F.col("bits").alias(f"m{x}"))
    only = lambda x, y: sum((F.bit_count(F.get(x, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(i))))) for i in range(1, BITS)), F.bit_count(F.get(x, F.lit(0)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(0))))))
    most = F.least(F.col("na") - only("ma", "mb"), F.col("nb") - only("mb", "ma"))
    likely = cut(near.join(side("a"), "a").join(side("b"), "b").filter(most >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9).select("a", "b"))

    wanted = likely.select(F.col("a").alias(id_col)).union(likely.select(F.col("b").alias(id_col))).distinct()
    sets = _sets(texts, wanted, id_col, text_col, id_type, width, least_words)
    both = likely.join(sets.select(F.col(id_col).alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col(id_col).alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    ratio = both.select("a", "b", common.alias("c"), (F.size("sa") + F.size("sb")).alias("t")).select("a", "b", (F.col("c") / (F.col("t") - F.col("c"))).alias("similarity"))
    pairs = ratio.filter(F.col("similarity") >= similarity).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity").distinct()
    return members, pairs


def _sets(texts: DataFrame, wanted: DataFrame, id_col: str, text_col: str, id_type: T.DataType, width: int, least_words: int) -> DataFrame:
    """(id, shingles) of the wanted ids, kept in the shared folder."""
    whole, schema = _whole_sets(id_col, text_col, id_type, width, least_words)
    return cut(texts.join(wanted, id_col, "left_semi").mapInPandas(whole, schema))


def document_pairs(members: DataFrame, pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(<id>_a, <id>_b), a < b, of all similar and equal records, copies expanded: as many rows as there are pairs. Where classes and links do, use near_duplicates or groups."""
    a, b = members.select(F.col(id_col).alias("x"), F.col("class_id").alias("class_a")), members.select(F.col(id_col).alias("y"), F.col("class_id").alias("class_b"))
    across = pairs.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("x", "y")
    within = a.join(b, a.class_a == b.class_b).filter("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).distinct()


def groups(members: DataFrame, pairs: DataFrame, id_col: str = "doc_id", rounds: int = 40) -> DataFrame:
    """(id, class_id, group_id, links): the group of records connected by pairs, named by its least class, and the number of other classes a record's class is linked to.

    Groups come by repeatedly taking the least name among neighbours and then the name of that name, until nothing changes; the
    links stay distributed and lineage is cut every round.
    """
    links = cut(pairs.select("class_a", "class_b").union(pairs.select("class_b", "class_a")).toDF("x", "y"))
    names = cut(links.select("x").distinct().select("x", F.col("x").alias("g")))
    hubs = heavy_keys(links, ["y"])  # the links of these are spread in every round
    for _ in range(rounds):
        offered = salted_join(links, names.withColumnRenamed("x", "y"), ["y"], "inner", hubs).groupBy("x").agg(F.min("g").alias("o"))
        closer = names.join(offered, "x").select("x", "g", F.least("g", "o").alias("n"))
        jumped = closer.join(names.select(F.col("x").alias("n"), F.col("g").alias("nn")), "n").select("x", "g", F.least("n", "nn").alias("n"))
        step = cut(jumped)
        changed = step.filter("n <> g").limit(1).count()
        names = step.select("x", F.col("n").alias("g"))
        if not changed:
            break
    else:
        raise RuntimeError(f"groups did not settle within {rounds} rounds")
    degree = links.groupBy("x").agg(F.count(F.lit(1)).alias("links"))
    known = names.join(degree, "x").withColumnRenamed("x", "class_id")
    return lookup_join(members, known, ["class_id"], "left").select(id_col, "class_id", F.coalesce("g", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
