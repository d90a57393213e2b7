"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreline.llm.tokens import TOKENIZER, same_spelling, sized
from loreline.session import cut

#: Steps into which the ranks of a source are sorted before only the one step in which the selection ends is ordered.
STEPS = 4096
#: Sizes to the octave for which chances of inclusion are solved for.
SIZES = 4


def fill(sources: dict[str, tuple[float, float]], goal: float) -> dict[str, float]:
    """How much each of the sources (share, most it can give) gives towards goal.

    Shares hold among those that can give theirs; what the others fall short of is shared by these, as far as they can.
    """
    gives: dict[str, float] = {}
    while True:
        rest = goal - sum(gives.values())
        free = {s: x for s, x in sources.items() if s not in gives}
        shares = sum(share for share, _ in free.values())
        short = {s: most for s, (share, most) in free.items() if shares > 0 and share / shares * rest >= most}
        if not short or shares <= 0:
            return gives | {s: share / shares * rest if shares > 0 else 0.0 for s, (share, _) in free.items()}
        gives |= short


def mix(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_share: float = 0.5, seed: int = 9, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens, copies): the records of a mixture of total_share of all tokens of docs.

    targets has source, target_share and max_repeats; its share of the mixture is what a source is to give. A source
    that has to give its tokens w times over gives every record floor(w) times, but no more than max_repeats times; the rest is
    drawn without replacement by Pareto order sampling: records are ranked by the odds of a random number over the
    odds of their inclusion, and taken in that order until their tokens reach what is missing, at most by a part of
    the last record. The chance of a record's inclusion is in proportion to its size, up to 1, as long records are what
    decides how far a share is off; it is solved for from the tokens of each source in SIZES sizes to the octave, a
    bounded table. Ranks are first sorted into STEPS steps, whose sums tell in which step the
    selection ends; only the records of that one step are put in order, so that no source is sorted in one task.

    Sources are compared without case, surrounding blanks and the kind of separator; sources without target, null texts,
    null ids and texts without tokens are in no mixture but count in the total. A repeated target keeps its greatest row.
    Repeated ids are records of their own. Where a source has too little, even with all repeats, it gives all it has, and
    the others make up for it in proportion to their shares.
    """
    spark = docs.sparkSession
    rows = sized(docs.withColumn("_source", same_spelling(F.col(source_col))).withColumn("_text_id", F.xxhash64(text_col)), id_col, text_col, ["_source", "_text_id"], tokenizer)
    total = rows.agg(F.sum("tokens")).first()[0] or 0
    wanted = {}
    for t in targets.select(same_spelling(F.col("source")).alias("source"), "target_share", "max_repeats").dropna().orderBy("source", "target_share", "max_repeats").collect():
        wanted[t["source"]] = (max(0.0, t["target_share"]), max(0, t["max_repeats"]))
    out = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, source string, tokens bigint, copies int"
    if not wanted or not total:
        return spark.createDataFrame([], out)
    known = rows.filter(F.col("_source").isin(list(wanted)) & (F.col("tokens") > 0))
    weighed = known.select(id_col, F.col("_source").alias("source"), "_text_id", "tokens", F.round(F.log2("tokens") * SIZES).cast("int").alias("power"))
    sums: dict[str, dict[int, int]] = {}
    for r in weighed.groupBy("source", "power").agg(F.sum("tokens").alias("t")).collect():
        sums.setdefault(r["source"], {})[r["power"]] = r["t"]
    needs = fill({s: (wanted[s][0], sum(t.values()) * wanted[s][1]) for s, t in sums.items()}, total_share * total)
    plan = []
    for source, by_power in sorted(sums.items()):
        need, most = needs[source], wanted[source][1]
        have = sum(by_power.values())
        whole = min(most, int(need // have))
        rest = min(need - whole * have, have) if whole < most else 0.0
        chance, low, high = 1.0, 0.0, 1.0
        if 0 < rest < have:  # the factor c with sum of min(1, c * size) * tokens = rest
            for _ in range(100):
                c = (low + high) / 2
                low, high = (c, high) if sum(min(1.0, c * 2 ** (p / SIZES)) * t for p, t in by_power.items()) < rest else (low, c)
            chance = high
        plan.append((source, whole, float(rest), float(chance)))
    plan_df = spark.createDataFrame(plan, "source string, whole int, rest double, chance double")
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col("_text_id")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.least(F.lit(1.0 - 1e-12), F.col("chance") * F.pow(F.lit(2.0), F.col("power") / SIZES))
    rank = F.col("_u") / (1 - F.col("_u")) / (F.col("_p") / (1 - F.col("_p")))
    ranked = weighed.join(F.broadcast(plan_df), "source").withColumn("_u", u).withColumn("_p", p).withColumn("rank", rank)
    ranked = ranked.withColumn("step", F.floor(F.col("rank") / (1 + F.col("rank")) * STEPS).cast("int"))
    by_step: dict[str, list[tuple[int, int]]] = {}
    for r in ranked.filter("rest > 0").groupBy("source", "step").agg(F.sum("tokens").alias("t")).collect():
        by_step.setdefault(r["source"], []).append((r["step"], r["t"]))
    ends = []
    for source, _, rest, _ in plan:
        before = 0
        for step, t in sorted(by_step.get(source, [])):
            if before + t >= rest:
                ends.append((source, step, float(rest - before)))
                break
            before += t
        else:
            ends.append((source, STEPS + 1, 0.0))
    ended = ranked.join(F.broadcast(spark.createDataFrame(ends, "source string, last int, missing double")), "source")
    order = Window.partitionBy("source").orderBy("rank", id_col, "_text_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = ended.filter((F.col("step") == F.col("last")) & (F.col("rest") > 0)).withColumn("before", F.coalesce(F.sum("tokens").over(order), F.lit(0)))
    # the last record is taken if that comes nearer to the target than leaving it
    edge = edge.withColumn("drawn", (F.col("before") + F.col("tokens") / 2 <= F.col("missing")).cast("int")).drop("before")
    others = ended.filter((F.col("step") != F.col("last")) | (F.col("rest") <= 0)).withColumn("drawn", ((F.col("step") < F.col("last")) & (F.col("rest") > 0)).cast("int"))
    return others.unionByName(edge).withColumn("copies", F.col("whole") + F.col("drawn")).filter("copies > 0").select(id_col, "source", "tokens", F.col("copies").cast("int").alias("copies"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, records, most_copies) of every target, sources that gave nothing included."""
    got = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"))
    want = targets.select(same_spelling(F.col("source")).alias("source"), "target_share").dropna().groupBy("source").agg(F.max("target_share").alias("target_share"))
    both = want.join(got, "source", "left").na.fill(0, ["tokens", "records", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row a target: a bounded table
    return both.select("source", "target_share", F.when(total > 0, F.col("tokens") / total).alias("actual_share"), "tokens", "records", "most_copies")
