"""The evaluation loop on the samples, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.functions import text
from loreline.operators import evaluation, metrics, rank, trajectories
from loreline.operators.samples import current_samples, snapshot_chunks
from loreline.operators.snapshots import snapshot_index
from loreline.plans.data_quality import SNAPSHOTS_SQL
from loreline.plans.retrieval import _F, BM25_SQL, BUDGET_SQL, LEXICAL_SQL, RANKED_SQL, SAMPLES_SQL, TERMS_SQL, ranking_sql
from loreline.sources.tables import table

FILTER = "all_files"


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All current samples with why they are skipped, and the chunks of their snapshots."""
    t = table(spark, folder, "comment2context")
    fixes = t.groupBy(F.col("id").alias("sample_id")).agg(F.max_by("gold.fix_commit", "version").alias("fix_commit"))
    samples = current_samples(t).join(fixes, "sample_id")
    chunks = snapshot_chunks(table(spark, folder, "chunks"), samples)
    sizes = chunks.groupBy("repo", "base_commit").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.skip_reasons(samples, snapshot_index(table(spark, folder, "corpus_manifest")), sizes), chunks


def eval_skips(spark: SparkSession, folder: str) -> DataFrame:
    return _judged(spark, folder)[0].groupBy(F.coalesce("skip", F.lit("evaluated")).alias("reason")).agg(F.count(F.lit(1)).alias("samples"))


def _evaluated(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    samples, chunks = _judged(spark, folder)
    left = samples.filter("skip is null").withColumn("query_text", F.coalesce("query_text", F.lit("")))
    return left, evaluation.ranker(name)(left, chunks)


M22 = ["mrr", "coverage_auc_20", "gold_coverage", "pollution", "gold_ratio", "context_efficiency", "redundancy", *[f"{m}_{k}" for k in (5, 10, 20) for m in ("recall", "precision", "f05", "irrelevant", "negatives")]]


def eval_lexical(spark: SparkSession, folder: str) -> DataFrame:
    samples, r = _evaluated(spark, folder, "lexical")
    return evaluation.sample_metrics(r, samples).select("sample_id", "task_type", *[F.round(F.col(m).cast("double"), 6).alias(m) for m in M22])


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    samples, r = _evaluated(spark, folder, "bm25")
    return metrics.summarize(evaluation.sample_metrics(r, samples), M22)


FUSION = ["mrr", "ndcg_20", "coverage_auc_20", *[f"{m}_{k}" for k in (5, 10, 20) for m in ("recall", "precision", "f05", "any")]]


def _fused(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    samples, chunks = _judged(spark, folder)
    left = samples.filter("skip is null").withColumn("query_text", F.coalesce("query_text", F.lit("")))
    return left, rank.fuse({n: rank.files(f(left, chunks)).filter("rank <= 20") for n, f in evaluation.RANKERS.items()})


def fusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    samples, fused = _fused(spark, folder)
    return evaluation.fusion_metrics(fused, samples).select("sample_id", *[F.round(m, 6).alias(m) for m in FUSION])


def fusion_report(spark: SparkSession, folder: str) -> DataFrame:
    """The fused list against its components, all by the metrics of fused lists on the first 20 files."""
    samples, chunks = _judged(spark, folder)
    left = samples.filter("skip is null").withColumn("query_text", F.coalesce("query_text", F.lit("")))
    runs = {n: rank.files(f(left, chunks)).filter("rank <= 20") for n, f in evaluation.RANKERS.items()}
    runs["fused"] = rank.fuse(dict(runs))
    out = None
    for name, r in runs.items():
        part = metrics.summarize(evaluation.fusion_metrics(r, left), FUSION).select(F.lit(name).alias("run"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def select_shard(spark: SparkSession, folder: str) -> DataFrame:
    """The second of three shards of a run over the samples that the keep list names."""
    s = current_samples(table(spark, folder, "comment2context")).select("sample_id")
    return evaluation.select_samples(s, ["sample_id"], ids=table(spark, folder, "keep_list"), shards=3, shard=1).select("sample_id", F.col("place").cast("long").alias("place"))


def sample_refs(spark: SparkSession, folder: str) -> DataFrame:
    s = current_samples(table(spark, folder, "comment2context")).select("sample_id", "repo", "base_commit")
    return evaluation.sample_refs(s, ["sample_id"], keep=table(spark, folder, "keep_list"))


def resume_state(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of a run whose finished rows are the keep list, and what is wrong with these."""
    s = current_samples(table(spark, folder, "comment2context")).select("sample_id", F.lit(FILTER).alias("candidate_filter"))
    done = table(spark, folder, "keep_list").select("sample_id", F.when(F.col("verdict").isNull(), "code_only").otherwise(FILTER).alias("candidate_filter"))
    left, wrong = evaluation.pending(s, done)
    return left.select("sample_id", F.lit("pending").alias("state")).unionByName(wrong.select("sample_id", F.col("problem").alias("state")))


def details_integrity(spark: SparkSession, folder: str) -> DataFrame:
    s = current_samples(table(spark, folder, "comment2context")).select("sample_id")
    return evaluation.integrity(table(spark, folder, "keep_list").select("sample_id").dropna(), s)


_TRAJ = [f"{n}_{m}" for n in ("retrieved", "final", "utilized") for m in ("recall", "precision", "f1")]


def ranked_as_trajectory(spark: SparkSession, folder: str) -> DataFrame:
    """A ranking's first five files judged as the final context of an agent, over all samples and by task."""
    samples, r = _evaluated(spark, folder, "lexical")
    t = trajectories.set_metrics(evaluation.as_trajectory(rank.files(r), 5), samples.select("sample_id", "gold_files")).join(samples.select("sample_id", "task_type"), "sample_id")
    return metrics.summarize(t, _TRAJ)


def scripted_search(spark: SparkSession, folder: str) -> DataFrame:
    samples, chunks = _judged(spark, folder)
    left = samples.filter("skip is null").withColumn("query_text", F.coalesce("query_text", F.lit("")))
    ranked = rank.bm25(left, chunks).join(left.select("sample_id", "repo", "base_commit"), "sample_id")
    texts = chunks.filter("kind = 'file'").select("repo", "base_commit", "path", "text")
    out = evaluation.scripted_search(ranked, texts)
    return out.select("sample_id", F.col("step").cast("long").alias("step"), "tool", "path", F.col("chars").cast("long").alias("chars"))


def best_chunks(spark: SparkSession, folder: str) -> DataFrame:
    _, r = _evaluated(spark, folder, "bm25")
    return evaluation.best_chunks(r).select("sample_id", "path", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_REASON = f"""CASE WHEN len(gold_files) = 0 THEN 'no_gold'
  WHEN regexp_matches(replace(coalesce(query_text, ''), '\\n', chr(10)), '{text.PATCH_MARKER}') OR (trim(coalesce(fix, '')) <> '' AND contains(replace(coalesce(query_text, ''), '\\n', chr(10)), trim(fix))) THEN 'query_leakage'
  WHEN NOT coalesce(p.counts, false) THEN 'missing_corpus' WHEN coalesce(z.n, 0) = 0 THEN 'empty_corpus' END"""
_JUDGED = SNAPSHOTS_SQL.strip() + f""",
fx AS (SELECT id, gold.fix_commit AS fix FROM now), cz AS (SELECT repo, base_commit, count(*) AS n FROM cur GROUP BY ALL),
judged AS (SELECT e.*, {_REASON} AS skip FROM every e JOIN fx ON fx.id = e.sample_id LEFT JOIN snapshots p ON p.repo = e.repo AND p.base_commit = e.base_commit LEFT JOIN cz z ON z.repo = e.repo AND z.base_commit = e.base_commit),
"""
# the samples that are evaluated take the place of all samples in the rankers' SQL
_BASE = SAMPLES_SQL.replace("{filter}", "true")
_HEAD, _TAIL = _BASE.split("samples AS (", 1)
_TAIL = _TAIL.split("),\n", 1)[1]
_CUR, _CAND = _TAIL.split("cand AS", 1)
_LEFT = _HEAD + _CUR + _JUDGED + "samples AS (SELECT * REPLACE (coalesce(query_text, '') AS query_text) FROM judged WHERE skip IS NULL),\ncand AS" + _CAND


def left_sql(name: str) -> str:
    return _LEFT + TERMS_SQL + (LEXICAL_SQL if name == "lexical" else BM25_SQL) + RANKED_SQL


_PK = lambda k, p: f"h{k} / n_gold AS recall_{k}, h{k} / {p} AS precision_{k}, {_F(f'(h{k} / {p})', f'(h{k} / n_gold)')} AS f05_{k}"
_M22 = BUDGET_SQL + """,
mk AS (SELECT f.*, list_contains(s.gold_files, f.path) AS gold, list_contains(s.hard_negatives, f.path) AS negative, len(s.gold_files) AS n_gold, s.task_type FROM frank f JOIN samples s USING (sample_id)),
sm AS (SELECT sample_id, any_value(task_type) AS task_type, any_value(n_gold) AS n_gold, count(*) AS n, min(rank) FILTER (WHERE gold) AS first, sum(CASE WHEN gold THEN greatest(0, 21 - rank) ELSE 0 END) AS auc, """ + ", ".join(f"count(*) FILTER (WHERE gold AND rank <= {k}) AS h{k}, count(*) FILTER (WHERE negative AND rank <= {k}) AS negatives_{k}" for k in (5, 10, 20)) + """ FROM mk GROUP BY sample_id),
cx AS (SELECT f.*, list_contains(s.gold_files, f.path) AS gold FROM fits f JOIN samples s USING (sample_id)),
ca AS (SELECT sample_id, count(*) AS chunks, count(DISTINCT path) FILTER (WHERE gold) AS found, count(DISTINCT path) AS paths, sum(CASE WHEN gold THEN 0 ELSE chars END) AS pollution, sum(CASE WHEN gold THEN chars ELSE 0 END) AS gold_chars FROM cx GROUP BY sample_id),
m AS (SELECT sample_id, task_type, coalesce(1.0 / first, 0) AS mrr, auc / (20.0 * n_gold) AS coverage_auc_20, found / n_gold AS gold_coverage, pollution, CASE WHEN gold_chars + pollution > 0 THEN gold_chars / (gold_chars + pollution) ELSE 0 END AS gold_ratio,
      CASE WHEN gold_chars + pollution > 0 THEN gold_chars / (gold_chars + pollution) ELSE 0 END AS context_efficiency, (chunks - paths) / chunks AS redundancy, """ + ", ".join(f"{_PK(k, f'least({k}, n)')}, least({k}, n) - h{k} AS irrelevant_{k}, negatives_{k}" for k in (5, 10, 20)) + """ FROM sm JOIN ca USING (sample_id))
"""
_TWO = (
    _LEFT + TERMS_SQL + LEXICAL_SQL.replace("hits", "hits_l").replace("scored AS", "scored_l AS")
    + RANKED_SQL.replace("ranking", "ranking_l").replace("scored", "scored_l").replace("ffirst", "ffirst_l").replace("frank AS", "frank_l AS") + ", " + BM25_SQL + RANKED_SQL
    + """, runs AS (SELECT 'bm25' AS run, sample_id, path, rank FROM frank WHERE rank <= 20 UNION ALL SELECT 'lexical', sample_id, path, rank FROM frank_l WHERE rank <= 20),
fs AS (SELECT sample_id, path, sum(1.0 / (60 + rank)) AS s FROM runs GROUP BY ALL),
fused AS (SELECT 'fused' AS run, sample_id, path, row_number() OVER (PARTITION BY sample_id ORDER BY round(s, 12) DESC, path) AS rank FROM fs QUALIFY rank <= 20),
allr AS (SELECT * FROM runs UNION ALL SELECT * FROM fused),
fk AS (SELECT r.*, list_contains(s.gold_files, r.path) AS gold, len(s.gold_files) AS n_gold, s.task_type FROM allr r JOIN samples s USING (sample_id)),
fm0 AS (SELECT run, sample_id, any_value(task_type) AS task_type, any_value(n_gold) AS n_gold, min(rank) FILTER (WHERE gold) AS first, sum(CASE WHEN gold THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN gold THEN 21 - rank ELSE 0 END) AS auc, """
    + ", ".join(f"count(*) FILTER (WHERE gold AND rank <= {k}) AS h{k}" for k in (5, 10, 20)) + """ FROM fk GROUP BY ALL),
fm AS (SELECT run, sample_id, task_type, coalesce(1.0 / first, 0) AS mrr, dcg / list_sum(list_transform(range(1, least(n_gold, 20) + 1), lambda i: 1 / log2(i + 1.0))) AS ndcg_20, auc / (20.0 * n_gold) AS coverage_auc_20, """
    + ", ".join(f"{_PK(k, f'{k}.0')}, CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END AS any_{k}" for k in (5, 10, 20)) + " FROM fm0)"
)
_ROUND = lambda cols: ", ".join(f"round(CAST({m} AS DOUBLE), 6) AS {m}" for m in cols)
_MEANS = lambda cols: "CASE WHEN grouping(task_type) = 1 THEN 'overall' ELSE task_type END AS scope, count(*) AS samples, " + ", ".join(f"round(avg(CAST({m} AS DOUBLE)), 6) AS {m}" for m in cols)
_KEEP = "(SELECT DISTINCT sample_id FROM keep_list WHERE sample_id IS NOT NULL)"
_T1 = lambda n: f"len(list_intersect(r, gold_files)) / len(gold_files) AS {n}_recall, len(list_intersect(r, gold_files)) / len(r) AS {n}_precision, CASE WHEN len(list_intersect(r, gold_files)) > 0 THEN 2 * (len(list_intersect(r, gold_files)) / len(gold_files)) * (len(list_intersect(r, gold_files)) / len(r)) / (len(list_intersect(r, gold_files)) / len(gold_files) + len(list_intersect(r, gold_files)) / len(r)) ELSE 0 END AS {n}_f1"

ORACLE = {
    "eval_skips": _HEAD + _CUR + _JUDGED.rstrip().rstrip(",") + " SELECT coalesce(skip, 'evaluated') AS reason, count(*) AS samples FROM judged GROUP BY 1",
    "eval_lexical": left_sql("lexical") + _M22 + f"SELECT sample_id, task_type, {_ROUND(M22)} FROM m",
    "eval_summary": left_sql("bm25") + _M22 + f"SELECT {_MEANS(M22)} FROM m GROUP BY GROUPING SETS ((), (task_type))",
    "fusion_metrics": _TWO + f" SELECT sample_id, {_ROUND(FUSION)} FROM fm WHERE run = 'fused'",
    "fusion_report": _TWO + f" SELECT run, {_MEANS(FUSION)} FROM fm GROUP BY GROUPING SETS ((run), (run, task_type))",
    "select_shard": _BASE + f"r AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) AS place FROM every WHERE sample_id IN {_KEEP}) SELECT * FROM r WHERE (place - 1) % 3 = 1",
    "sample_refs": _BASE + f"r AS (SELECT repo, base_commit, min(sample_id) AS first FROM every WHERE repo IS NOT NULL AND base_commit IS NOT NULL AND sample_id IN {_KEEP} GROUP BY 1, 2) SELECT * FROM r",
    "resume_state": _BASE + "d AS (SELECT sample_id, count(*) AS n, min(CASE WHEN verdict IS NULL THEN 'code_only' ELSE 'all_files' END) AS f FROM keep_list GROUP BY 1), w AS (SELECT d.sample_id, CASE WHEN e.sample_id IS NULL THEN 'unexpected' WHEN n > 1 THEN 'repeated' WHEN f <> 'all_files' THEN 'candidate_filter' END AS state FROM d LEFT JOIN every e USING (sample_id)) SELECT sample_id, 'pending' AS state FROM every WHERE sample_id NOT IN (SELECT sample_id FROM d WHERE sample_id IS NOT NULL) UNION ALL SELECT * FROM w WHERE state IS NOT NULL",
    "details_integrity": _BASE + "d AS (SELECT sample_id, count(*) AS n FROM keep_list WHERE sample_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN e.sample_id IS NULL THEN 'unexpected' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' ELSE 'fine' END AS problem, count(*) AS samples FROM d FULL JOIN every e ON e.sample_id = d.sample_id GROUP BY 1",
    "ranked_as_trajectory": left_sql("lexical") + f", tr AS (SELECT f.sample_id, list(path) AS r, any_value(gold_files) AS gold_files, any_value(task_type) AS task_type FROM frank f JOIN samples s USING (sample_id) WHERE rank <= 5 GROUP BY 1), tm AS (SELECT sample_id, task_type, {_T1('retrieved')}, {_T1('final')}, {_T1('utilized')} FROM tr) SELECT {_MEANS(_TRAJ)} FROM tm GROUP BY GROUPING SETS ((), (task_type))",
    "scripted_search": left_sql("bm25") + ", tx AS (SELECT repo, base_commit, path, text FROM cand WHERE kind = 'file') SELECT DISTINCT sample_id, 1 AS step, 'search' AS tool, NULL AS path, 0 AS chars FROM ranking UNION ALL SELECT f.sample_id, f.rank + 1, 'read', f.path, least(4000, coalesce(length(t.text), 0)) FROM frank f JOIN samples s USING (sample_id) LEFT JOIN tx t ON t.repo = s.repo AND t.base_commit = s.base_commit AND t.path = f.path WHERE f.rank < 4",
    "best_chunks": left_sql("bm25") + ", bc AS (SELECT sample_id, path, arg_min(chunk_id, rank) AS chunk_id, arg_min(score, rank) AS score, min(rank) AS r FROM ranking WHERE path <> '' GROUP BY ALL) SELECT sample_id, path, chunk_id, row_number() OVER (PARTITION BY sample_id ORDER BY r) AS rank, round(score, 6) AS score FROM bc QUALIFY rank <= 20",
}
_ALL = [eval_skips, eval_lexical, eval_summary, fusion_metrics, fusion_report, select_shard, sample_refs, resume_state, details_integrity, ranked_as_trajectory, scripted_search, best_chunks]
QUERIES = {f.__name__: f for f in _ALL}
