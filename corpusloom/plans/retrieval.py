"""Retrieval queries over embeddings: every tenth vector is a query, the rest the corpus, and vectors of one label are relevant to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import reports, search, vectors

DIMS = (64, 32, 16)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.col("label").alias("q_label"))
    return q, e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), F.col("label").alias("c_label"))


def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = _sides(spark, sf_dir)
    return vectors.top_k(q.select("qid", "vec"), c.select("cid", "vec"), 10, [64]).select("qid", "cid", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


def _metrics(spark: SparkSession, sf_dir: str, dims: tuple[int, ...], least: float = -2.0) -> DataFrame:
    q, c = _sides(spark, sf_dir)
    hits = vectors.top_k(q.select("qid", "vec"), c.select("cid", "vec"), 100, dims).where(F.col("sim") >= least)
    judged = hits.join(q.select("qid", "q_label"), "qid").join(c.select("cid", "c_label"), "cid").withColumn("hit", F.col("q_label") == F.col("c_label"))
    relevant = q.join(c.groupBy("c_label").agg(F.count(F.lit(1)).alias("n_rel")), F.col("q_label") == F.col("c_label")).select("qid", "n_rel")
    return vectors.metrics(judged.select("dim", "qid", "rank", "hit"), relevant, dims).select(F.col("dim").cast("long").alias("dim"), *[F.round(m, 6).alias(m) for m in vectors.METRICS])


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, (64,))


#: So high that some queries have no hit at all.
LEAST = 0.4


def retrieval_metrics_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of what is at least so similar; queries without a hit count 0."""
    return _metrics(spark, sf_dir, (64,), LEAST)


def matryoshka_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir, DIMS)


#: Rows of a block, so that blocks of the test tables are met in pairs, as those of large ones.
BLOCK = 64


def retrieval_topk_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as ``retrieval_topk``, at two dimensions, by many small blocks whose pairs are searched in the order of their bounds."""
    q, c = _sides(spark, sf_dir)
    hits, _ = search.search(q.select("qid", "vec"), c.select("cid", "vec"), 10, DIMS[:2], query_block=BLOCK, corpus_block=BLOCK)
    return hits.select(F.col("dim").cast("long").alias("dim"), "qid", "cid", F.round("sim", 6).alias("sim"), F.col("rank").cast("long").alias("rank"))


#: Every tenth block of 20 rows are queries, so that each of the test tables' sources has both.
_ASKS = "vec_id div 20 % 10 = 0"


def _in_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Queries and corpus, each row once in the set ``combined`` and once in that of the source of the document of its number."""
    sources = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "source")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").join(sources, "vec_id", "left")
    rows = rows.withColumn("eval_set", F.explode(F.array(F.lit("combined"), F.col("source")))).where("eval_set is not null")
    q = rows.where(_ASKS).select("eval_set", F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.col("label").alias("q_label"))
    return q, rows.where(f"not ({_ASKS})").select("eval_set", F.col("vec_id").alias("cid"), F.col("embedding").alias("vec"), F.col("label").alias("c_label"))


def sweep_in_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every set at every dimension; a query is ranked against the corpus of each set that it is in, by one search."""
    q, c = _in_sets(spark, sf_dir)
    hits = vectors.top_k(q.select("eval_set", "qid", "vec"), c.select("eval_set", "cid", "vec"), 100, DIMS, "eval_set")
    judged = hits.join(q.select("eval_set", "qid", "q_label"), ["eval_set", "qid"]).join(c.select("eval_set", "cid", "c_label"), ["eval_set", "cid"]).withColumn("hit", F.col("q_label") == F.col("c_label"))
    n_rel = c.groupBy("eval_set", F.col("c_label").alias("q_label")).agg(F.count(F.lit(1)).alias("n_rel"))
    relevant = q.join(n_rel, ["eval_set", "q_label"]).select("eval_set", "qid", "n_rel")
    return vectors.metrics(judged, relevant, DIMS, "eval_set").select("eval_set", F.col("dim").cast("long").alias("dim"), *[F.round(m, 6).alias(m) for m in vectors.METRICS])


def best_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each set the dimension of the highest score, the smallest of equals."""
    return reports.best(sweep_in_sets(spark, sf_dir), ["eval_set"], "dim", "ndcg_10")


def _gold(q: DataFrame, c: DataFrame) -> DataFrame:
    """The gold row of a query is the smallest corpus id of its label."""
    first = c.groupBy("c_label").agg(F.min("cid").alias("gold_cid"))
    pairs = q.join(first, F.col("q_label") == F.col("c_label")).select("qid", "vec", "gold_cid")
    other = c.select(F.col("cid").alias("gold_cid"), F.col("vec").alias("gold_vec"))
    dot = F.aggregate(F.zip_with(vectors.normalised(F.col("vec")), vectors.normalised(F.col("gold_vec")), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return pairs.join(other, "gold_cid").select("qid", "gold_cid", F.round(dot, 12).alias("gold_sim"))


def _mined(spark: SparkSession, sf_dir: str, **filters) -> tuple[DataFrame, DataFrame, DataFrame]:
    q, c = _sides(spark, sf_dir)
    gold = _gold(q, c)
    return vectors.negatives(q.select("qid", "vec"), c.select("cid", "vec"), gold, 5, 64, **filters), gold, q


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir)[0].select("qid", F.col("seat").cast("long").alias("seat"), "cid", F.round("sim", 6).alias("sim"))


#: First rank, margin and highest similarity.
MINING = {"range_min": 5, "margin": 0.1, "max_score": 0.9}


def hard_negatives_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mined(spark, sf_dir, **MINING)[0].select("qid", F.col("seat").cast("long").alias("seat"), "cid", F.round("sim", 6).alias("sim"))


def hard_negatives_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _, q = _mined(spark, sf_dir, **MINING)
    return vectors.widened(found.withColumn("text", F.col("cid").cast("string")), q, 5)


def mining_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries, those short of negatives, and mean, least and largest similarity of the gold rows."""
    mined, gold, _ = _mined(spark, sf_dir, **MINING)
    found = mined.groupBy("qid").agg(F.count(F.lit(1)).alias("k"))
    full = gold.join(found, "qid", "left")
    return full.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum((F.coalesce("k", F.lit(0)) < 5).cast("long")).alias("n_insufficient"),
        F.round(F.avg("gold_sim"), 6).alias("mean_sim"),
        F.round(F.min("gold_sim"), 6).alias("min_sim"),
        F.round(F.max("gold_sim"), 6).alias("max_sim"),
    )


def mining_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong rows that each filter of the mining passes over."""
    q, c = _sides(spark, sf_dir)
    return vectors.skipped(q.select("qid", "vec"), c.select("cid", "vec"), _gold(q, c), 5, 64, **MINING)


def collapse_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's vector with its gold row and the corpus row after the query's id."""
    q, c = _sides(spark, sf_dir)
    gold = _gold(q, c).select("qid", F.col("gold_cid").alias("cid")).join(c.select("cid", F.col("vec").alias("relevant")), "cid").select("qid", "relevant")
    after = c.select((F.col("cid") - 1).alias("qid"), F.col("vec").alias("irrelevant"))
    rows = q.select("qid", F.col("vec").alias("anchor")).join(gold, "qid").join(after, "qid").withColumnRenamed("qid", "id")
    out = vectors.collapse(rows)
    return out.select("id", *[F.round(x, 6).alias(x) for x in out.columns if x != "id"])


QUERIES = {f.__name__: f for f in (best_dimension, sweep_in_sets, retrieval_topk_bounded, retrieval_metrics_cut, mining_skips, collapse_diagnostic, retrieval_topk, retrieval_metrics, matryoshka_sweep, hard_negatives, hard_negatives_filtered, hard_negatives_wide, mining_counters)}


def _ranked(dims: tuple[int, ...], sets: bool = False) -> str:
    member = "embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id" if sets else "embeddings e"
    names = "unnest(['combined', source])" if sets else "''"
    asks = "{0}.vec_id // 20 % 10 = 0" if sets else "{0}.vec_id % 10 = 0"
    return f"""
b AS (SELECT {names} AS eval_set, vec_id, label, embedding FROM {member}),
e AS (SELECT d.dim, eval_set, vec_id, label, list_transform(embedding[1:d.dim], lambda x: x::DOUBLE) AS v FROM b, (SELECT unnest({list(dims)}) AS dim) d WHERE eval_set IS NOT NULL),
u AS (SELECT dim, eval_set, vec_id, label, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-9)) AS v FROM e),
s AS (SELECT q.dim, q.eval_set, q.vec_id AS qid, c.vec_id AS cid, q.label = c.label AS hit, round(list_dot_product(q.v, c.v), 12) AS sim
      FROM u q JOIN u c ON q.dim = c.dim AND q.eval_set = c.eval_set AND {asks.format("q")} AND NOT {asks.format("c")}),
r AS (SELECT *, row_number() OVER (PARTITION BY eval_set, dim, qid ORDER BY sim DESC, cid) AS rank FROM s)"""


def _metrics_sql(dims: tuple[int, ...], least: float = -2.0, sets: bool = False) -> str:
    cols = ["round(avg(dcg / ideal), 6) AS ndcg_10", "round(avg(coalesce(1.0 / first, 0)), 6) AS mrr_10", "round(avg(ap / n_rel), 6) AS map_100"]
    for k in (1, 3, 5, 10):
        cols += [f"round(avg(h{k} / n_rel), 6) AS recall_{k}", f"round(avg(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy_{k}", f"round(avg(h{k} / {k}), 6) AS precision_{k}"]
    return f"""WITH {_ranked(dims, sets)},
g AS (SELECT * EXCLUDE (hit), hit AND sim >= {least}::DOUBLE AS hit, sum(hit::INT) OVER (PARTITION BY eval_set, dim, qid) AS n_rel FROM r),
h AS (SELECT *, sum(hit::INT) OVER (PARTITION BY eval_set, dim, qid ORDER BY rank) AS so_far FROM g),
p AS (SELECT eval_set, dim, qid, n_rel, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) AS dcg, min(rank) FILTER (hit AND rank <= 10) AS first,
        coalesce(sum(so_far / rank) FILTER (hit AND rank <= 100), 0) AS ap, {", ".join(f"(count(*) FILTER (hit AND rank <= {k}))::DOUBLE AS h{k}" for k in (1, 3, 5, 10))}
      FROM h WHERE n_rel > 0 GROUP BY ALL),
i AS (SELECT n, sum(1 / log2(k + 1)) AS ideal FROM (SELECT unnest(range(1, 11)) AS n) JOIN (SELECT unnest(range(1, 11)) AS k) ON k <= n GROUP BY n)
SELECT {"eval_set, " if sets else ""}dim::BIGINT AS dim, {", ".join(cols)} FROM p JOIN i ON i.n = least(10, n_rel) GROUP BY {"eval_set, " if sets else ""}dim"""


_GOLD = """, g AS (SELECT qid, cid AS gold_cid, sim AS gold_sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cid) AS o FROM r WHERE hit) WHERE o = 1),
w AS (SELECT r.qid, r.cid, r.sim, gold_sim, row_number() OVER (PARTITION BY r.qid ORDER BY r.sim DESC, r.cid) - 1 AS wr FROM r JOIN g USING (qid) WHERE r.cid <> gold_cid),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, cid) AS seat FROM w WHERE wr >= 5 AND sim <= 0.9 AND sim <= gold_sim - 0.1)"""

SQL = {
    "retrieval_topk": f"WITH {_ranked((64,))} SELECT qid, cid, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10",
    "retrieval_topk_bounded": f"WITH {_ranked(DIMS[:2])} SELECT dim::BIGINT AS dim, qid, cid, round(sim, 6) AS sim, rank FROM r WHERE rank <= 10",
    "sweep_in_sets": _metrics_sql(DIMS, sets=True),
    "best_dimension": f"SELECT eval_set, dim, ndcg_10 FROM (SELECT *, row_number() OVER (PARTITION BY eval_set ORDER BY ndcg_10 DESC, dim) AS o FROM ({_metrics_sql(DIMS, sets=True)})) WHERE o = 1",
    "retrieval_metrics": _metrics_sql((64,)),
    "matryoshka_sweep": _metrics_sql(DIMS),
    "retrieval_metrics_cut": _metrics_sql((64,), LEAST),
    "mining_skips": f"""WITH {_ranked((64,))} {_GOLD}, k AS (SELECT g.qid, count(f.cid) AS k FROM g LEFT JOIN f ON f.qid = g.qid GROUP BY ALL)
SELECT sum((wr < 5)::INT)::BIGINT AS skipped_range, sum((wr >= 5 AND sim > 0.9)::INT)::BIGINT AS skipped_max, sum((wr >= 5 AND sim <= 0.9 AND sim > gold_sim - 0.1)::INT)::BIGINT AS skipped_margin,
  (SELECT count(*) FROM k WHERE k < 5) AS skipped_match, (SELECT count(*) FROM k WHERE k < 5) AS insufficient FROM w""",
    "collapse_diagnostic": f"""WITH {_ranked((64,))} {_GOLD}, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
t AS (SELECT g.qid AS id, a.v AS a, b.v AS b, c.v AS c FROM g JOIN v a ON a.vec_id = g.qid JOIN v b ON b.vec_id = gold_cid JOIN v c ON c.vec_id = g.qid + 1),
n AS (SELECT id, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(b, b)) AS nb, sqrt(list_dot_product(c, c)) AS nc, list_dot_product(a, b) AS ab, list_dot_product(a, c) AS ac FROM t)
SELECT id, round(na, 6) AS norm_anchor, round(nb, 6) AS norm_relevant, round(nc, 6) AS norm_irrelevant, round(ab / na / nb, 6) AS cos_relevant, round(ac / na / nc, 6) AS cos_irrelevant, round(ab / na / nb - ac / na / nc, 6) AS gap FROM n""",
    "hard_negatives": f"WITH {_ranked((64,))} {_GOLD} SELECT qid, wr + 1 AS seat, cid, round(sim, 6) AS sim FROM w WHERE wr < 5",
    "hard_negatives_filtered": f"WITH {_ranked((64,))} {_GOLD} SELECT qid, seat, cid, round(sim, 6) AS sim FROM f WHERE seat <= 5",
    "hard_negatives_wide": f"WITH {_ranked((64,))} {_GOLD} SELECT g.qid, " + ", ".join(f"coalesce(max(f.cid::VARCHAR) FILTER (seat = {i}), '') AS negative_{i}" for i in range(1, 6)) + " FROM g LEFT JOIN f ON f.qid = g.qid GROUP BY g.qid",
    "mining_counters": f"WITH {_ranked((64,))} {_GOLD}, k AS (SELECT g.qid, g.gold_sim AS gold_sim, least(count(f.cid), 5) AS k FROM g LEFT JOIN f ON f.qid = g.qid GROUP BY ALL) SELECT count(*) AS n_queries, (count(*) FILTER (k < 5))::BIGINT AS n_insufficient, round(avg(gold_sim), 6) AS mean_sim, round(min(gold_sim), 6) AS min_sim, round(max(gold_sim), 6) AS max_sim FROM k",
}
