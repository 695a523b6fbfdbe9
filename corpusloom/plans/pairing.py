"""Queries on query-passage pairs, their splits, replies of a model, and scores."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import components as C
from corpusloom.operators import pairs as P
from corpusloom.operators import reports as R
from corpusloom.sources import tables
from corpusloom.streaming import arrivals


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the next assistant turn, then documents with their first sentence as the anchor."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    u, a = c.where("role = 'user'"), c.where("role = 'assistant'")
    turns = u.alias("u").join(a.alias("a"), (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("u.turn") + 1 == F.col("a.turn")))
    turns = turns.select(F.col("u.text").alias("anchor"), F.col("a.text").alias("positive"), F.concat_ws(":", "u.conv_id", "u.turn").alias("chunk_id"), F.lit("chat").alias("document_name"), (F.col("u.conv_id") * 1000 + F.col("u.turn")).alias("seq"))
    docs = _docs(spark, sf_dir).select(F.get(T.sentences(F.col("text")), F.lit(0)).alias("anchor"), F.col("text").alias("positive"), F.md5(F.col("text").cast("binary")).alias("chunk_id"), F.col("source").alias("document_name"), F.col("doc_id").alias("seq"))
    return P.union_all(turns, docs)


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("source_seq").cast("long").alias("source_seq"), "seq", "chunk_id", F.md5(F.col("anchor").cast("binary")).alias("anchor_md5"))


def pairs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(_pairs(spark, sf_dir))


def pairs_dedup_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(P.keep_first(_pairs(spark, sf_dir), ["anchor"], "source_seq", "seq"))


def pairs_dedup_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digest(P.keep_first(_pairs(spark, sf_dir), ["anchor", "chunk_id"], "source_seq", "seq"))


def split_chunk_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id")
    train, held = P.split(d, P.eval_ids(d, "doc_id"), "doc_id")
    return train.withColumn("part", F.lit("train")).union(held.withColumn("part", F.lit("eval")))


def split_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select("doc_id", "source")
    train, held = P.split(d, P.eval_ids(d, "doc_id", stratum="source"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("eval"))).select("doc_id", "source", "part")


def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that both parts of the stratified split hold: ids are apart, copies need not be."""
    d = _docs(spark, sf_dir).select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))
    train, held = P.split(d, P.eval_ids(d, "doc_id", stratum="source"), "doc_id")
    return P.leaks(train, held, "text_md5")


def split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs split by what is connected: no chunk and no anchor is in both parts."""
    rows = C.split_components(_pairs(spark, sf_dir), "anchor", "chunk_id", "document_name", ("source_seq", "seq"))
    return rows.select(F.col("source_seq").cast("long").alias("source_seq"), "seq", "chunk_id", F.md5(F.col("anchor").cast("binary")).alias("anchor_md5"), "component", "part")


def eval_triple_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("source").alias("cid"), F.md5(F.col("text").cast("binary")).alias("value"), F.col("doc_id").alias("seq"))
    return P.first_wins(rows, "cid", "value", "seq")


def eval_triple_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("source").alias("cid"), F.md5(F.col("text").cast("binary")).alias("value"), F.col("doc_id").alias("seq"))
    return P.last_wins(rows, "cid", "value", "seq")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model made from doc_id: plain, fenced, after thoughts, with prose around, and broken ones."""
    n = F.col("doc_id")
    body = F.concat(F.lit('{"queries": ["q'), n.cast("string"), F.lit('", '), F.when(n % 7 == 0, F.lit("1")).otherwise(F.lit('"b"')), F.lit("]}"))
    k = n % 5
    reply = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit('<think>{"queries": []}</think> '), body)).when(k == 3, F.concat(F.lit("Here: "), body, F.lit(" done"))).otherwise(F.lit('{"queries": ["cut'))
    return _docs(spark, sf_dir).select("doc_id", reply.alias("reply"))


def llm_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("doc_id", T.json_payload(F.col("reply")).alias("payload"))


def llm_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per query of a valid reply."""
    found = _replies(spark, sf_dir).select("doc_id", P.valid_queries(T.json_payload(F.col("reply"))).alias("q"))
    return found.select("doc_id", F.posexplode("q").alias("pos", "query")).select("doc_id", F.col("pos").cast("long").alias("pos"), "query")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from labels: documents without a label have none."""
    d = _docs(spark, sf_dir).select("doc_id").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "left")
    part = lambda a, b: (F.lit(a) + F.col("quality") * b - F.col("toxic") * 2).cast("string")
    overall = (F.lit(5.5) + F.col("quality") * 2.5 - F.col("toxic") * 1.5 + F.col("doc_id") % 3 * 0.5).cast("string")
    text = F.concat(F.lit('{"relevance": '), part(6, 2), F.lit(', "accuracy": '), part(5, 3), F.lit(', "clarity": '), part(4, 4), F.lit(', "specificity": '), part(3, 5), F.lit(', "overall": '), overall, F.lit("}"))
    return d.select("doc_id", P.valid_scores(text).alias("quality_scores"))


def _overall() -> Column:
    return F.col("quality_scores.overall")


def score_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, rejected = P.by_threshold(_scored(spark, sf_dir), _overall())
    both = kept.withColumn("kept", F.lit(True)).union(rejected.withColumn("kept", F.lit(False)))
    return both.select("doc_id", "kept", F.round(_overall(), 6).alias("overall"), F.round(P.weighted(F.col("quality_scores")), 6).alias("weighted"))


def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.score_statistics(_scored(spark, sf_dir), "quality_scores", [*P.WEIGHTS, "overall"])


def threshold_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.survivors(_scored(spark, sf_dir), _overall(), [5, 6, 6.5, 7, 7.5, 8])


def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text once, numbered in order."""
    return P.corpus_index(_docs(spark, sf_dir), "text").select("cid", F.md5(F.col("text").cast("binary")).alias("md5"))


def gold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the corpus of distinct texts."""
    d = _docs(spark, sf_dir).select("doc_id", "text")
    return P.with_index(d, P.corpus_index(d, "text"), "text").select("doc_id", "cid")


def _triple(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = _docs(spark, sf_dir).select(F.col("lang").alias("anchor"), "text", "source", "doc_id")
    rows = d.select("anchor", F.md5(F.col("text").cast("binary")).alias("positive"), (F.floor(F.col("doc_id") / 3)).alias("chunk_id"), "source", "doc_id")
    return P.evaluation_triple(rows, "doc_id", "source")


def evaluation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, _, relevant = _triple(spark, sf_dir)
    return queries.join(relevant, ["eval_set", "qid"]).select("eval_set", "qid", "text", "cid")


def evaluation_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three neighbouring documents are a chunk, of which the last text counts."""
    return _triple(spark, sf_dir)[1].select("eval_set", "cid", "text")


def split_first_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three neighbouring documents, in the stratum of their first one."""
    rows = _docs(spark, sf_dir).select(F.floor(F.col("doc_id") / 3).alias("chunk_id"), "source", "doc_id")
    chunks = P.first_stratum(rows, "chunk_id", "source", "doc_id")
    train, held = P.split(rows, P.eval_ids(chunks, "chunk_id", stratum="source"), "chunk_id")
    return train.withColumn("part", F.lit("train")).unionByName(held.withColumn("part", F.lit("eval"))).select("doc_id", "chunk_id", "part")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("source").alias("chunk_id"), "doc_id")
    train, held = P.split(rows, P.eval_ids(rows.select("doc_id"), "doc_id"), "doc_id")
    return R.split_statistics(train, held).select("part", "n_pairs", "n_chunks", "pairs_per_chunk", "n_shared")


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.training_columns(_pairs(spark, sf_dir).withColumn("section_type", F.when(F.col("source_seq") == 0, "chat")))
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return rows.select(md5("anchor"), md5("positive"), "chunk_id", "section_type", "hierarchy_path", "document_name")


def json_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as a new version of JSON lines and read back."""
    rows = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    at = tables.write_versioned(rows, f"{tables.shared_dir(spark)}/corpusloom/lines-{uuid.uuid4().hex[:12]}")
    return tables.json_lines(spark, at, "doc_id long, text string, lang string").select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("md5"))


def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with scores as arriving JSON lines: what the stream keeps and rejects."""
    at = f"{tables.shared_dir(spark)}/corpusloom/stream-{uuid.uuid4().hex[:12]}"
    scores = F.to_json(F.struct(*[F.col(f"quality_scores.{n}") for n in [*P.WEIGHTS, "overall"]]))
    _scored(spark, sf_dir).select(F.col("doc_id").alias("pair_id"), F.when(F.col("quality_scores").isNotNull(), F.concat(F.lit("Scores: "), scores)).otherwise("none").alias("reply")).write.json(f"{at}/in")
    arrivals.split_by_score(arrivals.scored_replies(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    both = [spark.read.parquet(f"{at}/out/{part}").select("pair_id", F.lit(part == "kept").alias("kept"), F.round("quality_scores.overall", 6).alias("overall")) for part in ("kept", "rejected")]
    return both[0].union(both[1])


QUERIES = {f.__name__: f for f in (split_components, corpus_index, gold_lookup, evaluation_queries, evaluation_corpus, split_first_stratum, split_counts, training_table, json_lines_roundtrip, stream_scores, pairs_union, pairs_dedup_anchor, pairs_dedup_pair, split_chunk_level, split_stratified, split_leak_check, eval_triple_first_wins, eval_triple_last_wins, llm_json_extract, llm_validate, score_filter, score_stats, threshold_survival)}

_PAIRS = r"""WITH p AS (
  SELECT 0::BIGINT AS source_seq, u.conv_id * 1000 + u.turn AS seq, u.conv_id || ':' || u.turn AS chunk_id, u.text AS anchor FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE u.role = 'user' AND a.role = 'assistant'
  UNION ALL SELECT 1, doc_id, md5(text), list_filter(list_transform(string_split(regexp_replace(text, '([.;:])\s+|\n{2,}', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1] FROM documents)"""
_ORDER = "row_number() OVER (PARTITION BY {keys} ORDER BY source_seq, seq)"
_STRATA = "WITH r AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.15)) AS held FROM documents)"
_REPLIES = """WITH b AS (SELECT doc_id, '{"queries": ["q' || doc_id || '", ' || CASE WHEN doc_id % 7 = 0 THEN '1' ELSE '"b"' END || ']}' AS body FROM documents)"""
_SCORED = """WITH s AS (SELECT d.doc_id, 6 + quality * 2 - toxic * 2 AS relevance, 5 + quality * 3 - toxic * 2 AS accuracy, 4 + quality * 4 - toxic * 2 AS clarity, 3 + quality * 5 - toxic * 2 AS specificity,
  5.5::DOUBLE + quality * 2.5::DOUBLE - toxic * 1.5::DOUBLE + d.doc_id % 3 * 0.5::DOUBLE AS overall FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_DIMENSIONS = " UNION ALL ".join(f"SELECT '{n}' AS dimension, {n}::DOUBLE AS v FROM s WHERE {n} IS NOT NULL" for n in [*P.WEIGHTS, "overall"])
_SETS = "WITH d AS (SELECT unnest(['combined', source]) AS eval_set, lang AS anchor, md5(text) AS positive, (doc_id // 3)::VARCHAR AS cid, doc_id FROM documents)"
_COMPONENTS = """, n AS (SELECT *, 'c' || chunk_id AS c, 't' || md5(anchor) AS t FROM q
), e AS (SELECT DISTINCT c AS u, t AS v FROM n WHERE c IS NOT NULL AND t IS NOT NULL UNION SELECT DISTINCT t, c FROM n WHERE c IS NOT NULL AND t IS NOT NULL
), l AS (SELECT u AS node, least(u, min(v)) AS c FROM e GROUP BY u UNION SELECT e.v, l.c FROM l JOIN e ON e.u = l.node
), m AS (SELECT node, min(c) AS component FROM l GROUP BY node
), w AS (SELECT n.*, coalesce(m.component, n.c, n.t) AS component FROM n LEFT JOIN m ON m.node = coalesce(n.c, n.t)
), k AS (SELECT component, arg_min(document_name, (source_seq, seq)) AS stratum, greatest(1, count(DISTINCT c)) AS weight, md5('42:' || component) AS turn FROM w WHERE component IS NOT NULL GROUP BY component
), s AS (SELECT *, floor(sum(weight) OVER (PARTITION BY stratum) * 0.15::DOUBLE)::BIGINT AS room, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY weight, turn, component) AS light FROM k
), f AS (SELECT *, sum(weight) OVER (PARTITION BY stratum ORDER BY turn, component) AS total FROM s WHERE weight <= greatest(1, room // 5)
), h AS (SELECT stratum, component FROM f WHERE total <= room
), held AS (SELECT component FROM h UNION SELECT component FROM s WHERE light = 1 AND (n > 1 OR weight = 1) AND NOT EXISTS (SELECT 1 FROM h WHERE h.stratum IS NOT DISTINCT FROM s.stratum))
SELECT source_seq, seq, chunk_id, md5(anchor) AS anchor_md5, component, CASE WHEN component IN (SELECT component FROM held) THEN 'eval' ELSE 'train' END AS part FROM w"""
SQL = {
    "split_components": _PAIRS.replace("WITH p AS", "WITH RECURSIVE p AS").replace("u.text AS anchor", "u.text AS anchor, 'chat' AS document_name").replace("[1] FROM documents", "[1], source FROM documents") + ", q AS (SELECT * FROM p)" + _COMPONENTS,
    "corpus_index": "SELECT row_number() OVER (ORDER BY text) - 1 AS cid, md5(text) AS md5 FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)",
    "gold_lookup": "SELECT doc_id, dense_rank() OVER (ORDER BY text) - 1 AS cid FROM documents WHERE text IS NOT NULL",
    "evaluation_queries": _SETS + " SELECT eval_set, 'q_' || (row_number() OVER (PARTITION BY eval_set ORDER BY doc_id) - 1) AS qid, anchor AS text, cid FROM d WHERE eval_set IS NOT NULL",
    "evaluation_corpus": _SETS + " SELECT eval_set, cid, arg_max(positive, doc_id) AS text FROM d WHERE eval_set IS NOT NULL GROUP BY ALL",
    "split_first_stratum": """WITH c AS (SELECT doc_id // 3 AS chunk_id, arg_min(source, doc_id) AS source FROM documents GROUP BY ALL),
r AS (SELECT chunk_id, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || chunk_id), chunk_id) <= greatest(1, floor(count(*) OVER (PARTITION BY source) * 0.15)) AS held FROM c)
SELECT doc_id, chunk_id, CASE WHEN held THEN 'eval' ELSE 'train' END AS part FROM documents JOIN r ON chunk_id = doc_id // 3""",
    "split_counts": """WITH s AS (SELECT source, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER () * 0.15)) THEN 'eval' ELSE 'train' END AS part FROM documents),
k AS (SELECT source, part, count(*) AS k, count(*) OVER (PARTITION BY source) = 2 AS shared FROM s GROUP BY source, part)
SELECT part, sum(k)::BIGINT AS n_pairs, count(*) AS n_chunks, round(sum(k) / count(*), 6) AS pairs_per_chunk, count(*) FILTER (shared) AS n_shared FROM k GROUP BY part""",
    "training_table": _PAIRS.replace("u.text AS anchor", "u.text AS anchor, a.text AS positive, 'chat' AS section_type, 'chat' AS document_name").replace("[1] FROM documents", "[1], text, '', source FROM documents")
    + " SELECT md5(anchor) AS anchor, md5(positive) AS positive, chunk_id, section_type, '' AS hierarchy_path, document_name FROM p",
    "json_lines_roundtrip": "SELECT doc_id, lang, md5(text) AS md5 FROM documents",
    "stream_scores": _SCORED + " SELECT doc_id AS pair_id, coalesce(overall, 0) >= 7 AS kept, round(overall, 6) AS overall FROM s",
    "pairs_union": _PAIRS + " SELECT source_seq, seq, chunk_id, md5(anchor) AS anchor_md5 FROM p",
    "pairs_dedup_anchor": _PAIRS + f", o AS (SELECT *, {_ORDER.format(keys='anchor')} AS o FROM p) SELECT source_seq, seq, chunk_id, md5(anchor) AS anchor_md5 FROM o WHERE o = 1",
    "pairs_dedup_pair": _PAIRS + f", o AS (SELECT *, {_ORDER.format(keys='anchor, chunk_id')} AS o FROM p) SELECT source_seq, seq, chunk_id, md5(anchor) AS anchor_md5 FROM o WHERE o = 1",
    "split_chunk_level": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER () * 0.15)) THEN 'eval' ELSE 'train' END AS part FROM documents",
    "split_stratified": _STRATA + " SELECT doc_id, source, CASE WHEN held THEN 'eval' ELSE 'train' END AS part FROM r",
    "split_leak_check": _STRATA + " SELECT md5(text) AS text_md5 FROM r WHERE held INTERSECT SELECT md5(text) FROM r WHERE NOT held",
    "eval_triple_first_wins": "SELECT source AS cid, md5(arg_min(text, doc_id)) AS value FROM documents GROUP BY source",
    "eval_triple_last_wins": "SELECT source AS cid, md5(arg_max(text, doc_id)) AS value FROM documents GROUP BY source",
    "llm_json_extract": _REPLIES + """ SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN '{"queries": ["cut' ELSE body END AS payload FROM b""",
    "llm_validate": """SELECT doc_id, unnest([0, 1])::BIGINT AS pos, unnest(['q' || doc_id, 'b']) AS query FROM documents WHERE doc_id % 5 <> 4 AND doc_id % 7 <> 0""",
    "score_filter": _SCORED + " SELECT doc_id, coalesce(overall, 0) >= 7 AS kept, round(overall, 6) AS overall, round(relevance * 0.35::DOUBLE + accuracy * 0.25::DOUBLE + clarity * 0.2::DOUBLE + specificity * 0.2::DOUBLE, 6) AS weighted FROM s",
    "score_stats": _SCORED + f", l AS ({_DIMENSIONS}) SELECT dimension, count(*) AS n, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS most, count(*) FILTER (v < 5) AS below_5, count(*) FILTER (v >= 5 AND v < 7) AS from_5, count(*) FILTER (v >= 7) AS from_7 FROM l GROUP BY dimension",
    "threshold_survival": _SCORED + " SELECT t::DOUBLE AS threshold, count(*) FILTER (coalesce(overall, 0) >= t) AS n, round((count(*) FILTER (coalesce(overall, 0) >= t)) / count(*), 6) AS share FROM s, (SELECT unnest([5, 6, 6.5, 7, 7.5, 8]) AS t) GROUP BY t",
}
