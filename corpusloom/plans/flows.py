"""Queries on what surrounds a model: its calls, its batches and loss, files that come in, and results that go out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import calls, similarity, training
from corpusloom.plans.retrieval import DIMS, _gold, _sides
from corpusloom.sources import tables, versions
from corpusloom.sources.files import put
from corpusloom.sources.json_maps import json_map


def _folder(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"


def full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of every document, of 64 at most and none with a text twice."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    return training.full_batches(rows, "text", 64).select("row_id", "batch")


#: Rows of a batch of which the loss is taken.
BATCH = 16


def contrastive_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of each batch of queries and their gold rows at each dimension; no batch holds a gold row twice."""
    q, c = _sides(spark, sf_dir)
    pairs = _gold(q, c).select("qid", "gold_cid").join(q.select("qid", F.col("vec").alias("anchor")), "qid")
    pairs = pairs.join(c.select(F.col("cid").alias("gold_cid"), F.col("vec").alias("positive")), "gold_cid")
    batches = training.full_batches(pairs.withColumn("gold", F.col("gold_cid").cast("string")), "gold", BATCH, "qid")
    out = training.contrastive_losses(batches.select("batch", "anchor", "positive"), DIMS)
    return out.select("batch", "dim", "n_rows", F.round("loss", 6).alias("loss"))


#: Least scores of the two versions that are written.
FIRST, SECOND = 7, 8


def score_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored documents, kept and rejected in one pass and committed twice with another least score; read from what is current and from its backup."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (6 + 2 * F.col("quality") - 2 * F.col("toxic")).alias("score"))
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").join(labels, "doc_id", "left")
    path = _folder(spark, "versions")
    for least in (FIRST, SECOND):
        keep = F.coalesce("score", F.lit(0)) >= least
        versions.write(rows, path, {"kept": keep, "rejected": ~keep})
    schema = "doc_id long, score long"
    now, before = versions.read(spark, path, schema), versions.read(spark, path, schema, "kept", back=1)
    return now.select(F.lit("current").alias("version"), "part", "doc_id", "score").union(before.select(F.lit("backup"), F.lit("kept"), "doc_id", "score"))


def two_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two renderings, as Parquet and as JSON lines with other column names, committed together and read back."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    path = _folder(spark, "outputs")
    headed = rows.withColumn("text", F.concat(F.lit("["), F.coalesce("source", F.lit("")), F.lit("] "), "text"))
    plain = tables.renamed(rows, {"doc_id": "id", "text": "positive"})
    versions.commit(spark, path, versions.stage_outputs(spark, path, {"headed": (headed, "parquet"), "plain": (plain, "json")}))
    a = versions.read(spark, path, "doc_id long, source string, text string", "headed", kind="parquet").select(F.lit("headed").alias("output"), "doc_id", "text")
    b = versions.read(spark, path, "id long, positive string", "plain").select(F.lit("plain"), "id", "positive")
    return a.union(b).select("output", "doc_id", F.md5(F.col("text").cast("binary")).alias("md5"))


def _reply(prompt: str) -> str:
    return f"{len(prompt)}:{prompt[:20]}"


def _half(prompt: str) -> str:
    """A model that fails for half of all prompts."""
    import hashlib

    if hashlib.sha256(prompt.encode()).hexdigest() < "8":
        raise TimeoutError("busy")
    return _reply(prompt)


def calls_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's reply, and the run that got it: the first one fails for half of the prompts, the second asks for these only. Copies of a text are asked once."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    store, prompts = _folder(spark, "replies"), rows.select(F.col("text").alias("prompt"))
    first = calls.ask(spark, prompts, store, _half, flush=50)
    second = calls.ask(spark, prompts, store, _reply, flush=50)
    runs = first.where("error is null").select("digest", F.lit(1).alias("run")).union(second.select("digest", F.lit(2)))
    got = calls.answered(rows, "text", store).withColumn("digest", calls.digest_of(F.col("text")))
    return got.join(runs, "digest", "left").select("doc_id", "reply", F.col("run").cast("long").alias("run"))


#: Pages of a file, and the files that end with a byte that is no text.
PER_FILE, BROKEN = 10, "file % 7 = 3"


def page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read back, one row each, from binary files of ten; some files are broken and say so after their last page."""
    folder = _folder(spark, "files")
    html = F.struct("page_id", F.translate(F.coalesce("html", F.lit("")), "\f", " ").alias("html"))
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(F.floor(F.col("page_id") / PER_FILE).alias("file")).agg(F.sort_array(F.collect_list(html)).alias("pages"))
    content = F.encode(F.array_join(F.transform("pages", lambda p: p["html"]), "\f"), "UTF-8")
    files = files.select("file", F.when(F.expr(BROKEN), F.concat(content, F.unhex(F.lit("0CFF")))).otherwise(content).alias("content"))

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for n, data in zip(f["file"], f["content"], strict=True):
                put(f"{folder}/{n:08d}.txt", data)
            yield f[["file"]]

    tables.materialize(spark, files.mapInPandas(save, "file long"), "saved")
    found = tables.binary_pages(spark, folder, pattern="*.txt")
    name = F.element_at(F.split("doc", "/"), -1)
    return found.select(F.substring(name, 1, 8).cast("long").alias("file"), "page", F.md5(F.col("text").cast("binary")).alias("md5"), "error")


#: Documents of a map, and bytes of a range, so that entries lie across ranges.
PER_MAP, RANGE = 200, 10_000


def json_maps_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a text, written as JSON objects of some hundred each and read back in byte ranges."""
    folder = _folder(spark, "maps")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id is not null and text is not null")
    entry = F.struct(F.col("doc_id").cast("string").alias("k"), F.col("text").alias("v"))
    rows.groupBy(F.floor(F.col("doc_id") / PER_MAP).alias("map")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).write.partitionBy("map").text(folder)
    return json_map(spark, folder, RANGE).select("id", F.md5(F.col("text").cast("binary")).alias("md5"))


#: Documents of a sample.
SAMPLE = 25


def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """So many documents, the first in a seeded order."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return similarity.shuffled_cap(rows, F.col("doc_id"), SAMPLE)


QUERIES = {f.__name__: f for f in (full_batches, contrastive_loss, score_versions, two_outputs, calls_resumed, page_scan, json_maps_scan, random_sample)}

_DIMS = ", ".join(map(str, DIMS))
SQL = {
    "full_batches": """WITH c AS (SELECT doc_id AS row_id, coalesce(md5(text), '-' || doc_id) AS t FROM documents), n AS (SELECT *, count(*) OVER (PARTITION BY t) AS copies FROM c),
b AS (SELECT greatest(1, ceil(count(*) / 64.0), max(copies))::BIGINT AS batches FROM n)
SELECT row_id, (row_number() OVER (ORDER BY copies DESC, t, row_id) - 1) % batches AS batch FROM n, b""",
    "contrastive_loss": f"""WITH q AS (SELECT vec_id AS qid, label, embedding AS a FROM embeddings WHERE vec_id % 10 = 0), g AS (SELECT label, min(vec_id) AS cid FROM embeddings WHERE vec_id % 10 <> 0 GROUP BY label),
p AS (SELECT qid, cid, a, embedding AS p, count(*) OVER (PARTITION BY cid) AS copies FROM q JOIN g USING (label) JOIN embeddings e ON e.vec_id = cid),
n AS (SELECT greatest(1, ceil(count(*) / {BATCH}.0), max(copies))::BIGINT AS batches FROM p),
b AS (SELECT qid, a, p, (row_number() OVER (ORDER BY copies DESC, md5(cid::VARCHAR), qid) - 1) % batches AS batch FROM p, n),
e AS (SELECT dim, batch, qid, list_transform(a[1:dim], lambda x: x::DOUBLE) AS a, list_transform(p[1:dim], lambda x: x::DOUBLE) AS p FROM b, (SELECT unnest([{_DIMS}]) AS dim)),
s AS (SELECT x.dim, x.batch, x.qid, y.qid = x.qid AS own, 20 * list_dot_product(x.a, y.p) / greatest(sqrt(list_dot_product(x.a, x.a)), 1e-9) / greatest(sqrt(list_dot_product(y.p, y.p)), 1e-9) AS s FROM e x JOIN e y ON x.dim = y.dim AND x.batch = y.batch),
r AS (SELECT dim, batch, qid, ln(sum(exp(s))) - max(s) FILTER (own) AS loss FROM s GROUP BY ALL)
SELECT batch, dim::BIGINT AS dim, count(*) AS n_rows, round(avg(loss), 6) AS loss FROM r GROUP BY batch, dim""",
    "score_versions": f"""WITH s AS (SELECT doc_id, (6 + 2 * quality - 2 * toxic)::BIGINT AS score FROM documents LEFT JOIN labels USING (doc_id))
SELECT 'current' AS version, CASE WHEN coalesce(score, 0) >= {SECOND} THEN 'kept' ELSE 'rejected' END AS part, doc_id, score FROM s UNION ALL SELECT 'backup', 'kept', doc_id, score FROM s WHERE score >= {FIRST}""",
    "two_outputs": "SELECT 'headed' AS output, doc_id, md5('[' || coalesce(source, '') || '] ' || text) AS md5 FROM documents UNION ALL SELECT 'plain', doc_id, md5(text) FROM documents",
    "calls_resumed": "SELECT doc_id, length(text) || ':' || substr(text, 1, 20) AS reply, CASE WHEN sha256(text) < '8' THEN 2 WHEN text IS NOT NULL THEN 1 END::BIGINT AS run FROM documents",
    "page_scan": f"""WITH p AS (SELECT page_id // {PER_FILE} AS file, row_number() OVER (PARTITION BY page_id // {PER_FILE} ORDER BY page_id) - 1 AS page, md5(translate(coalesce(html, ''), chr(12), ' ')) AS md5 FROM pages)
SELECT file, page, md5, NULL AS error FROM p UNION ALL SELECT file, count(*), NULL, 'UnicodeDecodeError' FROM p WHERE {BROKEN} GROUP BY file""",
    "json_maps_scan": "SELECT doc_id::VARCHAR AS id, md5(text) AS md5 FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL",
    "random_sample": f"SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT {SAMPLE}",
}
