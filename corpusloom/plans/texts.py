"""Queries on the texts of documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking
from corpusloom.operators import reports as R


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def doc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = T.clean_page(F.col("text"), [r"(?m)^Page \d+$"])
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.cast("binary")).alias("text_md5"), F.length(text).cast("long").alias("n"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("sentence").cast("binary")).alias("md5"))


def token_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = _docs(spark, sf_dir).select("lang", T.token_estimate(F.col("text")).alias("t"))
    return tokens.groupBy("lang", chunking.size_bucket(F.col("t")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("t").cast("long").alias("min_t"), F.max("t").cast("long").alias("max_t"), F.sum("t").alias("total_t"))


def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, extremes, mean and upper median of lengths per language. The median comes from cumulated counts of lengths, not from a sort of all rows."""
    by_length = _docs(spark, sf_dir).groupBy("lang", F.length("text").alias("len")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("lang")
    run = by_length.withColumns({"upto": F.sum("k").over(w.orderBy("len")), "n": F.sum("k").over(w)})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("len")))
    return run.groupBy("lang").agg(F.max("n").alias("n"), F.min("len").cast("long").alias("min_len"), F.max("len").cast("long").alias("max_len"), F.round(F.sum(F.col("len") * F.col("k")) / F.max("n"), 6).alias("mean_len"), middle.cast("long").alias("median_len"))


def length_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    return turns.where((n < 30) | (n > 200)).select("conv_id", "turn", F.when(n < 30, "short").otherwise("long").alias("kind"), T.shown(F.col("text"), 40).alias("shown"))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.packed(_docs(spark, sf_dir), "doc_id").select("doc_id", F.col("part").cast("long").alias("part"), F.col("n_parts").cast("long").alias("n_parts"), F.md5(F.col("chunk").cast("binary")).alias("md5"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = chunking.packed(_docs(spark, sf_dir).select("doc_id", "source", "text"), "doc_id").join(_docs(spark, sf_dir).select("doc_id", "source", "lang"), "doc_id")
    return chunking.numbered(d, "source", "doc_id", "part")


def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("source", "chunk_id", "doc_id", F.col("part").cast("long").alias("part"))


def chunk_context_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = T.path_of(F.col("source"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")))
    c = _chunks(spark, sf_dir).select("source", "chunk_id", F.concat(path, F.lit(":")).alias("context_header"), F.col("chunk").alias("text"))
    with_header, without = chunking.variants(c, "context_header", "text")
    md5 = lambda x: F.md5(F.col(x).cast("binary"))
    both = with_header.select("source", "chunk_id", F.lit("with").alias("variant"), md5("text").alias("md5"))
    return both.unionByName(without.select("source", "chunk_id", F.lit("without").alias("variant"), md5("text").alias("md5")))


def chunk_merge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document as its chunks; every seventh line has another section type, so that runs of small ones end."""
    d = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("source"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    c = d.select("source", F.col("pos").cast("long").alias("pos"), "text", T.token_estimate(F.col("text")).alias("tokens"), F.when(F.col("pos") % 7 == 6, "b").otherwise("a").alias("section_type"), F.lit(None).cast("int").alias("article_number"), F.lit("").alias("annex_number"), F.concat(F.lit("doc > "), F.col("pos").cast("string")).alias("hierarchy_path"))
    return chunking.merged(c).select("source", "pos", F.md5(F.col("text").cast("binary")).alias("md5"), "tokens", "hierarchy_path")


#: Ordered classes of user turns by keyword.
KINDS = {"definition": ["the of", "de la", "der die"], "procedure": ["ing "], "other": [" "]}


def query_type_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    kinds = q.select(T.first_class(F.col("text"), KINDS).alias("kind")).where("kind is not null").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def article_ref_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    hit = T.any_of(F.lower("text"), ["tion", "heit"])
    return q.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_distinct"), F.round(F.avg(hit.cast("double")), 6).alias("rate"), F.round(1 - F.countDistinct("text") / F.count(F.lit(1)), 6).alias("duplicate_rate"))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = T.render('{{"source": "{source}"}}\n{text}', {"source": F.col("source"), "text": F.col("text")})
    return _docs(spark, sf_dir).select("doc_id", F.md5(prompt.cast("binary")).alias("md5"))


def no_duplicate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of every row; the SQL gives it from the rule, and batches of more than 64 rows or with a text twice would show as rows of another batch."""
    rows = _docs(spark, sf_dir).select(F.col("doc_id").alias("row_id"), "text")
    return chunking.batches_without_repeats(rows, "text", 64).select("row_id", "batch")


#: Labels of sources; all others are "other".
LABELS = {"src0": "first", "src1": "second"}


def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.label_of(F.col("source"), LABELS, "other").alias("label"), T.label_of(F.substring("lang", 1, 0), {"": "all"}).alias("whole"))


def text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White space squeezed, a path's last part, a captured number and a namespaced id."""
    path = T.path_of(F.col("lang"), F.col("source"), F.col("doc_id").cast("string"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.squeeze(F.col("text")).cast("binary")).alias("md5"), T.last_segment(path).alias("last"), T.captured_int(F.col("source"), r"(\d+)").cast("long").alias("number"), T.namespaced(F.col("source"), F.col("lang"), F.col("doc_id")).alias("name"))


def query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns against four expected of each conversation id up to 500."""
    return R.coverage(spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'"), 2000)


def query_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents of each source."""
    return R.samples(_docs(spark, sf_dir).select("source", "doc_id"), "source", "doc_id").select("source", "place", "doc_id")


def turn_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = R.listing(rows, "conv_id", "turn", "role")
    return found.select("conv_id", F.size("rows").cast("long").alias("n"), F.array_join(F.transform("rows", lambda x: F.concat_ws(":", x["turn"], x["role"])), ",").alias("turns"))


QUERIES = {f.__name__: f for f in (doc_clean, sentence_split, token_buckets, length_stats, length_outliers, chunk_pack, chunk_ids, chunk_context_variants, chunk_merge_small, query_type_hist, article_ref_rate, prompt_render, no_duplicate_batches, label_lookup, text_fields, query_coverage, query_samples, turn_listing)}

_SENTENCES = r"""
s AS (SELECT doc_id, source, list_filter(list_transform(string_split(regexp_replace(text, '([.;:])\s+|\n{2,}', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents)"""
_PACK = (
    "WITH RECURSIVE"
    + _SENTENCES
    + """,
t AS (SELECT doc_id, source, ss, len(ss) AS n, [0] || list_transform(range(1, len(ss) + 1), lambda i: list_sum(list_transform(ss[1:i], lambda x: length(x) // 4))::BIGINT) AS c FROM s WHERE len(ss) > 0),
p AS (
  SELECT doc_id, 1 AS part, 0::BIGINT AS a, coalesce(list_min(list_filter(range(1, n), lambda i: c[i + 2] - c[1] > 1000)), n) AS b FROM t
  UNION ALL
  SELECT doc_id, part + 1, a2, coalesce(list_min(list_filter(range(b + 1, n), lambda i: c[i + 2] - c[a2 + 1] > 1000)), n) FROM (
    SELECT p.doc_id, part, b, t.n, t.c, greatest(a, list_min(list_filter(range(0, b + 1), lambda j: c[b + 1] - c[j + 1] <= 50))) AS a2 FROM p JOIN t USING (doc_id) WHERE b < n)
),
k AS (SELECT p.doc_id, source, part, max(part) OVER (PARTITION BY p.doc_id) AS n_parts, array_to_string(ss[a + 1:b], ' ') AS chunk FROM p JOIN t USING (doc_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, part) - 1 AS chunk_id FROM k)"""
)
_MERGE = f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
c AS (SELECT doc_id::VARCHAR AS source, pos, text, length(text) // 4 AS tokens, CASE WHEN pos % 7 = 6 THEN 'b' ELSE 'a' END AS t, 'doc > ' || pos AS path FROM l),
b AS (
  SELECT source, pos, 0 AS g, text, tokens, t, path FROM c WHERE pos = 0
  UNION ALL
  SELECT source, pos, CASE WHEN m THEN g ELSE g + 1 END, CASE WHEN m THEN old || chr(10) || chr(10) || text ELSE text END, CASE WHEN m THEN (length(old) + 2 + length(text)) // 4 ELSE tokens END, t, CASE WHEN m THEN before || ' + ' || pos ELSE path END
  FROM (SELECT c.*, b.g, b.text AS old, b.path AS before, c.tokens < {chunking.MIN_TOKENS} AND b.t = c.t AND b.tokens + c.tokens <= {chunking.MAX_TOKENS} AS m FROM b JOIN c ON c.source = b.source AND c.pos = b.pos + 1)
), k AS (SELECT source, g, arg_max(text, pos) AS text, arg_max(tokens, pos) AS tokens, arg_max(t, pos) AS t, arg_max(path, pos) AS path FROM b GROUP BY source, g),
f AS (
  SELECT source, g, 0 AS n, text, tokens, t, path FROM k WHERE g = 0
  UNION ALL
  SELECT source, g, CASE WHEN m THEN n ELSE n + 1 END, CASE WHEN m THEN old || chr(10) || chr(10) || text ELSE text END, CASE WHEN m THEN (length(old) + 2 + length(text)) // 4 ELSE tokens END, t, CASE WHEN m THEN string_split(before, ' > ')[-1] || ' + ' || path ELSE path END
  FROM (SELECT k.*, f.n, f.text AS old, f.path AS before, f.tokens < {chunking.MIN_TOKENS} AND f.t = k.t AND f.tokens + k.tokens <= {chunking.MAX_TOKENS} AS m FROM f JOIN k ON k.source = f.source AND k.g = f.g + 1)
)
SELECT source, n::BIGINT AS pos, md5(arg_max(text, g)) AS md5, arg_max(tokens, g)::INT AS tokens, arg_max(path, g) AS hierarchy_path FROM f GROUP BY source, n"""
SQL = {
    "chunk_merge_small": _MERGE,
    "doc_clean": r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^Page \d+$', '', 'g'), '([\pL\pN_])-\s*\n\s*([\pL\pN_])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS text_md5, length(t)::BIGINT AS n FROM c""",
    "sentence_split": f"WITH {_SENTENCES} SELECT doc_id, unnest(range(len(ss))) AS pos, md5(unnest(ss)) AS md5 FROM s",
    "token_buckets": """WITH t AS (SELECT lang, length(text) // 4 AS t FROM documents)
SELECT lang, CASE WHEN t < 50 THEN '<50' WHEN t < 200 THEN '50-200' WHEN t < 500 THEN '200-500' WHEN t < 800 THEN '500-800' WHEN t <= 1000 THEN '800-1000' ELSE '>1000' END AS bucket,
  count(*) AS n, min(t)::BIGINT AS min_t, max(t)::BIGINT AS max_t, sum(t)::BIGINT AS total_t FROM t GROUP BY ALL""",
    "length_stats": "SELECT lang, count(*) AS n, min(length(text))::BIGINT AS min_len, max(length(text))::BIGINT AS max_len, round(avg(length(text)), 6) AS mean_len, (list_sort(list(length(text)))[count(*) // 2 + 1])::BIGINT AS median_len FROM documents GROUP BY lang",
    "length_outliers": "SELECT conv_id, turn, CASE WHEN length(text) < 30 THEN 'short' ELSE 'long' END AS kind, substr(text, 1, 40) AS shown FROM conversations WHERE role = 'user' AND (length(text) < 30 OR length(text) > 200)",
    "chunk_pack": _PACK + " SELECT doc_id, part::BIGINT AS part, n_parts::BIGINT AS n_parts, md5(chunk) AS md5 FROM k",
    "chunk_ids": _PACK + " SELECT source, chunk_id, doc_id, part::BIGINT AS part FROM i",
    "chunk_context_variants": _PACK + " SELECT source, chunk_id, 'with' AS variant, md5(source || ' > doc ' || doc_id || ':' || chr(10) || chr(10) || chunk) AS md5 FROM i UNION ALL SELECT source, chunk_id, 'without', md5(chunk) FROM i",
    "query_type_hist": """WITH k AS (SELECT CASE WHEN contains(lower(text), 'the of') OR contains(lower(text), 'de la') OR contains(lower(text), 'der die') THEN 'definition' WHEN contains(lower(text), 'ing ') THEN 'procedure' WHEN contains(text, ' ') THEN 'other' END AS kind FROM conversations WHERE role = 'user')
SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM k WHERE kind IS NOT NULL GROUP BY kind""",
    "article_ref_rate": "SELECT count(*) AS n, count(DISTINCT text) AS n_distinct, round(avg(CASE WHEN contains(lower(text), 'tion') OR contains(lower(text), 'heit') THEN 1.0 ELSE 0.0 END), 6) AS rate, round(1 - count(DISTINCT text) / count(*), 6) AS duplicate_rate FROM conversations WHERE role = 'user'",
    "prompt_render": """SELECT doc_id, md5('{"source": "' || source || '"}' || chr(10) || text) AS md5 FROM documents""",
    "no_duplicate_batches": """WITH d AS (SELECT doc_id AS row_id, text, (strpos('0123456789abcdef', substr(md5(doc_id::VARCHAR), 1, 1)) - 1) % 4 AS part, strpos('0123456789abcdef', substr(md5(text), 1, 1)) - 1 AS share FROM documents),
c AS (SELECT *, row_number() OVER (PARTITION BY text, part ORDER BY row_id) - 1 AS copy FROM d),
a AS (SELECT *, row_number() OVER (PARTITION BY part, copy, share ORDER BY row_id) - 1 AS place FROM c)
SELECT row_id, part || '/' || copy || '/' || share || '/' || (place // 64) AS batch FROM a""",
    "label_lookup": "SELECT doc_id, CASE source WHEN 'src0' THEN 'first' WHEN 'src1' THEN 'second' ELSE 'other' END AS label, 'all' AS whole FROM documents",
    "text_fields": r"SELECT doc_id, md5(regexp_replace(text, '\s+', ' ', 'g')) AS md5, doc_id::VARCHAR AS last, try_cast(regexp_extract(source, '(\d+)', 1) AS BIGINT) AS number, coalesce(lang, source) || '_' || doc_id AS name FROM documents",
    "query_coverage": "SELECT count(*) AS n, 2000::BIGINT AS expected, round(count(*) / 2000, 6) AS share FROM conversations WHERE role = 'user'",
    "query_samples": "SELECT source, place, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 2",
    "turn_listing": "SELECT conv_id, count(*) AS n, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS turns FROM conversations GROUP BY conv_id",
}
