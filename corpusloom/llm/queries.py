"""One query for each operator, over its whole table, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from corpusloom.llm import alignment, chat, decontaminate, language_id, line_dedup, mixing, ngram_join, piece_lattice, quality_rules, resampling, token_counts, token_files, warc
from corpusloom.llm.runtime import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(spark, table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), 2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark, table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(spark, table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A conversation whose texts are made of the template's own strings.
HARD_CASE = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", HARD_CASE), (-7, 1, "assistant", HARD_CASE)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(spark, rows.unionByName(extra), tokenizer_path("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.with_bitmaps(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return marked.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(line_dedup.kept_text(F.col("text"), F.col("keep_runs")), "UTF-8"), 256).alias("kept_sha256"))


#: Segmentations drawn for each document.
SEGMENTATIONS = 2


def op9_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = piece_lattice.sampled_segmentations(spark, table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), SEGMENTATIONS)
    return drawn.select(
        "doc_id",
        F.transform("ids", lambda x: (F.length(x) / 2).cast("long")).alias("n_pieces"),
        F.transform("ids", F.crc32).alias("ids_crc32"),
        "log_prob",
        "perturbed",
        "log_inclusion",
        "decoded",
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(spark, table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_token_files": op3_token_files,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat_format": op7_chat_format,
    "op8_line_dedup": op8_line_dedup,
    "op9_piece_lattice": op9_piece_lattice,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_source_mix": op12_source_mix,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {}

#: Words are runs of bytes that are not ASCII white space; \\x1F joins the words of a shingle.
SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], chr(31))) WHEN len(ws) > 0 THEN [array_to_string(ws, chr(31))] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT DISTINCT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id
), c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SQL["op8_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (f.key IS NOT NULL))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id
"""

SQL["op4_warc"] = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END::BIGINT AS refers_to
FROM p LEFT JOIN f USING (d)
"""

SQL["op7_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (SELECT *, length(regexp_replace(text, '(\\*(?:###|</turn>|<\|endoftext\|>))', '\\\1', 'g')) AS k FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(role) + 2 + k + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: CRC-32 is linear: a run's is the combination of the images of its bytes, each carried over the bytes behind it.
SQL["op11_importance_resampling"] = r"""
WITH RECURSIVE
byte_table AS (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)::BIGINT AS v FROM range(256) r(b)),
words AS (
  SELECT 'd' AS side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
), runs AS (
  SELECT side, doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS run FROM words
), counted AS (SELECT side, doc_id, run, count(*) AS n FROM runs GROUP BY ALL
), known AS (SELECT run, hex(encode(run)) AS x, octet_length(encode(run)) AS size FROM (SELECT DISTINCT run FROM counted)
), images AS (
  SELECT 0 AS k, b, v FROM byte_table
  UNION ALL
  SELECT k + 1, i.b, xor(i.v >> 8, t.v) FROM images i JOIN byte_table t ON t.b = i.v & 255 WHERE k + 1 < (SELECT max(size) FROM known)
), spelt AS (SELECT run, size, unnest(range(size)) AS i, x FROM known
), buckets AS (
  SELECT run, xor(xor(bit_xor(v), CASE WHEN any_value(size) < 4 THEN 4294967295 >> (8 * any_value(size)) ELSE 0 END), 4294967295) % 10000 AS bucket
  FROM spelt JOIN images ON k = size - 1 - i AND b = CASE WHEN i < 4 THEN xor(('0x' || substr(x, 2 * i + 1, 2))::BIGINT, 255) ELSE ('0x' || substr(x, 2 * i + 1, 2))::BIGINT END GROUP BY run
), held AS (SELECT side, doc_id, bucket, n FROM counted JOIN buckets USING (run)
), totals AS (SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t FROM held GROUP BY bucket
), whole AS (SELECT (sum(s) + 10000)::DOUBLE AS s, (sum(t) + 10000)::DOUBLE AS t FROM totals
), gains AS (SELECT bucket, floor(1000 * ln(((coalesce(o.t, 0) + 1)::DOUBLE * w.s) / ((coalesce(o.s, 0) + 1)::DOUBLE * w.t)))::BIGINT AS gain FROM totals o, whole w
), weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM words LEFT JOIN weights USING (doc_id) WHERE side = 'd'
), ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT s.doc_id, n_words, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END::BIGINT AS rank FROM scored s LEFT JOIN ordered USING (doc_id)
"""

SQL["op12_source_mix"] = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS seat FROM sized GROUP BY source
), w AS (SELECT *, [3, 1, 2][1 + seat % 3] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS words FROM s
), o AS (
  SELECT *, row_number() OVER (ORDER BY 2 * source_size / weight, seat) AS r, (words - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, seat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY 2 * source_size / weight, seat ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM w
), l AS (SELECT coalesce(min_by(share, r) FILTER (share * weight < 2 * source_size), 0) AS share FROM o
), t AS (SELECT w.*, least((2 * source_size)::DOUBLE, l.share * weight) AS target FROM w, l
), copies AS (
  SELECT doc_id, size, seat, source_size, target, words,
    unnest(range(1, 1 + CASE WHEN size > 0 THEN least(2, greatest(1, ceil(target / source_size)::BIGINT)) ELSE 1 END)) AS copy
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source
), turns AS (SELECT *, ('0x' || substr(md5('42:' || copy || ':' || doc_id), 1, 15))::BIGINT AS turn FROM copies
), queued AS (SELECT *, sum(size) OVER (PARTITION BY seat ORDER BY copy, turn, doc_id, size)::BIGINT - size AS sent, floor(target)::BIGINT AS due FROM turns
), packets AS (
  SELECT *, unnest(CASE WHEN due - sent > 0 AND due - sent < size THEN [{'start': 0, 'part': due - sent}, {'start': due - sent, 'part': size - due + sent}] ELSE [{'start': 0, 'part': size}] END) AS p FROM queued
), done AS (SELECT *, p.start AS start, p.part AS part, sent + p.start + p.part AS done FROM packets
), timed AS (
  SELECT *, CASE WHEN done > due AND f <= 1 THEN 1 + 2.220446049250313e-16::DOUBLE ELSE f END AS finish
  FROM (SELECT *, CASE WHEN target <= 0 THEN 0 WHEN done = due THEN 1 ELSE done::DOUBLE / target END AS f FROM done)
), served AS (SELECT *, sum(part) OVER (ORDER BY finish, seat, copy, turn, doc_id, size, start)::BIGINT - part AS before FROM timed)
SELECT doc_id, size, source_size, target, sum(least(part, greatest(floor(words)::BIGINT - before, 0)))::BIGINT AS taken
FROM served GROUP BY doc_id, size, source_size, target
"""
