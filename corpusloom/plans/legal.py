"""The structural parser on short texts that are made of the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import structure

EU_TEXT = """Voorwoord
(1)
Noot.
(1)
Overwegende dat dit de eerste overweging is, met ge-
gevens.
(2) Tweede overweging.
HOOFDSTUK I
ALGEMENE BEPALINGEN
Artikel 1
Onderwerp
Deze verordening regelt iets.
Afdeling 1
Eerste afdeling
Artikel 2
Definities
1) begrip: een woord;
2) ander: nog een woord.
HOOFDSTUK II
SLOT
Artikel 3
Einde
Dit is het einde.
BIJLAGE I
Lijst
Een, twee en drie.
"""
LAW_TEXT = """Wij, bij de gratie, doen te weten.
Hoofdstuk 1. Algemeen
Paragraaf 1.1. Begrippen
Artikel 1. Begrippen
In deze wet is een begrip een woord.
Artikel 12a. Slot
Deze wet eindigt hier.
Lasten en bevelen
"""
SOURCES = [structure.Source("eu", "Verordening", definitions_article=2, annexes=True), structure.Source("wet", "Wet", layout="law", end_marker="Lasten en bevelen")]


def structure_parse_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts for each nation, whose name is the title of an article."""
    texts = F.explode(F.array(*[F.struct(F.lit(n).alias("source"), F.lit(t).alias("text")) for n, t in (("eu", EU_TEXT), ("wet", LAW_TEXT))]))
    docs = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("doc"), texts.alias("t")).select("doc", "t.source", F.replace("t.text", F.lit("Onderwerp"), F.col("doc")).alias("text"))
    found = structure.chunked(docs, SOURCES, "doc")
    return found.select("source", "doc", "chunk_id", "section_type", "chapter_number", "section", F.col("article_number").cast("long").alias("article_number"), "hierarchy_path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _of_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A law for each nation, whose articles are its suppliers, and a regulation for each region, whose articles are its nations and which has an annex."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    joined = lambda n, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(n.alias("n"), text.alias("text")))), lambda x: x["text"]), "")
    nation = read("nation")
    one = F.concat(F.lit("Artikel "), F.col("s_suppkey"), F.lit(". "), F.col("s_name"), F.lit("\nSaldo van "), F.col("s_name"), F.lit(".\n"))
    law = read("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(joined(F.col("s_suppkey"), one).alias("body"))
    law = law.select(F.lit("wet").alias("source"), F.col("n_name").alias("doc"), F.concat(F.lit("Kort.\nHoofdstuk 1. "), "n_name", F.lit("\nParagraaf 1.2. Leden\n"), "body").alias("text"))
    land = F.concat(F.lit("Artikel "), F.col("n_nationkey") + 1, F.lit("\n"), F.col("n_name"), F.lit("\nDit land.\n"))
    eu = nation.join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(joined(F.col("n_nationkey"), land).alias("body"))
    eu = eu.select(F.lit("eu").alias("source"), F.col("r_name").alias("doc"), F.concat(F.lit("HOOFDSTUK I\nLANDEN VAN "), F.upper("r_name"), F.lit("\n"), "body", F.lit("BIJLAGE I\nLijst\nEinde.\n")).alias("text"))
    return law.unionByName(eu)


def structure_parse_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.chunked(_of_tables(spark, sf_dir), [structure.Source("eu", "Verordening", annexes=True), structure.Source("wet", "Wet", layout="law")], "doc")
    return found.select("source", "doc", "chunk_id", "section_type", "chapter", "section", F.col("article_number").cast("long").alias("article_number"), "article_title", "annex_title", "hierarchy_path", "context_header", "text", F.col("token_estimate").cast("long").alias("token_estimate"))


def structure_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = structure.statistics(structure.chunked(_of_tables(spark, sf_dir), [structure.Source("eu", "Verordening", annexes=True), structure.Source("wet", "Wet", layout="law")], "doc"))
    return s.select("n_chunks", F.col("min_tokens").cast("long").alias("min_tokens"), F.col("max_tokens").cast("long").alias("max_tokens"), "total_tokens", F.col("mean_tokens").cast("long").alias("mean_tokens"), F.col("by_type")["artikel"].alias("n_articles"), F.col("by_type")["bijlage"].alias("n_annexes"))


QUERIES = {f.__name__: f for f in (structure_parse_golden, structure_parse_tables, structure_statistics)}

_GOLDEN = [
    ("eu", 0, "overweging", "", "", None, "Overwegingen > (1) + (2)", "Overwegende dat dit de eerste overweging is, met gegevens.\n\nTweede overweging."),
    ("eu", 1, "artikel", "HOOFDSTUK I", "", 1, "HOOFDSTUK I — ALGEMENE BEPALINGEN > Artikel 1 — Onderwerp", "Onderwerp\nDeze verordening regelt iets.\nAfdeling 1\nEerste afdeling"),
    ("eu", 2, "artikel", "HOOFDSTUK I", "Afdeling 1 — Eerste afdeling", 2, "HOOFDSTUK I — ALGEMENE BEPALINGEN > Afdeling 1 — Eerste afdeling > Artikel 2 — Definities > Definitie 1, 2", "1) begrip: een woord;\n\n2) ander: nog een woord."),
    ("eu", 3, "artikel", "HOOFDSTUK II", "", 3, "HOOFDSTUK II — SLOT > Artikel 3 — Einde", "Einde\nDit is het einde."),
    ("eu", 4, "bijlage", "", "", None, "Bijlage I — Lijst", "Een, twee en drie."),
    ("wet", 0, "artikel", "1", "Paragraaf 1.1 — Begrippen", 1, "Hoofdstuk 1 — Algemeen > Paragraaf 1.1 — Begrippen > Artikel 1 — Begrippen", "In deze wet is een begrip een woord."),
    ("wet", 1, "artikel", "1", "Paragraaf 1.1 — Begrippen", 12, "Hoofdstuk 1 — Algemeen > Paragraaf 1.1 — Begrippen > Artikel 12a — Slot", "Deze wet eindigt hier."),
]


def _literal(x: object) -> str:
    return "NULL" if x is None else f"{x}::BIGINT" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


_TABLES = r"""WITH l AS (
  SELECT 'wet' AS source, n_name AS doc, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS chunk_id, 'artikel' AS section_type, 'Hoofdstuk 1 — ' || n_name AS chapter, 'Paragraaf 1.2 — Leden' AS section,
    s_suppkey::BIGINT AS article_number, s_name AS article_title, '' AS annex_title, 'Hoofdstuk 1 — ' || n_name || ' > Paragraaf 1.2 — Leden > Artikel ' || s_suppkey || ' — ' || s_name AS hierarchy_path, 'Wet' AS display, 'Saldo van ' || s_name || '.' AS text
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'eu', r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) - 1, 'artikel', 'HOOFDSTUK I — LANDEN VAN ' || upper(r_name), '', n_nationkey + 1, n_name, '',
    'HOOFDSTUK I — LANDEN VAN ' || upper(r_name) || ' > Artikel ' || (n_nationkey + 1) || ' — ' || n_name, 'Verordening', n_name || chr(10) || 'Dit land.' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'eu', r_name, count(*), 'bijlage', '', '', NULL, '', 'Lijst', 'Bijlage I — Lijst', 'Verordening', 'Einde.' FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)"""
SQL = {
    # What the rules give for the two texts, by hand.
    "structure_parse_golden": "SELECT source, n_name AS doc, chunk_id, section_type, chapter_number, section, article_number, replace(hierarchy_path, 'Onderwerp', n_name) AS hierarchy_path, md5(replace(text, 'Onderwerp', n_name)) AS text_md5 FROM nation, (VALUES "
    + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _GOLDEN)
    + ") AS t(source, chunk_id, section_type, chapter_number, section, article_number, hierarchy_path, text)",
    "structure_parse_tables": _TABLES + " SELECT * EXCLUDE (display), display || ' > ' || hierarchy_path || ':' AS context_header, (length(text) // 4)::BIGINT AS token_estimate FROM l",
    "structure_statistics": _TABLES + " SELECT count(*) AS n_chunks, min(length(text) // 4)::BIGINT AS min_tokens, max(length(text) // 4)::BIGINT AS max_tokens, sum(length(text) // 4)::BIGINT AS total_tokens, sum(length(text) // 4)::BIGINT // count(*) AS mean_tokens, count(*) FILTER (section_type = 'artikel') AS n_articles, count(*) FILTER (section_type = 'bijlage') AS n_annexes FROM l",
}
