"""A training-data pipeline of five stages over documents, each a Parquet table that the next one reads.

Every stage works on all rows of its predecessor, and its decisions take effect. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, language_id, line_dedup, ngram_join, piece_lattice
from corpusloom.llm.queries import SEGMENTATIONS, tokenizer_path
from corpusloom.llm.runtime import discard, materialize, settle, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of whose languages the best is hardly more probable than a guess. Each row is judged by its text alone."""
    settle(spark)
    return language_id.confident(spark, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document; n_chars follows.

    Rows of equal doc_id count as one document, rows without one together as one; each loses its own lines. A text that loses no line stays as it is, null included.
    """
    settle(spark)
    marked = line_dedup.with_bitmaps(spark, docs)
    kept = marked.withColumn("text", F.when(F.col("keep_runs").isNull(), F.col("text")).otherwise(line_dedup.kept_text(F.col("text"), F.col("keep_runs"))))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("keep_runs").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones stays, that of the smallest doc_id; repeated rows and rows without a doc_id are told apart by their place in the table.

    Rows without words are linked with nothing and stay.
    """
    settle(spark)
    return ngram_join.one_of_each(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item, or a paraphrase of one, go; those of null or empty texts stay."""
    settle(spark)
    return decontaminate.uncontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every row that is left; a null or empty text has one, of no pieces."""
    settle(spark)
    return piece_lattice.sampled_segmentations(spark, docs, tokenizer_path("piece_bpe_32k.model"), SEGMENTATIONS)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("SentencePiece encoding and decoding", pieces),
]

#: Language ID, decontamination and sampling are no SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's table is removed when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = materialize(spark, stage(spark, docs, sf_dir), "stage-" + "".join(c if c.isalnum() else "-" for c in name.lower()))
        if before:
            discard(spark, before)
        before = path
    return docs
