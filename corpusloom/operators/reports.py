"""Reports on result tables (model, eval_set, dim, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_dimension(results: DataFrame, dim: int, listed: str = "seq") -> DataFrame:
    """model, eval_set, metric and the value at the dimension nearest to dim; of two as near that which is listed first, by the column ``listed``."""
    return results.groupBy("model", "eval_set", "metric").agg(F.min_by("value", F.struct(F.abs(F.col("dim") - dim), F.col(listed))).alias("value"))


def pivoted(results: DataFrame, dim: int, sets: Sequence[str], listed: str = "seq") -> DataFrame:
    return nearest_dimension(results, dim, listed).groupBy("model", "metric").pivot("eval_set", list(sets)).agg(F.first("value"))


def deltas(base: DataFrame, final: DataFrame) -> DataFrame:
    """dim, metric, base, final, delta; a missing value counts 0."""
    keys = ["eval_set", "dim", "metric"]
    both = base.select(*keys, F.col("value").alias("base")).join(final.select(*keys, F.col("value").alias("final")), keys, "full")
    filled = both.withColumns({"base": F.coalesce("base", F.lit(0.0)), "final": F.coalesce("final", F.lit(0.0))})
    return filled.withColumn("delta", F.round(F.col("final") - F.col("base"), 6))


def best(rows: DataFrame, group: Sequence[str], step: str, score: str) -> DataFrame:
    """The row of the highest score in each group, the earliest step of equals: group, step, score."""
    top = F.max_by(F.struct(step, score), F.struct(F.col(score), -F.col(step))).alias("x")
    return rows.groupBy(*group).agg(top).select(*group, f"x.{step}", f"x.{score}")


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and those models of new that it lacks."""
    return old.unionByName(new.join(old.select("model").distinct(), "model", "left_anti"))


def named_like(rows: DataFrame, column: str, part: str) -> DataFrame:
    return rows.where(F.contains(F.lower(column), F.lit(part.lower())))


def coverage(rows: DataFrame, expected: int) -> DataFrame:
    """One row: rows found, rows expected, and their share."""
    return rows.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(expected).cast("long").alias("expected"), F.round(F.try_divide("n", F.lit(expected)), 6).alias("share"))


def samples(rows: DataFrame, group: str, order: str, n: int = 2) -> DataFrame:
    """The first n rows of each group in order, with their place from 1."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long")).where(F.col("place") <= n)


def split_statistics(train: DataFrame, evaluation: DataFrame, chunk: str = "chunk_id") -> DataFrame:
    """part, n_pairs, n_chunks, pairs_per_chunk of both parts and n_shared, the chunks that both hold."""
    both = train.select(chunk, F.lit("train").alias("part")).union(evaluation.select(chunk, F.lit("eval")))
    chunks = both.groupBy(chunk).pivot("part", ["train", "eval"]).agg(F.count(F.lit(1)))
    long = chunks.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("k"), (F.col("train").isNotNull() & F.col("eval").isNotNull()).alias("shared")) for p in ("train", "eval")])).alias("x")).select("x.*").where("k is not null")
    return long.groupBy("part").agg(F.sum("k").alias("n_pairs"), F.count(F.lit(1)).alias("n_chunks"), F.round(F.sum("k") / F.count(F.lit(1)), 6).alias("pairs_per_chunk"), F.sum(F.col("shared").cast("long")).alias("n_shared"))


def listing(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """group and its rows' columns as a sorted array; for groups of a chunk's size."""
    return rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
