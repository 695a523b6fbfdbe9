"""Arriving JSON lines: replies of a model are validated and split by score as they come, a batch at a time and each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import json_payload
from corpusloom.operators.pairs import by_threshold, valid_scores


def scored_replies(spark: SparkSession, folder: str, schema: str = "pair_id long, reply string") -> DataFrame:
    return spark.readStream.schema(schema).json(folder).withColumn("quality_scores", valid_scores(json_payload(F.col("reply"))))


def split_by_score(rows: DataFrame, out: str, checkpoint: str, least: float = 7.0) -> StreamingQuery:
    """Writes kept and rejected rows below out, a folder per batch: a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        kept, rejected = by_threshold(batch, F.col("quality_scores.overall"), least)
        kept.write.mode("overwrite").parquet(f"{out}/kept/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
