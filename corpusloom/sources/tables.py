"""Readers, writers and shared scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the folder that all executors share."""
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *written: DataFrame) -> None:
    """Removes the scratch tables that these rows are read from."""
    scratch = re.sub(r"^file:/+", "/", f"{shared_dir(spark)}/corpusloom/")
    for rows in written:
        for folder in {f.rpartition("/")[0] for f in rows.inputFiles()}:
            if scratch in re.sub(r"^file:/+", "/", folder):
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; on a cluster this is an error, as executors don't share local folders."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def clear(spark: SparkSession) -> None:
    """Removes all scratch tables of this library, results that have not been read included."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/corpusloom")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def dense_index(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """rows with ``name``, dense from 0 in each group of ``by``, in order. Ranks count within ranges of the order, and ranges are added up by a table of one row per range and group,
    so a group of any size spans tasks. Rows of equal order get their numbers in any order."""
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    placed = materialize(spark, ranged.withColumn("_dense_part", F.spark_partition_id()).withColumn("_dense_seat", F.monotonically_increasing_id()), "ranges")
    group = [F.col(b).alias(f"_dense_by{i}") for i, b in enumerate(by)]
    sizes = placed.groupBy("_dense_part", *group).agg(F.count(F.lit(1)).alias("_dense_n"), F.min("_dense_seat").alias("_dense_first")).withColumnRenamed("_dense_part", "_dense_of")
    before = Window.partitionBy(*[f"_dense_by{i}" for i in range(len(by))]).orderBy("_dense_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_dense_start", F.coalesce(F.sum("_dense_n").over(before), F.lit(0)))
    same = F.col("_dense_part") == F.col("_dense_of")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_dense_by{i}"))
    return placed.join(starts, same).select(*rows.columns, (F.col("_dense_start") + F.col("_dense_seat") - F.col("_dense_first")).alias(name))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """One object per line; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)


def renamed(rows: DataFrame, names: dict[str, str], others: bool = False) -> DataFrame:
    """The columns {old: new} of rows under their new names, in that order, and with ``others`` those not named behind them. A column that is missing, or a name that two columns would have, is an error."""
    left = [c for c in rows.columns if c not in names] if others else []
    if missing := set(names) - set(rows.columns):
        raise KeyError(f"no column {sorted(missing)}")
    if len({*names.values(), *left}) < len(names) + len(left):
        raise ValueError("two columns of one name")
    return rows.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()], *[F.col(f"`{c}`") for c in left])


def json_lines_if_any(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """Rows of the paths that exist; none give an empty table."""
    found = [p for p in paths if exists(spark, p)]
    return json_lines(spark, found, schema) if found else spark.createDataFrame([], schema)


def preferred(spark: SparkSession, path: str, filtered: bool = True) -> str:
    """The _filtered file beside path, if it is wanted and there is one."""
    stem, dot, suffix = path.rpartition(".")
    better = f"{stem}_filtered{dot}{suffix}"
    return better if filtered and exists(spark, better) else path


def json_lines_matching(spark: SparkSession, folder: str, pattern: str, schema: str, without: Sequence[str] = ("filtered", "rejected", "scored")) -> DataFrame:
    """Rows of the folder's files that match pattern, with ``file``, except those with one of the words in their names."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("pathGlobFilter", pattern).json(folder).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    for word in without:
        rows = rows.where(~F.contains("file", F.lit(word)))
    return rows


def whole_texts(spark: SparkSession, path: str, end_marker: str | None = None) -> DataFrame:
    """path, text of whole files; text ends before the marker where it is found."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    if end_marker:
        at = F.locate(end_marker, F.col("text"))
        rows = rows.withColumn("text", F.when(at > 0, F.regexp_replace(F.substring("text", F.lit(1), at - 1), r"(?U)^\s+|\s+$", "")).otherwise(F.col("text")))
    return rows


def page_texts(pages: DataFrame) -> DataFrame:
    """doc, text from pages(doc, page, text) that another program has extracted, joined in order of page."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])
    return pages.groupBy("doc").agg(F.array_join(ordered, "\n").alias("text"))


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """id, text of files that hold a JSON object of strings, read in byte ranges; a malformed file fails the read."""
    from corpusloom.sources import json_maps  # which needs this module

    return json_maps.json_map(spark, path)


def json_relations(spark: SparkSession, path: str) -> DataFrame:
    """qid, cid of a JSON object of arrays; each pair once. A malformed file fails the read."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<string>>", {"mode": "FAILFAST"})).alias("qid", "cids"))
    return rows.select("qid", F.explode("cids").alias("cid")).distinct()


def write_json_map(rows: DataFrame, path: str, key: str, value: str) -> None:
    """One JSON object of rows(key, value). For small tables: the object is one string."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("key"), F.col(value).alias("value"))))
    rows.agg(F.to_json(F.map_from_entries(entries)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def results_json(spark: SparkSession, path: str) -> DataFrame:
    """model, eval_set, dim, metric, value, seq of a JSON object model > set > dimension > metric > value; seq is the place of the dimension in its set."""
    kind = "map<string,map<string,map<string,map<string,double>>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("model", "sets"))
    rows = rows.select("model", F.explode("sets").alias("eval_set", "dims")).select("model", "eval_set", F.posexplode(F.map_entries("dims")).alias("seq", "d"))
    return rows.select("model", "eval_set", F.col("d.key").cast("long").alias("dim"), F.explode("d.value").alias("metric", "value"), F.col("seq").cast("long").alias("seq"))


def write_results_json(results: DataFrame, path: str) -> None:
    """The object that ``results_json`` reads, dimensions in order of seq where there is one, else of size. One string: for result tables."""
    order = "seq" if "seq" in results.columns else "dim"
    pack = lambda key, value, *first: F.map_from_entries(F.transform(F.sort_array(F.collect_list(F.struct(*first, key.alias("k"), value.alias("v")))), lambda x: F.struct(x["k"], x["v"])))
    dims = results.groupBy("model", "eval_set", "dim").agg(F.min(order).alias("o"), pack(F.col("metric"), F.col("value")).alias("m"))
    sets = dims.groupBy("model", "eval_set").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col("dim").cast("string").alias("k"), "m")), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)), lambda x: F.struct(x["k"], x["m"]))).alias("m"))
    entries = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))), lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)))
    models = sets.groupBy("model").agg(entries("eval_set", "m").alias("m"))
    models.agg(F.to_json(entries("model", "m")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_versioned(rows: DataFrame, path: str) -> str:
    """Writes a new version below path; returns its place. Older versions stay."""
    at = f"{path.rstrip('/')}/version={datetime.now(UTC):%Y%m%dT%H%M%S%f}"
    rows.write.json(at)
    return at


def write_kept_rejected_scored(spark: SparkSession, scored: DataFrame, path: str, keep, scores: str) -> None:
    """kept without its scores, rejected and all rows with them; the rows are computed once."""
    rows = materialize(spark, scored, "scored")
    rows.where(keep).drop(scores).write.mode("overwrite").json(f"{path}/kept")
    rows.where(~keep).write.mode("overwrite").json(f"{path}/rejected")
    rows.write.mode("overwrite").json(f"{path}/scored")


def text_pages(content: bytes) -> Iterator[str]:
    """Pages of a UTF-8 text, which form feeds end."""
    for page in content.split(b"\f"):
        yield page.decode("utf-8")


def pdf_pages(content: bytes) -> Iterator[str]:
    """Pages of a PDF file, by the pypdf library where it is installed."""
    from io import BytesIO

    import pypdf

    for page in pypdf.PdfReader(BytesIO(content)).pages:
        yield page.extract_text()


def binary_pages(spark: SparkSession, path: str | Sequence[str], reader: Callable[[bytes], Iterator[str]] = text_pages, pattern: str = "*") -> DataFrame:
    """doc, page, text, error of binary files: a row for each page, numbered from 0, which leaves its task as soon as it is read.

    A file that cannot be read gives the pages before its fault, then a row with the kind of its fault and no text. A file of no bytes has no page. ``page_texts`` joins the pages of a file.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for doc, content in zip(f["path"], f["content"], strict=True):
                n = 0
                try:
                    for text in reader(content):
                        yield pd.DataFrame({"doc": [doc], "page": [n], "text": [text], "error": [None]}, dtype=object)
                        n += 1
                except Exception as e:  # noqa: BLE001  a file may be broken in any way; its row says how
                    yield pd.DataFrame({"doc": [doc], "page": [n], "text": [None], "error": [type(e).__name__]}, dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "doc string, page long, text string, error string")
