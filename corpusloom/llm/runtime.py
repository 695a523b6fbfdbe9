"""Session helpers shared by the operators: scratch tables in the cluster's shared folder and shipping of this package."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import shared_dir

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()
#: Rows of a batch, and bytes of one sent to a worker; a longer row comes alone.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex[:12]}"


def materialize(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts lineage with a Parquet table in the shared folder; returns the table and its path for ``discard``."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable by Python workers that were started without the repository on their path."""
    sc = spark.sparkContext
    # Rows are whole texts or sets: smaller batches of Arrow and of the Parquet reader bound what the JVM and a worker hold at once. Results are lazy, so the session keeps these settings.
    arrow = "spark.sql.execution.arrow"
    for key, most in ((f"{arrow}.maxRecordsPerBatch", BATCH_ROWS), (f"{arrow}.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", BATCH_ROWS)):
        plain = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if not plain or not 0 < int(plain[1]) <= most:
            spark.conf.set(key, str(most))
    if str(_ROOT) in os.environ.get("PYTHONPATH", "").split(":") or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    at = Path(tempfile.mkdtemp(prefix="corpusloom-zip-")) / "corpusloom.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((_ROOT / "corpusloom").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    sc.addPyFile(str(at))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """left joined with right, which has few rows for a key, so that a frequent key of left is dealt to ``salts`` tasks by its columns ``spread``."""
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


#: Keys that balanced_join deals out: those with more than this part of all rows, so there are at most so many.
SHARE = 1000


def balanced_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], count: str, how: str = "inner") -> DataFrame:
    """left joined with right, a table of one row per key, whose column ``count`` is the number of left's rows of that key, less that column.

    A key of more than one in ``SHARE`` of these rows goes to tasks in proportion to its rows, by left's columns ``spread``; the list of such keys, of at most ``SHARE`` entries
    whatever the input, is broadcast. No other key holds more than one in ``SHARE``. Keys are never null in right.
    """
    spark = left.sparkSession
    total = right.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    parts = max(partitions(spark), 16)
    hot = F.col(count) * SHARE > total
    salts = F.when(hot, F.ceil(F.col(count) * F.lit(parts) / F.lit(max(total, 1)))).otherwise(1).cast("long")
    listed = right.where(hot).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], salts.alias("_salts"))
    dealt = left
    for k in keys:
        dealt = dealt.withColumn(f"_key_{k}", F.col(k))
    dealt = dealt.join(F.broadcast(listed), [F.col(f"_key_{k}") == F.col(f"_hot_{k}") for k in keys], "left")
    dealt = dealt.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0))).drop("_salts", *[f"_{a}_{k}" for k in keys for a in ("key", "hot")])
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop(count)
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def settle(spark: SparkSession) -> None:
    """Frees what finished queries hold on the driver; Spark's cleaner then removes their shuffle files and broadcasts."""
    trim()
    spark.sparkContext._jvm.System.gc()


#: Most files of a table whose list is broadcast to number its rows, some 20 MB; a table of more files is written with numbers.
FILES = 100_000


def _has_places(docs: DataFrame) -> bool:
    """Whether the source of docs knows a row's place in its file, as Parquet does and text formats do not."""
    try:
        return "row_index" in docs.select("_metadata.row_index").columns
    except AnalysisException:
        return False


def numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str | None]:
    """(row, number): the rows of docs as one column, so that no name can clash, and a number of each that is equal in every scan.

    docs read straight from at most ``FILES`` Parquet files is numbered as it is, by a row's file among the table's files and its place there. Anything else is written first with
    numbers, and that table's path is returned for ``discard``.
    """
    own = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    place = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"))
    # A plan without children: whatever is made of a table may hold a row of it twice.
    straight = docs._jdf.queryExecution().analyzed().children().isEmpty() and _has_places(docs) and 0 < len(docs.inputFiles()) <= FILES
    if not straight:
        return materialize(spark, docs.select(own, F.monotonically_increasing_id().alias("number")), name)
    # One row per file.
    files = [r[0] for r in docs.select(place[0]).distinct().sort("path").collect()]
    listed = spark.createDataFrame([(f, k) for k, f in enumerate(files)], "file string, place long")
    return docs.select(own, *place).join(F.broadcast(listed), F.col("path") == F.col("file")).select("row", (F.shiftleft("place", 40) + F.col("at")).alias("number")), None


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives freed memory back to the system; workers are reused and would keep a task's peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
