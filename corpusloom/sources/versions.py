"""Versioned results: all outputs of a write are staged in one pass, then one pointer is swapped.

A version is a folder of its own, with a folder for each part. The file ``CURRENT`` names the versions that were committed, the last one first; it is written beside its place and renamed over it, in one
step on HDFS and local disks. A write that ends before that leaves the old version current, and its own folder is never read; ``sweep`` removes such folders. Older versions are backups until ``sweep`` is told not to keep them.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import exists

POINTER, PART = "CURRENT", "part"


def _files(spark: SparkSession, path: str):
    """Hadoop's path type and file system for path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at, at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed versions, the current one first."""
    at = f"{path}/{POINTER}"
    return [r[0] for r in spark.read.text(at, wholetext=True).select(F.explode(F.split(F.btrim("value"), "\n"))).collect()] if exists(spark, at) else []


def stage(rows: DataFrame, path: str, parts: dict[str, Column] | None = None) -> str:
    """Writes rows as JSON lines in a new version below path, in one pass, and returns its name; nothing that is read changes. With ``parts`` each row goes to the first part whose condition it meets; one that meets none fails the write."""
    name = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    if parts:
        chosen = reduce(lambda when, p: when.when(p[1], F.lit(p[0])), list(parts.items())[1:], F.when(next(iter(parts.values())), F.lit(next(iter(parts)))))
        rows = rows.withColumn(PART, chosen.otherwise(F.raise_error(F.lit("a row belongs to no part"))))
        rows.write.partitionBy(PART).json(f"{path}/{name}")
    else:
        rows.write.json(f"{path}/{name}")
    return name


def stage_outputs(spark: SparkSession, path: str, outputs: dict[str, tuple[DataFrame, str]]) -> str:
    """Writes several outputs, {name: (rows, json or parquet)}, as parts of one new version, and returns its name: a table and its JSON, or the same rows in two renderings. Rows that several outputs are made of should be a table already."""
    name = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    for part, (rows, kind) in outputs.items():
        rows.write.format(kind).save(f"{path}/{name}/{PART}={part}")
    at, files = _files(spark, path)
    files.create(at(f"{path}/{name}/_SUCCESS")).close()
    return name


def commit(spark: SparkSession, path: str, name: str) -> None:
    """Makes a staged version the current one."""
    kind, files = _files(spark, path)
    if not files.exists(kind(f"{path}/{name}/_SUCCESS")):
        raise ValueError(f"{name} is not a whole version")
    _point(spark, path, [name, *committed(spark, path)])


def _point(spark: SparkSession, path: str, names: list[str]) -> None:
    kind, files = _files(spark, path)
    draft = kind(f"{path}/.{POINTER}-{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray("\n".join(names).encode()))
    out.close()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    how = getattr(hadoop, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(how, 1)
    options[0] = how.OVERWRITE
    context = hadoop.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(draft), files.makeQualified(kind(f"{path}/{POINTER}")), options)


def write(rows: DataFrame, path: str, parts: dict[str, Column] | None = None) -> str:
    """Stages rows and commits them; what was current is the first backup."""
    name = stage(rows, path, parts)
    commit(rows.sparkSession, path, name)
    return name


def read(spark: SparkSession, path: str, schema: str, part: str | None = None, back: int = 0, kind: str = "json") -> DataFrame:
    """Rows of the current version, or of the one ``back`` commits before; of one part, in its format, or of all, with ``part`` where there are parts."""
    names = committed(spark, path)
    if back >= len(names):
        raise LookupError(f"{path} has {len(names)} versions")
    at = f"{path}/{names[back]}"
    one = spark.read.option("mode", "FAILFAST").format(kind)
    if part is not None:
        at = f"{at}/{PART}={part}"
        return one.schema(schema).load(at) if exists(spark, at) else spark.createDataFrame([], schema)
    return one.schema(f"{schema}, {PART} string").load(at) if _parted(spark, at) else one.schema(schema).load(at)


def _parted(spark: SparkSession, at: str) -> bool:
    kind, files = _files(spark, at)
    return any(f.getPath().getName().startswith(f"{PART}=") for f in files.listStatus(kind(at)))


def sweep(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Removes versions that were never committed, and committed ones but the last ``keep``; returns their names. Not to be run beside a write."""
    kind, files = _files(spark, path)
    names = committed(spark, path)
    if len(names) > keep >= 1:
        _point(spark, path, names[:keep])
    gone = [f.getPath().getName() for f in files.listStatus(kind(path)) if f.isDirectory() and f.getPath().getName() not in names[: max(1, keep)]]
    for name in gone:
        files.delete(kind(f"{path}/{name}"), True)
    return sorted(gone)
