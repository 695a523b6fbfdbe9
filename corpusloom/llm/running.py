"""Running totals over a global order: ranges of the order are summed apart, and a table of one row per range and group adds them up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusloom.llm.runtime import materialize, partitions, ship

#: Most rows of the table of ranges and groups for it to be broadcast, some 10 MB; a larger one is joined by a shuffle.
STARTS = 200_000


def _sums(schema: pa.Schema, value: str, by: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(v) - v
            group = b.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(len(v), np.int64)
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sizes = np.diff(np.append(heads, len(v)))
            base = -before[heads]
            if group[0] == last:
                base[0] += carry
            before = before + np.repeat(base, sizes)
            last, carry = group[-1], int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int64)), pa.array(before)], schema=schema)

    return run


def running_total(spark: SparkSession, rows: DataFrame, order: list[Column], value: str, out: str, by: str | None = None) -> DataFrame:
    """rows with ``out``, the sum of the long ``value`` over all rows before, in the order of ``order``; with the long column ``by``, over those of the same group, ``by`` being the first
    of the order. No value is null. Rows of equal order come in any order, so a last column that is unique makes the result repeatable.

    Rows are range-partitioned, so a group of any size spans tasks; what each task passes on is a total for each group that it holds.
    """
    ship(spark)
    ranged = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", _part long, `{out}` long"
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.schema).append(pa.field("_part", pa.int64())).append(pa.field(out, pa.int64()))
    placed, _ = materialize(spark, ranged.mapInArrow(_sums(schema, value, by), kinds), "running")
    group = [by] if by else []
    sums = placed.groupBy("_part", *group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    if by is None or sums.count() <= STARTS:  # without groups there is a row for each range
        starts = F.broadcast(starts)
    return placed.join(starts, ["_part", *group]).select(*rows.columns, (F.col("_start") + F.col(out)).alias(out))
