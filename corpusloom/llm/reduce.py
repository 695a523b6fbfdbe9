"""Sums of fixed-size arrays over all tasks by a two-level tree of blocks; the result's size does not depend on the input."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.runtime import discard, materialize

BLOCKS = 16
SCHEMA = "block int, part int, data binary"


def _deflated(x: np.ndarray) -> bytes:
    """Dense floats don't get smaller, and are only stored."""
    return zlib.compress(x.tobytes(), 0 if x.dtype.kind == "f" and np.count_nonzero(x) * 4 > x.size * 3 else 1)


def packed(a: np.ndarray, part: int) -> list[tuple[int, int, bytes]]:
    """Rows (block, part, data) of an array's non-empty pieces."""
    return [(k, part, _deflated(x)) for k, x in enumerate(np.array_split(a, BLOCKS)) if x.any()]


def _sum(dtype: str, how: str):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for d in pdf["data"]:
            x = np.frombuffer(zlib.decompress(d), dtype)
            total = x.copy() if total is None else np.bitwise_or(total, x, out=total) if how == "or" else np.add(total, x, out=total)
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": [0], "data": [_deflated(total)]})

    return add


def total(rows: DataFrame, size: int, dtype: str = "uint32", how: str = "add") -> np.ndarray:
    """The array summed over all rows, brought to the driver: ``size`` entries, whatever the input."""
    # The rows are counted to choose the tree's width, and must not be made twice for that.
    rows, at = materialize(rows.sparkSession, rows, "partial-sums")
    out = total_of(rows, size, dtype, how)
    discard(rows.sparkSession, at)
    return out


def merged(rows: DataFrame, dtype: str = "uint32", how: str = "add") -> DataFrame:
    """A row of each block that is not empty, with its sum, of rows that are a table already."""
    n = rows.count()
    fan = max(1, int((n / BLOCKS) ** 0.5))
    once = rows.withColumn("part", F.pmod("part", F.lit(fan))).groupBy("block", "part").applyInPandas(_sum(dtype, how), SCHEMA)
    return once.groupBy("block").applyInPandas(_sum(dtype, how), SCHEMA)


def filled(blocks: DataFrame, size: int, dtype: str) -> np.ndarray:
    """The array of a table of blocks, brought to the driver one at a time."""
    out = np.zeros(size, dtype)
    pieces = np.array_split(out, BLOCKS)
    for r in blocks.select("block", "data").toLocalIterator():
        pieces[r[0]][:] = np.frombuffer(zlib.decompress(r[1]), dtype)
    return out


def total_of(rows: DataFrame, size: int, dtype: str = "uint32", how: str = "add") -> np.ndarray:
    """``total`` of rows that are a table already."""
    sums, at = materialize(rows.sparkSession, merged(rows, dtype, how), "sums")
    out = filled(sums, size, dtype)
    discard(rows.sparkSession, at)
    return out
