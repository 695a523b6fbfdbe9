"""Connected components of an edge table of any size, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.runtime import discard, materialize, salted_join

ROUNDS = 60


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def edges(self) -> Iterator[tuple[int, int]]:
        for x in list(self.up):
            if (r := self.root(x)) != x:
                yield x, r


EDGES = "u long, v long"
FLUSH = 200_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's edges by stars around each smallest member, in pieces of bounded size."""

    def out(f: Forest) -> pa.RecordBatch:
        pairs = list(f.edges())
        return pa.RecordBatch.from_pydict({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    f = Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if u != v:
                f.join(u, v)
        if len(f.up) > FLUSH:
            yield out(f)
            f = Forest()
    yield out(f)


def components(spark: SparkSession, edges: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Each round sends every node's larger neighbours, then its smaller ones, to its smallest neighbour. Both steps group by
    node with a map-side minimum, so a centre of many edges costs one row per partition. Rounds end when all are stars.
    Joins are sorted at every size: their sides grow with the edges, and Spark's estimate of a side, which does not count the copies of ``salted_join``, would let many times as much pass through the driver.
    """
    now, at = materialize(spark, edges.select("u", "v").where("u <> v").mapInArrow(contract, EDGES), f"{name}-edges")
    for _ in range(ROUNDS):
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # A centre's edges are dealt to several tasks.
        large = salted_join(both, least.hint("merge"), ["u"], ["v"], salts=8).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, smaller.hint("merge"), ["u"], ["v"], salts=8).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        after, path = materialize(spark, small, f"{name}-edges")
        # A round that finds only stars (every node has one edge, no centre is a leaf) has nothing left to join.
        leaves = after.groupBy("u").count()
        open_ends = leaves.where("count > 1").select("u").union(after.select(F.col("v").alias("u")).distinct().join(leaves.hint("merge"), "u", "left_semi"))
        done = open_ends.limit(1).count() == 0
        discard(spark, at)
        now, at = after, path
        if done:
            break
    else:
        raise RuntimeError(f"components of {name} did not settle in {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct()), at
