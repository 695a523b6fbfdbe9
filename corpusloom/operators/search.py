"""Exact search by cosine within sets, in pairs of blocks that bounds can rule out.

Rows of queries and corpus are ordered by their nearest of a bounded number of pivots, and cut into blocks. A block of the corpus is described by its rows' pivots, and by their largest angle to each.
The angle of a query to a row is at least that to the row's pivot, less that radius: so no row of a pivot is more similar than the cosine of the rest. Each block of queries first searches the blocks nearest to it,
until every query has seen k rows; what its k-th row then reaches is a floor, and only blocks that may hold something above some query's floor are searched after. Inside a pair of blocks, rows go
whose first dimensions' product, and the lengths of the rest, cannot reach a floor. Both bounds lose nothing.

A row is copied once for each block of the other side that its own meets, which are blocks of thousands of rows. Rows without a direction (of length 0 at some dimension) are met by all, and meet all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.runtime import trim
from corpusloom.sources.tables import dense_index, materialize

#: Rows of a block of queries and of one of the corpus; similarities are computed ``TILE`` queries at a time, 4 MB. A pair of blocks returns up to k rows for each query and dimension, as Arrow columns
#: that go to the JVM as they are, so a block of queries is the smaller.
QUERY_BLOCK, CORPUS_BLOCK, TILE = 2048, 8192, 64
#: Rows that are placed by the pivots at once, 8 MB.
PLACED = 1024
#: Blocks of each side up to which smaller blocks than these may be asked for: their pairs would grow as the square of the input.
SMALL_BLOCKS = 64
#: Most pivots, and rows of the corpus for each.
PIVOTS, PER_PIVOT = 1024, 512
#: What rounding may take from an angle and from a similarity.
ANGLE_SLACK, SIM_SLACK = 1e-6, 1e-9
PAIR = "_set string, qb long, cb long"
HITS = "_set string, dim int, qid long, cid long, sim double"
NAMES = ["_set", "dim", "qid", "cid", "sim"]
TYPES = pa.schema(list(zip(NAMES, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()), strict=True)))


def unit(m: np.ndarray, dim: int) -> np.ndarray:
    m = m[:, :dim].astype(np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-9)


def _stacked(rows: pd.DataFrame) -> np.ndarray:
    return np.stack(rows["vec"].to_numpy())


def _undirected(m: np.ndarray, dims: Sequence[int]) -> np.ndarray:
    """Rows that are not of unit length at each dimension."""
    return np.any([np.linalg.norm(m[:, :d].astype(np.float64), axis=1) < 1e-9 for d in dims], axis=0)


def _first(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest entries, ties by column: all that reach the k-th largest, then in order."""
    n = sim.shape[1]
    if n > k:
        row, col = np.nonzero(sim >= np.partition(sim, n - k, axis=1)[:, n - k, None])
    else:
        row, col = (x.ravel() for x in np.indices(sim.shape))
    order = np.lexsort((col, -sim[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _best(dims: Sequence[int], k: int) -> Callable:
    """The k best rows of one block of the corpus for each query of a block, at each dimension, of those that reach the query's floor."""

    def run(key: tuple, queries: pd.DataFrame, corpus: pd.DataFrame) -> pa.Table:
        out = []
        if len(queries) and len(corpus):
            corpus = corpus.sort_values("cid", kind="stable")
            q, c = _stacked(queries), _stacked(corpus)
            qid, cid = queries["qid"].to_numpy(), corpus["cid"].to_numpy()
            floors = np.stack(queries["floors"].to_numpy()) if "floors" in queries else None
            caps = queries["cap"].to_numpy() if "cap" in queries else None
            for n, d in enumerate(dims):
                right = unit(c, d)
                for lo in range(0, len(q), TILE):
                    tile = slice(lo, lo + TILE)
                    row, col, sim = _tile(unit(q[tile], d), right, k, None if caps is None else caps[tile], None if floors is None else floors[tile, n])
                    out.append(pa.record_batch([pa.array([key[0]] * len(row), pa.string()), pa.array(np.full(len(row), d, np.int32)), pa.array(qid[tile][row]), pa.array(cid[col]), pa.array(sim)], names=NAMES))
        return pa.Table.from_batches(out, TYPES)

    return run


def _tile(left: np.ndarray, right: np.ndarray, k: int, caps: np.ndarray | None, floors: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of left, rows of right and similarities of each row's k best, ties by right's; of those that reach floors, where most do not, only these are sorted."""
    cols = None
    if floors is not None:
        cols = _reachable(left, right, floors)
        if not len(cols):
            return cols, cols, np.zeros(0)
    sim = left @ (right if cols is None or len(cols) == len(right) else right[cols]).T
    if caps is not None:
        sim[np.round(sim, 12) > caps[:, None]] = -np.inf
    if floors is not None:
        high = sim >= floors[:, None] - SIM_SLACK
        if np.count_nonzero(high) * 2 < high.size:
            row, col = np.nonzero(high)
            row, col = (x[~np.isneginf(sim[row, col])] for x in (row, col))
            found = np.round(sim[row, col], 12)
            order = np.lexsort((col, -found, row))
            row, col, found = row[order], col[order], found[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            return row[keep], cols[col[keep]], found[keep]
        sim[~high] = -np.inf
    row, col = _first(np.round(sim, 12, out=sim), k)
    found = sim[row, col]
    keep = ~np.isneginf(found)
    return row[keep], col[keep] if cols is None else cols[col[keep]], found[keep]


def _hits(dims: Sequence[int], k: int) -> Callable:
    """``_best`` of Arrow's tables. A worker is kept for other tasks, so what a pair of blocks took goes back to the system."""
    best = _best(dims, k)

    def run(key: tuple, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if len(queries) * len(corpus) >= TILE * CORPUS_BLOCK:
            trim()
        return best([x.as_py() for x in key], queries.to_pandas(), corpus.to_pandas())

    return run


def _keyed(rows: pd.DataFrame, key: tuple) -> pd.DataFrame:
    """rows of the set that a group's key begins with, as plain strings."""
    return rows.assign(_set=pd.Series([key[0]] * len(rows), index=rows.index, dtype=object))[["_set", *rows.columns]]


def _reachable(left: np.ndarray, right: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """Columns that may reach some row's floor, by a quarter of the dimensions and the lengths of the rest."""
    part = max(1, left.shape[1] // 4)
    rest = [np.sqrt(np.maximum(0, (x[:, part:] ** 2).sum(axis=1))) for x in (left, right)]
    most = left[:, :part] @ right[:, :part].T + rest[0][:, None] * rest[1][None, :]
    return np.flatnonzero((most >= floors[:, None] - SIM_SLACK).any(axis=0))


def _pivots(corpus: DataFrame, n: int, dim: int) -> np.ndarray:
    """Vectors of the corpus' rows of least hash, at most ``PIVOTS``, each followed by the nearest that is left."""
    rows = corpus.select("cid", "vec").orderBy(F.xxhash64("cid"), "cid").limit(max(1, min(PIVOTS, n // PER_PIVOT))).collect()
    left = unit(np.array([r.vec for r in rows], np.float64), dim)
    chain, free = [0], set(range(1, len(left)))
    while free:
        near = left @ left[chain[-1]]
        chain.append(max(free, key=lambda i: (near[i], -i)))
        free.discard(chain[-1])
    return np.array([rows[i].vec for i in chain], np.float64)


def _placed(pivots: np.ndarray, dims: Sequence[int]) -> Callable:
    """Adds each row's nearest pivot, -1 for rows without a direction, and its angle to it at each dimension."""

    def run(frames):
        at = [unit(pivots, d) for d in dims]
        widest = int(np.argmax(dims))
        for f in frames:
            if not len(f):
                continue
            m = _stacked(f)
            near, angles = np.zeros(len(m), np.int64), np.zeros((len(m), len(dims)))
            for lo in range(0, len(m), PLACED):
                tile = slice(lo, lo + PLACED)
                near[tile] = np.argmax(unit(m[tile], dims[widest]) @ at[widest].T, axis=1)
                for n, (d, p) in enumerate(zip(dims, at, strict=True)):
                    angles[tile, n] = np.arccos(np.clip((unit(m[tile], d) * p[near[tile]]).sum(axis=1), -1, 1))
            none = _undirected(m, dims)
            angles[none] = 0.0
            yield f.assign(pivot=np.where(none, -1, near).astype(np.int64), angles=list(angles))

    return run


def _angles(queries: pd.DataFrame, parts: pd.DataFrame, pivots: np.ndarray, dim: int) -> np.ndarray:
    """Least angles that each query may have to the rows of each part: 0 where either has no direction."""
    m = _stacked(queries)
    to = parts["pivot"].to_numpy()
    theta = np.arccos(np.clip(unit(m, dim) @ unit(pivots, dim)[np.maximum(to, 0)].T, -1, 1))
    theta[:, to < 0] = 0.0
    theta[_undirected(m, [dim])] = 0.0
    return theta


def _seeds(pivots: np.ndarray, dims: Sequence[int], k: int) -> Callable:
    """Blocks that hold the parts nearest to a query, until it has seen k rows."""

    def run(key: tuple, queries: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(0, np.int64)
        if len(queries) and len(parts):
            n, cb = parts["n"].to_numpy(), parts["cb"].to_numpy()
            for lo in range(0, len(queries), TILE):
                order = np.argsort(_angles(queries[lo : lo + TILE], parts, pivots, max(dims)), axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                found = np.union1d(found, cb[order[before < k]])
        return _keyed(pd.DataFrame({"qb": key[1], "cb": found}), key)

    return run


def _others(pivots: np.ndarray, dims: Sequence[int]) -> Callable:
    """Blocks that hold a part of which a row may reach a query's floor."""

    def run(key: tuple, queries: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(0, np.int64)
        if len(queries) and len(parts):
            radii, cb = np.stack(parts["radii"].to_numpy()), parts["cb"].to_numpy()
            for lo in range(0, len(queries), TILE):
                some = queries[lo : lo + TILE]
                floors = np.stack(some["floors"].to_numpy())
                for j, d in enumerate(dims):
                    least = np.maximum(0, _angles(some, parts, pivots, d) - radii[:, j] - ANGLE_SLACK)
                    found = np.union1d(found, cb[(np.cos(least) >= floors[:, j, None] - SIM_SLACK).any(axis=0)])
        return _keyed(pd.DataFrame({"qb": key[1], "cb": found}), key)

    return run


def grown(n: int, block: int, most: int) -> int:
    """Rows of a block, of which n rows make at most ``SMALL_BLOCKS`` until it has the usual size."""
    return max(block, min(most, -(-n // SMALL_BLOCKS)))


def _met(queries: DataFrame, corpus: DataFrame, pairs: DataFrame, dims: Sequence[int], k: int) -> DataFrame:
    """Hits of the pairs of blocks."""
    left, right = queries.join(pairs, ["_set", "qb"]), corpus.select("_set", "cb", "cid", "vec").join(pairs, ["_set", "cb"])
    return _paired(left, right, ["_set", "qb", "cb"], dims, k)


def _paired(left: DataFrame, right: DataFrame, keys: list[str], dims: Sequence[int], k: int) -> DataFrame:
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_hits(dims, k), HITS)


def search(queries: DataFrame, corpus: DataFrame, k: int, dims: Sequence[int], by: str | None = None, query_block: int | None = None, corpus_block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, pairs). hits: [by,] dim, qid, cid, sim, rank, the k most similar rows of corpus([by,] cid, vec) for each of queries([by,] qid, vec[, cap]) at each truncated dimension, within the query's set;
    rows more similar than a query's cap are left out, ties go by cid. pairs: [by,] n_pairs, n_met, the pairs of blocks and those that were searched.

    A row may be in any number of sets, as one row of each; rows without a set are in none. Ids are unique within a set.
    """
    spark = queries.sparkSession
    query_block, corpus_block = query_block or QUERY_BLOCK, corpus_block or CORPUS_BLOCK
    name = F.col(by).cast("string") if by else F.lit("")
    extra = ["cap"] if "cap" in queries.columns else []
    q = queries.select(name.alias("_set"), F.col("qid").cast("long"), "vec", *extra).where("_set is not null")
    c = corpus.select(name.alias("_set"), F.col("cid").cast("long"), "vec").where("_set is not null")
    n_q, n_c = q.count(), c.count()
    query_block, corpus_block = (grown(n, block, most) for n, block, most in ((n_q, query_block, QUERY_BLOCK), (n_c, corpus_block, CORPUS_BLOCK)))
    own = [F.col("_set").cast(queries.schema[by].dataType).alias(by)] if by else []
    if n_q <= query_block and n_c <= corpus_block:
        # One pair of blocks for each set, at most.
        found = _paired(q, c, ["_set"], dims, k)
        met = q.select("_set").intersect(c.select("_set")).select("_set", F.lit(1).cast("long").alias("n_pairs"), F.lit(1).cast("long").alias("n_met"))
    else:
        pivots = _pivots(c, n_c, max(dims))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in c.schema)
        c = dense_index(c.mapInPandas(_placed(pivots, dims), f"{fields}, pivot long, angles array<double>"), ["_set"], ["pivot", "cid"], "at").withColumn("cb", F.floor(F.col("at") / corpus_block))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.schema)
        q = dense_index(q.mapInPandas(_placed(pivots, dims), f"{fields}, pivot long, angles array<double>"), ["_set"], ["pivot", "qid"], "at").withColumn("qb", F.floor(F.col("at") / query_block)).drop("pivot", "angles", "at")
        radii = F.array(*[F.max(F.get("angles", F.lit(j))) for j in range(len(dims))])
        parts = materialize(spark, c.groupBy("_set", "cb", "pivot").agg(F.count(F.lit(1)).alias("n"), radii.alias("radii")), "parts")
        blocks = materialize(spark, q.select("_set", "qb").distinct(), "query-blocks")
        # Some rows for each pair of blocks; a block of queries gets the description of the corpus' blocks, not their rows.
        described = blocks.join(parts, "_set")
        first = materialize(spark, q.groupBy("_set", "qb").cogroup(described.groupBy("_set", "qb")).applyInPandas(_seeds(pivots, dims, k), PAIR), "seeds")
        hits = materialize(spark, _met(q, c, first, dims, k), "hits")
        seat = F.row_number().over(Window.partitionBy("_set", "dim", "qid").orderBy(F.desc("sim"), "cid"))
        kth = hits.withColumn("_seat", seat).where(F.col("_seat") == k).groupBy("_set", "qid").agg(F.map_from_entries(F.collect_list(F.struct("dim", "sim"))).alias("kth"))
        floors = F.array(*[F.coalesce(F.col("kth")[d], F.lit(-2.0)) for d in dims])
        q = q.join(kth, ["_set", "qid"], "left").withColumn("floors", floors).drop("kth")
        q = materialize(spark, q, "floors")
        more = q.groupBy("_set", "qb").cogroup(described.groupBy("_set", "qb")).applyInPandas(_others(pivots, dims), PAIR)
        more = materialize(spark, more.join(first, ["_set", "qb", "cb"], "left_anti"), "others")
        found = reduce(DataFrame.unionByName, [hits, _met(q, c, more, dims, k)])
        size = lambda rows, what: rows.groupBy("_set").agg(F.count(F.lit(1)).alias(what))
        met = size(blocks.join(parts.select("_set", "cb").distinct(), "_set"), "n_pairs").join(size(first.union(more), "n_met"), "_set")
    rank = F.row_number().over(Window.partitionBy("_set", "dim", "qid").orderBy(F.desc("sim"), "cid"))
    hits = found.withColumn("rank", rank).where(F.col("rank") <= k).select(*own, "dim", "qid", "cid", "sim", "rank")
    return hits, met.select(*own, "n_pairs", "n_met")
