"""Exact vector search in blocks, hard negatives and ranking metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.runtime import trim
from corpusloom.operators import search


#: Rows and columns of each row's k largest entries.
_first = search._first


def normalised(v: Column, dim: int | None = None, least: float = 1e-9) -> Column:
    """The first dim entries at unit length; a zero vector stays zero."""
    part = F.slice(v, 1, dim) if dim else v
    part = F.transform(part, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(part, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(part, lambda x: x / F.greatest(norm, F.lit(least)))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, dims: Sequence[int], by: str | None = None) -> DataFrame:
    """[by,] dim, qid, cid, sim, rank of the k most similar rows of corpus([by,] cid, vec) for each of queries([by,] qid, vec[, cap]), at each truncated dimension, within the query's set.

    Rows more similar than a query's cap are left out. The search is that of ``search.search``.
    """
    return search.search(queries, corpus, k, dims, by)[0]


METRICS = "ndcg_10, mrr_10, map_100, recall_1, recall_3, recall_5, recall_10, accuracy_1, accuracy_3, accuracy_5, accuracy_10, precision_1, precision_3, precision_5, precision_10".split(", ")


def metrics(hits: DataFrame, relevant: DataFrame, dims: Sequence[int] | None = None, by: str | None = None) -> DataFrame:
    """Means per dim, and per set if ``by`` names it, over queries with a relevant row. A query, dimension or set without any hit row counts as 0;
    without ``dims``, dimensions are those of the hits.

    hits([by,] dim, qid, rank, hit boolean), relevant([by,] qid, n_rel).
    """
    own = [by] if by else []
    judged = relevant.where("n_rel > 0")
    if by:
        judged = judged.where(F.col(by).isNotNull())
    seen = hits.select(*own, "dim", "qid", "rank", "hit").join(judged, [*own, "qid"])
    so_far = F.sum(F.col("hit").cast("int")).over(Window.partitionBy(*own, "dim", "qid").orderBy("rank"))
    seen = seen.withColumn("so_far", so_far)
    within = lambda k: F.sum(F.when(F.col("hit") & (F.col("rank") <= k), 1).otherwise(0))
    aggs = [F.sum(F.when(F.col("hit") & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("hit") & (F.col("rank") <= 10), F.col("rank"))).alias("first")]
    aggs += [F.sum(F.when(F.col("hit") & (F.col("rank") <= 100), F.col("so_far") / F.col("rank")).otherwise(0.0)).alias("ap")]
    aggs += [within(k).alias(f"h{k}") for k in (1, 3, 5, 10)]
    per = seen.groupBy(*own, "dim", "qid", "n_rel").agg(*aggs)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_rel")).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    cols = {"ndcg_10": F.col("dcg") / ideal, "mrr_10": F.coalesce(1 / F.col("first"), F.lit(0.0)), "map_100": F.col("ap") / F.col("n_rel")}
    for k in (1, 3, 5, 10):
        cols[f"recall_{k}"] = F.col(f"h{k}") / F.col("n_rel")
        cols[f"accuracy_{k}"] = (F.col(f"h{k}") > 0).cast("double")
        cols[f"precision_{k}"] = F.col(f"h{k}") / k
    sums = per.groupBy(*own, "dim").agg(*[F.sum(v).alias(n) for n, v in cols.items()])
    # One row per set, and as many dimensions as asked for.
    whole = judged.groupBy(*own).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0")
    if dims is None:
        return _means(whole.crossJoin(F.broadcast(hits.select("dim").distinct())), sums, own, cols)
    return _means(whole.withColumn("dim", F.explode(F.array(*[F.lit(d) for d in dims]))), sums, own, cols)


def _means(whole: DataFrame, sums: DataFrame, own: list[str], cols: dict[str, Column]) -> DataFrame:
    return whole.join(sums, [*own, "dim"], "left").select(*own, "dim", *[(F.coalesce(F.col(n), F.lit(0.0)) / F.col("_n")).alias(n) for n in cols])


def negatives(queries: DataFrame, corpus: DataFrame, gold: DataFrame, n: int, dim: int, range_min: int = 0, max_score: float | None = None, margin: float = 0.0) -> DataFrame:
    """The first n wrong rows per query that pass the filters: qid, seat, cid, sim. gold(qid, gold_cid, gold_sim).

    Ranks count wrong rows from 0, the right one being last. Similarities fall with rank, so each filter skips a prefix: the
    first ranks are one search, the rows below the similarity limits another, and neither sends on more than n + range_min + 1 rows for a query.
    """
    cap = F.lit(float("inf"))
    if max_score is not None:
        cap = F.least(cap, F.lit(max_score))
    if margin > 0:
        cap = F.least(cap, F.col("gold_sim") - margin)
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), "cid")
    capped = top_k(queries.join(gold, "qid").select("qid", "vec", cap.alias("cap")), corpus, n + range_min + 1, [dim]).select("qid", "cid", "sim")
    wrong = capped.join(gold, "qid").where("cid <> gold_cid").select("qid", "cid", "sim")
    if range_min > 0:
        lead = top_k(queries.select("qid", "vec"), corpus, range_min + 1, [dim]).join(gold.select("qid", "gold_cid"), "qid").where("cid <> gold_cid")
        lead = lead.withColumn("place", F.row_number().over(order)).where(F.col("place") <= range_min)
        wrong = wrong.join(lead.select("qid", "cid"), ["qid", "cid"], "left_anti")
    return wrong.withColumn("seat", F.row_number().over(order)).where(F.col("seat") <= n).select("qid", "seat", "cid", "sim")


#: Rows of each query that a block holds: those that are wrong, and of these the ones above the highest score and above the query's limit.
ABOVE = pa.schema([(x, pa.int64()) for x in ("qid", "wrong", "over", "near")])


def _above(dim: int):
    def run(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        if len(queries) * len(corpus) >= search.TILE * search.CORPUS_BLOCK:
            trim()
        if not len(queries) or not len(corpus):
            return ABOVE.empty_table()
        queries, corpus, out = queries.to_pandas(), corpus.to_pandas(), []
        right, cid = search.unit(np.stack(corpus["vec"].to_numpy()), dim), corpus["cid"].to_numpy()[None, :]
        for lo in range(0, len(queries), search.TILE):
            some = queries[lo : lo + search.TILE]
            sim = np.round(search.unit(np.stack(some["vec"].to_numpy()), dim) @ right.T, 12)
            wrong = cid != some["gold_cid"].to_numpy()[:, None]
            count = lambda limit: ((sim > some[limit].to_numpy()[:, None]) & wrong).sum(axis=1)  # noqa: B023, E731
            out.append(pa.record_batch([some["qid"].to_numpy(), wrong.sum(axis=1), count("most"), count("cap")], names=ABOVE.names))
        return pa.Table.from_batches(out, ABOVE)

    return run


def skipped(queries: DataFrame, corpus: DataFrame, gold: DataFrame, n: int, dim: int, range_min: int = 0, max_score: float | None = None, margin: float = 0.0) -> DataFrame:
    """One row: wrong rows that ``negatives`` passes over by each filter, in the order range, highest score, margin, and match (the right row, met last by a query that is short of n).

    Blocks count what lies above each query's limits; only counts leave them.
    """
    high = F.lit(float("inf") if max_score is None else float(max_score))
    cap = F.least(high, F.col("gold_sim") - margin) if margin > 0 else high
    n_q, n_c = 1 + queries.count() // search.QUERY_BLOCK, 1 + corpus.count() // search.CORPUS_BLOCK
    q = queries.join(gold, "qid").select("qid", "vec", "gold_cid", high.alias("most"), cap.alias("cap"))
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(n_q))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_c - 1).cast("long"))))
    c = corpus.withColumn("cb", F.pmod(F.xxhash64("cid"), F.lit(n_c))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))
    each = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(_above(dim), "qid long, wrong long, over long, near long").groupBy("qid").agg(*[F.sum(x).alias(x) for x in ("wrong", "over", "near")])
    first = F.lit(range_min)
    left = F.col("wrong") - F.greatest(first, F.col("near"))
    return each.agg(
        F.sum(F.least(first, F.col("wrong") + 1)).alias("skipped_range"),
        F.sum(F.greatest(F.col("over") - first, F.lit(0))).alias("skipped_max"),
        F.sum(F.greatest(F.col("near") - F.greatest(first, F.col("over")), F.lit(0))).alias("skipped_margin"),
        F.sum(((left < n) & (F.col("wrong") >= first)).cast("long")).alias("skipped_match"),
        F.sum((left < n).cast("long")).alias("insufficient"),
    )


def collapse(rows: DataFrame) -> DataFrame:
    """rows(id, anchor, relevant, irrelevant) to their norms, the cosines of the anchor with both, and the gap: equal norms and a gap near 0 are signs of a collapsed encoder."""
    norm = lambda c: F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    cos = lambda c: F.aggregate(F.zip_with(normalised(F.col("anchor")), normalised(F.col(c)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    out = rows.select("id", *[norm(c).alias(f"norm_{c}") for c in ("anchor", "relevant", "irrelevant")], *[cos(c).alias(f"cos_{c}") for c in ("relevant", "irrelevant")])
    return out.withColumn("gap", F.col("cos_relevant") - F.col("cos_irrelevant"))


def widened(found: DataFrame, queries: DataFrame, n: int, text: str = "text") -> DataFrame:
    """One row per query with negative_1 to negative_n, empty where there are fewer. found(qid, seat, text)."""
    wide = found.groupBy("qid").pivot("seat", list(range(1, n + 1))).agg(F.first(text))
    return queries.select("qid").join(wide, "qid", "left").select("qid", *[F.coalesce(F.col(str(i)), F.lit("")).alias(f"negative_{i}") for i in range(1, n + 1)])


def negative_columns(columns: Sequence[str]) -> list[str]:
    """The negatives among a training table's columns, in numeric order; anchor, positive and at least one negative are needed."""
    found = sorted((c for c in columns if c.startswith("negative")), key=lambda c: int("0" + "".join(x for x in c if x.isdigit())))
    if "anchor" not in columns or "positive" not in columns or not found:
        raise ValueError("anchor, positive and at least one negative column are needed")
    return found


def encode(texts: DataFrame, encoder, prefix: str = "") -> DataFrame:
    """texts(id, text) to (id, vec) by encoder(list of str) -> list of vectors, a batch at a time on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "vec": list(encoder([prefix + t for t in b["text"]]))})

    return texts.select("id", "text").mapInPandas(run, "id long, vec array<float>")


def hashed_vectors(dim: int = 64):
    """A deterministic encoder for tests: the vector depends on the text only."""

    def run(texts: list[str]) -> list[list[float]]:
        import zlib

        return [np.random.default_rng(zlib.crc32(t.encode())).normal(size=dim).astype(np.float32).tolist() for t in texts]

    return run
