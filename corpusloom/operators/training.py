"""What a training run needs of its table: batches without repeated texts, the loss of fixed vectors, and numbers of steps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.components import dealt_join
from corpusloom.operators.search import unit
from corpusloom.sources.tables import dense_index, materialize

# Fixed value: similarities are multiplied by this before the loss.
SCALE = 20.0
#: Candidates whose similarities to a batch's anchors are held at once.
CHUNK = 1024


def full_batches(rows: DataFrame, text: str, size: int, key: str = "row_id") -> DataFrame:
    """rows with ``batch``, from 0: at most ``size`` rows, no text twice, and all batches of as many rows as any other, or one less.

    Rows in order of their text's copies, most first, then text, are numbered densely; a row's batch is its number modulo the number of batches. That number is what ``size`` asks for, or the copies of the most frequent text if
    these are more, as each needs a batch of its own. Copies thus lie in different batches, whatever their number. A null text repeats nothing. ``key`` is unique.
    """
    spark = rows.sparkSession
    named = rows.withColumn("_text", F.coalesce(F.md5(F.col(text).cast("binary")), F.concat(F.lit("-"), F.col(key).cast("string"))))
    table = materialize(spark, named, "rows")
    copies = materialize(spark, table.groupBy("_text").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_n", F.col("_copies")), "copies")
    n, most = copies.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    batches = max(1, -(-n // size), most)
    ordered = dealt_join(table, copies, "_text", [key], "_n").withColumn("_rare", -F.col("_copies"))
    return dense_index(ordered, [], ["_rare", "_text", key], "_place").withColumn("batch", F.col("_place") % batches).select(*rows.columns, "batch")


def _losses(dims: Sequence[int], scale: float, chunk: int) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        stacked = lambda c: np.stack([np.asarray(v, np.float64) for v in rows[c]])
        anchors, candidates = stacked("anchor"), stacked("positive")
        if "negatives" in rows:
            candidates = np.concatenate([candidates, *[np.stack([np.asarray(v, np.float64) for v in n]) for n in rows["negatives"] if n is not None and len(n)]])
        out = []
        for d in dims:
            a, c = unit(anchors, d), unit(candidates, d)
            # The logarithm of the sum of exponentials as a running maximum and a running sum.
            top, total = np.full(len(a), -np.inf), np.zeros(len(a))
            for lo in range(0, len(c), chunk):
                x = scale * (a @ c[lo : lo + chunk].T)
                higher = np.maximum(top, x.max(axis=1))
                total = total * np.exp(top - higher) + np.exp(x - higher[:, None]).sum(axis=1)
                top = higher
            own = scale * (a * c[: len(a)]).sum(axis=1)
            out.append((key[0], d, len(a), len(c), float(np.mean(top + np.log(total) - own))))
        return pd.DataFrame(out, columns=["batch", "dim", "n_rows", "n_candidates", "loss"])

    return run


def contrastive_losses(rows: DataFrame, dims: Sequence[int], scale: float = SCALE, chunk: int = CHUNK) -> DataFrame:
    """batch, dim, n_rows, n_candidates, loss of rows(batch, anchor, positive[, negatives]) at each truncated dimension: the mean, over a batch's anchors, of the cross-entropy of the own positive among all positives and
    negatives of the batch, by scaled cosine. A batch is worked by one task, which holds ``chunk`` columns of its similarities at a time."""
    return rows.groupBy("batch").applyInPandas(_losses(dims, scale, chunk), "batch long, dim long, n_rows long, n_candidates long, loss double")


def weighted_loss(losses: DataFrame, weights: dict[int, float]) -> DataFrame:
    """One row: n_batches and loss, the mean over batches of the sum of the dimensions' losses by weight."""
    weight = F.create_map(*[F.lit(x) for d, w in weights.items() for x in (int(d), float(w))])
    each = losses.groupBy("batch").agg(F.sum(F.col("loss") * weight[F.col("dim").cast("int")]).alias("loss"))
    return each.agg(F.count(F.lit(1)).alias("n_batches"), F.avg("loss").alias("loss"))


def steps(n_rows: int, batch: int, accumulated: int = 1, epochs: int = 1) -> dict[str, int]:
    """What a run of so many rows prints: rows of a step, negatives of a row from its batch, whole steps of an epoch and of all."""
    per_step = batch * accumulated
    return {"rows_per_step": per_step, "in_batch_negatives": batch - 1, "steps_per_epoch": n_rows // per_step, "steps": n_rows // per_step * epochs}
