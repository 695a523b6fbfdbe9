"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, seeded by doc_id, and once more in another order where its target is beyond its size. A document's virtual finish time is the
running total of its source's words, its own included, over the source's target. A document in service at virtual time 1, when the source has sent its target, leaves in two packets, of which the
first ends then. All packets are range-sorted by finish time, and the mix is cut where their running total reaches the budget. So a source is within as many words of its
target as there are sources.

Targets share the budget by weight and stop at ``MOST`` times their source's size; what is above is shared again among the others until none is above. Each such round is an aggregate
over the table of sources, of which three numbers reach the driver. Sources are never collected, as there can be as many as web hosts.

A null source is a source of its own, the last one. Null and empty texts and those without words have size 0; they are not taken and have a row. Rows that repeat a doc_id are documents of
their own, next to each other in their queues. Rows without a doc_id are shuffled under the empty string. If nothing has words, targets are 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.running import running_total
from corpusloom.llm.runtime import balanced_join, materialize

# Weights of sources in order, as often as there are sources; the budget over all sizes; most times a document is taken.
WEIGHTS, BUDGET, MOST = (3, 1, 2), 1.5, 2
SEED = 42


def words_in(text: Column) -> Column:
    """Number of words of a text, none in null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _key(source: Column) -> Column:
    """A name of each source that is never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def targets(spark: SparkSession, sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> tuple[DataFrame, float]:
    """key, n_docs, source_size, seat (the source's place by code point, null last), weight and target of each source of sized(source, size); and the budget in words."""
    sums = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")).select(_key(F.col("source")).alias("key"), F.col("source").isNull().cast("long").alias("last"), "n_docs", "source_size")
    one = sums.withColumn("one", F.lit(1).cast("long"))
    # Spark and DuckDB compare strings by their UTF-8 bytes, which is the order of code points.
    seated = running_total(spark, one, [F.col("last"), F.col("key")], "one", "seat").drop("one", "last")
    every = F.array(*[F.lit(w).cast("long") for w in weights])
    sources, _ = materialize(spark, seated.withColumn("weight", F.get(every, (F.col("seat") % len(weights)).cast("int"))), "sources")
    words = budget * float(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    capped, share = -1, 0.0
    while True:
        # Those at their caps stay there: the share of the others only grows.
        full = F.col("source_size") * most <= F.lit(share) * F.col("weight")
        row = sources.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if row[0] == capped or not row[2]:
            break
        capped, share = row[0], (words - float(row[1])) / float(row[2])
    target = F.least((F.col("source_size") * most).cast("double"), F.lit(share) * F.col("weight"))
    return sources.withColumn("target", target), words


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED) -> DataFrame:
    """Packets of the mix of docs(doc_id, text, source): number (of the document's row), doc_id, size, source_size, target, copy (from 1), start and words (the part of the copy's words that
    the packet holds), finish, offset (words of the mix before) and taken (what of the packet the budget has room for; those with none are no part of the mix)."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words_in(F.col("text").cast("string")).alias("size"))
    sized, _ = materialize(spark, found.withColumn("number", F.monotonically_increasing_id()), "sized")
    sources, room = targets(spark, sized, weights, budget, most)
    rows = balanced_join(sized.select("number", "doc_id", "size", _key(F.col("source")).alias("key")), sources, ["key"], ["number"], "n_docs")
    # As many copies as the target needs; a document without words waits in the first.
    needed = F.when((F.col("size") > 0) & (F.col("source_size") > 0), F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("target") / F.col("source_size"))))).otherwise(1)
    copies = rows.select("number", "doc_id", "size", "seat", "source_size", "target", F.explode(F.sequence(F.lit(1), needed.cast("int"))).alias("copy"))
    name = F.concat(F.lit(f"{seed}:"), F.col("copy").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    shuffled = copies.withColumn("turn", F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long"))
    queue = [F.col(c) for c in ("seat", "copy", "turn", "doc_id", "size", "number")]
    queued = running_total(spark, shuffled, queue, "size", "sent", "seat")
    # The words that are left until virtual time 1.
    left = F.floor("target") - F.col("sent")
    split = (left > 0) & (left < F.col("size"))
    packet = lambda start, words: F.struct(start.cast("long").alias("start"), words.cast("long").alias("words"))
    both = F.when(split, F.array(packet(F.lit(0), left), packet(left, F.col("size") - left))).otherwise(F.array(packet(F.lit(0), F.col("size"))))
    packets = queued.withColumn("packet", F.explode(both)).select("*", "packet.start", "packet.words").drop("packet")
    done = F.col("sent") + F.col("start") + F.col("words")
    # What a target's fraction of a word leaves is not waited for: the first packet ends at 1.
    finish = F.when(F.col("target") <= 0, F.lit(0.0)).when(done == F.floor("target"), F.lit(1.0)).otherwise(done / F.col("target"))
    timed = packets.withColumn("finish", F.when((done > F.floor("target")) & (finish <= 1), F.lit(1.0) + F.lit(2.0**-52)).otherwise(finish))
    served = running_total(spark, timed, [F.col("finish"), *queue, F.col("start")], "words", "offset")
    taken = F.least(F.col("words"), F.greatest(F.lit(int(room)) - F.col("offset"), F.lit(0)))
    return served.select("number", "doc_id", "size", "source_size", "target", "copy", "start", "words", "finish", "offset", taken.cast("long").alias("taken"))


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs(doc_id, text, source): the words that the mix takes of it, repeats counted."""
    packets = mixed(spark, docs, weights, budget, most, seed)
    same = ("doc_id", "size", "source_size", "target")
    return packets.groupBy("number").agg(*[F.first(c).alias(c) for c in same], F.sum("taken").alias("taken")).select(*same, "taken")
