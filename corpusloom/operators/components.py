"""Connected components of edges of any number, and joins and sums that spread frequent keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.pairs import seeded
from corpusloom.sources.tables import materialize

#: Keys with more than this part of all rows are dealt out, so there are at most so many.
SHARE = 1000
ROUNDS = 60


def dealt_join(left: DataFrame, right: DataFrame, key: str, spread: Sequence[str], count: str) -> DataFrame:
    """left joined with right, which has one row for each key and in ``count`` the number of left's rows of it; ``count`` is dropped.

    A key of more than one in ``SHARE`` of these rows is worked by tasks in proportion to its rows, told apart by left's columns ``spread``. The list of such keys has at most ``SHARE`` entries and is broadcast.
    """
    spark = left.sparkSession
    total = right.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    tasks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = F.col(count) * SHARE > total
    salts = F.when(hot, F.ceil(F.col(count) * F.lit(tasks) / F.lit(max(total, 1)))).otherwise(1).cast("long")
    listed = right.where(hot).select(F.col(key).alias("_hot"), salts.alias("_salts"))
    place = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0))
    dealt = left.join(F.broadcast(listed), left[key] == F.col("_hot"), "left").withColumn("_salt", place).drop("_hot", "_salts")
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop(count)
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, component of every node of edges(u string, v string): component is the smallest node that can be reached.

    Rounds tie the larger neighbours of each node, then the smaller ones, to its smallest neighbour. The minimum is taken map-side, and a node of very many edges is dealt out. Rounds end
    when the table is a set of stars: every node but the centres has one edge, and no centre has one to a smaller node.
    """
    tied = lambda u, v: F.struct(u.alias("u"), v.alias("v"))
    now = materialize(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(ROUNDS):
        both = now.select("u", "v").union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        larger = materialize(spark, dealt_join(both, least, "u", ["v"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "edges")
        least = larger.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = dealt_join(larger, least, "u", ["v"], "n").select(F.explode(F.array(tied(F.col("v"), F.col("m")), tied(F.col("u"), F.col("m")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = materialize(spark, small, "edges")
        degree = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        loose = degree.where("n > 1").select("u").union(now.select(F.col("v").alias("u")).distinct().join(degree.select("u"), "u", "left_semi"))
        if loose.limit(1).count() == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def running_sum(rows: DataFrame, by: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """rows with ``name``, the sum of ``value`` over all rows of the same ``by`` up to and with this one. Rows are summed within ranges of the order, and ranges are added up by a table of one row per range and group, so a
    group of any size spans tasks."""
    spark = rows.sparkSession
    placed = materialize(spark, rows.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy(F.col("_range").alias("_of"), F.col(by).alias("_by")).agg(F.sum(value).alias("_sum"))
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(Window.partitionBy("_by").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = (F.col("_range") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_by"))
    return placed.withColumn(name, F.sum(value).over(inside)).join(starts, same).withColumn(name, F.col(name) + F.col("_start")).drop("_range", "_of", "_by", "_sum", "_start")


#: A component is eligible for evaluation up to this part of its stratum's share, unless it is the only choice.
LARGEST = 5


def chosen_components(weights: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """The components, of weights(component, stratum, weight), that go to evaluation.

    In each stratum those of at most a ``LARGEST``-th of the share are taken in seeded order while their sum stays within floor(share * all weights): so what is taken is at most the share, and, where eligible components
    suffice, at least the share less a ``LARGEST``-th of it, and less one. A stratum of which none is taken gives its lightest, by seeded order, unless that is all it has and holds several chunks. A null stratum is one of its own.
    """
    stratum = F.when(F.col("stratum").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("stratum")))
    named = weights.select("component", stratum.alias("stratum"), F.col("weight").cast("long").alias("weight"), seeded(F.col("component"), seed).alias("turn"))
    totals = named.groupBy("stratum").agg(F.floor(F.sum("weight") * share).alias("room"), F.count(F.lit(1)).alias("n"), F.min(F.struct("weight", "turn", "component")).alias("lightest"))
    each = dealt_join(named, totals.withColumn("rows", F.col("n")), "stratum", ["component"], "rows")
    table = materialize(weights.sparkSession, each, "weights")
    fit = table.where(F.col("weight") <= F.greatest(F.lit(1), F.floor(F.col("room") / LARGEST)))
    taken = running_sum(fit, "stratum", ["turn", "component"], "weight", "sum").where("sum <= room").select("stratum", "component")
    left = totals.join(taken.select("stratum").distinct(), "stratum", "left_anti").where("n > 1 or lightest.weight = 1")
    return taken.select("component").union(left.select("lightest.component"))


def split_components(rows: DataFrame, text: str, chunk: str, stratum: str, order: Sequence[str], share: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with ``component`` and ``part``, train or eval: neither a chunk nor a text is in both parts, so rows of a text with several chunks stay together.

    Chunks and texts are the two sides of a graph whose edges are the rows. Components are weighed by their chunks, those without a chunk by 1; a component's stratum is that of its first row. Rows without a chunk belong to their text, rows without a
    text to their chunk, and rows without either are train.
    """
    spark = rows.sparkSession
    side = lambda mark, c: F.concat(F.lit(mark), c)
    keyed = rows.withColumns({"_chunk": side("c", F.col(chunk).cast("string")), "_text": side("t", F.md5(F.col(text).cast("binary")))}).withColumn("_node", F.coalesce("_chunk", "_text"))
    keyed = materialize(spark, keyed, "pairs")
    edges = keyed.where("_chunk is not null and _text is not null").select(F.col("_chunk").alias("u"), F.col("_text").alias("v")).distinct()
    found = components(spark, edges)
    nodes = keyed.where("_node is not null").groupBy("_node").agg(F.count(F.lit(1)).alias("_n")).join(found.withColumnRenamed("node", "_node"), "_node", "left")
    nodes = nodes.select("_node", F.coalesce("component", "_node").alias("component"), "_n")
    placed = materialize(spark, dealt_join(keyed.where("_node is not null"), nodes, "_node", ["_text", *order], "_n"), "placed")
    first = placed.groupBy("component").agg(F.min_by(stratum, F.struct(*order)).alias("stratum"), F.count(F.lit(1)).alias("_rows"))
    weights = nodes.groupBy("component").agg(F.greatest(F.lit(1), F.count_if(F.col("_node").startswith("c"))).alias("weight"))
    held = chosen_components(first.join(weights, "component").select("component", "stratum", "weight"), share, seed).withColumn("part", F.lit("eval"))
    parts = first.select("component", "_rows").join(held, "component", "left").select("component", F.coalesce("part", F.lit("train")).alias("part"), "_rows")
    done = dealt_join(placed, parts, "component", ["_text", *order], "_rows")
    own = [*rows.columns, "component", "part"]
    return done.select(*own).union(keyed.where("_node is null").select(*rows.columns, F.lit(None).cast("string").alias("component"), F.lit("train").alias("part")))
