"""Query-passage pairs: union, dedup, splits without leakage, evaluation triples, scores and replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import dense_index

# Score names and their weights in the overall score.
WEIGHTS = {"relevance": 0.35, "accuracy": 0.25, "clarity": 0.20, "specificity": 0.20}


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of frames, whose columns may differ, with ``source_seq`` from the frame's place and the row's ``seq`` in it."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("source_seq", F.lit(i)) for i, f in enumerate(frames)])


def keep_first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key. A minimum per key, joined back: only keys and order are moved for groups of any size."""
    place = F.struct(*order)
    first = rows.groupBy(*keys).agg(F.min(place).alias("_first"))
    cond = [rows[k].eqNullSafe(first[k]) for k in keys] + [place == F.col("_first")]
    return rows.join(first.select(*[first[k].alias(f"_{k}") for k in keys], "_first"), reduce(lambda a, b: a & b, [rows[k].eqNullSafe(F.col(f"_{k}")) for k in keys] + cond[-1:]), "left_semi")


def seeded(key: Column, seed: int = 42) -> Column:
    """A reproducible order: by this digest, then by key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def eval_ids(ids: DataFrame, key: str, share: float = 0.15, stratum: str | None = None, seed: int = 42) -> DataFrame:
    """Distinct ids for evaluation: in each stratum (or of all) the first max(1, floor(n * share)) in seeded order."""
    by = [stratum] if stratum else []
    one = ids.select(key, *by).distinct()
    if by:
        ranked = dense_index(one.withColumn("_o", seeded(F.col(key), seed)), by, ["_o", key], "_r")
        sizes = one.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(stratum, "_s")
        return ranked.join(sizes, ranked[stratum].eqNullSafe(sizes["_s"])).where(F.col("_r") < F.greatest(F.lit(1), F.floor(F.col("_n") * share))).select(key)
    n = max(1, int(one.count() * share))
    return one.orderBy(seeded(F.col(key), seed), key).limit(n).select(key)


def split(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(train, eval) rows by membership of key in ids."""
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi")


def leaks(train: DataFrame, evaluation: DataFrame, *keys: str) -> DataFrame:
    return train.select(*keys).intersect(evaluation.select(*keys))


def first_wins(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, seq).alias(value))


def last_wins(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, seq).alias(value))


def valid_queries(payload: Column) -> Column:
    """The queries of a reply, or null: the field must be an array of strings only; other fields are ignored."""
    v = F.try_parse_json(payload)
    items = F.try_variant_get(v, "$.queries", "array<variant>")
    strings = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
    return F.when(strings, F.try_variant_get(v, "$.queries", "array<string>"))


def valid_scores(payload: Column) -> Column:
    """The scores of a reply as a struct, or null. Whole numbers, also as strings, fractions of zero or true, from 1 to 10; overall may have a fraction."""

    def number(v: Column, name: str) -> Column:
        field = F.try_variant_get(v, f"$.{name}", "variant")
        true = F.try_variant_get(v, f"$.{name}", "boolean")
        return F.when(F.schema_of_variant(field) == "BOOLEAN", true.cast("double")).otherwise(F.try_variant_get(v, f"$.{name}", "double"))

    def checked(s: Column) -> Column:
        ok = (s["overall"] >= 1) & (s["overall"] <= 10)
        for n in WEIGHTS:
            ok = ok & (s[n] >= 1) & (s[n] <= 10) & (s[n] == F.floor(s[n]))
        return F.when(ok, F.struct(*[s[n].cast("int").alias(n) for n in WEIGHTS], s["overall"].alias("overall")))

    # Bound in two steps, so that the payload is parsed and each number read once.
    parsed = F.transform(F.array(F.try_parse_json(payload)), lambda v: F.struct(*[number(v, n).alias(n) for n in [*WEIGHTS, "overall"]]))
    return F.transform(parsed, checked)[0]


def weighted(scores: Column) -> Column:
    return sum((scores[n] * w for n, w in WEIGHTS.items()), F.lit(0.0))


def by_threshold(rows: DataFrame, score: Column, least: float = 7.0) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected); a missing score counts 0."""
    keep = F.coalesce(score, F.lit(0.0)) >= least
    return rows.where(keep), rows.where(~keep)


def score_statistics(rows: DataFrame, scores: str, names: list[str]) -> DataFrame:
    """dimension, n, mean, least, most, below_5, from_5, from_7; null means where nothing is scored."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("dimension"), F.col(f"{scores}.{n}").cast("double").alias("value")) for n in names])).alias("x")).select("x.*").where("value is not null")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    v = F.col("value")
    return long.groupBy("dimension").agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), count(v < 5).alias("below_5"), count((v >= 5) & (v < 7)).alias("from_5"), count(v >= 7).alias("from_7"))


def survivors(rows: DataFrame, score: Column, thresholds: list[float]) -> DataFrame:
    """threshold, n, share: rows that each threshold would keep, in one pass."""
    counts = rows.agg(F.count(F.lit(1)).alias("all"), *[F.sum((F.coalesce(score, F.lit(0.0)) >= t).cast("long")).alias(f"k{i}") for i, t in enumerate(thresholds)])
    rows_of = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.coalesce(F.col(f"k{i}"), F.lit(0)).alias("n")) for i, t in enumerate(thresholds)])
    return counts.select("all", F.explode(rows_of).alias("x")).select("x.threshold", "x.n", F.round(F.try_divide("x.n", "all"), 6).alias("share"))


def first_stratum(rows: DataFrame, key: str, stratum: str, seq: str) -> DataFrame:
    """key with the stratum of its first row."""
    return rows.groupBy(key).agg(F.min_by(stratum, seq).alias(stratum))


# The columns of a training table, and those that are empty where a pair lacks them.
TRAINING, FILLED = ("anchor", "positive", "chunk_id"), ("section_type", "hierarchy_path", "document_name")


def training_columns(rows: DataFrame) -> DataFrame:
    """Only the columns of a training table."""
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in FILLED]
    return rows.select(*TRAINING, *filled)


def corpus_index(rows: DataFrame, text: str = "positive") -> DataFrame:
    """cid, text: each text once, numbered from 0 in order."""
    return dense_index(rows.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct(), [], ["text"], "cid").select("cid", "text")


def with_index(rows: DataFrame, corpus: DataFrame, text: str = "positive") -> DataFrame:
    """rows with the cid of their text. Texts meet by digest, so that they are moved but not sorted, and are compared after."""
    left = rows.withColumn("_digest", F.sha2(F.col(text), 256))
    right = corpus.select("cid", F.col("text").alias("_text"), F.sha2("text", 256).alias("_digest"))
    return left.join(right, "_digest").where(F.col(text) == F.col("_text")).drop("_digest", "_text")


def evaluation_triple(rows: DataFrame, seq: str, part: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(queries, corpus, relevant) of pairs(anchor, positive, chunk_id): queries(eval_set, qid, text), qid = q_ and the row's number, corpus(eval_set, cid, text), where the last
    pair's text counts, and relevant(eval_set, qid, cid). All rows are the set ``combined``; ``part`` names a column each of whose values is a set besides."""
    sets = F.array(F.lit("combined"), F.col(part)) if part else F.array(F.lit("combined"))
    every = rows.select(F.explode(sets).alias("eval_set"), "anchor", "positive", F.col("chunk_id").cast("string").alias("cid"), F.col(seq).alias("_seq")).where("eval_set is not null")
    numbered = dense_index(every, ["eval_set"], ["_seq"], "_n").withColumn("qid", F.concat(F.lit("q_"), F.col("_n")))
    return numbered.select("eval_set", "qid", F.col("anchor").alias("text")), every.groupBy("eval_set", "cid").agg(F.max_by("positive", "_seq").alias("text")), numbered.select("eval_set", "qid", "cid")
