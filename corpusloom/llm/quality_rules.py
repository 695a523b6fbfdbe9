"""Quality rules with DataFrame functions only: base counts, then robust multivariate outliers per language and source.

Each document that passes the base rules gives a vector of four transformed statistics. For every (lang, source) a
minimum-covariance-determinant estimate is made by concentration steps: the three quarters of the group with the smallest
Mahalanobis distances give the next mean and covariance. Steps start from the classical estimate, from medians with median absolute deviations, and from medians with
the least deviations alone, as a classical start that outliers have moved may never leave them; after ``TRIALS`` steps the start of the least determinant goes on. The quantile comes from counts in logarithmic bins and the moments from integer sums of
fixed-point values, so both combine map-side, no group meets in one task, and the result does not depend on partitioning. A
document is rejected when its squared distance from its group's last estimate exceeds ``CUTOFF``, or when one statistic alone, measured by its own
spread in the group's core with the smaller floor of ``ALONE``, does.

Standard deviations have a floor (``FLOORS``): most documents have no symbol or repetition at all, and a variance of zero would
make any deviation infinite. A group of fewer than ``MIN_GROUP`` documents is judged by the estimate of its whole language, and where that
has fewer too, by the estimate of all documents, so every document has a verdict. Null lang or source is a group like others. Null and empty texts have no words and fail the base rules. Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.line_dedup import BLANKS, let
from corpusloom.llm.runtime import discard, materialize, salted_join

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
FEATURES = ("x1", "x2", "x3", "x4")
#: Units of a fixed-point value in 1.
SCALE = 1024
#: Least standard deviations of log mean word length, and of log(1 + rate per thousand) of symbols, repeated lines and repeated words.
FLOORS = (0.12, 0.9, 2.0, 2.0)
#: The same for a statistic alone. Each is below the statistic's greatest value, 6.91, or 5.71 for repeated words as base rules cap them, over the root of CUTOFF.
ALONE = (0.12, 0.9, 1.05, 0.95)
MIN_GROUP = 20
#: Stands for all languages or sources in the key of a pool; keys of groups are empty or begin with "=".
POOL = "*"
STEPS, TRIALS = 6, 3
MAD = 1.4826
BINS_PER_OCTAVE = 16
#: A share of 3/4 of a 4-dimensional normal has a covariance smaller by this factor: 0.75 / P(chi2_6 <= q), q the 0.75 quantile of chi2_4.
CONSISTENCY = 1.485
#: The chi2_4 quantile of 1 - 1e-6.
CUTOFF = 33.4


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))


def _repeat_words(words: Column) -> Column:
    """Words covered by WINDOW-word windows that occur twice or more: window hashes, sorted with their positions, then the union of the hits."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        hits = let(
            pairs,
            lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == x["h"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])),
        )
        return let(hits, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    worded = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = let(
        _words(F.col("text")),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    lines = let(worded, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines")))
    out = docs.select("doc_id", "lang", "source", counts.alias("c"), lines.alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    out = out.select("doc_id", "lang", "source", "c.n_words", "c.word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", "l.n_lines")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _fixed(x: Column) -> Column:
    return F.round(x * SCALE).cast("long")


def _rate(part: str, whole: str) -> Column:
    return _fixed(F.log(1 + 1000 * F.col(part) / F.greatest(F.col(whole), F.lit(1))))


def features(counts: DataFrame) -> DataFrame:
    return counts.withColumns(
        {
            "x1": _fixed(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))),
            "x2": _rate("n_symbols", "word_chars"),
            "x3": _rate("n_dup_lines", "n_lines"),
            "x4": _rate("n_repeat_words", "n_words"),
        }
    )


def _estimates(points: DataFrame, first: bool) -> DataFrame:
    """Mean and Cholesky factor of the covariance per group, from integer sums."""
    k = len(FEATURES)
    sums = {"n": F.count(F.lit(1)).cast("double")}
    for i in range(k):
        sums[f"s{i}"] = F.sum(F.col(FEATURES[i])).cast("double")
        for j in range(i + 1):
            sums[f"s{i}{j}"] = F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).cast("double")
    g = points.groupBy("start", "g_lang", "g_source").agg(*[v.alias(n) for n, v in sums.items()])
    g = g.withColumns({f"m{i}": F.col(f"s{i}") / F.col("n") / SCALE for i in range(k)})
    cov = {}
    for i in range(k):
        for j in range(i + 1):
            c = F.col(f"s{i}{j}") / F.col("n") / (SCALE * SCALE) - F.col(f"m{i}") * F.col(f"m{j}")
            c = c if first else c * CONSISTENCY
            cov[f"c{i}{j}"] = c + FLOORS[i] ** 2 if i == j else c
    g = g.withColumns(cov)
    for j in range(k):
        d = F.col(f"c{j}{j}")
        for a in range(j):
            d = d - F.col(f"l{j}{a}") * F.col(f"l{j}{a}")
        g = g.withColumn(f"l{j}{j}", F.sqrt(F.greatest(d, F.lit(1e-9))))
        for i in range(j + 1, k):
            e = F.col(f"c{i}{j}")
            for a in range(j):
                e = e - F.col(f"l{i}{a}") * F.col(f"l{j}{a}")
            g = g.withColumn(f"l{i}{j}", e / F.col(f"l{j}{j}"))
    return g.select(*_columns())


def _columns() -> list[str]:
    k = len(FEATURES)
    return ["start", "g_lang", "g_source", *[f"m{i}" for i in range(k)], *[f"l{i}{j}" for i in range(k) for j in range(i + 1)]]


def _robust_starts(points: DataFrame) -> DataFrame:
    """Starts 1 and 2: medians, with median absolute deviations and with floors only. Values are fixed-point numbers of a small range, so a median comes from counts of bounded number."""
    k = len(FEATURES)
    middle = points.groupBy("g_lang", "g_source").agg(*[F.percentile(x, F.lit(0.5)).alias(f"m{i}") for i, x in enumerate(FEATURES)])
    apart = salted_join(points, middle, ["g_lang", "g_source"], list(FEATURES))
    spread = apart.groupBy("g_lang", "g_source").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(k)], *[F.percentile(F.abs(F.col(x) - F.col(f"m{i}")), F.lit(0.5)).alias(f"s{i}") for i, x in enumerate(FEATURES)])
    both = spread.withColumn("start", F.explode(F.array(F.lit(1), F.lit(2))))
    made = {f"m{i}": F.col(f"m{i}") / SCALE for i in range(k)}
    for i in range(k):
        for j in range(i):
            made[f"l{i}{j}"] = F.lit(0.0)
        made[f"l{i}{i}"] = F.sqrt(F.when(F.col("start") == 1, (MAD * F.col(f"s{i}") / SCALE) ** 2).otherwise(0.0) + FLOORS[i] ** 2)
    return both.withColumns(made).select(*_columns())


def _least(estimates: DataFrame) -> DataFrame:
    """Of each group's starts, that of the least determinant; the first of equals."""
    determinant = F.lit(1.0)
    for i in range(len(FEATURES)):
        determinant = determinant * F.col(f"l{i}{i}")
    best = estimates.groupBy("g_lang", "g_source").agg(F.min(F.struct(determinant.alias("determinant"), *[c for c in _columns() if c[:2] != "g_"])).alias("best"))
    return best.select("g_lang", "g_source", "best.*").select(*_columns())


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d2, by forward substitution."""
    z: list[Column] = []
    for i, x in enumerate(FEATURES):
        e = F.col(x) / SCALE - F.col(f"m{i}")
        for j in range(i):
            e = e - F.col(f"l{i}{j}") * z[j]
        z.append(e / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((v * v for v in z), F.lit(0.0)))


def _alone(i: int) -> Column:
    """Squared distance by one statistic only: its variance in the core is what the factor's row has besides the floor."""
    variance = sum((F.col(f"l{i}{j}") * F.col(f"l{i}{j}") for j in range(i + 1)), F.lit(0.0)) - FLOORS[i] ** 2
    e = F.col(FEATURES[i]) / SCALE - F.col(f"m{i}")
    return e * e / (F.greatest(variance, F.lit(0.0)) + ALONE[i] ** 2)


def _bin(d2: Column) -> Column:
    return F.floor(BINS_PER_OCTAVE * F.log2(F.greatest(d2, F.lit(1e-6)))).cast("int")


def _judges(points: DataFrame) -> DataFrame:
    """g_lang, g_source, the (e_lang, e_source) whose estimate judges the group, and ``also``: all estimates that its documents enter. A pool has POOL for what it joins."""
    each = Window.partitionBy("g_lang")
    sizes = points.groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.groupBy("g_lang").agg(F.sum("n").alias("of_lang"), F.min("n").alias("least"))
    # A language's pool is needed where one of its groups is small; that of all, where such a language is small too.
    need_all = langs.agg(F.coalesce(F.max((F.col("least") < MIN_GROUP) & (F.col("of_lang") < MIN_GROUP)), F.lit(False)).alias("need_all"))
    d = sizes.withColumns({"of_lang": F.sum("n").over(each), "least": F.min("n").over(each)}).crossJoin(F.broadcast(need_all))
    own, lang = F.col("n") >= MIN_GROUP, F.col("of_lang") >= MIN_GROUP
    key = lambda a, b: F.struct(a.alias("lang"), b.alias("source"))
    mine, pool, whole = key(F.col("g_lang"), F.col("g_source")), key(F.col("g_lang"), F.lit(POOL)), key(F.lit(POOL), F.lit(POOL))
    also = F.array_compact(F.array(F.when(own, mine), F.when(lang & (F.col("least") < MIN_GROUP), pool), F.when(F.col("need_all"), whole)))
    by = F.when(own, mine).when(lang, pool).otherwise(whole)
    return d.select("g_lang", "g_source", by["lang"].alias("e_lang"), by["source"].alias("e_source"), also.alias("also"))


def outliers(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """counts with its features, ``d2`` and the greatest distance ``d2_alone`` by one statistic, null where the base rules failed. counts must be a table, as it is read once per step."""
    rows = features(counts).withColumns({"g_lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")), "g_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))})
    points = rows.where(~F.col("base_failed")).select("g_lang", "g_source", *FEATURES)
    judges, judged = materialize(spark, _judges(points), "judges")
    entered = salted_join(points, judges, ["g_lang", "g_source"], list(FEATURES)).select(F.explode("also").alias("k"), *FEATURES)
    points, members = materialize(spark, entered.select(F.col("k.lang").alias("g_lang"), F.col("k.source").alias("g_source"), *FEATURES), "members")
    starts = _estimates(points.withColumn("start", F.lit(0)), True).union(_robust_starts(points))
    now, at = materialize(spark, starts, "mcd")
    keys = ["start", "g_lang", "g_source"]
    for step in range(STEPS):
        near = _distance(salted_join(points, now, ["g_lang", "g_source"], list(FEATURES))).withColumn("bin", _bin(F.col("d2")))
        bins = near.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("k"))
        each = Window.partitionBy(*keys)
        ranked = bins.withColumns({"upto": F.sum("k").over(each.orderBy("bin")), "all": F.sum("k").over(each)})
        edge = ranked.where(4 * F.col("upto") >= 3 * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("edge"))
        core = salted_join(near, edge, keys, list(FEATURES)).where("bin <= edge")
        found = _estimates(core, False)
        after, path = materialize(spark, _least(found) if step == TRIALS - 1 else found, "mcd")
        discard(spark, at)
        now, at = after, path
    now = now.drop("start")
    by = now.withColumnsRenamed({"g_lang": "e_lang", "g_source": "e_source"})
    now, path = materialize(spark, judges.drop("also").join(by, ["e_lang", "e_source"]).drop("e_lang", "e_source"), "mcd")
    for done in (at, members, judged):
        discard(spark, done)
    far = _distance(salted_join(rows, now, ["g_lang", "g_source"], ["doc_id", *FEATURES], "left")).withColumn("d2_alone", F.greatest(*[_alone(i) for i in range(len(FEATURES))]))
    return far.withColumns({c: F.when(~F.col("base_failed"), F.col(c)) for c in ("d2", "d2_alone")})


def quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2."""
    counts, _ = materialize(spark, base_counts(docs), "quality")
    judged = outliers(spark, counts)
    kept = ~F.col("base_failed") & (F.coalesce(F.greatest("d2", "d2_alone"), F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("d2").alias("distance2"))
