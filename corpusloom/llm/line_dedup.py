"""Line dedup with DataFrame functions only.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased, held as two 64-bit hashes. The occurrences of
all lines are written once, range-partitioned by hash and document, so that a frequent key spans as many partitions as its share of the rows, and sorted by
hash, document and position. Down each run the first occurrence of a key in a document is streamed off; these alone are counted, map-side, as
the documents of a key, and the least of them is the key's first occurrence of all. Keys found in at least ``min_docs`` documents meet their
occurrences again by a join that deals frequent keys to tasks in proportion to their rows. What is returned per document is a run-length compressed keep bitmap, not text.

Null and empty texts are one empty line, whose key has no code points and which is never dropped unless ``min_chars`` is 0. Rows that repeat a
doc_id count as one document; each keeps its own bitmap, by its text. Rows without a doc_id count as one document together.
Extra columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.runtime import balanced_join, discard, materialize, partitions

#: ASCII white space.
BLANKS = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(x: Column) -> Column:
    return F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _UPPER.lower()))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_id, pos, h1, h2 for each line whose key has at least min_chars code points."""
    lines = docs.select(F.col("doc_id"), _text_id(F.col("text")).alias("text_id"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_id", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def dropped_lines(spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, text_id and dropped (sorted positions) for each document that loses a line.

    ``keep_first`` leaves the first occurrence of each key, by document and position.
    """
    found, found_at = materialize(spark, occurrences(docs, min_chars), "lines")
    ordered = found.repartitionByRange(partitions(spark), "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos", "text_id")
    seat = F.row_number().over(Window.partitionBy("h1", "h2", "doc_id").orderBy("pos", "text_id"))
    each = ordered.withColumn("first", seat == 1).groupBy("h1", "h2").agg(
        F.count_if("first").alias("n_docs"), F.count(F.lit(1)).alias("n"), *([F.min(F.when(F.col("first"), F.struct("doc_id", "pos", "text_id"))).alias("head")] if keep_first else [])
    )
    counts, counts_at = materialize(spark, each.where(F.col("n_docs") >= min_docs).drop("n_docs"), "frequent-lines")
    hit = balanced_join(found, counts, ["h1", "h2"], ["doc_id", "text_id", "pos"], "n")
    if keep_first:
        hit = hit.where(~F.struct("doc_id", "pos", "text_id").eqNullSafe(F.col("head")))
    marks, _ = materialize(spark, hit.groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("pos")).alias("dropped")), "marks")
    discard(spark, found_at, counts_at)
    return marks


def _kept_runs(dropped: Column, n_lines: Column) -> Column:
    """Runs between dropped positions: the bitmap, run-length compressed."""
    stops = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))
    return let(
        stops,
        lambda s: F.filter(
            F.transform(s, lambda x, i: F.struct((x + 1).alias("start"), (F.coalesce(F.get(s, i + 1), x + 1) - x - 1).alias("length"))),
            lambda r: r["length"] > 0,
        ),
    )


def with_bitmaps(spark: SparkSession, docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """All columns of docs, and n_lines, n_dropped and keep_runs (null where nothing is dropped), which replace columns of these names."""
    marks = dropped_lines(spark, docs, min_docs, min_chars, keep_first).select(F.struct("doc_id", "text_id", "dropped").alias("mark"))
    # The row travels as one column, so that none of its names can clash.
    own = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row").getField("text")
    joined = own.join(marks, F.col("row").getField("doc_id").eqNullSafe(F.col("mark.doc_id")) & (_text_id(text) == F.col("mark.text_id")), "left")
    size = F.size(split_lines(text))
    made = {
        "n_lines": size.cast("long"),
        "n_dropped": F.coalesce(F.size("mark.dropped"), F.lit(0)).cast("long"),
        "keep_runs": F.when(F.col("mark").isNotNull(), _kept_runs(F.col("mark.dropped"), size)),
    }
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in made], *[v.alias(k) for k, v in made.items()])


def kept_text(text: Column, runs: Column) -> Column:
    """The text of the lines in runs; the whole text where runs is null."""
    lines = split_lines(text)
    return F.when(runs.isNull(), F.coalesce(text, F.lit(""))).otherwise(let(lines, lambda a: F.array_join(F.flatten(F.transform(runs, lambda r: F.slice(a, r["start"] + 1, r["length"]))), "\n")))
