"""Token-budget packing of sentences, merging of small chunks and chunk ids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import CHARS_PER_TOKEN, sentences
from corpusloom.sources.tables import dense_index

MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS = 1000, 50, 50


def _spans(sizes: Sequence[int], budget: int, overlap: int) -> list[int]:
    """Begin and end of each chunk, end to end."""
    sums = [0, *accumulate(sizes)]
    out, start, opened = [], 0, 0
    for i in range(len(sizes)):
        if i > opened and sums[i + 1] - sums[start] > budget:
            out += [start, i]
            opened = i
            # The first sentence from which at most the overlap is carried over.
            while sums[i] - sums[start] > overlap:
                start += 1
    return [*out, start, len(sizes)] if sizes else []


def pack(parts: Column, budget: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """Array of chunks of an array of sentences: filled from the left up to ``budget`` tokens, each next one starting with the longest run of
    last sentences that has at most ``overlap`` tokens. A longer sentence is a chunk of its own. Null gives null.

    Only sizes leave the JVM: one pass over them, linear in the sentences, gives each chunk's first and last.
    """

    @F.pandas_udf("array<int>")
    def spans(sizes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else _spans(x.tolist(), budget, overlap) for x in sizes])

    sizes = F.transform(parts, lambda x: F.floor(F.length(x) / CHARS_PER_TOKEN).cast("int"))
    ends = lambda at: F.transform(F.filter(at, lambda x, i: i % 2 == 0), lambda a, i: F.struct(a.alias("a"), F.get(at, 2 * i + 1).alias("b")))
    # Bound together, so that the sentences are made once and not for each chunk.
    both = F.array(F.struct(parts.alias("parts"), spans(sizes).alias("at")))
    return F.transform(both, lambda v: F.transform(ends(v["at"]), lambda x: F.array_join(F.slice(v["parts"], x["a"] + 1, x["b"] - x["a"]), " ")))[0]


def packed(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, part (1-based), n_parts, chunk."""
    return docs.select(key, pack(sentences(F.col(text))).alias("chunks")).select(key, F.size("chunks").alias("n_parts"), F.posexplode("chunks").alias("part", "chunk")).withColumn("part", F.col("part") + 1)


def _join_paths(a: str, b: str) -> str:
    return f"{a} + {b.split(' > ')[-1]}"


def merge_small(chunks: Sequence[dict], budget: int = MAX_TOKENS, least: int = MIN_TOKENS) -> list[dict]:
    """One document's chunks in order, small ones merged: first into the chunk before, if kind, article and annex are the same and the sum fits, then what
    is still small into the chunk after, where annexes may differ. Keys: text, tokens, section_type, article_number, annex_number, hierarchy_path.
    """

    def same(a: dict, b: dict, *keys: str) -> bool:
        return all(a.get(k) == b.get(k) for k in keys)

    back: list[dict] = []
    for c in chunks:
        p = back[-1] if back else None
        if p and c["tokens"] < least and same(p, c, "section_type", "article_number", "annex_number") and p["tokens"] + c["tokens"] <= budget:
            text = p["text"] + "\n\n" + c["text"]
            back[-1] = p | {"text": text, "tokens": len(text) // CHARS_PER_TOKEN, "hierarchy_path": _join_paths(p["hierarchy_path"], c["hierarchy_path"])}
        else:
            back.append(dict(c))
    out: list[dict] = []
    pending: dict | None = None
    for c in back:
        if pending and pending["tokens"] < least and same(pending, c, "section_type", "article_number") and pending["tokens"] + c["tokens"] <= budget:
            text = pending["text"] + "\n\n" + c["text"]
            pending = c | {"text": text, "tokens": len(text) // CHARS_PER_TOKEN, "hierarchy_path": pending["hierarchy_path"].split(" > ")[-1] + " + " + c["hierarchy_path"]}
        else:
            if pending:
                out.append(pending)
            pending = dict(c)
    return out + [pending] if pending else out


MERGED = "source string, pos long, text string, tokens int, section_type string, article_number int, annex_number string, hierarchy_path string"


_NAMES = [c.split()[0] for c in MERGED.split(", ")]


def _documents_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[dict]]]:
    """Each source and its chunks, of batches in which a source's rows follow each other."""
    source, rows = None, []
    for b in batches:
        columns = [b.column(c).to_pylist() for c in _NAMES]
        for values in zip(*columns, strict=True):
            if rows and values[0] != source:
                yield source, rows
                rows = []
            source = values[0]
            rows.append(dict(zip(_NAMES, values, strict=True)))
    if rows:
        yield source, rows


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[kind]) for c, kind in (c.split() for c in MERGED.split(", "))])
    for _, rows in _documents_of(batches):
        out += [r | {"pos": i} for i, r in enumerate(merge_small(rows))]
        if len(out) >= MERGED_ROWS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


#: Merged chunks that leave a task at once.
MERGED_ROWS = 2000


def merged(chunks: DataFrame) -> DataFrame:
    """merge_small per source of chunks with the columns of ``MERGED``; pos is renumbered from 0. Sources are sorted in a task and pass through it one after the other, a document at a time."""
    ordered = chunks.select(*[F.col(c).cast(kind).alias(c) for c, kind in (c.split() for c in MERGED.split(", "))]).repartition("source").sortWithinPartitions("source", "pos")
    return ordered.mapInArrow(_merged_rows, MERGED)


def numbered(chunks: DataFrame, source: str, *order: str) -> DataFrame:
    """With chunk_id, dense from 0 in each source."""
    return dense_index(chunks, [source], list(order), "chunk_id")


def variants(chunks: DataFrame, header: str, text: str) -> tuple[DataFrame, DataFrame]:
    """The table with the header in front of the text, and the one without; neither has the header column."""
    with_header = chunks.withColumn(text, F.concat(F.col(header), F.lit("\n\n"), F.col(text)))
    return with_header.drop(header), chunks.drop(header)


def size_bucket(tokens: Column) -> Column:
    return F.when(tokens < 50, "<50").when(tokens < 200, "50-200").when(tokens < 500, "200-500").when(tokens < 800, "500-800").when(tokens <= 1000, "800-1000").otherwise(">1000")


#: Hexadecimal digits, to read a number from a digest.
DIGITS = "0123456789abcdef"


def _digit(x: Column) -> Column:
    return F.instr(F.lit(DIGITS), F.substring(F.md5(x.cast("string").cast("binary")), 1, 1)) - 1


def batches_without_repeats(rows: DataFrame, text: str, size: int, salts: int = 4) -> DataFrame:
    """rows with ``batch``: at most ``size`` rows, no text twice.

    Copies of a text are numbered within ``salts`` parts of the rows; the rows of a part, a copy number and a digit of the text's digest hold each text once, and are cut into batches
    in order of row_id. All batches but the last of each such share are full, and a text of very many copies is spread.
    """
    part = rows.withColumns({"_part": (_digit(F.col("row_id")) % salts).cast("int"), "_share": _digit(F.col(text)).cast("int")})
    copied = part.withColumn("_copy", F.row_number().over(Window.partitionBy(text, "_part").orderBy("row_id")) - 1)
    placed = dense_index(copied, ["_part", "_copy", "_share"], ["row_id"], "_at")
    return placed.withColumn("batch", F.concat_ws("/", "_part", "_copy", "_share", F.floor(F.col("_at") / size).cast("string"))).drop("_part", "_copy", "_share", "_at")


def in_batches(frames: Iterator[pd.DataFrame], client, column: str, concurrent: int = 1, attempts: int = 1) -> Iterator[pd.DataFrame]:
    """Calls client(list of prompts) -> list of replies. With ``concurrent`` above 1 each prompt is a call of its own, so many at a time.

    A call that fails is made again, ``attempts`` times in all; then its rows get a null reply and the last error's message. Replies keep the rows' order.
    """

    def call(prompts: list) -> tuple[list, list]:
        said = ""
        for _ in range(attempts):
            try:
                replies = list(client(prompts))
                if len(replies) != len(prompts):
                    raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
                return replies, [None] * len(prompts)
            except Exception as e:  # noqa: BLE001  a remote client may raise anything; the rows carry it
                said = str(e)
        return [None] * len(prompts), [said] * len(prompts)

    for b in frames:
        prompts = b[column].tolist()
        if concurrent > 1:
            with ThreadPoolExecutor(concurrent) as pool:
                done = list(pool.map(lambda p: call([p]), prompts))
        else:
            done = [call(prompts)]
        yield b.assign(content=[x for replies, _ in done for x in replies], error=[x for _, errors in done for x in errors])


def first_rows(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first ``most`` rows in order; all of them without a number, or with 0."""
    return rows.orderBy(order).limit(most) if most else rows
