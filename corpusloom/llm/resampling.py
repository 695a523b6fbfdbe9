"""Importance resampling towards a target distribution, by hashed n-gram features.

Each task holds a trie of the words of a stretch of its partition: a node stands for a run of one to three words, and has how often it occurs, and the CRC-32 state of its
bytes, which is its parent's state carried on over a space and one word. Equal runs of a stretch thus share a node, whose bucket is found once. Levels of the trie are arrays:
a node is a pair of its parent and a word. A trie holds at most ``TRIE_WORDS`` words' runs; then its counts go to the task's bucket totals and a new one
is begun, so memory does not grow with the partition, nor with a text.

Totals of all tasks are merged per bucket; gains of the buckets are a table of fixed size. Documents are scored by a second walk along the paths of tries whose
nodes have their gains attached. What is drawn is found by a range sort of all scores.

Null and empty texts have no words, no features and a weight of 0. Rows that repeat a doc_id are scored and drawn each for itself; a row without a doc_id takes the empty string for it and
comes last among ties. With an empty target each bucket's share of it is as if it held one feature. Ties of score and doc_id go by weight, number of features, then place. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bytetext import ascii_lower, column_bytes, word_hashes, words
from corpusloom.llm.running import running_total
from corpusloom.llm.runtime import materialize, ship, trim

BUCKETS, LONGEST, SEED, MIN_WORDS, PERCENT = 10_000, 3, 42, 20, 5
#: Words whose runs one trie holds, and bytes of text that are gathered for one.
TRIE_WORDS, TRIE_BYTES = 400_000, 3 << 20
TOTALS = "bucket int, n long"
SCORED = "doc_id long, n_words long, n_features long, weight long"

#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_POLY = np.uint32(0xEDB88320)


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ _POLY, t >> np.uint32(1))
    return t


def _applied(tables: np.ndarray, v: np.ndarray) -> np.ndarray:
    return tables[0][v & 255] ^ tables[1][(v >> np.uint32(8)) & 255] ^ tables[2][(v >> np.uint32(16)) & 255] ^ tables[3][v >> np.uint32(24)]


def _powers(n: int = 32) -> list[np.ndarray]:
    """Maps of a CRC-32 state over 2^k zero bytes, each as four tables of a byte's image."""
    one, byte = _byte_table(), np.arange(256, dtype=np.uint32)
    images = [byte << np.uint32(8 * i) for i in range(4)]
    maps = [np.stack([(x >> np.uint32(8)) ^ one[x & 255] for x in images])]
    for _ in range(n - 1):
        maps.append(np.stack([_applied(maps[-1], maps[-1][i]) for i in range(4)]))
    return maps


_MAPS = _powers()


def carried(state: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of strings joined with others, from the CRC-32 of both and the others' lengths."""
    out, length = state.copy(), length.astype(np.int64)
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> k) & 1)
        out[at] = _applied(_MAPS[k], out[at])
    return out ^ crc


class Trie:
    """Runs of one to ``LONGEST`` words that begin in words [lo, hi) of a stretch of text; ``stop`` has for each word the first one of the next text."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, stop: np.ndarray, lo: int, hi: int) -> None:
        top = min(hi + LONGEST - 1, len(starts))
        starts, ends, stop = starts[lo:top], ends[lo:top], stop[lo:top] - lo
        _, first, word = np.unique(word_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        text = raw.tobytes()
        spelt = [text[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        length = ends[first] - starts[first] + 1
        spaced = np.array([zlib.crc32(b" " + w) for w in spelt], np.uint32)
        n = hi - lo
        #: For each level, the node of the run that begins at each word, -1 for none, and the CRC-32 state and count of each node.
        self.node, self.state, self.count = [], [], []
        at, node, state = np.arange(n), word[:n], np.array([zlib.crc32(w) for w in spelt], np.uint32)
        for level in range(LONGEST):
            if level:
                here = at + level < stop[at]
                at = at[here]
                pair, node = np.unique(node[here].astype(np.int64) << 32 | word[at + level], return_inverse=True)
                last = pair & 0xFFFFFFFF
                state = carried(state[pair >> 32], spaced[last], length[last])
            seats = np.full(n, -1, np.int64)
            seats[at] = node
            self.node.append(seats)
            self.state.append(state)
            self.count.append(np.bincount(node, minlength=len(state)))

    def add_to(self, totals: np.ndarray) -> None:
        for state, count in zip(self.state, self.count, strict=True):
            np.add.at(totals, (state % np.uint32(len(totals))).astype(np.int64), count)

    def weights(self, gains: np.ndarray) -> np.ndarray:
        """For each word, the gains of all runs that begin there."""
        out = np.zeros(len(self.node[0]), np.int64)
        for node, state in zip(self.node, self.state, strict=True):
            attached = np.append(gains[(state % np.uint32(len(gains))).astype(np.int64)], 0)
            out += attached[node]
        return out


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, gathered to about ``TRIE_BYTES``."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= TRIE_BYTES:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tries(text: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, Trie | None]]:
    """(first word, first words of the rows, trie) of a stretch; a stretch without words gives one without a trie."""
    raw, offsets = column_bytes(text.chunk(0) if text.num_chunks else pa.array([], pa.string()))
    raw = ascii_lower(raw)
    starts, ends, at = words(raw, offsets, BETWEEN)
    stop = np.repeat(at[1:], np.diff(at))
    if not len(starts):
        yield 0, at, None
    for lo in range(0, len(starts), TRIE_WORDS):
        yield lo, at, Trie(raw, starts, ends, stop, lo, min(lo + TRIE_WORDS, len(starts)))


def _totals(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(buckets, np.int64)
        for stretch in _stretches(batches):
            for _, _, trie in _tries(stretch.column(0)):
                if trie:
                    trie.add_to(totals)
        found = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found.astype(np.int32)), "n": pa.array(totals[found])})
        trim()

    return run


def _scores(gains: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for stretch in _stretches(batches):
            per_word = []
            for _, at, trie in _tries(stretch.column(1)):
                if trie:
                    per_word.append(trie.weights(gains))
            sums = np.concatenate([[0], *per_word]).cumsum()
            n = np.diff(at)
            features = sum(np.maximum(n - k, 0) for k in range(LONGEST))
            columns = [stretch.column(0).combine_chunks(), pa.array(n), pa.array(features), pa.array(sums[at[1:]] - sums[at[:-1]])]
            yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=["doc_id", "n_words", "n_features", "weight"])
        trim()

    return run


def bucket_totals(spark: SparkSession, texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts(text) fall into each bucket; ``buckets`` numbers reach the driver, whatever the input."""
    ship(spark)
    rows = texts.select(F.col("text").cast("string")).mapInArrow(_totals(buckets), TOTALS).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's share of the target over that of the corpus, each bucket counting one more; floored."""
    s_all, t_all = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log(((t + 1.0) * s_all) / ((s + 1.0) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def resampled(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of each row of docs(doc_id, text): weights by the texts of ``target``, scores with Gumbel noise seeded by doc_id, and the place among
    the ``percent`` per cent drawn of rows of at least ``min_words`` words, null where a row is not drawn."""
    ship(spark)
    gains = bucket_gains(bucket_totals(spark, docs, buckets), bucket_totals(spark, target, buckets))
    weighed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scores(gains), SCORED)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    score = F.col("weight") + F.floor(-1000 * F.log(-F.log(u)))
    scored, _ = materialize(spark, weighed.select("*", score.cast("long").alias("score"), (F.col("n_words") >= min_words).cast("long").alias("fit"), F.monotonically_increasing_id().alias("number")), "scored")
    drawn = scored.where("fit = 1").count() * percent // 100
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc(), F.col("number")]
    placed = running_total(spark, scored.withColumn("one", F.lit(1).cast("long")), order, "one", "place")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
