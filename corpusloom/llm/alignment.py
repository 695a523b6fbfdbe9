"""Alignment of two tokenizers' tokens by the bytes that they stand for, as relations.

A is a byte-level BPE over a space and the text, B a sentencepiece BPE over the text, which puts that space itself. Executors encode whole texts; all else is relational: the tokens of both sides are
exploded with their positions, a windowed sum of their lengths gives the byte offset at which each ends, an equi-join on document and end finds the offsets at which both have a token's end, the cuts, and
the running count of a document's cuts numbers its groups of tokens. What a cut joins is a link: the two tokens that end together. Links are counted per pair of ids over all documents,
and each link then meets its pair's count.

Documents are dealt by a number of their own, with both id arrays in one row; windows, join and groups of a document need no other exchange. The order of a document's tokens is sorted, and spilled where it is long.

Null and empty texts, and those whose tokens of either side don't spell a space and the text, have no tokens: zeros, and an empty digest. Strings of special tokens inside texts are plain text. Rows that repeat a
doc_id are documents of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusloom.llm import bpe_units, token_counts
from corpusloom.llm.runtime import balanced_join, materialize, partitions, ship, trim

#: Most pairs of ids whose counts are broadcast, some 50 MB; more are joined by a shuffle that deals frequent pairs out.
PAIRS = 1_000_000
#: Times the session's shuffle partitions that documents are dealt to: a token's row is some twenty times its bytes of text.
SPREAD = 8
SAME = "spark.sql.requireAllClusterKeysForCoPartition"
#: Cuts arrive in the order of documents, so that a document's are collected as they come; by hash they would be sorted once more.
BY_HASH = "spark.sql.execution.useObjectHashAggregateExec"


class Encoders:
    """Ids of both tokenizers as numpy arrays, and the bytes that each id stands for."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        self.a = bpe_units.ByteBpe(byte_level, special=False)
        counter = token_counts.load(pieces)
        self.b, self.by_word = counter.library, counter.by_word
        value = {c: b for b, c in enumerate(bpe_units.byte_alphabet())}
        vocabulary = self.a.library.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(value.__getitem__, entry)) if all(c in value for c in entry) else entry.encode()
        spelt = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(token_counts.SPACE, " ").encode() for i, p in enumerate(spelt)]
        self.kind_a, self.kind_b = (np.dtype("<u2" if len(v) <= 1 << 16 else "<u4") for v in (self.bytes_a, self.bytes_b))
        self.size_a = np.array([len(x) for x in self.bytes_a])
        # What was not used since the memory was last full goes when it is full again.
        self.words: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}
        # Every two pieces that make a piece; the library joins those of the best score first.
        score = counter.score
        number, place = {p: self.b.piece_to_id(p) for p in score}, {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = [(p[:k], p[k:], p) for p in score for k in range(1, len(p)) if p[:k] in score and p[k:] in score]
        self.merges = bpe_units.Merges(*([number[x[k]] for x in pairs] for k in (0, 1)), [place[score[x[2]]] for x in pairs], [number[x[2]] for x in pairs])
        self.of_char = np.full(1 << 16, -1)
        for p, k in number.items():
            if len(p) == 1 and p < "\U00010000":
                self.of_char[ord(p)] = k

    def _made(self, words: list[str]) -> list[bytes | None]:
        """B's ids of each word behind a space, packed; none if they spell something else. Words with a character that is no piece go to the library."""
        n = np.array([1 + len(w) for w in words])
        code = np.frombuffer("".join([token_counts.SPACE + w for w in words]).encode("utf-32-le"), np.uint32)
        symbols = np.where(code < 1 << 16, self.of_char[np.minimum(code, (1 << 16) - 1)], -1)
        strange = np.logical_or.reduceat(symbols < 0, np.cumsum(n) - n)
        ids, left = self.merges.joined(symbols[~np.repeat(strange, n)], n[~strange])
        plain = iter(bpe_units.cut(ids.astype(self.kind_b), left))
        return [self._asked(w) if x else next(plain) for w, x in zip(words, strange.tolist(), strict=True)]

    def _asked(self, word: str) -> bytes | None:
        # The library puts no space before an empty text.
        ids = self.b.encode(word) if word else [self.b.piece_to_id(token_counts.SPACE)]
        return np.array(ids, self.kind_b).tobytes() if b"".join(map(self.bytes_b.__getitem__, ids)) == b" " + word.encode() else None

    def _known(self, words: set[str]) -> dict[str, bytes | None]:
        """The memory with all of these words in it."""
        new = words.difference(self.words)
        if len(self.words) + len(new) > bpe_units.LIMIT:
            self.old, self.words, new = self.words, {}, words
        again = new.intersection(self.old)
        self.words.update(zip(again, map(self.old.__getitem__, again)))
        if rest := list(new.difference(again)):
            self.words.update(zip(rest, self._made(rest), strict=True))
        return self.words

    def pieces(self, texts: list[str]) -> list[np.ndarray | None]:
        """B's ids of each text, none if they spell something else than a space and the text. No piece crosses the start of a word, and the space before it is one that the library puts."""
        split = [_words(t) if self.by_word and token_counts.SPACE not in t else None for t in texts]
        known = self._known(set().union(*[x for x in split if x]))
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is not None:
                try:
                    out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), self.kind_b))
                    continue
                except TypeError:  # a word of other bytes
                    pass
            ids = self.b.encode(text)
            out.append(np.array(ids, self.kind_b) if b"".join(map(self.bytes_b.__getitem__, ids)) == (" " + text).encode() else None)
        for w in [w for w in known if len(w) >= bpe_units.LONGEST]:
            del known[w]
        return out

    def ids(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Both sides' ids; none where either side does not spell a space and the text."""
        return self.all_ids([text])[0]

    def all_ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """ids of each text; words that are not remembered are made together."""
        none = np.zeros(0, self.kind_a), np.zeros(0, self.kind_b)
        out = []
        sides = zip(texts, self.a.all_ids([" " + (t or "") for t in texts]), self.pieces([t or "" for t in texts]), strict=True)
        for text, a, b in sides:
            if not text or b is None:
                out.append(none)
                continue
            a = np.frombuffer(a, self.a.dtype)
            # A's entries are runs of bytes of the text, in order: what is missing shows in their length.
            out.append((a, b) if int(self.size_a[a].sum()) == len(text.encode()) + 1 else none)
        return out


def _words(text: str) -> list[str]:
    """What follows the first space of each stretch of a space and the text; a stretch begins with all the spaces before a word."""
    return [x[1:] for x in token_counts._RUNS.findall(" " + text)] if text[:1] == " " or "  " in text else text.split(" ")


_loaded: dict[tuple[str, str], Encoders] = {}


def load(byte_level: str, pieces: str) -> Encoders:
    if (byte_level, pieces) not in _loaded:
        _loaded[byte_level, pieces] = Encoders(byte_level, pieces)
    return _loaded[byte_level, pieces]


def _kinds(n: int) -> tuple[pa.DataType, np.dtype]:
    """Types that hold ids below n: 16 bits, which wrap around, or 32."""
    return (pa.int16(), np.dtype(np.int16)) if n <= 1 << 16 else (pa.int32(), np.dtype(np.int32))


def _encoded(byte_level: str, pieces: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = load(byte_level, pieces), TaskContext.get().partitionId() << 40
        for batch in batches:
            sides = list(zip(*both.all_ids(batch.column(1).to_pylist()), strict=True)) or [(), ()]
            columns = [pa.array(np.arange(number, number + batch.num_rows)), batch.column(0)]
            number += batch.num_rows
            for ids, vocabulary in zip(sides, (both.bytes_a, both.bytes_b), strict=True):
                kind, plain = _kinds(len(vocabulary))
                ends = np.cumsum([0, *map(len, ids)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, plain)]).astype(plain), kind)))
            yield pa.RecordBatch.from_arrays(columns, names=["number", "doc_id", "a", "b"])
        trim()

    return run


def encoded(spark: SparkSession, docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """number, doc_id, a, b: a number of each row, and both sides' ids, in 16 bits where they fit."""
    ship(spark)
    both = load(byte_level, pieces)
    kind = lambda v: "smallint" if len(v) <= 1 << 16 else "int"
    schema = f"number long not null, doc_id long, a array<{kind(both.bytes_a)}>, b array<{kind(both.bytes_b)}>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encoded(byte_level, pieces), schema)


def tokens(rows: DataFrame, side: str, other: str, vocabulary: list[bytes]) -> DataFrame:
    """number, <side>_pos, <side>_id, end of each token of a side; end is the byte offset behind it."""
    # Every plan over the encoded rows reads all their columns, and filters none out, so that all share one exchange and texts are encoded once.
    ids = F.when((F.size(other) >= 0) & F.coalesce(F.col("doc_id") >= F.lit(-(2**63)), F.lit(True)), F.col(side))
    each = rows.select("number", F.posexplode_outer(ids).alias(f"{side}_pos", "_id"))
    token = F.col("_id").cast("int")
    each = each.select("number", f"{side}_pos", (token.bitwiseAND(F.lit(0xFFFF)) if len(vocabulary) <= 1 << 16 else token).alias(f"{side}_id"))
    lengths = F.split(F.lit(",".join(str(len(x)) for x in vocabulary)), ",").cast("array<int>")
    end = F.sum(F.get(lengths, F.col(f"{side}_id"))).over(Window.partitionBy("number").orderBy(f"{side}_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return each.withColumn("end", end)


def cuts(rows: DataFrame, both: Encoders) -> DataFrame:
    """number, end, a_pos, a_id, b_pos, b_id, group: the offsets at which tokens of both sides end, with the two tokens, and the number of the group of tokens that ends there, from 1."""
    met = tokens(rows, "a", "b", both.bytes_a).join(tokens(rows, "b", "a", both.bytes_b).hint("merge"), ["number", "end"])
    return met.withColumn("group", F.row_number().over(Window.partitionBy("number").orderBy("end")))


def _rendered(n_a: int, n_b: int) -> Callable:
    """Rows (doc_id, a, b, ends of groups as (group, a_pos, b_pos)) to what the result has of a document by itself, and its links' pairs."""
    mask_a, mask_b = (0xFFFF if n <= 1 << 16 else -1 for n in (n_a, n_b))
    top = max(n_a, n_b)
    # Every id before each of its three separators, eight bytes or fewer: what is missing is zeros.
    names = np.array([b"%d%b" % (i, sep) for sep in (b",", b"|", b";") for i in range(top)], "S8").view(np.uint64)

    def rendered(a: np.ndarray, b: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> bytes:
        """a_end, b_end: the last token of each group."""
        entries = np.empty(len(a) + len(b), np.int64)
        a_group, b_group = (np.repeat(np.arange(len(x)), np.diff(x, prepend=-1)) for x in (a_end, b_end))
        # A's tokens stand behind B's of the groups before, B's behind A's of their own too.
        at_a = np.arange(len(a)) + np.concatenate([[0], b_end[:-1] + 1])[a_group]
        at_b = np.arange(len(b)) + (a_end + 1)[b_group]
        entries[at_a], entries[at_b] = a, b
        entries[at_a[a_end]] += top
        entries[at_b[b_end]] += 2 * top
        text = names[entries].view(np.uint8)
        return text[text != 0][:-1].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, a, b, found = (batch.column(k) for k in range(4))
            out, pairs, sizes = [], [], [0]
            found = found.cast(pa.list_(pa.struct([("group", pa.int32()), ("a_pos", pa.int32()), ("b_pos", pa.int32())])))
            groups, a_pos, b_pos = (found.values.field(k).to_numpy() for k in range(3))
            side_a, side_b = (x.values.to_numpy() for x in (a, b))
            # Offsets of null lists are equal to those before.
            at_a, at_b, at = (x.offsets.to_numpy().tolist() for x in (a, b, found))
            for k in range(batch.num_rows):
                xs = side_a[at_a[k] : at_a[k + 1]].astype(np.int64) & mask_a
                ys = side_b[at_b[k] : at_b[k + 1]].astype(np.int64) & mask_b
                lo, hi = at[k], at[k + 1]
                order = lo + np.argsort(groups[lo:hi], kind="stable")
                a_end, b_end = a_pos[order], b_pos[order]
                pairs.append(xs[a_end] * n_b + ys[b_end])
                sizes.append(len(order))
                out.append((len(xs), len(ys), len(order), hashlib.sha256(rendered(xs, ys, a_end, b_end)).hexdigest() if len(xs) else ""))
            columns = [doc_id, *[pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64()) for i in range(4)]]
            columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(pairs) if pairs else np.zeros(0, np.int64), pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"])
        trim()

    return run


def aligned(spark: SparkSession, docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """number, doc_id, n_a, n_b, n_groups, groups_sha256, pairs of each row of docs(doc_id, text), a table; pairs has a number for each link's two ids."""
    both = load(byte_level, pieces)
    rows = encoded(spark, docs, byte_level, pieces).repartition(SPREAD * partitions(spark), "number")
    ends = cuts(rows, both).groupBy(F.col("number").alias("_number")).agg(F.collect_list(F.struct("group", "a_pos", "b_pos")).alias("found"))
    joined = rows.join(ends.hint("merge"), F.col("number") == F.col("_number"), "left")
    made = joined.select("doc_id", "a", "b", "found").mapInArrow(_rendered(len(both.bytes_a), len(both.bytes_b)), "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>")
    before = {key: spark.conf.get(key) for key in (SAME, BY_HASH)}
    for key in before:
        spark.conf.set(key, "false")  # a document's rows are together already
    try:
        return materialize(spark, made.withColumn("number", F.monotonically_increasing_id()), "aligned")[0]
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """pair, n, best: the links of each pair of ids, and whether no other pair of its B id has more."""
    counts = links.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).withColumn("b_id", F.col("pair") % n_b)
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def alignment(spark: SparkSession, docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs(doc_id, text)."""
    table = aligned(spark, docs, byte_level, pieces)
    links = table.select("number", F.explode("pairs").alias("pair"))
    counts, _ = materialize(spark, pair_counts(links, len(load(byte_level, pieces).bytes_b)), "pair-counts")
    if counts.count() <= PAIRS:
        met = links.join(F.broadcast(counts), "pair")
    else:
        met = balanced_join(links, counts.withColumn("links", F.col("n")), ["pair"], ["number"], "links")
    sums = met.groupBy("number").agg(F.count(F.lit(1)).alias("n_links"), F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return table.join(sums, "number", "left").select("doc_id", "n_a", "n_b", "n_groups", *[zero(c) for c in ("n_links", "n_best", "count_sum")], "groups_sha256")
