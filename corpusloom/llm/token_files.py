"""Token-id files: one concatenated id array, with Elias-Fano coded document boundaries.

A monotone sequence of n values below u takes about 2 + log2(u / n) bits each: the low bits are stored as they are, the
high bits in unary in a bit vector, and a directory of every ``SAMPLE``-th set bit answers select(i), so that any document's offset
is found without a table of 64-bit offsets; reading a whole file selects between one directory entry and the next. Document ids are coded the same way, relative to the file's first.

File: magic, a JSON header with the places of its sections, ids (16 bits where the vocabulary allows, else 32), boundaries, document ids.
Documents are range-partitioned and sorted by doc_id (nulls first), each task writes files of at most ``FILE_IDS`` ids (a longer document has its own file),
and a manifest of one row per file carries the running totals.

Null and empty texts are documents of the end id alone. Repeated doc_ids are documents of their own, in the order of their texts. Extra columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusloom.llm import bpe_units
from corpusloom.llm.files import open_input, write_whole
from corpusloom.llm.runtime import materialize, partitions, scratch_path, ship

MAGIC = b"LOOMTOK1"
SAMPLE = 128
FILE_IDS = 8_000_000
MANIFEST = "path string, part int, seq int, n_docs long, n_ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits and n:
            shifts = np.arange(bits, dtype=np.uint64)
            low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype(np.uint32 if n == 0 or ones[-1] < 1 << 32 else np.uint64))

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        a = i * self.low_bits
        b = a + self.low_bits
        return (int.from_bytes(self.low[a // 8 : (b + 7) // 8].tobytes(), "little") >> (a % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Place of the i-th set bit of the high part: from the directory, then over at most SAMPLE ones."""
        at, left = int(self.directory[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        first = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
        first[: at % 8] = 0
        while True:
            ones = np.flatnonzero(first)
            if left < len(ones):
                return byte * 8 + int(ones[left])
            left -= len(ones)
            byte += len(first) // 8
            first = np.unpackbits(self.high[byte : byte + 64], bitorder="little")

    def __getitem__(self, i: int) -> int:
        return ((self.select(i) - i) << self.low_bits) | self._low(i)

    def run(self, k: int) -> np.ndarray:
        """The values of directory entry k: select(i) of SAMPLE neighbours at once, from the bits between two entries."""
        first, n = k * SAMPLE, min(SAMPLE, self.n - k * SAMPLE)
        begin = int(self.directory[k])
        stop = int(self.directory[k + 1]) if k + 1 < len(self.directory) else 8 * len(self.high)
        bits = np.unpackbits(self.high[begin // 8 : (stop + 7) // 8], bitorder="little")
        ones = np.flatnonzero(bits[begin % 8 :])[:n] + begin
        out = (ones - np.arange(first, first + n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            a = first * self.low_bits
            low = np.unpackbits(self.low[a // 8 : (a + n * self.low_bits + 7) // 8], bitorder="little")[a % 8 :][: n * self.low_bits]
            out |= low.reshape(n, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return out

    def all(self) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *map(self.run, range(-(-self.n // SAMPLE)))])

    def sections(self) -> tuple[dict, list[bytes]]:
        parts = [self.low.tobytes(), self.high.tobytes(), self.directory.tobytes()]
        return {"n": self.n, "low_bits": self.low_bits, "wide": self.directory.dtype == np.uint64, "bytes": [len(p) for p in parts]}, parts

    @classmethod
    def load(cls, head: dict, data: memoryview) -> EliasFano:
        a, b, c = head["bytes"]
        return cls(head["n"], head["low_bits"], np.frombuffer(data[:a], np.uint8), np.frombuffer(data[a : a + b], np.uint8), np.frombuffer(data[a + b : a + b + c], np.uint64 if head["wide"] else np.uint32))


def pack_file(doc_ids: list[int | None], lengths: list[int], ids: list[bytes], width: int) -> list[bytes]:
    """The file's bytes in pieces. doc_ids ascend, nulls first."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    ends, names = EliasFano.of(np.cumsum(np.array(lengths, np.int64))), EliasFano.of((known - base).view(np.uint64))
    (eh, ep), (nh, np_) = ends.sections(), names.sections()
    head = json.dumps({"docs": len(doc_ids), "ids": int(sum(lengths)), "width": width, "nulls": nulls, "base": base, "ends": eh, "names": nh}).encode()
    return [MAGIC, len(head).to_bytes(4, "little"), head, *ids, *ep, *np_]


class TokenFile:
    """Random access to a file's documents."""

    def __init__(self, uri: str) -> None:
        with open_input(uri) as f:
            data = memoryview(f.read())
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        size = int.from_bytes(data[8:12], "little")
        self.head = head = json.loads(bytes(data[12 : 12 + size]))
        at = 12 + size
        self.ids = np.frombuffer(data[at : at + head["ids"] * head["width"]], f"<u{head['width']}")
        at += head["ids"] * head["width"]
        self.ends = EliasFano.load(head["ends"], data[at:])
        self.names = EliasFano.load(head["names"], data[at + sum(head["ends"]["bytes"]) :])

    def __len__(self) -> int:
        return self.head["docs"]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.head["nulls"] else self.head["base"] + self.names[i - self.head["nulls"]]

    def tokens(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i - 1] if i else 0 : self.ends[i]]

    def runs(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """Document ids, and their offsets and the last one's end, of SAMPLE documents at a time."""
        nulls, names, known = self.head["nulls"], [], -1
        end = 0
        for k in range(-(-len(self) // SAMPLE)):
            ends = self.ends.run(k).astype(np.int64)
            ids: list[int | None] = []
            for i in range(k * SAMPLE, k * SAMPLE + len(ends)):
                if i < nulls:
                    ids.append(None)
                    continue
                j = i - nulls
                if j // SAMPLE != known:
                    known = j // SAMPLE
                    names = (self.names.run(known).view(np.int64) + self.head["base"]).tolist()
                ids.append(names[j % SAMPLE])
            yield ids, np.concatenate([np.array([end], np.int64), ends])
            end = int(ends[-1])


def _writer(path: str, tokenizer: str, end_id: int) -> Callable:
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bpe_units.load(tokenizer)
        width, end = bpe.dtype.itemsize, np.array([end_id], bpe.dtype).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        lengths: list[int] = []
        held: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            at = f"{path}/part-{part:06d}-{seq:06d}.tok"
            write_whole(at, pack_file(names, lengths, held, width))
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((at, part, seq, len(names), total), schema, strict=True)], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = bpe.ids(text or "") + end
                k = len(data) // width
                if names and total + k > FILE_IDS:
                    yield close()
                    names, lengths, held, seq, total = [], [], [], seq + 1, 0
                names.append(doc_id)
                lengths.append(k)
                held.append(data)
                total += k
        if names:
            yield close()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f = TokenFile(path)
            ids: list[int | None] = []
            starts: list[np.ndarray] = []
            sizes: list[np.ndarray] = []
            sums: list[int] = []
            for some, at in f.runs():
                wide = f.ids[at[0] : at[-1]].astype("<u4")
                cut = (at - at[0]).tolist()
                ids += some
                starts.append(at[:-1] + base)
                sizes.append(np.diff(at))
                sums += [zlib.crc32(wide[s:e]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(np.concatenate(starts)), "n_tokens": pa.array(np.concatenate(sizes)), "ids_crc32": pa.array(sums, pa.int64())})


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs(doc_id, text) below path and returns the manifest with ``base``, the ids of all files before."""
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = source.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest, _ = materialize(spark, ranged.mapInArrow(_writer(path, tokenizer, end_id), MANIFEST), "token-manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, tasks: int) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    return manifest.select("path", "base").repartition(tasks, "path").mapInArrow(_reader, RESULT)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    return read_token_files(write_token_files(spark, docs, scratch_path(spark, "tokens"), tokenizer, end_id), partitions(spark))
