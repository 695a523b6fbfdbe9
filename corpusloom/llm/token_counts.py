"""Token counts of a sentencepiece BPE model without making identifiers.

Symbols of a stretch form a linked list; a heap holds adjacent pairs whose joined string is a piece, best score and then leftmost first. Popping a
pair joins it and offers the new neighbours, until none is left: the count is the initial symbols less the merges, where a character that is no
piece counts its UTF-8 bytes if the model falls back to bytes, else runs of such characters count one.

No piece of such a model crosses the start of a word, nor any pair of neighbouring characters that occurs in no piece, so texts are cut there
and the counts of stretches are remembered, up to a fixed number. Null and empty texts have no tokens.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe_units import Memo
from corpusloom.llm.runtime import ship

SPACE = "▁"
RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
_RUNS = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")


class PieceCounter:
    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        plain = not norm.precompiled_charsmap and not norm.normalization_rule_tsv and not norm.remove_extra_whitespaces
        if train.model_type != 2 or not plain or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("a BPE model with identity normalisation, a dummy prefix and no user-defined or unused pieces is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score = {p.piece: p.score for p in spec.pieces if p.type == 1}
        self.bytes = train.byte_fallback
        self.pairs = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.by_word = not any(b == SPACE and a != SPACE for a, b in self.pairs)
        # What may not stand before a mark for the text to be cut there; no piece holds a line break.
        before = {a for a, b in self.pairs if b in ".,"}
        self.uncut = re.compile(f"[{re.escape(''.join(sorted(before | {' ', SPACE})))}][ .,{SPACE}]|^[ .,{SPACE}]|{SPACE}|\x01")
        self.lines = not any(c == "\n" for p in self.score for c in p)
        self.memo = Memo(self._stretch)

    def heap_count(self, symbols: str) -> int:
        """Tokens of a string in which spaces are already marked."""
        score, n = self.score, len(symbols)
        part = list(symbols)
        alone = [c not in score for c in part]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(-s, i, 2) for i in range(n - 1) if (s := score.get(symbols[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            j = right[i] if part[i] else n
            if j >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the two has been joined since
            part[i] += part[j]
            part[j] = ""
            merges += 1
            alone[i] = False
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (s := score.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (-s, i, size + len(part[k])))
            if (k := left[i]) >= 0 and (s := score.get(part[k] + part[i])) is not None:
                heapq.heappush(heap, (-s, k, size + len(part[k])))
        extra = 0
        if any(alone):
            strange = [part[i] if alone[i] and part[i] else "" for i in range(n) if part[i]]
            if self.bytes:
                extra = sum(len(c.encode()) - 1 for c in strange if c)
            else:
                extra = -sum(1 for a, b in zip(strange, strange[1:], strict=False) if a and b)
        return n - merges + extra

    def _stretch(self, s: str) -> int:
        s = s.replace(" ", SPACE)
        total, start, pairs = 0, 0, self.pairs
        for i in range(1, len(s)):
            if s[i - 1 : i + 1] not in pairs:
                total += self.heap_count(s[start:i]) if i - start > 1 else self.single(s[start])
                start = i
        return total + (self.heap_count(s[start:]) if len(s) - start > 1 else self.single(s[start:]))

    def single(self, c: str) -> int:
        return 1 if c in self.score else len(c.encode())

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word or not self.bytes or not self.lines:
            return self.heap_count(SPACE + text.replace(" ", SPACE))
        if self.uncut.search(text):
            return sum(map(self.memo.__getitem__, _RUNS.findall(" " + text)))
        cut = (" " + text).replace(" ", "\x01 ").replace(".", "\x01.").replace(",", "\x01,").replace("\n", "\x01\n").split("\x01")
        return sum(map(self.memo.__getitem__, cut[1:]))


_loaded: dict[str, PieceCounter] = {}


def load(path: str) -> PieceCounter:
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def _counts(model: str, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(model)
        for b in batches:
            text = b.column(1)
            n = np.array([counter.count(t) if t else 0 for t in text.to_pylist()], np.int64)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": size, "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return run


def token_counts(spark: SparkSession, docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text); other columns are ignored, repeated rows count each."""
    ship(spark)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_counts(model, limit), RESULT)
