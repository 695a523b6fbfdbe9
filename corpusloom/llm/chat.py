"""Chat formatting at token level.

Every turn is assembled from segments that are encoded separately: ``[OPEN] role [NEXT] text [CLOSE]``, where the three are
reserved ids above the vocabulary, so no text can produce them. Rendered as text they read ``### ``, ``: `` and ``</turn>`` with a line break. Control strings inside
texts get one more backslash in front, whatever backslashes stand there already, which one backslash less undoes. The loss mask comes from prefix sums of the segments' lengths.

Texts are encoded where they lie; turns are then brought together per conversation in order and packed into pieces of whole turns,
of about ``PIECE`` ids, so that a conversation of any length passes through a task as a stream. Digests over a whole
conversation are sequential by nature: they are fed piece by piece.

Null text and null role are empty. Turns of one conversation are ordered by turn (nulls first), then by a digest of role and text. Rows
without a conv_id are one conversation. Repeated rows are turns of their own. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe_units import ByteBpe, byte_alphabet
from corpusloom.llm.runtime import materialize, partitions, ship

OPEN_TEXT, NEXT_TEXT, CLOSE_TEXT = "### ", ": ", "</turn>\n"
#: Ids in a piece before it is closed at the end of a turn.
PIECE = 1 << 16
_CONTROL = r"\\*(?:###|</turn>|<\|endoftext\|>)"
_CONTROL_IN_ROLE = rf"{_CONTROL}|\\*:"
TURNS = "conv_id long, turn long, role_len int, text_len int, loss boolean, ids binary, seat string"
PIECES = "conv_id long, piece int, start long, ids binary, mask binary"
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str, role: bool = False) -> str:
    return re.sub(_CONTROL_IN_ROLE if role else _CONTROL, lambda m: "\\" + m[0], text)


def unescape(text: str, role: bool = False) -> str:
    return re.sub(rf"\\(?={_CONTROL_IN_ROLE if role else _CONTROL})(\\*)([^\\])", r"\1\2", text)


class Codec:
    """Encoding of segments and, over the same vocabulary, decoding of ids to text."""

    def __init__(self, path: str) -> None:
        self.bpe = ByteBpe(path, special=False)
        size = self.bpe.library.get_vocab_size()
        self.open, self.next, self.close = size, size + 1, size + 2
        if self.close >= 1 << (8 * self.bpe.dtype.itemsize):
            raise ValueError("no room for reserved ids")
        byte_of = {c: b for b, c in enumerate(byte_alphabet())}
        self.text_of = [b""] * size
        added = set(self.bpe.library.get_added_tokens_decoder())
        for token, i in self.bpe.library.get_vocab().items():
            self.text_of[i] = token.encode() if i in added else bytes(byte_of[c] for c in token)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.text_of.__getitem__, ids.tolist())).decode("utf-8")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _encode(tokenizer: str, learn: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        width, code = c.bpe.dtype.itemsize, c.bpe.code
        first, then, last = (array(code, [i]).tobytes() for i in (c.open, c.next, c.close))
        for b in batches:
            out = []
            for conv, turn, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                role, text = role or "", text or ""
                r, t = c.bpe.ids(escape(role, True)), c.bpe.ids(escape(text))
                seat = hashlib.sha256(f"{role}\n{text}".encode()).hexdigest()
                out.append((conv, turn, len(r) // width, len(t) // width, role == learn, first + r + then + t + last, seat))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["conv_id", "turn", "role_len", "text_len", "loss", "ids", "seat"])

    return run


def _assemble(tokenizer: str) -> Callable:
    types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    names = ["conv_id", "piece", "start", "ids", "mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = codec(tokenizer).bpe.dtype.itemsize
        now, piece, start = object(), 0, 0
        ids: list[bytes] = []
        lengths: list[int] = []
        flags: list[bool] = []
        n = 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal piece, start, n
            if ids:
                ends = np.cumsum(lengths)
                # +1 where a learnt segment starts and -1 where it ends: the running sum is the mask.
                steps = np.zeros(n + 1, np.int8)
                learnt = np.flatnonzero(np.array(flags) & (np.array(lengths) > 0))
                steps[ends[learnt] - np.array(lengths)[learnt]] += 1
                steps[ends[learnt]] -= 1
                done.append((now, piece, start, b"".join(ids), np.packbits(np.cumsum(steps[:-1]).astype(bool)).tobytes()))
                piece, start, n = piece + 1, start + n, 0
                ids.clear()
                lengths.clear()
                flags.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(types)], names=names)
            done.clear()
            return batch

        for b in batches:
            for conv, role_len, text_len, loss, data in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role_len", "text_len", "loss", "ids")), strict=True):
                if conv != now:
                    close()
                    now, piece, start = conv, 0, 0
                elif n >= PIECE:
                    close()
                ids.append(data)
                lengths.extend((role_len + 2, text_len, 1))
                flags.extend((False, loss, False))
                n += len(data) // width
            yield out()
        close()
        yield out()

    return run


def _read_back(tokenizer: str) -> Callable:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        nothing = object()
        now = nothing
        turns = chars = loss_chars = 0
        whole, learnt = hashlib.sha256(), hashlib.sha256()
        for b in batches:
            done = []
            for conv, data, mask in zip(*(b.column(x).to_pylist() for x in ("conv_id", "ids", "mask")), strict=True):
                if conv != now or now is nothing:
                    if now is not nothing:
                        done.append((now, turns, whole.hexdigest(), loss_chars, learnt.hexdigest(), chars))
                    now, turns, chars, loss_chars, whole, learnt = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                ids = np.frombuffer(data, c.bpe.dtype)
                under = np.unpackbits(np.frombuffer(mask, np.uint8))[: len(ids)].astype(bool)
                opens, nexts, closes = (np.flatnonzero(ids == x).tolist() for x in (c.open, c.next, c.close))
                for o, m, e in zip(opens, nexts, closes, strict=True):
                    role, text = c.decode(ids[o + 1 : m]), c.decode(ids[m + 1 : e])
                    chars += len(OPEN_TEXT) + len(role) + len(NEXT_TEXT) + len(text) + len(CLOSE_TEXT)
                    whole.update(f"{unescape(role, True)}\n{unescape(text)}\n".encode())
                    turns += 1
                    if under[m + 1 : e].any():
                        said = unescape(c.decode(ids[m + 1 : e][under[m + 1 : e]]))
                        loss_chars += len(said)
                        learnt.update(said.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate(types)], names=names)
        if now is not nothing:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, turns, whole.hexdigest(), loss_chars, learnt.hexdigest(), chars), types, strict=True)], names=names)

    return run


def format_chats(spark: SparkSession, turns: DataFrame, tokenizer: str, learn: str = "assistant") -> DataFrame:
    """conv_id, piece, start, ids, mask (bits) of turns(conv_id, turn, role, text), as a table; start is the ids of the conversation before."""
    ship(spark)
    source = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    encoded = source.mapInArrow(_encode(tokenizer, learn), TURNS)
    ordered = encoded.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "seat")
    return materialize(spark, ordered.mapInArrow(_assemble(tokenizer), PIECES), "chats")[0]


def read_chats(spark: SparkSession, pieces: DataFrame, tokenizer: str) -> DataFrame:
    ordered = pieces.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "piece")
    return ordered.mapInArrow(_read_back(tokenizer), RESULT)


def chat_digests(spark: SparkSession, turns: DataFrame, tokenizer: str) -> DataFrame:
    return read_chats(spark, format_chats(spark, turns, tokenizer), tokenizer)
