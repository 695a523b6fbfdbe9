"""Byte-level BPE ids of whole texts by the tokenizers library, with memory of the stretches between spaces.

The published pre-tokenizer never lets a token hold white space behind another character, nor a mark behind a letter or digit, so a text
may be cut there and its ids are those of the stretches one after the other. Each distinct stretch goes to the library once as long as it is remembered; the
memory is emptied when it reaches a fixed size. Stretches of plain Latin text are cut by the published pattern and given to the library's
model; all others, and texts that hold an added token's string, are encoded by the library as they are.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array

import numpy as np
import regex

# The published byte-level pattern, and the characters with the property White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Where a text may not simply be cut before each of " ", "\n", "." and ",": next to other white space, or after what is neither a letter nor a digit.
_NEAR = re.compile(f"[{WHITE}][ \\n.,]|[ \\n][{WHITE}]|[^0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f \\n][.,]|^[.,]|\x01")
_WORD = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
_STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_PLAIN = re.compile("[\t\n\r -~\xa1-\u024f]*")
# The same by kinds of UTF-8 bytes: s is " " or "\n", w other white space, p "." or ",", a part of a letter or digit of the plain Latin range, o other ASCII, x what only _NEAR can tell.
_KINDS = bytes(
    ord("s" if c in b" \n" else "w" if c in b"\t\x0b\x0c\r" else "p" if c in b".," else "x" if c == 1 or c == 0xC2 or c > 0xC8 else "a" if c > 0x7F or chr(c).isalnum() else "o") for c in range(256)
)
_UNCUT = (b"ss", b"sp", b"ws", b"wp", b"sw", b"op", b"pp")
_SIGNS = ("\xd7".encode(), "\xf7".encode())
#: Remembered stretches, and their most characters: longer ones are rare and would make the memory's size depend on the texts.
LIMIT, LONGEST = 300_000, 64


class Memo(dict):
    """A dictionary of bounded size that makes what it lacks: when it is full, what was not used since it last was full goes."""

    def __init__(self, make, limit: int = LIMIT) -> None:
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) > LONGEST:
            return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


    def lacking(self, keys: set) -> set:
        """Those of keys that are neither remembered nor were so lately."""
        return keys.difference(self).difference(self.old)

    def fill(self, keys: list, values: list) -> None:
        if len(self) + len(keys) > self.limit:
            self.old = dict(self)
            self.clear()
        self.update(zip(keys, values, strict=True))


class Merges:
    """Joins neighbouring symbols of many words at once: in each round the first pair of least rank in every word, until no word has a pair that joins."""

    NONE = 1 << 30

    def __init__(self, left: list[int], right: list[int], rank: list[int], made: list[int]) -> None:
        """Pairs of symbols, distinct, with their ranks and what they make; symbols are below 2^31."""
        keys = np.array(left, np.int64) << 31 | np.array(right, np.int64)
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], np.array(rank, np.int64)[order], np.array(made, np.int64)[order]

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 31 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE), self.made[at]

    def joined(self, symbols: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of words of n symbols each, at least one, and each word's number of these."""
        symbols, word = symbols.astype(np.int64), np.repeat(np.arange(len(n)), n)
        rank, made = (np.append(x, self.NONE) for x in self._found(symbols[:-1], symbols[1:]))
        rank[np.cumsum(n) - 1] = self.NONE
        done = []
        while len(word):
            heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), heads)
            going = best >> 32 < self.NONE
            at = best[going] & 0xFFFFFFFF
            symbols[at] = made[at]
            rank[at] = rank[at + 1]
            made[at] = made[at + 1]
            stays = np.repeat(going, np.diff(np.append(heads, len(word))))
            done.append((word[~stays], symbols[~stays]))
            stays[at + 1] = False
            at = (np.cumsum(stays) - 1)[at]
            word, symbols, rank, made = word[stays], symbols[stays], rank[stays], made[stays]
            # Both pairs of what was made.
            near = np.concatenate([at, at - 1])
            near = near[(near >= 0) & (near < len(word) - 1)]
            near = near[word[near] == word[near + 1]]
            rank[near], made[near] = self._found(symbols[near], symbols[near + 1])
        if not done:
            return symbols, np.zeros(0, np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(n))


def cut(packed: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Each word's bytes of an array that holds n entries of each."""
    raw, at = packed.tobytes(), (np.append(0, np.cumsum(n)) * packed.itemsize).tolist()
    return [raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def uncut(text: str) -> bool:
    """Whether a text may not simply be cut before each of " ", "\n", "." and ","."""
    raw = text.encode()
    kinds = raw.translate(_KINDS)
    if b"x" in kinds or any(x in raw for x in _SIGNS):
        return _NEAR.search(text) is not None
    return kinds[:1] == b"p" or any(x in kinds for x in _UNCUT)


class ByteBpe:
    """ids(text) as little-endian bytes of ``dtype``, equal to encode(text, add_special_tokens=False).ids."""

    def __init__(self, path: str, special: bool = True) -> None:
        """special: whether strings of added tokens in a text give their ids, as the library does by default."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        self.added = [t["content"] for t in spec.get("added_tokens", ()) if special]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        if sys.byteorder != "little":
            raise ValueError("ids are packed in the machine's order, which must be little-endian")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.pieces = regex.compile(PATTERN)
        alphabet = byte_alphabet()
        self.shown = {b: alphabet[b] for b in range(256)}
        self.memo = Memo(self._stretch)
        self.merges = None
        model, known = spec["model"], self.library.get_vocab()
        if model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")) and all(c in known for c in alphabet):
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            self.merges = Merges(*([known[p[k]] for p in pairs] for k in (0, 1)), list(range(len(pairs))), [known["".join(p)] for p in pairs])
            self.of_byte = np.array([known[c] for c in alphabet])

    def _words(self, words: list[str]) -> list[bytes]:
        """The same as _stretch of each word, which the published pattern leaves whole."""
        raw = [w.encode() for w in words]
        ids, n = self.merges.joined(self.of_byte[np.frombuffer(b"".join(raw), np.uint8)], np.array([len(x) for x in raw]))
        return cut(ids.astype(self.dtype), n)

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha() and piece.isascii():
            shown = piece
        elif piece[0] == " " and piece[1:].isalpha() and piece.isascii():
            shown = self.shown[32] + piece[1:]
        else:
            shown = "".join(map(self.shown.__getitem__, piece.encode()))
        return array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _stretch(self, s: str) -> bytes:
        if _WORD.fullmatch(s):
            return self._piece(s)
        if _PLAIN.fullmatch(s):
            return b"".join(map(self._piece, self.pieces.findall(s)))
        return self._pack(self.library.encode(s, add_special_tokens=False).ids)

    def _cut(self, text: str) -> list[str] | None:
        """The stretches of a text, none if it holds an added token's string."""
        if any(a in text for a in self.added):
            return None
        if uncut(text):
            return _STRETCH.findall(text)
        parts = text.replace(" ", "\x01 ").replace(".", "\x01.").replace(",", "\x01,").replace("\n", "\x01\n").split("\x01")
        return parts if parts[0] else parts[1:]

    def ids(self, text: str) -> bytes:
        return self._joined(text, self._cut(text))

    def _joined(self, text: str, parts: list[str] | None) -> bytes:
        return self._pack(self.library.encode(text, add_special_tokens=False).ids) if parts is None else b"".join(map(self.memo.__getitem__, parts))

    def all_ids(self, texts: list[str]) -> list[bytes]:
        """ids of each text; words that are not remembered are made together."""
        parts = [self._cut(t) for t in texts]
        if self.merges is not None:
            new = self.memo.lacking(set().union(*[p for p in parts if p]))
            if words := [w for w in new if len(w) <= LONGEST and _WORD.fullmatch(w)]:
                self.memo.fill(words, self._words(words))
        return [self._joined(t, p) for t, p in zip(texts, parts, strict=True)]


_loaded: dict[str, ByteBpe] = {}


def load(path: str) -> ByteBpe:
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]
