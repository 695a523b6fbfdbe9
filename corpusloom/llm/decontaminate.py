"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all documents counts the passages of ``PASSAGE`` words that hold each hashed term (a fixed-size sum by a tree, which gives the inverse
   document frequencies).
2. Latent space: a single-pass randomised SVD of the TF-IDF matrix of all passages of all documents, of all passages of the benchmark and of its items' answers. A second pass over the texts
   multiplies each task's passages into A'(A G) for a seeded Gaussian G over ``SPACE_BITS`` hashed terms; the tree's sum, of fixed size whatever the input, gives singular values and right vectors in
   Nystroem form. ``RANK`` is far below the number of passages, so terms that occur together share directions.
3. Candidates: every whole document is searched by cosine in the latent space: windows of ``PASSAGE`` words against the item's passages and its answer, with a cut of ``COSINE``. Only
   windows that can still pass step 4 are projected: a stretch that passes holds ``LCS_LIKELY`` of an item's words, and the ``SKIP`` commonest of the item can stand for
   no more than their own number, so two neighbouring blocks hold a known number of its other words. This count rules out nothing that step 4 would find.
4. Checks: the longest common subsequence of words between the item and each stretch of 5/4 of its length, and the same of the item's answer (its last sentence). A document is
   contaminated by an item if ``LCS_SURE`` of the item's words are found in order, or ``LCS_LIKELY`` of them and ``ANSWER`` of the answer's, as in a paraphrase.

An item of fewer than ``MIN_WORDS`` words has nothing to paraphrase and occurs by chance in running text: it is found where all its words stand verbatim as a line or sentence of their own,
with or without a mark that ends it, in the item or in the text. All other marks are part of the words that they touch, here and in the common subsequences.
The benchmark is searched in blocks of about ``BLOCK_WORDS`` words, each a pass over the documents, whose hits or rows are written before the next block is broadcast, so that what is broadcast is bounded.

Null and empty texts and items match nothing. Repeated rows of documents give repeated results, repeated items one. ``contaminated`` ignores rows
without an id, ``uncontaminated`` judges them by their text. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusloom.llm import reduce
from corpusloom.llm.bytetext import chained, column_bytes, mix, slices, word_hashes, words
from corpusloom.llm.runtime import discard, materialize, ship, trim

#: Bits of a term's number where passages are counted, and in the latent space.
TERM_BITS, SPACE_BITS = 18, 15
#: Words in a passage; those of items overlap by half, a document's windows move by a third.
PASSAGE = 24
RANK, OVERSAMPLE, SEED = 64, 16, 11
#: Passages that are multiplied at once, those whose vectors are gathered at once, 1 MB, and tasks of that pass for each core, as each returns 10 MB.
AT_ONCE, GATHERED, TASKS = 4096, 128, 4
#: Least cosine of a candidate; it decides alone what is checked, so it is low: the README has its recall.
COSINE = 0.15
#: Words of the benchmark in a block, and items counted at once.
BLOCK_WORDS, GRID = 1_000_000, 1024
#: At most this share of an item's words, the commonest in the documents, are not counted when blocks are ruled out; below LCS_LIKELY.
SKIP = 0.25
MIN_WORDS = 6
LCS_SURE, LCS_LIKELY, ANSWER = 0.75, 0.55, 0.6
#: Bytes that end a sentence.
STOPS = b".?!:;"
MASKS_KEPT = 4096
RESULT = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, latent_cosine double"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, term numbers and each row's first word. Marks at the ends of words are part of them."""
    starts, ends, at = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    return h, (h >> np.uint64(64 - TERM_BITS)).astype(np.int64), at


def _rows(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    raw, offs = column_bytes(batch.column(text))
    for i, j in slices(offs):
        o = offs[i : j + 1]
        yield (i, *_terms(raw[o[0] : o[-1]], o - o[0]))


def _spans(at: np.ndarray, length: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of windows of ``length`` words moved by ``step`` over each row; the last one ends with the row."""
    n = np.diff(at)
    k = np.where(n > 0, np.maximum(0, -(-(n - length) // step)) + 1, 0)
    row = np.repeat(np.arange(len(n)), k)
    place = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    start = np.minimum(place * step, np.maximum(0, n[row] - length))
    return row, at[:-1][row] + start, at[:-1][row] + np.minimum(start + length, n[row])


def _packed_rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages that hold each term, and in one more entry all passages."""
    df = np.zeros((1 << TERM_BITS) + 1, np.uint32)
    part = TaskContext.get().partitionId()
    for b in batches:
        for _, _, term, at in _rows(b, 0):
            row, start, _ = _spans(at, PASSAGE, PASSAGE)
            if len(row):
                # Passages of a row may overlap at its end only; each word counts for the last one that holds it.
                order, new = _sorted(_padded(term, start, np.append(start[1:], len(term))))
                df[: 1 << TERM_BITS] += np.bincount(order[new & (order >= 0)], minlength=1 << TERM_BITS).astype(np.uint32)
                df[-1] += len(row)
    yield _packed_rows(reduce.packed(df, part))
    trim()


def _padded(term: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A row of PASSAGE terms for each span, padded with -1."""
    place = start[:, None] + np.arange(PASSAGE)
    return np.where(place < end[:, None], term[np.minimum(place, len(term) - 1)], -1).astype(np.int32)


def _sorted(passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's terms in order, and where one differs from that before it."""
    order = np.sort(passages, axis=1)
    new = np.ones(order.shape, bool)
    new[:, 1:] = order[:, 1:] != order[:, :-1]
    return order, new


def _inverse(df: np.ndarray) -> np.ndarray:
    return (np.log((1 + float(df[-1])) / (1 + df[:-1].astype(np.float64))) + 1).astype(np.float32)


def _weighed(passages: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in the latent space and weights of the words of passages (rows of terms, padded with -1), scaled to unit TF-IDF vectors.

    Each word's weight adds up at its term, so a term's entry is its count times its inverse document frequency.
    """
    w = np.where(passages >= 0, idf[passages], np.float32(0))
    order, new = _sorted(passages)
    real = order >= 0
    run = np.cumsum(new.ravel()) - 1
    times = np.bincount(run, weights=real.ravel())
    heads = (new & real).ravel()
    square = np.zeros(heads.shape)
    square[heads] = (times[run[heads]] * idf[order.ravel()[heads]]) ** 2
    norm = np.sqrt(square.reshape(order.shape).sum(axis=1, keepdims=True))
    return np.maximum(passages, 0) >> (TERM_BITS - SPACE_BITS), (w / np.maximum(norm, 1e-12)).astype(np.float32)


def _projected(passages: np.ndarray, idf: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Unit vectors of passages in the latent space; zero where nothing is left of one."""
    term, w = _weighed(passages, idf)
    x = np.einsum("ij,ijk->ik", w, vectors[term])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(n > 1e-6, x / np.maximum(n, 1e-6), 0).astype(np.float32)


def _gaussian() -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((1 << SPACE_BITS, RANK + OVERSAMPLE), np.float32)


def _multiplied(passages: np.ndarray, idf: np.ndarray, test: np.ndarray, y: np.ndarray) -> None:
    """Adds A'(A G) of some passages (rows of terms, padded with -1) to y."""
    term, w = _weighed(passages, idf)
    x = np.empty((len(term), test.shape[1]), np.float32)
    for lo in range(0, len(term), GATHERED):
        np.einsum("ij,ijk->ik", w[lo : lo + GATHERED], test[term[lo : lo + GATHERED]], out=x[lo : lo + GATHERED])
    # What a term gets is summed over its occurrences first: in runs of lengths that are powers of two, all of one length together, as the bits of its number of occurrences say.
    held = np.flatnonzero(w.ravel())
    held = held[np.argsort(term.ravel()[held], kind="stable")]
    some, weight, row = term.ravel()[held], w.ravel()[held], held // term.shape[1]
    heads = np.flatnonzero(np.append(True, some[1:] != some[:-1])) if len(held) else held
    n = np.diff(np.append(heads, len(held)))
    for k in range(int(n.max(initial=0)).bit_length()):
        size = 1 << k
        has = np.flatnonzero(n >> k & 1)
        first, step = heads[has] + (n[has] & (size - 1)), max(1, GATHERED * PASSAGE // size)
        for lo in range(0, len(has), step):
            at = first[lo : lo + step, None] + np.arange(size)
            y[some[at[:, 0]]] += np.einsum("ij,ijk->ik", weight[at], x[row[at]])


def _gathered(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The same passages, ``AT_ONCE`` in each array but the last."""
    kept, n = [], 0
    for part in parts:
        while n + len(part) >= AT_ONCE:
            yield np.concatenate([*kept, part[: AT_ONCE - n]])
            part, kept, n = part[AT_ONCE - n :], [], 0
        kept.append(part)
        n += len(part)
    if n:
        yield np.concatenate(kept)


def _range_finder(idf_bytes, found: Callable) -> Callable:
    """A'(A G) of a task's passages; ``found`` gives those of a batch, a part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, test = np.frombuffer(idf_bytes.value, np.float32), _gaussian()
        y = np.zeros_like(test)
        for passages in _gathered(part for b in batches for part in found(b)):
            _multiplied(passages, idf, test, y)
        yield _packed_rows(reduce.packed(y, TaskContext.get().partitionId()))
        trim()

    return run


def _text_passages(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """All passages of the texts."""
    for _, _, term, at in _rows(batch, 0):
        _, start, end = _spans(at, PASSAGE, PASSAGE)
        for lo in range(0, len(start), AT_ONCE):
            yield _padded(term, start[lo : lo + AT_ONCE], end[lo : lo + AT_ONCE])


def _item_passages(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    yield item_passages(batch.column(0).to_pylist())[1]


def item_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Item of each passage and its terms: an item's overlapping passages, then its answer's."""
    owner, rows = [], []
    for some, step in ((texts, PASSAGE // 2), ([answer_of(t) for t in texts], PASSAGE)):
        raw, offs = column_bytes(pa.array(some, pa.string()))
        _, term, at = _terms(raw, offs)
        row, start, end = _spans(at, PASSAGE, step)
        if len(row):
            owner.append(row)
            rows.append(_padded(term, start, end))
    return (np.concatenate(owner), np.concatenate(rows)) if rows else (np.zeros(0, np.int64), np.zeros((0, PASSAGE), np.int32))


def latent_space(texts: DataFrame, items: DataFrame, idf_bytes) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (terms, RANK) and singular values of all passages of texts(text) and of items(text).

    A task returns an array of fixed size, so texts are read by some tasks for each core, not by more the more there are.
    """
    spark = texts.sparkSession
    texts = texts.coalesce(TASKS * spark.sparkContext.defaultParallelism)
    sums = texts.mapInArrow(_range_finder(idf_bytes, _text_passages), reduce.SCHEMA).union(items.mapInArrow(_range_finder(idf_bytes, _item_passages), reduce.SCHEMA))
    test = _gaussian()
    y = reduce.total(sums, test.size, "float32").reshape(test.shape)
    # A'A is about Y (G'Y)^-1 Y'. With a small shift for stability that is X X' for X = Y L^-T and G'Y = L L'; X'X, of the width of G, has the same eigenvalues.
    shift = np.float32(1e-6 * max(float(np.linalg.norm(y)), 1e-12) / np.sqrt(len(y)))
    y += shift * test
    core = (test.T @ y).astype(np.float64)
    root = np.linalg.cholesky((core + core.T) / 2 + (1e-6 * np.trace(core) / len(core) + 1e-12) * np.eye(len(core)))
    x = y @ np.linalg.inv(root).T.astype(np.float32)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    values, vectors = np.maximum(values[::-1][:RANK], 0), vectors[:, ::-1][:, :RANK]
    scale = np.where(values > 1e-9 * max(float(values[0]), 1e-12), 1 / np.sqrt(np.maximum(values, 1e-30)), 0)
    return (x @ (vectors * scale).astype(np.float32)), np.sqrt(values)


def _masks(a: list[int]) -> dict[int, int]:
    """Places of each word of a, as bits."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    return masks


def _common(n: int, columns: list[int]) -> int:
    """Length of the longest common subsequence of n words and those whose masks are given."""
    full = (1 << n) - 1
    v = full
    for m in columns:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a column of b at a time in the bits of one integer."""
    masks = _masks(a)
    return _common(len(a), [masks[y] for y in b if y in masks])


def answer_of(text: str) -> str:
    """The last sentence of an item, or its last quarter if it has one sentence only."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    if len(parts) > 1:
        return parts[-1]
    w = text.split()
    return " ".join(w[-max(1, len(w) // 4) :])


def _hashes(texts: list[str]) -> list[np.ndarray]:
    raw, offs = column_bytes(pa.array(texts, pa.string()))
    h, _, at = _terms(raw, offs)
    return [h[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _unmarked(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words without the marks that end a sentence behind them; of a word of such marks only, the first stays."""
    ends = ends.copy()
    stop = np.isin(np.arange(256), list(STOPS))
    while len(some := np.flatnonzero(stop[raw[ends - 1]] & (ends - starts > 1))):
        ends[some] -= 1
    return word_hashes(raw, starts, ends)


def _runs(h: np.ndarray, unmarked: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, the last of each without its marks."""
    return unmarked if n == 1 else mix(chained(h, n - 1)[: max(0, len(h) - n + 1)] ^ mix(unmarked[n - 1 :]))


class Searcher:
    """Candidates and checks against one block of items."""

    def __init__(self, items: list[tuple[int, str]], idf: np.ndarray, vectors: np.ndarray) -> None:
        self.idf, self.vectors = idf, vectors
        hashes = _hashes([t for _, t in items])
        full = [k for k, h in enumerate(hashes) if len(h) >= MIN_WORDS]
        self.ids, texts = [items[k][0] for k in full], [items[k][1] for k in full]
        self.words, self.answers = [hashes[k] for k in full], _hashes([answer_of(t) for t in texts])
        self.kept: dict[int, tuple[dict[int, int], dict[int, int]]] = {}
        owner, rows = item_passages(texts)
        order = np.argsort(owner, kind="stable")
        self.passages = rows[order]
        self.queries = _projected(self.passages, idf, vectors)
        self.query_at = np.searchsorted(owner[order], np.arange(len(full) + 1))
        # Short items by length: sorted hashes of all their words, and the items.
        self.short = []
        raw, offs = column_bytes(pa.array([t for _, t in items], pa.string()))
        starts, ends, at = words(raw, offs)
        whole = _unmarked(raw, starts, ends)
        for n in range(1, MIN_WORDS):
            if some := [(int(_runs(h, whole[at[k] : at[k + 1]], n)[0]), items[k][0]) for k, h in enumerate(hashes) if len(h) == n]:
                some.sort()
                self.short.append((n, np.array([x for x, _ in some], np.uint64), [i for _, i in some]))
        sets: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        for i, h in enumerate(self.words):
            n = len(h)
            t, k = np.unique((h >> np.uint64(64 - TERM_BITS)).astype(np.int64), return_counts=True)
            order = np.argsort(idf[t], kind="stable")
            skipped = np.cumsum(k[order])
            common = int(np.searchsorted(skipped, SKIP * n, "right"))
            need = math.ceil(LCS_LIKELY * n - 1e-9) - (int(skipped[common - 1]) if common else 0)
            sets.setdefault(max(32, 1 << (self._span(n) - 1).bit_length()), []).append((i, need, t[order[common:]]))
        # By length of block, a power of two that no item's span exceeds: items, counts needed, and the items that hold each term.
        self.grids = []
        for length, every in sorted(sets.items()):
            for lo in range(0, len(every), GRID):
                members = every[lo : lo + GRID]
                terms, holders = np.concatenate([t for _, _, t in members]), np.repeat(np.arange(len(members)), [len(t) for _, _, t in members])
                order = np.argsort(terms, kind="stable")
                first = np.searchsorted(terms[order], np.arange((1 << TERM_BITS) + 1)).astype(np.int32)
                self.grids.append((length, [i for i, _, _ in members], np.array([n for _, n, _ in members]), holders[order], first, np.diff(first)))

    def masks(self, item: int) -> tuple[dict[int, int], dict[int, int]]:
        """Places of the item's and of its answer's words, as bits."""
        if item not in self.kept:
            if len(self.kept) >= MASKS_KEPT:
                self.kept.clear()
            self.kept[item] = (_masks(self.words[item].tolist()), _masks(self.answers[item].tolist()))
        return self.kept[item]

    @staticmethod
    def _span(n: int) -> int:
        """Words of a stretch that may hold an item of n words."""
        return n + n // 4 + 1

    def possible(self, term: np.ndarray, at: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """Stretches by (row, item): every span of an item's length that could pass lies in one of them."""
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for length, members, need, holders, first, times in self.grids:
            place = np.flatnonzero(times[term])
            t = term[place]
            n = times[t]
            total = int(n.sum())
            if not total:
                continue
            holder = holders[np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(total)]
            blocks, m = -(-len(term) // length) + 1, len(members)
            count = np.bincount(np.repeat(place // length * m, n) + holder, minlength=blocks * m).reshape(blocks, m)
            for block, k in np.argwhere(count[:-1] + count[1:] >= need).tolist():
                a, b = block * length, min((block + 2) * length, len(term))
                row = int(np.searchsorted(at, a, "right")) - 1
                while row < len(at) - 1 and at[row] < b:
                    s, e = max(a, int(at[row])), min(b, int(at[row + 1]))
                    if e - s >= need[k]:
                        found.setdefault((row, members[k]), []).append((s, e))
                    row += 1
        return found

    def check(self, h: np.ndarray, item: int, stretches: list[tuple[int, int]]) -> tuple[float, float, int, int] | None:
        """Shares of the item's and of its answer's words in order, and begin and end, of the span that holds most of it and passes; none if none passes."""
        (masks, answer), n, n_answer = self.masks(item), len(self.words[item]), max(1, len(self.answers[item]))
        span, step = self._span(n), max(1, n // 4)
        best = None
        for s, e in stretches:
            near = h[s:e].tolist()
            columns = [masks.get(x, 0) for x in near]
            if _common(n, [m for m in columns if m]) / n < LCS_LIKELY:
                continue
            last = max(0, len(near) - span)
            coarse = [*range(0, last, step), last]
            # Every span is tried where the coarse ones do not pass.
            for starts in (coarse, sorted(set(range(last + 1)).difference(coarse))):
                passed = False
                for o in starts:
                    share = _common(n, [m for m in columns[o : o + span] if m]) / n
                    if share < LCS_LIKELY:
                        continue
                    part = _common(len(self.answers[item]), [answer[x] for x in near[o : o + span] if x in answer]) / n_answer
                    if share >= LCS_SURE or part >= ANSWER:
                        passed = True
                        if best is None or (share, part) > best[:2]:
                            best = (share, part, s + o, min(s + o + span, e))
                if passed:
                    break
        return best

    def _windows(self, term: np.ndarray) -> np.ndarray:
        _, start, end = _spans(np.array([0, len(term)]), PASSAGE, PASSAGE // 3)
        return _padded(term, start, end)

    def latent_cosines(self, term: np.ndarray, stretches: list[tuple[int, int, int]]) -> list[float]:
        """Of each (begin, end, item): the best cosine, in the latent space, of a window of its words with a passage or the answer of the item."""
        out: list[float] = []
        for lo in range(0, len(stretches), 128):
            some = stretches[lo : lo + 128]
            begin, end = (np.array(x, np.int64) for x in list(zip(*some, strict=True))[:2])
            n = np.maximum(0, -(-(end - begin - PASSAGE) // (PASSAGE // 3))) + 1
            place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            last = np.repeat(end, n)
            start = np.minimum(np.repeat(begin, n) + place * (PASSAGE // 3), np.maximum(np.repeat(begin, n), last - PASSAGE))
            windows = _projected(_padded(term, start, np.minimum(start + PASSAGE, last)), self.idf, self.vectors)
            cut = np.append(0, np.cumsum(n)).tolist()
            for (_, _, item), a, b in zip(some, cut[:-1], cut[1:], strict=True):
                out.append(float((windows[a:b] @ self.queries[self.query_at[item] : self.query_at[item + 1]].T).max(initial=0.0)))
        return out

    def cosine(self, term: np.ndarray, item: int) -> float:
        """The same of the TF-IDF vectors themselves, without the answer; it is reported and decides nothing."""
        lo, hi = int(self.query_at[item]), int(self.query_at[item + 1])
        answers = len(_spans(np.array([0, len(self.answers[item])]), PASSAGE, PASSAGE)[0])
        a, b = self._windows(term), self.passages[lo : hi - answers]
        (_, x), (_, y) = _weighed(a, self.idf), _weighed(b, self.idf)
        best = 0.0
        for p, w in zip(b, y, strict=True):
            same = (a[:, :, None] == p) & (p >= 0)
            best = max(best, float(np.einsum("ij,ijk,k->i", x, same.astype(np.float32), w).max(initial=0.0)))
        return min(1.0, best)

    def verbatim(self, h: np.ndarray, at: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, item) for each short item whose words stand as a line or sentence of their own; each once a row."""
        if not self.short:
            return
        seen = set()
        starts, ends, _ = words(raw, offsets)
        unmarked = _unmarked(raw, starts, ends)
        for n, known, ids in self.short:
            runs = _runs(h, unmarked, n)
            for k in np.flatnonzero(np.isin(runs, known)).tolist():
                row = int(np.searchsorted(at, k, "right")) - 1
                if k + n > at[row + 1]:
                    continue
                before = raw[ends[k - 1] - 1 : starts[k]].tobytes() if k > at[row] else b"\n"
                after = raw[ends[k + n - 1] - 1 : starts[k + n]].tobytes() if k + n < at[row + 1] else b"\n"
                if (before[0] in STOPS or b"\n" in before) and (after[0] in STOPS or b"\n" in after):
                    a, b = np.searchsorted(known, runs[k], "left"), np.searchsorted(known, runs[k], "right")
                    for i in ids[a:b]:
                        if (row, i) not in seen:
                            seen.add((row, i))
                            yield row, i

    def hits(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(row, item_id, cosine, lcs_share, answer_share, latent_cosine) for each item found in a text."""
        raw, offs = column_bytes(texts)
        for i, j in slices(offs):
            o = offs[i : j + 1]
            part = raw[o[0] : o[-1]]
            h, term, at = _terms(part, o - o[0])
            possible = [(row, item, s, e) for (row, item), stretches in self.possible(term, at).items() for s, e in stretches]
            near: dict[tuple[int, int], list[tuple[float, int, int]]] = {}
            for (row, item, s, e), c in zip(possible, self.latent_cosines(term, [(s, e, item) for _, item, s, e in possible]), strict=True):
                if c >= COSINE:
                    near.setdefault((row, item), []).append((c, s, e))
            for (row, item), candidates in near.items():
                if hit := self.check(h, item, [(s, e) for _, s, e in candidates]):
                    share, answer, s, e = hit
                    yield i + row, self.ids[item], self.cosine(term[s:e], item), share, answer, max(c for c, _, _ in candidates)
            for row, item_id in self.verbatim(h, at, part, o - o[0]):
                yield i + row, item_id, 1.0, 1.0, 1.0, 1.0


def _search(space, block, keep: int | None = None) -> Callable:
    """The hits in column 1 by the ids in column 0; with ``keep``, the rows whose text, in that column, has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, vectors = space.value
        searcher = Searcher(block.value, np.frombuffer(idf, np.float32), vectors)
        for b in batches:
            if keep is not None:
                clean = np.ones(b.num_rows, bool)
                clean[[r[0] for r in searcher.hits(b.column(keep))]] = False
                yield b.filter(pa.array(clean))
                continue
            ids = b.column(0).to_pylist()
            out = [(ids[r], *rest) for r, *rest in searcher.hits(b.column(1)) if ids[r] is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k < 2 else pa.float64()) for k in range(6)], names=NAMES)
        trim()

    return run


def _blocks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> Iterator:
    """Broadcasts of the latent space, which is the same each time, and of each block of the benchmark's items, with whether it is the last; a block is freed when the next is asked for."""
    items, items_at = materialize(spark, benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and length(text) > 0").distinct(), "items")
    texts = docs.select(F.col("text").cast("string"))
    idf = _inverse(reduce.total(texts.mapInArrow(_document_frequencies, reduce.SCHEMA), (1 << TERM_BITS) + 1))
    idf_bytes = spark.sparkContext.broadcast(idf.tobytes())
    vectors, _ = latent_space(texts, items.select("text"), idf_bytes)
    idf_bytes.unpersist()
    space = spark.sparkContext.broadcast((idf.tobytes(), vectors))
    size = items.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_WORDS))
    held = None
    for k in range(blocks):
        # One block of the benchmark.
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).sort("item_id", "text").collect()]
        if held is not None:
            held.unpersist()
        held = spark.sparkContext.broadcast(rows)
        yield space, held, k == blocks - 1
    discard(spark, items_at)
    trim()


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, latent_cosine for each document of docs(doc_id, text) and item of benchmark(item_id, text) found in it."""
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    result = spark.createDataFrame([], RESULT)
    for space, block, _ in _blocks(spark, source, benchmark):
        result = result.union(materialize(spark, source.mapInArrow(_search(space, block), RESULT), "contaminated")[0])
    return result


def uncontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all its columns, whose ``text`` holds no item of benchmark; decided row by row where the text is read. Rows that pass a block are written for the next one; those of the last are not."""
    ship(spark)
    before, schema, text = None, docs.schema, docs.columns.index("text")
    for space, block, last in _blocks(spark, docs, benchmark):
        docs = docs.mapInArrow(_search(space, block, text), schema)
        if not last:
            docs, at = materialize(spark, docs, "uncontaminated")
            if before:
                discard(spark, before)
            before = at
    return docs
