"""SentencePiece segmentations drawn without replacement, by Gumbel top-k search over the lattice, and their decoding.

The lattice of a text has its characters' boundaries as nodes and its pieces as edges; a character that is no piece has an edge of its bytes. Model scores of a BPE
vocabulary are ranks, so an edge weighs ``1 / (rank + RANK_SHIFT)`` to the power ``ALPHA``, and a segmentation's probability is in proportion to the product of its edges'.
No piece crosses the start of a word, so the lattice is a chain of word lattices, which are built once per distinct word of a slice of documents, for all at once.

Search is A* with perturbed bounds. A state is a set of segmentations: a common prefix and, at the next node, all edges but some; its bound is a Gumbel variable located at the
set's log probability. Opening the best state draws its best segmentation edge by edge, which keeps the bound as its value, and leaves along the path one state for
each edge not taken, with a Gumbel bound truncated at that value. The first k values are k distinct segmentations without replacement; the next bound
is the threshold of their inclusion probabilities, 1 - exp(-exp(logp - threshold)).

All draws come from a hash of doc_id, sample, word and step: a row's samples do not depend on other rows or on partitioning. Rows without a doc_id draw like doc_id 0.
Null and empty texts have one segmentation, of no pieces. The model's mark for a space, where it stands in a text, counts as a space. A text of fewer than k segmentations gives all of them. Repeated rows give equal results. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bytetext import mix
from corpusloom.llm.runtime import ship, trim
from corpusloom.llm.token_counts import SPACE, PieceCounter

ALPHA, RANK_SHIFT = 1.0, 8.0
SLICE_CHARS = 1 << 18
TABLE_BITS = 18
_WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = [np.uint64(x) for x in (0xD1342543DE82EF95, 0xA24BAED4963EE407, 0xAF251AF3B0F025B5)]
RESULT = "doc_id long, ids array<binary>, log_prob array<double>, perturbed array<double>, log_inclusion array<double>, decoded boolean"


def uniform(seed: np.ndarray, sample: int, word: np.ndarray, step: int | np.ndarray, use: int) -> np.ndarray:
    """Numbers in (0, 1) from a hash."""
    with np.errstate(over="ignore"):
        x = seed + _SPREAD[0] * np.uint64(2 * sample + use + 1) + _SPREAD[1] * word.astype(np.uint64) + _SPREAD[2] * np.asarray(step).astype(np.uint64)
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Vocabulary:
    """Pieces in a trie of characters, whose steps are a hash table with chains, so that many nodes step at once."""

    def __init__(self, path: str) -> None:
        counter = PieceCounter(path)
        if not counter.by_word or not counter.bytes:
            raise ValueError("pieces that cross words, or a model without byte pieces, are not supported")
        self.library = counter.library
        pieces = {p: (i, s) for p, s in counter.score.items() if (i := self.library.piece_to_id(p)) >= 0}
        if self.library.get_piece_size() > 1 << 16:
            raise ValueError("ids are packed in 16 bits")
        self.text_of = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.byte_id = np.array([self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint16)
        # Bytes that each id stands for, end to end.
        byte = {int(i): bytes([b]) for b, i in enumerate(self.byte_id)}
        stands = [byte.get(i, t.encode()) for i, t in enumerate(self.text_of)]
        self.text_bytes = np.frombuffer(b"".join(stands), np.uint8)
        self.text_size = np.array([len(x) for x in stands], np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        order = {p: r for r, (p, _) in enumerate(sorted(pieces.items(), key=lambda x: -x[1][1]))}
        self.weight = np.zeros(self.library.get_piece_size())
        # A state is the number of the step into it; state -1 is the root, and the last entry of steps matches nothing.
        number = {c: k for k, c in enumerate(sorted({c for p in pieces for c in p}), 1)}
        states: dict[int, int] = {}
        piece_of: list[int] = []
        for p, (i, _) in pieces.items():
            self.weight[i] = -ALPHA * np.log(order[p] + RANK_SHIFT)
            state = -1
            for c in p:
                key = ((state + 1) << 16) | number[c]
                if (to := states.get(key)) is None:
                    to = states[key] = len(piece_of)
                    piece_of.append(-1)
                state = to
            piece_of[state] = i
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in number]] = list(number.values())
        self.piece_of = np.array(piece_of, np.int32)
        self.root = np.full(len(number) + 1, -1, np.int32)
        for c, k in number.items():
            self.root[k] = states[k]
        self.steps = np.array([*states, -1], np.int64).view(np.uint64)
        self.head = np.full(1 << TABLE_BITS, -1, np.int32)
        self.next = np.full(len(states) + 1, -1, np.int32)
        for k, slot in enumerate(((self.steps[:-1] * _STEP) >> np.uint64(64 - TABLE_BITS)).tolist()):
            self.next[k], self.head[slot] = self.head[slot], k
        self.longest = max(map(len, pieces))
        self.byte_weight = -ALPHA * np.log(len(order) + RANK_SHIFT)

    def step(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have a step by their character, and the states it leads to."""
        key = ((state + np.int32(1)).astype(np.uint64) << np.uint64(16)) | char
        to = self.head[(key * _STEP) >> np.uint64(64 - TABLE_BITS)]
        live = np.flatnonzero(to >= 0)
        to, key = to[live], key[live]
        wrong = np.flatnonzero(self.steps[to] != key)
        while len(wrong):
            to[wrong] = self.next[to[wrong]]
            wrong = wrong[(to[wrong] >= 0) & (self.steps[to[wrong]] != key[wrong])]
        known = to >= 0
        return live[known], to[known]


class Lattice:
    """The word lattices of distinct words, in flat arrays: node = character, each word with one more node for its end. A node's edges are neighbours, the longest first."""

    def __init__(self, v: Vocabulary, words: list[str]) -> None:
        size = np.array(list(map(len, words)), np.int64)
        self.start = np.cumsum(size + 1) - size - 1
        nodes = int((size + 1).sum())
        code = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le"), np.uint32)
        left = (np.repeat(self.start + size, size + 1) - np.arange(nodes)).astype(np.int32)
        self.is_end = left == 0
        char = v.number[code]
        degree = np.zeros(nodes, np.int8)
        # Edges of a length have ascending sources, so an edge's seat at its node is the number of shorter ones.
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        alive = np.flatnonzero(~self.is_end).astype(np.int32)
        state = alive
        for length in range(v.longest):
            if length:
                fits = left[alive] > length
                alive, state = alive[fits], state[fits]
            if not len(alive):
                break
            if length:
                keep, state = v.step(state, char[alive + np.int32(length)])
            else:
                state = v.root[char[alive]]
                keep = np.flatnonzero(state >= 0)
                state = state[keep]
                single = np.zeros(len(alive), bool)
                single[keep[v.piece_of[state] >= 0]] = True
                odd = alive[~single]
                found.append((odd, np.full(len(odd), -1, np.int32), degree[odd]))
                degree[odd] += 1
            alive = alive[keep]
            piece = v.piece_of[state]
            whole = piece >= 0
            at = alive[whole]
            found.append((at, piece[whole], degree[at]))
            degree[at] += 1
        self.first = np.zeros(nodes + 1, np.int32)
        np.cumsum(degree, out=self.first[1:])
        edges = int(self.first[-1])
        self.source, self.target, self.piece = (np.empty(edges, np.int32) for _ in range(3))
        for k, (at, piece, seat) in enumerate(found):
            spot = self.first[at + 1] - 1 - seat
            self.source[spot], self.target[spot], self.piece[spot] = at, at + np.int32(max(k, 1)), piece
        self.code = code
        size_of = 1 + (code > 0x7F).astype(np.int8) + (code > 0x7FF) + (code > 0xFFFF)
        weight = v.weight[self.piece]
        odd = np.flatnonzero(self.piece < 0)
        weight[odd] = v.byte_weight * size_of[self.source[odd]]
        # Log sums of all ways to each word's end, by distance from it.
        ahead = np.zeros(nodes)
        distance = left[self.source]
        by = np.argsort(distance.astype(np.uint16) if int(left.max(initial=0)) < 1 << 16 else distance, kind="stable")
        cuts = np.cumsum(np.bincount(distance, minlength=1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            e = by[a:b]
            x, s = weight[e] + ahead[self.target[e]], self.source[e]
            first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            top = np.maximum.reduceat(x, first)
            ahead[s[first]] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(first, len(x))))), first))
        self.p = np.exp(weight + ahead[self.target] - ahead[self.source])
        run = np.cumsum(self.p)
        base = np.concatenate([np.zeros(1), run])[self.first[:-1]]
        self.upto = run - base[self.source]
        self.upto[self.first[1:][degree > 0] - 1] = np.inf

    def log_rest(self, edge: np.ndarray) -> np.ndarray:
        """Log probabilities of a node's other edges."""
        with np.errstate(divide="ignore"):
            out = np.log1p(-np.minimum(self.p[edge], 1.0))
        node = self.source[edge]
        out[self.first[node + 1] - self.first[node] == 1] = -np.inf
        return out

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, by probability."""
        edge = self.first[node]
        over = np.flatnonzero(u >= self.upto[edge])
        while len(over):
            edge[over] += 1
            over = over[u[over] >= self.upto[edge[over]]]
        return edge

    def walk(self, word: np.ndarray, node: np.ndarray, step: np.ndarray, seed: np.ndarray, index: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Edges from each node to its word's end, one walker after the other, and the number of each."""
        who = np.flatnonzero(~self.is_end[node])
        taken, owners, k = [], [], 0
        node = node.copy()
        while len(who):
            e = self.draw(node[who], uniform(seed[who], sample, index[who], step[who] + k, 0))
            taken.append(e)
            owners.append(who)
            node[who] = self.target[e]
            who = who[~self.is_end[node[who]]]
            k += 1
        count = np.bincount(np.concatenate(owners), minlength=len(word)) if owners else np.zeros(len(word), np.int64)
        offset = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for k, (e, o) in enumerate(zip(taken, owners, strict=True)):
            out[offset[o] + k] = e
        return out, count


def _truncated(location: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variables at location, given that they are at most ``most``."""
    return location - np.log(np.exp(np.minimum(location - most, 700.0)) - np.log(u))


class Path:
    """Samples of all documents of a slice: edges, with the word and the step within it of each."""

    def __init__(self, edge: np.ndarray, word: np.ndarray, step: np.ndarray, cut: np.ndarray) -> None:
        self.edge, self.word, self.step, self.cut = edge, word, step, cut


def _ramp(count: np.ndarray) -> np.ndarray:
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


class _Numbers(dict):
    """Numbers of words in the order of their first use."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def sample_slice(v: Vocabulary, texts: list[str], seeds: list[int], k: int) -> list[tuple[list[bytes], list[float], list[float], list[float]]]:
    """For each non-empty text: ids, log probabilities, perturbed values and log inclusion probabilities of at most k segmentations."""
    number = _Numbers()
    inst: list[int] = []
    counts = []
    for t in texts:
        found = _WORDS.findall(SPACE + t.replace(" ", SPACE))
        inst += map(number.__getitem__, found)
        counts.append(len(found))
    lat = Lattice(v, list(number))
    n_docs = len(texts)
    word_of, size = np.array(inst, np.int64), np.array(counts, np.int64)
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(n_docs), size)
    index = np.arange(len(doc)) - begin[doc]
    seed = mix(np.array(seeds, np.int64).view(np.uint64) + _STEP)
    zero = np.zeros(n_docs, np.int64)
    value = -np.log(-np.log(uniform(seed, 0, zero, 0, 1)))
    results: list[tuple[list, list, list]] = [([], [], []) for _ in texts]
    heaps: list[list[tuple]] = [[] for _ in texts]
    paths: list[Path] = []
    who = np.arange(n_docs)
    # Where each document's path leaves its parent's: token and, there, edges that are out and their mass.
    fork: list[tuple[int, tuple, float] | None] = [None] * n_docs
    for sample in range(k):
        if sample == 0:
            edge, count = lat.walk(word_of, lat.start[word_of], np.zeros(len(doc), np.int64), seed[doc], index, sample)
            path = Path(edge, np.repeat(np.arange(len(doc)), count), _ramp(count), np.searchsorted(np.repeat(doc, count), np.arange(n_docs + 1)))
        else:
            chosen, opened, parents, where = [], [], [], []
            value = np.full(n_docs, -np.inf)
            for d in range(n_docs):
                if heaps[d]:
                    heaps[d].sort()
                    chosen.append(d)
                    opened.append(heaps[d].pop())
                    parents.append((opened[-1][1], int(paths[opened[-1][1]].cut[d]) + opened[-1][2], opened[-1][2]))
            heights = uniform(seed[chosen], sample, np.array([int(paths[s].word[t] - begin[d]) for d, (s, t, _) in zip(chosen, parents, strict=True)], np.int64), np.array([int(paths[s].step[t]) for s, t, _ in parents], np.int64), 0)
            for d, (bound, s, at, out), (_, token, _), u in zip(chosen, opened, parents, heights.tolist(), strict=True):
                node = lat.source[paths[s].edge[token]]
                rest = [e for e in range(int(lat.first[node]), int(lat.first[node + 1])) if e not in out]
                mass = lat.p[rest]
                e = rest[min(int(np.searchsorted(np.cumsum(mass), u * mass.sum(), "right")), len(rest) - 1)]
                where.append(e)
                value[d] = bound
                fork[d] = (at, (*out, e), float(lat.p[list(out)].sum() + lat.p[e]))
            if not chosen:
                break
            who = np.array(chosen)
            # The word of the fork goes on behind the new edge; all later words of the document start anew.
            branch = np.array([int(paths[s].word[t]) for s, t, _ in parents])
            step0 = np.array([int(paths[s].step[t]) for s, t, _ in parents])
            later = begin[who] + size[who] - branch
            inst_of = np.repeat(branch, later) + _ramp(later)
            head = np.cumsum(later) - later
            node, steps = lat.start[word_of[inst_of]].copy(), np.zeros(len(inst_of), np.int64)
            node[head], steps[head] = lat.target[where], step0 + 1
            edge, count = lat.walk(word_of[inst_of], node, steps, seed[doc[inst_of]], index[inst_of], sample)
            grown = np.add.reduceat(count, head)
            parts_edge, parts_word, parts_step, cut = [], [], [], np.zeros(n_docs + 1, np.int64)
            new_word, new_step = np.repeat(inst_of, count), _ramp(count) + np.repeat(steps, count)
            at_new = np.cumsum(grown) - grown
            for i, (d, (s, token, at)) in enumerate(zip(chosen, parents, strict=True)):
                p, z = paths[s], slice(at_new[i], at_new[i] + grown[i])
                lead = slice(int(p.cut[d]), token)
                parts_edge += [p.edge[lead], [where[i]], edge[z]]
                parts_word += [p.word[lead], [branch[i]], new_word[z]]
                parts_step += [p.step[lead], [step0[i]], new_step[z]]
                cut[d + 1] = at + 1 + grown[i]
            path = Path(np.concatenate(parts_edge), np.concatenate(parts_word), np.concatenate(parts_step), np.cumsum(cut))
        paths.append(path)
        own = np.diff(path.cut)
        of = np.repeat(np.arange(n_docs), own)
        with np.errstate(divide="ignore"):
            lp = np.log(lat.p[path.edge])
        run = np.concatenate([np.zeros(1), np.cumsum(lp)])
        before = run[:-1] - run[path.cut[of]]
        rest = lat.log_rest(path.edge)
        if sample:
            for d in chosen:
                at, _, mass = fork[d]
                token = int(path.cut[d]) + at
                rest[path.cut[d] : token] = -np.inf  # states of the parent
                a, b = lat.first[lat.source[path.edge[token]]], lat.first[lat.source[path.edge[token]] + 1]
                rest[token] = np.log1p(-min(mass, 1.0)) if b - a > len(fork[d][1]) and mass < 1 else -np.inf
        bounds = _truncated(before + rest, value[of], uniform(seed[of], sample, path.word - begin[of], path.step, 1))
        live = who[own[who] > 0]
        flat = _ids(v, lat, path)
        for d in who.tolist():
            a, b = int(path.cut[d]), int(path.cut[d + 1])
            ids, logs, values = results[d]
            ids.append(flat(a, b))
            logs.append(float(run[b] - run[a]))
            values.append(float(value[d]))
        # The best k - sample states of each document are all that can still be opened, or be the threshold.
        for _ in range(k - sample):
            if not len(live):
                break
            top = np.maximum.reduceat(bounds, path.cut[live]) if len(live) == n_docs else np.array([bounds[path.cut[d] : path.cut[d + 1]].max() for d in live.tolist()])
            spot = np.full(n_docs, np.inf)
            spot[live] = top
            hits = np.flatnonzero((bounds == spot[of]) & ~np.isneginf(bounds))
            docs_hit, firsts = np.unique(of[hits], return_index=True)
            for d, t in zip(docs_hit.tolist(), hits[firsts].tolist(), strict=True):
                at = t - int(path.cut[d])
                forked = sample and fork[d][0] == at
                heaps[d].append((float(bounds[t]), len(paths) - 1, at, fork[d][1] if forked else (int(path.edge[t]),)))
                bounds[t] = -np.inf
            live = docs_hit
    out = []
    for d, (ids, logs, values) in enumerate(results):
        heaps[d].sort()
        threshold = heaps[d][-1][0] if heaps[d] else -np.inf
        x = np.array(logs) - threshold
        with np.errstate(over="ignore", divide="ignore"):
            # log(1 - exp(-exp(x))): about x where exp(x) is small.
            inclusion = np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.minimum(x, 700)))))
        out.append((ids, logs, values, inclusion.tolist()))
    return out


def _ids(v: Vocabulary, lat: Lattice, path: Path) -> Callable[[int, int], bytes]:
    """ids(a, b) of the edges a to b of a path; a character that is no piece gives its bytes' ids."""
    piece = lat.piece[path.edge]
    odd = np.flatnonzero(piece < 0)
    if not len(odd):
        small = piece.astype("<u2")
        return lambda a, b: small[a:b].tobytes()
    code, kind = np.unique(lat.code[lat.source[path.edge[odd]]], return_inverse=True)
    coded = [chr(int(c)).encode() for c in code]
    count = np.ones(len(piece), np.int64)
    count[odd] = np.array([len(c) for c in coded])[kind]
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    out = np.repeat(piece, count).astype("<u2")
    for i, c in enumerate(coded):
        first = at[odd[kind == i]]
        for j, x in enumerate(c):
            out[first + j] = v.byte_id[x]
    return lambda a, b: out[at[a] : at[b]].tobytes()


def decoded_bytes(v: Vocabulary, samples: list[bytes]) -> list[bytes]:
    """The texts of segmentations in UTF-8, with the model's marks for spaces."""
    i = np.frombuffer(b"".join(samples), "<u2")
    size = v.text_size[i]
    end = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    flat = v.text_bytes[np.repeat(v.text_at[i] - end[:-1], size) + np.arange(int(end[-1]))].tobytes()
    cut = end[np.cumsum([0, *(len(s) // 2 for s in samples)])].tolist()
    return [flat[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def decode(v: Vocabulary, ids: bytes) -> str:
    """The text of a segmentation, without the space that the model puts in front."""
    return decoded_bytes(v, [ids])[0].decode("utf-8").replace(SPACE, " ")[1:]


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _sample(model: str, k: int) -> Callable:
    types = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.bool_())
    names = ["doc_id", "ids", "log_prob", "perturbed", "log_inclusion", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            i = 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (j == i or held + len(texts[j] or "") <= SLICE_CHARS):
                    held += len(texts[j] or "")
                    j += 1
                full = [x for x in range(i, j) if texts[x]]
                got = dict(zip(full, sample_slice(v, [texts[x] for x in full], [keys[x] or 0 for x in full], k), strict=True)) if full else {}
                back = iter(decoded_bytes(v, [s for x in full for s in got[x][0]]))
                rows = []
                for x in range(i, j):
                    ids, logs, values, inclusion = got.get(x, ([b""], [0.0], [0.0], [0.0]))
                    same = True
                    if x in got:
                        marked = (SPACE + texts[x].replace(" ", SPACE)).encode()
                        same = all([next(back) == marked for _ in ids])
                    rows.append((keys[x], ids, logs, values, inclusion, same))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)
                i = j
        trim()

    return run


def sampled_segmentations(spark: SparkSession, docs: DataFrame, model: str, k: int = 2) -> DataFrame:
    """doc_id, ids (16-bit little-endian, one per sample), log_prob, perturbed, log_inclusion, decoded (each sample's text is the row's) of docs(doc_id, text)."""
    ship(spark)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sample(model, k), RESULT)
