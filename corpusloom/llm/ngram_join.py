"""N-gram Jaccard join by vertical partitioning.

The distinct word n-grams of all documents get one global order, rare ones first; the order is cut into fragments, partial
overlaps are counted fragment by fragment and summed per pair. Frequencies come from a counting sketch of fixed size over
the documents that can have a link; any function of the n-gram gives a valid order, so the sketch's errors cost time and never a link.

1. One pass cuts each document's n-grams by hash into fragments and sends each fragment's part to its bucket. Buckets find the n-grams of two
   or more documents, and these partial counts, summed per document over the fragments, bound every overlap: a document of which less than
   ``percent`` of the n-grams occur elsewhere has no link. Fragments travel as 32-bit hashes, whose rare collisions only raise the bound. A
   task sends one entry for each n-gram it has seen, so a common one costs a row per task.
2. For one document of each distinct set that is left, the first ``n - ceil(t n) + 1`` n-grams in the order are the fragment that each link must
   meet in. Documents that share one there, and whose sizes allow a link, are chained into candidate groups.
3. Pairs of a group are resolved by partial overlaps. The order is cut at pivots of equal load, and each document's n-grams of a fragment go to that fragment's task, which counts what
   each pair of a group shares there; these counts are summed per pair by a shuffle. That is done for groups of at most ``PAIR_GROUP`` documents, so there are at most
   half as many pairs per document. In a larger group, whose pairs would grow as its square, the same counts per fragment are summed inside a task, a pair is given up when
   what is left can't make it a link, and only links that join components leave the task. A group that is too large for a task is cut into blocks: first each
   block alone, then pairs of blocks, in which only documents of different components are compared.

Contract: 100 * intersection >= percent * union links two documents. Null, empty and blank texts have no n-grams and link with
nothing. A text of fewer than n words has one n-gram, its whole sequence. Rows that repeat a doc_id are
returned as often as given, with that id's component. Rows without a doc_id have a count and a null component. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from corpusloom.llm import reduce
from corpusloom.llm.bytetext import chained, column_bytes, mix, shingle_sets, slices
from corpusloom.llm.graph import EDGES, Forest, components
from corpusloom.llm.runtime import balanced_join, discard, materialize, numbered, partitions, salted_join, ship, trim

#: Least and most bits of the sketch of n-grams and of the filter of documents; between these they grow with the candidates. Beyond, both grow less selective, which costs time and no link.
SKETCH_BITS, BLOOM_BITS = (22, 24), (24, 27)
FRAGMENTS = 8
PAIR_GROUP = 16
#: N-grams in a task: of a bucket of step 2, and of a block of step 3.
BUCKET, BLOCK = 600_000, 1_000_000
FLUSH = 400_000
_SEEDS = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))
#: Bytes of text for each n-gram, to choose the number of buckets; a wrong guess changes their size only.
TEXT_PER_GRAM = 6
MULTI = 0xFFFF
FLUSH_DOCS = 60_000
SPREAD = "part int, seq int, bucket int, tokens binary, owners binary, doc_id array<long>, n array<int>, fp1 array<long>, fp2 array<long>, local array<int>"
PREFIX = "bucket int, tokens binary, owners binary, ids binary, low binary, high binary"


def _slot(h: np.ndarray, size: int) -> np.ndarray:
    """Places in a sketch of ``size`` entries, a power of two."""
    return (h >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _bits(entries: int, limits: tuple[int, int]) -> int:
    return min(max(entries.bit_length(), limits[0]), limits[1])


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids = batch.column(0).to_pylist()
    raw, offs = column_bytes(batch.column(1))
    for i, j in slices(offs):
        o = offs[i : j + 1]
        yield ids[i:j], shingle_sets(raw[o[0] : o[-1]], o - o[0], n)


def _spread(n: int, n_buckets: int) -> Callable:
    """Fragments of all documents by bucket, and a row of each flush with its documents, set sizes, set fingerprints and local counts."""
    lists = [("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("fp1", pa.list_(pa.int64())), ("fp2", pa.list_(pa.int64())), ("local", pa.list_(pa.int32()))]
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary()), *lists])

    def flush(seq: int, ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        size = np.array([len(x) for x in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        cut = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        prints = []
        for seed in _SEEDS:
            run = np.zeros(len(flat) + 1, np.uint64)
            np.cumsum(mix(flat ^ seed), out=run[1:])
            prints.append((run[cut[1:]] - run[cut[:-1]]).view(np.int64))
        order = np.argsort(flat, kind="stable")
        token, who = flat[order], owner[order].astype(np.uint16)
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(token)))
        local = np.bincount(who[np.repeat(times > 1, times)], minlength=len(sets))
        token, who = token[heads], who[heads]
        who[times > 1] = MULTI
        # The order by hash is the order by bucket.
        bounds = np.searchsorted(token, _bounds(n_buckets))
        part = TaskContext.get().partitionId()
        rows = [(part, seq, -1, None, None, ids, size.tolist(), prints[0].tolist(), prints[1].tolist(), local.tolist())]
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b > a:
                by = np.argsort(who[a:b], kind="stable")
                rows.append((part, seq, k, _short(token[a:b][by], n_buckets).tobytes(), who[a:b][by].tobytes(), None, None, None, None, None))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        held: list[np.ndarray] = []
        tokens, seq = 0, 0
        for b in batches:
            for some, sets in _sets(b, n):
                ids += some
                held += sets
                tokens += sum(map(len, sets))
                if tokens >= FLUSH or len(ids) >= FLUSH_DOCS - 10_000:
                    yield flush(seq, ids, held)
                    ids, held, tokens, seq = [], [], 0, seq + 1
        if ids:
            yield flush(seq, ids, held)
        ids = held = None
        trim()

    return run


def _bounds(n_buckets: int) -> np.ndarray:
    """Lower ends of equal ranges of 64-bit hashes, and the last one's upper end."""
    width = (1 << 64) // n_buckets
    return np.array([k * width for k in range(n_buckets)] + [(1 << 64) - 1], np.uint64)


def _short(token: np.ndarray, n_buckets: int) -> np.ndarray:
    """32 bits that tell the n-grams of a bucket apart, all but rarely."""
    return mix(token).astype(np.uint32)


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket: for each flush, the documents with n-grams that occur in another entry, and how many. What is sent on is bounded by the n-grams, not by documents times buckets."""
    tokens = [np.frombuffer(x, np.uint32) for x in pdf["tokens"]]
    token = np.concatenate(tokens)
    order = np.argsort(token, kind="stable")
    ordered = token[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(token), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    del token, order, ordered, same
    who = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf["owners"]])
    at = np.flatnonzero(twice & (who != MULTI))
    # Entries are ordered by document, so equal pairs of entry and document are neighbours.
    pair = (np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])[at] << 16) | who[at]
    heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else pair
    owner, count = (pair[heads] & 0xFFFF).astype(np.uint16), np.diff(np.append(heads, len(pair))).astype(np.uint32)
    cut = np.searchsorted(pair[heads] >> 16, np.arange(len(tokens) + 1)).tolist()
    out = [(part, seq, owner[a:b].tobytes(), count[a:b].tobytes()) for part, seq, a, b in zip(pdf["part"], pdf["seq"], cut[:-1], cut[1:], strict=True) if b > a]
    trim()
    return pd.DataFrame(out, columns=["part", "seq", "owners", "counts"])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one flush: the sum of its buckets' counts."""
    owners = [np.frombuffer(x, np.uint16) for x in pdf["owners"]]
    total = np.zeros(1 + max(int(o[-1]) for o in owners), np.int64)
    for o, c in zip(owners, pdf["counts"], strict=True):
        total[o] += np.frombuffer(c, np.uint32)
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "seq": pdf["seq"].iloc[:1], "shared": [total.tolist()]})


def _counted(size: int) -> Callable:
    """The sketch's rows for a table of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(size, np.uint32)
        for b in batches:
            for g in b.column(0).to_pylist():
                np.add.at(sketch, _slot(np.frombuffer(g, np.uint64), size), 1)
        rows = reduce.packed(sketch, TaskContext.get().partitionId())
        del sketch
        trim()
        yield pa.RecordBatch.from_pydict({"block": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.int32()), "data": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _load(rank: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """N-grams of each rank."""
    load = np.zeros(256)
    for k in range(0, len(rank), 1 << 20):
        load += np.bincount(rank[k : k + (1 << 20)], weights=counts[k : k + (1 << 20)], minlength=256)
    return load


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of the summed sketch: its ranks, which take a quarter of its counts' bytes, and the n-grams of each rank."""
    for b in batches:
        for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
            counts = np.frombuffer(zlib.decompress(data), np.uint32)
            rank = np.ceil(4 * np.log2(np.maximum(counts, 1).astype(np.float64))).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "data": pa.array([zlib.compress(rank.tobytes(), 1)], pa.binary()), "load": pa.array([_load(rank, counts).tolist()], pa.list_(pa.float64()))})
    trim()


def ranks(spark: SparkSession, grams: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each place of a sketch of grams' sets, and the n-grams of each rank. Counts are summed and ranked in tasks; the driver gets a byte for each place, of at most 2^24."""
    counted, counted_at = materialize(spark, grams.select("grams").mapInArrow(_counted(size), reduce.SCHEMA), "partial-sums")
    blocks, blocks_at = materialize(spark, reduce.merged(counted).mapInArrow(_ranked, "block int, data binary, load array<double>"), "ranks")
    rank = reduce.filled(blocks, size, "uint8")
    load = np.sum([r[0] for r in blocks.select("load").collect()], axis=0, initial=0.0) + np.zeros(256)
    discard(spark, counted_at, blocks_at)
    return rank, load


def pivots(rank: np.ndarray, counts: np.ndarray, parts: int = FRAGMENTS) -> list[tuple[int, int]]:
    """Places (rank, hash) that cut the order into fragments of about equal load."""
    return pivots_of(_load(rank, counts), parts)


def pivots_of(load: np.ndarray, parts: int = FRAGMENTS) -> list[tuple[int, int]]:
    """``pivots`` of the n-grams of each rank."""
    load = load.copy()
    load[0] = 0  # n-grams of one set are not sent
    upto = np.cumsum(load)
    out = []
    for k in range(1, parts):
        goal = upto[-1] * k / parts
        r = min(int(np.searchsorted(upto, goal, "right")), len(load) - 1)
        inside = (goal - (upto[r] - load[r])) / load[r] if load[r] else 0.0
        out.append((r, min(int(inside * 2.0**64), (1 << 64) - 1)))
    return out


def _fragments(sketch, cuts: list[tuple[int, int]]) -> Callable:
    """Each document's n-grams by fragment of the order; those of one set are left out. ``print`` tells rows of one doc_id and different texts apart."""
    schema = pa.schema([("fragment", pa.int32()), ("doc_id", pa.int64()), ("print", pa.int64()), ("component", pa.int64()), ("size", pa.int32()), ("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(sketch.value, np.uint8)
        for b in batches:
            out = []
            for doc_id, component, g in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = np.frombuffer(g, np.uint64)
                r = rank[_slot(s, len(rank))]
                known = r > 0
                h, r = s[known], r[known]
                fragment = np.zeros(len(h), np.int64)
                for pr, ph in cuts:
                    fragment += (r > pr) | ((r == pr) & (h >= np.uint64(ph)))
                order = np.argsort(fragment, kind="stable")
                at = np.searchsorted(fragment[order], np.arange(len(cuts) + 2))
                mark = int(np.add.reduce(mix(s)).view(np.int64))
                out += [(k, doc_id, mark, component, len(s), h[order[at[k] : at[k + 1]]].tobytes()) for k in range(len(cuts) + 1) if at[k + 1] > at[k]]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)
        trim()

    return run


PARTS = "fragment int, doc_id long, print long, component long, size int, part binary"
PARTIAL = "i long, pi long, j long, pj long, ni int, nj int, partial long"


def partial_overlaps(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one fragment: what each pair of documents of a group shares in it. Columns doc_id, print, component, size, part."""
    pdf = pdf.drop_duplicates(["doc_id", "print"]).sort_values(["doc_id", "print"])
    parts = [np.frombuffer(x, np.uint64) for x in pdf["part"]]
    token, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    group = np.unique(pdf["component"].to_numpy(), return_inverse=True)[1][owner]
    order = np.lexsort((owner, token, group))
    token, owner, group = token[order], owner[order], group[order]
    found = [np.zeros(0, np.int64)]
    for step in range(1, len(parts)):
        same = (token[step:] == token[:-step]) & (group[step:] == group[:-step])
        if not same.any():
            break
        found.append(owner[:-step][same] * len(parts) + owner[step:][same])
    pair, count = np.unique(np.concatenate(found), return_counts=True)
    i, j = pair // len(parts), pair % len(parts)
    ids, mark, size = (pdf[c].to_numpy() for c in ("doc_id", "print", "size"))
    out = pd.DataFrame({"i": ids[i], "pi": mark[i], "j": ids[j], "pj": mark[j], "ni": size[i], "nj": size[j], "partial": count})
    trim()
    return out


def _prefix_length(size: int, percent: int) -> int:
    return size - (size * percent + 99) // 100 + 1


def _chains(tokens: np.ndarray, owners: np.ndarray, low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by token and size, with a flag where a run of equal tokens and near sizes starts, and the run's largest size so far."""
    order = np.lexsort((low[owners], tokens))
    t, lo, hi = tokens[order], low[owners][order], high[owners][order]
    new = np.ones(len(t), bool)
    new[1:] = t[1:] != t[:-1]
    # The largest size so far within a token: sizes are raised by a rank of their token, so the running maximum starts anew.
    base = np.cumsum(new) * (np.int64(1) << np.int64(40))
    top = np.maximum.accumulate(base + hi)
    new[1:] |= (top[:-1] - base[:-1]) * 100 < lo[1:] * percent
    return order, new, top - base


def _prefixes(percent: int, n_buckets: int, sketch) -> Callable:
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("tokens", "owners", "ids", "low", "high"))])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], schema.field(i).type) for i in range(6)], schema=schema)

    def flush(ids: list[int], sizes: list[int], tokens: list[np.ndarray], lengths: list[int]) -> pa.RecordBatch:
        id_of, size = np.array(ids, np.int64), np.array(sizes, np.int64)
        tok, own = np.concatenate(tokens), np.repeat(np.arange(len(ids)), lengths)
        order, new, top = _chains(tok, own, size, size, percent)
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(tok)) - 1
        who = own[order]
        f = Forest()
        head_of = np.repeat(heads, np.diff(np.append(heads, len(tok))))
        inner = np.flatnonzero(~new)
        if len(inner):
            a, b = id_of[who[inner]], id_of[who[head_of[inner]]]
            for u, v in set(zip(a.tolist(), b.tolist(), strict=True)):
                f.join(u, v)
        found = []
        if pairs := list(f.edges()):
            u, v = np.array(pairs, np.int64).T
            found.append((-1, b"", b"", u.tobytes(), v.tobytes(), b""))
        t, w, hi = tok[order][heads], who[heads], top[ends].astype(np.int32)
        at = mix(t) % np.uint64(n_buckets)
        by = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[by], np.arange(n_buckets + 1, dtype=np.uint64))
        for k in range(n_buckets):
            if len(g := by[bounds[k] : bounds[k + 1]]):
                g = g[np.argsort(w[g], kind="stable")]
                uniq, inv = np.unique(w[g], return_inverse=True)
                wide = hi[g] != size[w[g]]
                # Entries are ordered by owner; those that stand for a run of sizes carry its upper end.
                found.append((k, t[g].tobytes(), inv.astype(np.uint32).tobytes(), id_of[uniq].tobytes(), size[uniq].astype(np.int32).tobytes(), np.array([np.flatnonzero(wide), hi[g][wide]], np.int32).tobytes()))
        return rows(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.frombuffer(sketch.value, np.uint8)
        ids, sizes, tokens, lengths, held = [], [], [], [], 0
        for b in batches:
            for i, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = np.frombuffer(g, np.uint64)
                place = rank[_slot(s, len(rank))]
                first = np.argsort(place, kind="stable")[: _prefix_length(len(s), percent)]
                # The sketch never counts too little, so rank 0 is an n-gram of one set.
                mine = s[first[place[first] > 0]]
                if len(mine):
                    ids.append(i)
                    sizes.append(len(s))
                    tokens.append(mine)
                    lengths.append(len(mine))
                    held += len(mine)
            if held >= FLUSH:
                yield flush(ids, sizes, tokens, lengths)
                ids, sizes, tokens, lengths, held = [], [], [], [], 0
        if ids:
            yield flush(ids, sizes, tokens, lengths)
        ids = sizes = tokens = lengths = None
        trim()

    return run


def _bucket_edges(percent: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, ids, low, high = [], [], [], []
        for r in pdf.itertuples(index=False):
            own = np.frombuffer(r.owners, np.uint32)
            lo = np.frombuffer(r.low, np.int32)[own].astype(np.int64)
            at, to = np.frombuffer(r.high, np.int32).reshape(2, -1)
            hi = lo.copy()
            hi[at] = to
            tokens.append(np.frombuffer(r.tokens, np.uint64))
            ids.append(np.frombuffer(r.ids, np.int64)[own])
            low.append(lo)
            high.append(hi)
        t, i = np.concatenate(tokens), np.concatenate(ids)
        order, new, _ = _chains(t, np.arange(len(t)), np.concatenate(low), np.concatenate(high), percent)
        heads = np.flatnonzero(new)
        head_of = np.repeat(heads, np.diff(np.append(heads, len(t))))
        who = i[order]
        inner = np.flatnonzero(~new)
        f = Forest()
        for u, v in set(zip(who[inner].tolist(), who[head_of[inner]].tolist(), strict=True)):
            f.join(u, v)
        out = pd.DataFrame(list(f.edges()), columns=["u", "v"], dtype="int64")
        del t, i, order, new, head_of, who, inner, f, tokens, ids, low, high
        trim()
        return out

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for u, v in zip(b.column("ids").to_pylist(), b.column("low").to_pylist(), strict=True):
            yield pa.RecordBatch.from_pydict({"u": np.frombuffer(u, np.int64), "v": np.frombuffer(v, np.int64)})


def _bloom(column: int, size: int) -> Callable:
    schema = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for b in batches:
            bits[_bloom_slot(b.column(column).to_numpy(zero_copy_only=False), size)] = True
        rows = reduce.packed(np.packbits(bits), TaskContext.get().partitionId())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], schema=schema)

    return run


def _bloom_slot(ids: np.ndarray, size: int) -> np.ndarray:
    return _slot(mix(ids.astype(np.int64).view(np.uint64)), size)


def _wanted_sets(n: int, bloom) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bloom.value, np.uint8)).astype(bool)
        for b in batches:
            ids = b.column(0)
            keep = np.zeros(len(ids), bool)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            keep[known] = bits[_bloom_slot(ids.drop_null().to_numpy(zero_copy_only=False), len(bits))]
            for some, sets in _sets(b.filter(pa.array(keep)), n) if keep.any() else ():
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(some, pa.int64()), "grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    return run


def links(ids: list[int], sets: list[np.ndarray], side: list[int], label: list[int], rank: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join components of one candidate group; only documents of different sides (0 matches 0) and labels are compared.

    Partial overlaps of a document with all smaller ones are counted per fragment of the order and summed; after each
    fragment a pair stays only while the n-grams that are left could still make it a link.
    """
    order = sorted(range(len(ids)), key=lambda k: (len(sets[k]), ids[k]))
    ids, sets, side, label = ([x[k] for k in order] for x in (ids, sets, side, label))
    size = np.array([len(s) for s in sets], np.int64)
    sides, labels = np.array(side), np.array(label, np.int64)
    m = len(ids)
    flat = np.concatenate(sets)
    gram, inv, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.full(len(gram), -1, np.int64)
    by = np.flatnonzero(shared)[np.lexsort((gram[shared], rank[_slot(gram[shared], len(rank))]))]
    place[by] = np.arange(len(by))
    owner = np.repeat(np.arange(m), size)
    where = place[inv]
    owner, where = owner[where >= 0], where[where >= 0]
    by_doc = np.lexsort((where, owner))
    doc_where, doc_at = where[by_doc], np.searchsorted(owner[by_doc], np.arange(m + 1))
    by_gram = np.argsort(where, kind="stable")
    postings, gram_at = owner[by_gram], np.searchsorted(where[by_gram], np.arange(len(by) + 1))
    cuts = np.linspace(0, len(by), FRAGMENTS + 1).astype(np.int64)[1:]
    f = Forest()
    for i in range(1, m):
        lo = int(np.searchsorted(size[:i], (size[i] * percent + 99) // 100))
        mine = doc_where[doc_at[i] : doc_at[i + 1]]
        if lo >= i or not len(mine):
            continue
        fit = labels[lo:i] != labels[i]
        if sides[i] >= 0:
            fit &= sides[lo:i] != sides[i]
        if not fit.any():
            continue
        need = (percent * (size[i] + size[lo:i]) + 99 + percent) // (100 + percent)
        partial = np.zeros(i - lo, np.int64)
        alive = np.flatnonzero(fit)
        ends = np.searchsorted(mine, cuts)
        start = 0
        for end in ends.tolist():
            if end > start:
                got = [postings[gram_at[g] : gram_at[g + 1]] for g in mine[start:end].tolist()]
                hit = np.concatenate(got) if len(got) > 1 else got[0]
                hit = hit[(hit >= lo) & (hit < i)]
                if len(hit):
                    partial += np.bincount(hit - lo, minlength=i - lo)
                start = end
            alive = alive[partial[alive] + (len(mine) - start) >= need[alive]]
            if not len(alive):
                break
        for j in (alive + lo).tolist():
            if f.join(ids[i], ids[j]):
                yield ids[i], ids[j]


def _resolve(percent: int, sketch) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rank = np.frombuffer(sketch.value, np.uint8)
        out = []
        for _, g in pdf.groupby("component", sort=False):
            if len(g) > 1:
                out += links(g["doc_id"].tolist(), [np.frombuffer(x, np.uint64) for x in g["grams"]], g["side"].tolist(), g["label"].tolist(), rank, percent)
        trim()
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    return run


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for each row of docs(doc_id, text)."""
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_buckets = max(partitions(spark), 1 + size // TEXT_PER_GRAM // BUCKET)
    spread, spread_at = materialize(spark, source.mapInArrow(_spread(n, n_buckets), SPREAD), "fragments")
    shared = spread.where("bucket >= 0").select("part", "seq", "bucket", "tokens", "owners").groupBy("bucket").applyInPandas(_shared, "part int, seq int, owners binary, counts binary")
    summed = shared.groupBy("part", "seq").applyInPandas(_summed, "part int, seq int, shared array<long>")
    flushes = spread.where("bucket < 0").select("part", "seq", "doc_id", "n", "fp1", "fp2", "local").join(summed.hint("merge"), ["part", "seq"], "left")
    each = flushes.select("shared", F.posexplode(F.arrays_zip("doc_id", "n", "fp1", "fp2", "local")).alias("at", "d"))
    found = F.col("d.local") + F.coalesce(F.get("shared", F.col("at")), F.lit(0))
    rows, rows_at = materialize(spark, each.select("d.doc_id", F.col("d.n").cast("long").alias("n_shingles"), "d.fp1", "d.fp2", (100 * found >= percent * F.col("d.n")).alias("may_link")), "signatures")
    discard(spark, spread_at)

    known = rows.where("doc_id is not null and n_shingles > 0 and may_link")
    alike, reps_at = materialize(spark, known.groupBy("fp1", "fp2", "n_shingles").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "representatives")
    same = balanced_join(known, alike.where("copies > 1").hint("merge"), ["fp1", "fp2", "n_shingles"], ["doc_id"], "copies").where("doc_id <> first").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    reps = alike.select(F.col("first").alias("doc_id"))
    # About 16 bits for each document in the filter, and a counter for each n-gram that passes it.
    size = 1 << _bits(8 * reps.count(), BLOOM_BITS)
    bits = reduce.total(reps.select("doc_id").mapInArrow(_bloom(0, size), reduce.SCHEMA), size >> 3, "uint8", "or")
    bloom = spark.sparkContext.broadcast(bits.tobytes())
    del bits
    grams, grams_at = materialize(spark, source.mapInArrow(_wanted_sets(n, bloom), "doc_id long, grams binary"), "sets")
    load = grams.agg(F.coalesce(F.sum(F.length("grams")), F.lit(0))).first()[0] // 8
    size = 1 << _bits(load // 4, SKETCH_BITS)
    bloom.destroy()
    rank, loads = ranks(spark, grams, size)
    cuts = pivots_of(loads)
    sketch = spark.sparkContext.broadcast(rank.tobytes())
    del rank
    n_buckets = max(partitions(spark), 1 + load * (100 - percent) // 100 // BUCKET)
    prefixes, prefixes_at = materialize(spark, grams.mapInArrow(_prefixes(percent, n_buckets, sketch), PREFIX), "prefixes")
    near = prefixes.where("bucket >= 0").groupBy("bucket").applyInPandas(_bucket_edges(percent), EDGES)
    local = prefixes.where("bucket < 0").mapInArrow(_unpacked, EDGES)
    groups, groups_at = components(spark, near.union(local), "candidates")
    discard(spark, prefixes_at)

    # Only ids and sizes are moved to weigh groups. Both sides of these joins grow with the input, so they are sorted at every size.
    node = groups.withColumnRenamed("node", "doc_id")
    sizes = grams.select("doc_id", (F.length("grams") / 8).alias("size"))
    weights = sizes.join(node.hint("merge"), "doc_id").groupBy("component").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("members"))
    placed, placed_at = materialize(spark, salted_join(node, weights.hint("merge"), ["component"], ["doc_id"]).select("doc_id", "component", "members", F.ceil(F.col("weight") / BLOCK).cast("int").alias("blocks")), "placed")
    discard(spark, groups_at)
    sets = grams.join(placed.hint("merge"), "doc_id")
    bins = max(partitions(spark), 1 + int(load // BLOCK))
    few = sets.where(F.col("members") <= PAIR_GROUP).select("doc_id", "component", "grams").mapInArrow(_fragments(sketch, cuts), PARTS)
    few = few.withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(-(-bins // FRAGMENTS))))
    partial = few.groupBy("fragment", "bin").applyInPandas(partial_overlaps, PARTIAL)
    overlap = partial.groupBy("i", "pi", "j", "pj", "ni", "nj").agg(F.sum("partial").alias("o"))
    paired = overlap.where(100 * F.col("o") >= percent * (F.col("ni") + F.col("nj") - F.col("o"))).select(F.col("j").alias("u"), F.col("i").alias("v"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    sets = sets.where(F.col("members") > PAIR_GROUP)
    alone = sets.select("doc_id", "component", "grams", F.lit(-1).alias("side"), F.col("doc_id").alias("label"), F.when(F.col("blocks") > 1, block).otherwise(-1).alias("block"), F.pmod(F.xxhash64("component"), F.lit(bins)).alias("bin"))
    alone = alone.withColumn("bin", F.when(F.col("block") < 0, F.col("bin")).otherwise(F.col("component")))
    work = _resolve(percent, sketch)
    first, first_at = materialize(spark, alone.groupBy("block", "bin").applyInPandas(work, EDGES).union(paired).union(same), "links")
    paths = [rows_at, reps_at, grams_at, placed_at, first_at]
    every = first
    if placed.where("blocks > 1").limit(1).count():
        large = sets.where("blocks > 1")
        so_far, so_far_at = components(spark, first, "block-links")
        labelled = large.join(so_far.select(F.col("node").alias("doc_id"), F.col("component").alias("label")).hint("merge"), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")).withColumn("block", block)
        # A block meets each other block once, in the task of the pair.
        paired = labelled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("other <> block")
        paired = paired.select("doc_id", "component", "grams", "label", F.when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
        second, second_at = materialize(spark, paired.groupBy("component", "a", "b").applyInPandas(work, EDGES), "links")
        every = first.union(second)
        paths += [so_far_at, second_at]
    final, final_at = components(spark, every, "components")
    out = rows.join(final.withColumnRenamed("node", "doc_id").hint("merge"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    result, _ = materialize(spark, out, "jaccard")
    discard(spark, *paths, final_at)
    sketch.destroy()
    return result


def one_of_each(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs, all its columns, less all but one of each group of linked rows: that of the smallest doc_id stays, rows without one after the others.

    Rows are told apart by their place in the table, so repeated rows are linked like other equal texts, and rows without a doc_id or with equal ones are judged each.
    Rows without words are linked with nothing and stay. An empty table stays empty. No column's name matters but those of doc_id and text.
    """
    rows, rows_at = numbered(spark, docs, "rows")
    found = jaccard_components(spark, rows.select(F.col("number").alias("doc_id"), "row.text"), n, percent)
    groups = found.where("component_id <> doc_id").select(F.col("component_id").alias("c")).distinct()
    # Of all rows of a group, counted map-side; a group's rows never meet in one task.
    members = salted_join(found.select(F.col("component_id").alias("c"), F.col("doc_id").alias("number")), groups.hint("merge"), ["c"], ["number"])
    ids = rows.select("number", F.col("row.doc_id").cast("long").alias("id"))
    seats = members.join(ids.hint("merge"), "number").select("c", F.struct(F.col("id").isNull().alias("none"), "id", "number").alias("seat"))
    seats, seats_at = materialize(spark, seats, "seats")
    first = seats.groupBy("c").agg(F.min("seat").alias("first"))
    gone, gone_at = materialize(spark, salted_join(seats, first.hint("merge"), ["c"], ["seat"]).where(F.col("seat") != F.col("first")).select("seat.number"), "gone")
    discard(spark, seats_at)
    # Both sides grow with the input, so the join is sorted at every size.
    return rows.join(gone.hint("merge"), "number", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
