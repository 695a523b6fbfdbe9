"""Resampling, mixing and alignment on rows with nulls, blanks, repeats, long texts and clashing columns, against brute force."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import alignment, decontaminate, graph, mixing, ngram_join, reduce, resampling
from corpusloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, number long, n long, size long, _part long, place long, rank string, weight string"


def rows():
    rng = random.Random(5)
    base = [f"w{rng.randrange(60)}" for _ in range(400)]
    some = lambda n: " ".join(rng.choice(base) for _ in range(n))
    texts = [None, "", " \t\n", "One", "one-two THREE", "ünï Ünï 中文 中文", "a" * 70_000, some(9000), "x<s>y <|endoftext|> \x00\x01", "tail space  ", "▁under ▁▁ score"] + [some(rng.randrange(1, 80)) for _ in range(60)]
    out = [(i, t, None if i == 3 else f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    out += [(20, texts[20], "s1"), (20, some(30), "s2"), (None, texts[21], "s1"), (None, None, None), (-4, some(40), "s0")]
    return [(i, t, "en", s, 1, 2, 3, 4, 5, 6, "x", "y") for i, t, s in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def features(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def resampled(docs, target):
    """doc_id, n_words, n_features, weight, score, rank by plain counting."""
    each = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = [math.floor(1000 * math.log(float((t[k] + 1) * s_all) / float((s[k] + 1) * t_all))) for k in range(10_000)]
    out = []
    for i, n, f in each:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    for k, r in enumerate(order[: 5 * len(order) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


def test_resampling(spark, docs, none, monkeypatch):
    target = ["w1 w2 w3 w4", None, "W5 w6, w7 ünï"]
    to = spark.createDataFrame([(t, 1) for t in target], "text string, n long")
    want = resampled([r[:2] for r in rows()], target)
    assert Counter(map(tuple, resampling.resampled(spark, docs, to).collect())) == want
    assert any(r[5] for r in want)
    empty = resampled([r[:2] for r in rows()], [])
    assert Counter(map(tuple, resampling.resampled(spark, docs, none).collect())) == empty
    assert resampling.resampled(spark, none, to).count() == 0


def test_tries_of_any_size_give_the_same(monkeypatch):
    """A trie that ends within a text leaves no run out and counts none twice."""
    import pyarrow as pa

    texts = [t for _, t, *_ in rows()]
    gains = np.random.default_rng(1).integers(-50, 50, resampling.BUCKETS)
    batch = lambda: iter([pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})])
    want_totals, want = Counter(b for t in texts for b in features(t)[1]), [int(sum(gains[b] for b in features(t)[1])) for t in texts]
    for size in (1, 2, 7, 1000, 400_000):
        monkeypatch.setattr(resampling, "TRIE_WORDS", size if size > 2 else 1 + 200 * size)
        totals = next(resampling._totals(resampling.BUCKETS)(b.select(["text"]) for b in batch()))
        assert Counter(dict(zip(totals.column(0).to_pylist(), totals.column(1).to_pylist(), strict=True))) == want_totals
        assert [w for b in resampling._scores(gains)(batch()) for w in b.column(3).to_pylist()] == want


def test_crc_carried_over_many_bytes():
    rng = random.Random(3)
    parts = [(rng.randbytes(rng.choice([0, 1, 3, 4, 17, 300])), rng.randbytes(rng.choice([0, 1, 2, 5, 64, 70_001]))) for _ in range(50)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = resampling.carried(crc(a for a, _ in parts), crc(b for _, b in parts), np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]


def shared(sizes, weights, budget):
    """Targets by taking away those above their caps, again and again."""
    target, left, free = {}, budget, dict(sizes)
    while free:
        share = left / sum(weights[s] for s in free)
        full = [s for s in free if 2 * free[s] <= share * weights[s]]
        if not full:
            return target | {s: share * weights[s] for s in free}
        for s in full:
            target[s] = 2.0 * free.pop(s)
            left -= target[s]
    return target


def queues(docs):
    """(doc_id, size, source_size, target, taken) by plain queues."""
    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in docs]
    sizes = Counter()
    for _, n, s in docs:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = shared(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    turn = lambda i, c: int(hashlib.md5(f"42:{c}:{'' if i is None else i}".encode()).hexdigest()[:15], 16)
    packets = []
    for k, s in enumerate(order):
        sent, due = 0, math.floor(target[s])
        queue = [(c, turn(i, c), i is not None, i or 0, n, j) for c in (1, 2) for j, (i, n, z) in enumerate(docs) if z == s]
        for q in sorted(queue):
            for part in [due - sent, q[4] - due + sent] if 0 < due - sent < q[4] else [q[4]]:
                sent += part
                packets.append((1.0 if sent == due else sent / target[s] if target[s] else 0.0, k, *q, part))
    room, taken = math.floor(1.5 * sum(sizes.values())), Counter()
    for *_, j, part in sorted(packets, key=lambda p: p[:-2]):
        taken[j] += min(part, room)
        room -= min(part, room)
    return [(i, n, sizes[s], target[s], taken[j]) for j, (i, n, s) in enumerate(docs)], room


def test_mixing(spark, docs, none):
    plain = [(i, t, s) for i, t, _, s, *_ in rows()]
    got = mixing.mix(spark, docs).collect()
    want, room = queues(plain)
    assert room == 0 and sum(r.taken for r in got) == sum(r[4] for r in want)
    # Rows of one doc_id and equal size may change places.
    key = lambda r: (r[0], r[1], r[2], round(r[3], 6), r[4])
    assert Counter(map(key, got)) == Counter(map(key, want))
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert Counter(map(tuple, mixing.mix(spark, docs.repartition(7)).collect())) == Counter(map(tuple, got))
    assert mixing.mix(spark, none).count() == 0
    blank = docs.where("text is null or length(trim(text)) = 0")
    assert {tuple(r)[1:] for r in mixing.mix(spark, blank).collect()} == {(0, 0, 0.0, 0)}


def test_mix_is_in_order_and_near_targets(spark, docs):
    """Packets in service are contiguous, in order of finish, and each source's words are within as many words of its target as there are sources."""
    packets = [r for r in mixing.mixed(spark, docs).collect() if r.taken]
    packets.sort(key=lambda r: r.offset)
    assert [r.offset for r in packets] == list(np.cumsum([0] + [r.taken for r in packets[:-1]]))
    assert all(a.finish <= b.finish for a, b in zip(packets, packets[1:]))
    sums = Counter()
    for r in packets:
        sums[(r.source_size, r.target)] += r.taken
    assert all(abs(n - target) <= 5 for (_, target), n in sums.items())


def test_targets_stop_at_twice_the_size(spark):
    sized = spark.createDataFrame([(f"s{k:02}" if k else None, n) for k, n in enumerate([7, 1, 1, 1000, 5, 0, 300, 2, 40_000])], "source string, size long")
    sources, words = mixing.targets(spark, sized)
    got = {r.key: r.target for r in sources.collect()}
    sizes = {"" if s is None else "=" + s: n for s, n in sized.collect()}
    order = sorted(sizes, key=lambda s: (s == "", s))
    want = shared(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, words)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(words)


VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def by_libraries(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text, from the libraries' ids and plain sets of offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    paths = [tokenizer_path(v) for v in VOCABULARIES]
    both = alignment.load(*paths)
    byte_level, pieces = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    byte_level.encode_special_tokens = True
    each, counts = [], Counter()
    for text in texts:
        sides = [byte_level.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)] if text else [[], []]
        spelt = [[v[i] for i in ids] for v, ids in zip((both.bytes_a, both.bytes_b), sides, strict=True)]
        if not text or any(b"".join(x) != (" " + text).encode() for x in spelt):
            each.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
        groups, links, at = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [x.index(e) + 1 for x in ends]
            groups.append("|".join(",".join(map(str, ids[i:j])) for ids, i, j in zip(sides, at, to, strict=True)))
            links.append((sides[0][to[0] - 1], sides[1][to[1] - 1]))
            at = to
        counts.update(links)
        each.append((len(sides[0]), len(sides[1]), groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return [none if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == most[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in each]


@pytest.mark.parametrize("broadcast", [True, False])
def test_alignment(spark, docs, none, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(alignment, "PAIRS", 0)
    paths = [tokenizer_path(v) for v in VOCABULARIES]
    plain = [(i, t) for i, t, *_ in rows()]
    want = Counter((i, *x) for (i, _), x in zip(plain, by_libraries([t for _, t in plain]), strict=True))
    assert Counter(map(tuple, alignment.alignment(spark, docs, *paths).collect())) == want
    # A text that holds the mark of a space spells a space on the other side only; special tokens' strings are text.
    assert [r for r in want if r[0] == 10] == [(10, 0, 0, 0, 0, 0, 0, "")]
    assert next(r for r in want if r[0] == 8)[1] > 10
    if broadcast:
        assert alignment.alignment(spark, none, *paths).count() == 0


def test_ids_are_those_of_the_libraries():
    """Stretches of random characters, spaces, marks and line breaks, cut and remembered, against whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    paths = [tokenizer_path(v) for v in VOCABULARIES]
    both = alignment.load(*paths)
    byte_level, pieces = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    byte_level.encode_special_tokens = True
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", "Quick", " ", "  ", "\n", "\t", ".", ",", "'s", "ü", "中", "\u00a0", "0", "12", "<s>", "<|endoftext|>", "\x01", "é", "𝒳", "-"]) for _ in range(rng.randrange(1, 30)))
        a, b = both.ids(text)
        assert a.tolist() == byte_level.encode(" " + text, add_special_tokens=False).ids
        assert b.tolist() == pieces.encode(text)


def test_group_numbers_are_running_counts_of_cuts(spark):
    paths = [tokenizer_path(v) for v in VOCABULARIES]
    text = "Alignment of tokenizers, unalike: pneumonoultramicroscopic!"
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = alignment.cuts(alignment.encoded(spark, frame, *paths).repartition(2, "number"), alignment.load(*paths)).sort("end").collect()
    assert [r.group for r in found] == list(range(1, len(found) + 1)) and found[-1].end == len(text) + 1


def test_short_items_with_and_without_end_marks(spark, monkeypatch):
    """A short item is found as a sentence whether a mark ends it in the item, in the text, in both or in neither; several blocks of the benchmark give the same."""
    items = [(1, "Paris is the capital"), (2, "So it goes!"), (3, "yes"), (4, "a: b"), (5, "one two three four five six seven eight")]
    docs = [
        (1, "Indeed. Paris is the capital. Yes."), (2, "Paris is the capital"), (3, "x\nParis is the capital!?\ny"), (4, "Paris is the capital city."), (5, "They say Paris is the capital. No."),
        (6, "so it goes"), (7, "And. So it goes. On"), (8, "So it goes on."), (9, "No; a: b; c"), (10, "a b"), (11, "...\n?"), (12, "yes?"), (13, None), (14, "x one two three four five six seven eight y"),
    ]
    want = [(1, 1), (1, 3), (2, 1), (3, 1), (6, 2), (7, 2), (9, 4), (12, 3), (14, 5)]
    table, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (1_000_000, 6):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, table, benchmark).collect()) == want
        assert {r.doc_id for r in decontaminate.uncontaminated(spark, table, benchmark).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_one_of_each_from_any_format(spark, tmp_path):
    """Rows are told apart in tables whose files know no places, too, and in rows that are no table."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(1, words), (2, words + " more"), (2, words), (3, "else"), (3, "else"), (None, words), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = Counter([(1, words), (3, "else"), (None, None)])
    for kind in ("json", "orc", "parquet"):
        frame.write.format(kind).save(f"{tmp_path}/{kind}")
        docs = spark.read.schema(frame.schema).format(kind).load(f"{tmp_path}/{kind}")
        assert Counter(map(tuple, ngram_join.one_of_each(spark, docs).collect())) == want
    assert Counter(map(tuple, ngram_join.one_of_each(spark, frame).collect())) == want


def test_ranks_of_the_sketch_are_made_in_tasks(spark):
    """The driver holds a byte for each place of the sketch, not its counts."""
    import tracemalloc

    from corpusloom.llm.bytetext import mix

    rng = np.random.default_rng(2)
    sets = [np.unique(mix(rng.zipf(1.3, 400).astype(np.uint64))) for _ in range(60)]
    size = 1 << 22
    grams = spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets], "grams binary")
    tracemalloc.start()
    rank, load = ngram_join.ranks(spark, grams, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = np.bincount(ngram_join._slot(np.concatenate(sets), size), minlength=size)
    assert (rank == np.ceil(4 * np.log2(np.maximum(counts, 1)))).all() and counts.max() > 20
    assert load[1:].sum() == counts[counts > 1].sum() and ngram_join.pivots_of(load) == ngram_join.pivots(rank, counts)
    assert peak < 2.5 * size
    empty, none = ngram_join.ranks(spark, grams.limit(0), size)
    assert not empty.any() and not none.any()


def test_the_latent_space_is_of_all_passages(spark):
    """Few passages have all their singular values in the space: those of every passage of every text, not of one of each."""
    rng = random.Random(13)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(n)) for n in (300, 30, 7)] + ["", None]
    items = ["what " * 3 + " ".join(f"w{k}" for k in range(20)) + "."]
    idf = np.linspace(1, 3, 1 << decontaminate.TERM_BITS).astype(np.float32)
    frame = lambda rows: spark.createDataFrame([(t,) for t in rows], "text string")
    _, values = decontaminate.latent_space(frame(texts).repartition(3), frame(items), spark.sparkContext.broadcast(idf.tobytes()))
    passages = [p for t in texts if t for w in [t.split()] for k in range(0, len(w), decontaminate.PASSAGE) for p in [w[max(0, min(k, len(w) - decontaminate.PASSAGE)) :][: decontaminate.PASSAGE]]]
    passages += [items[0].split(), *[decontaminate.answer_of(items[0]).split()] * 1]
    a = np.zeros((len(passages), 1 << decontaminate.SPACE_BITS))
    for k, p in enumerate(passages):
        full = np.zeros(1 << decontaminate.TERM_BITS)
        for h in decontaminate._hashes([" ".join(p)])[0]:
            t = int(h) >> (64 - decontaminate.TERM_BITS)
            full[t] += idf[t]
        full /= np.linalg.norm(full)
        np.add.at(a[k], np.arange(len(full)) >> (decontaminate.TERM_BITS - decontaminate.SPACE_BITS), full)
    want = np.linalg.svd(a, compute_uv=False)
    assert len(passages) > 14
    np.testing.assert_allclose(values[: len(want)], want, atol=0.02)


def test_products_of_passages_are_summed_in_runs():
    """A'(A G) in float64, and in less than 0.7 of the time of one reduction for each term."""
    rng = np.random.default_rng(7)
    passages = (rng.zipf(1.2, (4 * decontaminate.AT_ONCE // 3, decontaminate.PASSAGE)) * 2654435761 % (1 << decontaminate.TERM_BITS)).astype(np.int32)
    passages[::5, 20:] = -1
    passages[7] = -1
    idf, test = rng.random(1 << decontaminate.TERM_BITS, np.float32) + 1, decontaminate._gaussian()

    def reduced(some, y):
        term, w = decontaminate._weighed(some, idf)
        held = np.flatnonzero(w.ravel())
        held = held[np.argsort(term.ravel()[held], kind="stable")]
        of = term.ravel()[held]
        heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        y[of[heads]] += np.add.reduceat(w.ravel()[held, None] * np.einsum("ij,ijk->ik", w, test[term])[held // term.shape[1]], heads, axis=0)

    def timed(multiply):
        took = []
        for _ in range(3):
            y, start = np.zeros_like(test), time.thread_time()
            multiply(y)
            took.append(time.thread_time() - start)
        return y, min(took)

    got, new = timed(lambda y: [decontaminate._multiplied(p, idf, test, y) for p in decontaminate._gathered(iter(np.array_split(passages, 9)))])
    _, old = timed(lambda y: [reduced(passages[lo : lo + 1024], y) for lo in range(0, len(passages), 1024)])
    term, w = decontaminate._weighed(passages, idf)
    want = np.zeros(test.shape)
    np.add.at(want, term.ravel(), (w[:, :, None] * np.einsum("ij,ijk->ik", w.astype(float), test[term].astype(float))[:, None, :]).reshape(-1, test.shape[1]))
    np.testing.assert_allclose(got, want, atol=1e-5 * np.abs(want).max())
    assert new < 0.7 * old
    empty = np.zeros_like(test)
    decontaminate._multiplied(np.full((3, decontaminate.PASSAGE), -1, np.int32), idf, test, empty)
    assert not empty.any() and not list(decontaminate._gathered(iter([])))


def test_dense_floats_are_stored_as_they_are():
    dense, sparse = np.random.default_rng(3).standard_normal(1 << 16, np.float32), np.zeros(1 << 16, np.float32)
    sparse[:99] = 1.5
    for a in (dense, sparse, np.arange(1 << 16, dtype=np.uint32)):
        got = b"".join(zlib.decompress(d) for _, _, d in reduce.packed(a, 0))
        assert got == a.tobytes()[: len(got)] and not any(a.tobytes()[len(got) :])
    assert sum(len(d) for _, _, d in reduce.packed(dense, 0)) >= dense.nbytes > 50 * sum(len(d) for _, _, d in reduce.packed(sparse, 0))


def test_words_are_made_together(monkeypatch):
    """Ids of words that are joined at once are the libraries'; neither library is asked for a word of letters by itself."""
    paths = [tokenizer_path(v) for v in VOCABULARIES]
    both = alignment.Encoders(*paths)
    rng = random.Random(21)
    words = list({"".join(rng.choice("aabcdeeefghiilmnoorsttuyzABCéü") for _ in range(rng.randrange(1, 16))) for _ in range(4000)}) + ["aaaaaaaa", "z"]
    strange = ["中文字", "x-1", "don't", "\x00", "😀b", "", "12"]
    want_b = [both._asked(w) for w in words + strange]
    want_a = [both.a._stretch(" " + w) for w in words]
    with monkeypatch.context() as m:
        m.setattr(both, "_asked", lambda w: pytest.fail(w))
        m.setattr(both.a, "_piece", lambda w: pytest.fail(w))
        texts = [" ".join(words[k : k + 40]) for k in range(0, len(words), 40)]
        for text, (a, b) in zip(texts, both.all_ids(texts), strict=True):
            assert a.tobytes() == b"".join(both.a.memo[" " + w] for w in text.split(" "))
            assert b.tobytes() == b"".join(both.words[w] for w in text.split(" "))
    assert both._made(words + strange) == want_b and both.a._words([" " + w for w in words]) == want_a
    monkeypatch.setattr(alignment.bpe_units, "LIMIT", 100)
    both.words, both.old = {}, {}
    assert [b.tolist() for _, b in both.all_ids(texts)] == [both.b.encode(t) for t in texts]
    assert len(both._known({"one", "two"})) <= 100 and both.all_ids([]) == []


def test_links_are_joined_without_growing_broadcasts(spark, monkeypatch):
    """What grows with the documents never passes through the driver, however small Spark thinks it is; lists of bounded size may."""
    plans = []

    def noted(own):
        def run(spark, df, name):
            plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
            return own(spark, df, name)

        return run

    for module in (graph, ngram_join):
        monkeypatch.setattr(module, "materialize", noted(module.materialize))
    shown = [(k, " ".join(f"w{k // 3}x{i}" for i in range(30)) + (" end" if k % 3 == 2 else "")) for k in range(60)]
    out = ngram_join.one_of_each(spark, spark.createDataFrame(shown, "doc_id long, text string"))
    plans.append(("one_of_each", out._jdf.queryExecution().executedPlan().toString()))
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 60, 3))
    # Of the joins of these tables one has a list of bounded size: the frequent keys of equal sets.
    assert {n for n, p in plans if "BroadcastHashJoin" in p} <= {"links"}
    assert all(p.count("BroadcastHashJoin") <= 1 for n, p in plans), [(n, p.count("BroadcastHashJoin")) for n, p in plans]
    assert sum("SortMergeJoin" in p for n, p in plans if n.endswith("-edges")) >= 2
