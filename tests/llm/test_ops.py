"""Each operator on rows with nulls, blanks, repeats, long texts and clashing columns, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontaminate, language_id, line_dedup, ngram_join, piece_lattice, quality_rules, token_counts, token_files, warc
from corpusloom.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, at long, d struct<x:int>, _doc string, first string"
BASE = "the quick brown fox jumps over the lazy dog while seven wizards mix potent brews under a pale moon tonight and dance"


def near(seed, swaps):
    rng = random.Random(seed)
    w = BASE.split()
    for _ in range(swaps):
        w[rng.randrange(len(w))] = f"word{rng.randrange(10**6)}"
    return " ".join(w)


def rows():
    texts = [None, "", "   \t\n", "One", "one two three", "ONE  two\nthree", BASE, BASE.upper(), near(1, 1), near(2, 2), near(3, 9), "x" * 70_000, "a b c d e f g h " * 2000, "12 34 !?", "ü é ß 中𝒳", "<s> <|endoftext|> \\### </turn>\x01\x00"]
    out = [(i, t) for i, t in enumerate(texts)] + [(6, BASE), (8, near(1, 1)), (None, BASE), (None, None), (-5, near(4, 1))]
    out += [(100 + i, f"Shared Line\nown {i} line\n shared line \n\n") for i in range(10)] + [(300, BASE), (301, BASE)]
    return [(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else "s", None, 1, 2, None, "x", "y") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_ngram_join(spark, docs, none):
    got = ngram_join.jaccard_components(spark, docs).collect()
    all_rows = [(r[0], grams(r[1])) for r in rows()]
    up = {i: i for i, _ in all_rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [r for r in all_rows if r[0] is not None]
    for a, (i, s) in enumerate(known):
        for j, t in known[:a]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    want = Counter((i, len(s), root(i) if i is not None else None) for i, s in all_rows)
    assert Counter(tuple(r) for r in got) == want
    assert ngram_join.jaccard_components(spark, none).count() == 0


def test_shared_counts():
    """A bucket's counts per flush and document against plain counting; only documents that share something are sent on."""
    rng = random.Random(2)
    entries = [sorted((rng.choice([0, 3, 40_000, ngram_join.MULTI]), rng.randrange(12)) for _ in range(n)) for n in (5, 1, 9, 4)]
    arrays = lambda k, t: [np.array([e[k] for e in x], t).tobytes() for x in entries]
    got = ngram_join._shared(pd.DataFrame({"part": 1, "seq": range(4), "tokens": arrays(1, np.uint32), "owners": arrays(0, np.uint16)}))
    times = Counter(t for x in entries for _, t in x)
    want = {i: Counter(o for o, t in x if times[t] > 1 and o != ngram_join.MULTI) for i, x in enumerate(entries)}
    read = lambda r: dict(zip(np.frombuffer(r.owners, np.uint16).tolist(), np.frombuffer(r.counts, np.uint32).tolist(), strict=True))
    assert {r.seq: read(r) for r in got.itertuples()} == {i: dict(c) for i, c in want.items() if c}
    alone = ngram_join._shared(pd.DataFrame({"part": [1], "seq": [0], "tokens": [np.arange(3, dtype=np.uint32).tobytes()], "owners": [np.zeros(3, np.uint16).tobytes()]}))
    assert not len(alone)
    twice = pd.concat([got, got]).query("seq == 0")
    total = ngram_join._summed(twice)["shared"].iloc[0]
    assert {i: n for i, n in enumerate(total) if n} == {i: 2 * n for i, n in want[0].items()}


def test_ngram_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 60)
    texts = [near(i, i % 4) for i in range(25)]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [grams(t) for t in texts]
    up = list(range(len(texts)))
    for _ in texts:
        for i in range(len(texts)):
            for j in range(len(texts)):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    up[i] = up[j] = min(up[i], up[j])
    assert got == dict(enumerate(up))


def test_language(spark, none):
    rng = random.Random(1)
    words = {"xx": ["zug", "kraft", "ober", "schiff"], "yy": ["lei", "amora", "cielo", "ventaja"]}
    table = [(i, " ".join(rng.choice(words[k]) for _ in range(rng.randint(5, 60))), k, None, None, 1, 2, None, "x", "y") for i, k in ((i, "xx" if i % 2 else "yy") for i in range(160))]
    table += [(900, None, "xx", None, None, 1, 2, None, "x", "y"), (901, "12 !?", "xx", None, None, 1, 2, None, "x", "y"), (902, "zug kraft schiff ober", None, None, None, 1, 2, None, "x", "y"), (None, "", None, None, None, 1, 2, None, "x", "y")]
    got = {r.doc_id: r for r in language_id.identify(spark, spark.createDataFrame(table, DOCS)).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    assert got[902].lang_pred == "xx"
    held = [i for i in range(160) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in range(160) if got[i].held_out} == set(held)
    assert sum(got[i].lang_pred == ("xx" if i % 2 else "yy") for i in held) >= 0.9 * len(held)
    assert language_id.identify(spark, none).count() == 0


def test_language_of_repeated_rows(spark):
    """Rows that repeat a document don't multiply what is learnt from; the same is learnt as from one of each."""
    table = [(i, ("zug kraft " if i % 2 else "lei cielo ") * 5, "xx" if i % 2 else "yy", None, None, 1, 2, None, "x", "y") for i in range(40)]
    again = [(3, "zug zug kraft", "xx", None, None, 1, 2, None, "x", "y")] * 30 + table[5:6] * 30
    rows = lambda t: spark.createDataFrame(t, DOCS).select("doc_id", "text", "lang")
    once, many = language_id.learn(rows(table)), language_id.learn(rows(table + again))
    assert once[0] == many[0] == ["xx", "yy"]
    for k, w in once[1].items():
        assert np.array_equal(w, many[1][k]), k


def test_gradients():
    """Backpropagation through time against differences."""
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in language_id.start_weights(2).items()}
    x = rng.integers(0, 256, (5, 3))
    grad = rng.normal(size=(5, language_id.HIDDEN, 3)).astype(np.float32)
    value = lambda: float((language_id._states(w["ef"], w["uf"], x)[0] * grad).sum())
    _, trace = language_id._states(w["ef"], w["uf"], x)
    de, du = language_id._back(w["ef"], w["uf"], x, trace, grad)
    for name, d, spots in (("ef", de, [(0, int(x[0, 0])), (9, int(x[2, 1])), (20, int(x[4, 2]))]), ("uf", du, [(0, 0), (10, 3), (23, 7)])):
        for s in spots:
            w[name][s] += 1e-3
            up = value()
            w[name][s] -= 2e-3
            assert math.isclose((up - value()) / 2e-3, d[s], rel_tol=2e-2, abs_tol=2e-3)
            w[name][s] += 1e-3


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want, start = [], 0
    for i, x in sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in token_files.token_files(spark, docs, tokenizer_path("byte_bpe_50k.json"), 2).collect())
    assert token_files.token_files(spark, none, tokenizer_path("byte_bpe_50k.json"), 2).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 1, 900], list(range(0, 100_000, 7)), [3] * 300 + [1 << 40]])
def test_elias_fano(values):
    e = token_files.EliasFano.of(np.array(values, np.int64))
    assert e.all().tolist() == values
    assert [x for k in range(-(-len(values) // token_files.SAMPLE)) for x in e.run(k).tolist()] == values
    assert [e[i] for i in range(0, len(values), max(1, len(values) // 50))] == values[:: max(1, len(values) // 50)]


def test_token_file_random_access(tmp_path):
    data = [np.array(x, "<u2").tobytes() for x in ([1, 2, 3], [], [4])]
    (tmp_path / "f").write_bytes(b"".join(token_files.pack_file([None, 3, 900], [3, 0, 1], data, 2)))
    f = token_files.TokenFile(str(tmp_path / "f"))
    assert [f.doc_id(i) for i in range(3)] == [None, 3, 900] and [f.tokens(i).tolist() for i in range(3)] == [[1, 2, 3], [], [4]]


def test_token_files_roll_over(spark, docs, tmp_path, monkeypatch):
    """Many small files give the offsets of one; a document longer than a file's size has its own."""
    whole = sorted(map(repr, token_files.token_files(spark, docs, tokenizer_path("byte_bpe_50k.json"), 2).collect()))
    monkeypatch.setattr(token_files, "FILE_IDS", 50)
    monkeypatch.setattr(token_files, "SAMPLE", 3)
    ids = [None, None, *range(7), 1 << 40]
    data = [np.arange(k % 4 + (60 if k == 5 else 0), dtype="<u2").tobytes() for k in range(len(ids))]
    (tmp_path / "f").write_bytes(b"".join(token_files.pack_file(ids, [len(x) // 2 for x in data], data, 2)))
    f = token_files.TokenFile(str(tmp_path / "f"))
    got = [(i, int(a), int(b)) for some, at in f.runs() for i, a, b in zip(some, at[:-1], at[1:], strict=True)]
    ends = np.cumsum([len(x) // 2 for x in data]).tolist()
    assert got == list(zip(ids, [0, *ends[:-1]], ends, strict=True)) and [f.doc_id(k) for k in range(len(f))] == ids

    def small(batches):
        token_files.FILE_IDS = 50
        yield from token_files._writer(str(tmp_path / "t"), tokenizer_path("byte_bpe_50k.json"), 2)(batches)

    source = docs.select("doc_id", "text").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = source.mapInArrow(small, token_files.MANIFEST).toPandas().sort_values(["part", "seq"])
    manifest["base"] = manifest["n_ids"].cumsum() - manifest["n_ids"]
    assert len(manifest) > 10
    assert sorted(map(repr, token_files.read_token_files(spark.createDataFrame(manifest), 2).collect())) == whole


def test_texts_that_may_be_cut():
    from corpusloom.llm import bpe_units

    rng = random.Random(9)
    alphabet = [*"ab1  \n.,'é×÷ßɏɐ·\x1c\t\r\x85\x01中-", "\u2028"]
    for _ in range(20_000):
        t = "".join(rng.choices(alphabet[: rng.choice([8, 14, len(alphabet)])], k=rng.randint(0, 7)))
        assert bpe_units.uncut(t) == (bpe_units._NEAR.search(t) is not None), repr(t)


def test_warc_has_a_dictionary_however_few_its_records():
    import io

    for n in (0, 1, 7):
        records = [warc.page_record(i, None, b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None) for i in range(n)]
        data = b"".join(warc.archive(records, warc.trained(records)))
        assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE and list(warc.frames(io.BytesIO(data))) == records


def test_warc_rolls_over(spark, monkeypatch, tmp_path):
    """Files of one task; the smallest page_id of a payload, given twice, is a response both times."""
    pages = spark.createDataFrame([(i % 50, f"http://h/{i}", "y" * 300 if i % 3 == 0 else f"{i} " * 90) for i in range(60)], "page_id long, url string, html string").coalesce(1)

    def small(batches):
        warc.FILE_BYTES = 2000
        yield from warc._writer(str(tmp_path / "w"))(batches)

    manifest = warc.with_revisits(pages).coalesce(1).mapInArrow(small, "path string, records long")
    rows = warc.read_archives(spark.createDataFrame(manifest.collect(), manifest.schema), 2).collect()
    assert len(list((tmp_path / "w").iterdir())) > 5 and len(rows) == 60
    assert {r.record_type for r in rows if r.page_id == 0} == {"response"}
    assert {(r.page_id, r.refers_to) for r in rows if r.record_type == "revisit"} == {(i % 50, 0) for i in range(0, 60, 3) if i % 50}


def test_token_counts(spark, docs, none):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = Counter((r[0], len((r[1] or "").encode()), n := len(p.encode(r[1] or "")), n > 4096) for r in rows())
    assert Counter(tuple(r) for r in token_counts.token_counts(spark, docs, tokenizer_path("piece_bpe_32k.model")).collect()) == want
    assert token_counts.token_counts(spark, none, tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_units_equal_libraries_on_random_strings():
    from corpusloom.llm import bpe_units

    rng = random.Random(7)
    alphabet = [*"ab  \n\n'sx.,!19\té中▁", "<|endoftext|>", "<s>", "　", "\x85", "\x1c", "'ll", "\r\n", "\x00", "\x01", "ß"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    b, c = bpe_units.load(tokenizer_path("byte_bpe_50k.json")), token_counts.load(tokenizer_path("piece_bpe_32k.model"))
    for t in texts:
        assert np.frombuffer(b.ids(t), b.dtype).tolist() == b.library.encode(t, add_special_tokens=False).ids
        assert c.count(t) == len(c.library.encode(t))


PAGES = [(1, "http://a", "x" * 200), (0, None, "x" * 200), (5, "u\r\nX: y", "x" * 200), (2, "b", "short"), (3, "c", "short"), (4, "d", None), (None, "e", "x" * 200), (7, "f", "\r\n\r\nWARC/1.1é" * 20), (1, "http://a", "x" * 200)]


def test_warc(spark):
    pages = spark.createDataFrame([(*p, 1, "z") for p in PAGES], "page_id long, url string, html string, size int, digest string")
    want = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        to = 0 if i not in (None, 0) and html == "x" * 200 else None
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to)] += 1
    assert Counter(tuple(r) for r in warc.archived_pages(spark, pages).collect()) == want
    assert warc.archived_pages(spark, pages.limit(0)).count() == 0


def test_warc_faults():
    import io

    records = [warc.page_record(i, "http://x", f"<p>{i} {'word ' * 50}</p>".encode(), hashlib.sha256(f"<p>{i} {'word ' * 50}</p>".encode()).hexdigest(), None) for i in range(60)]
    data = b"".join(warc.archive(records, warc.trained(records)))
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    assert list(warc.frames(io.BytesIO(data), 100)) == records
    for broken in (data[:-5], data[:10], data[:-30] + b"\0" * 30):
        with pytest.raises(warc.WarcError):
            list(map(warc.page_of, warc.frames(io.BytesIO(broken))))
    for wrong in (records[0].replace(b"word", b"wore", 1), records[0] + b"x", records[0].replace(b"WARC/1.1", b"WARC/9"), records[0].replace(b"WARC-Type", b"WARC-Tipe")):
        with pytest.raises(warc.WarcError):
            warc.page_of(wrong)


def test_decontamination(spark, none):
    rng = random.Random(2)
    common = ["the", "of", "and", "to", "in"]
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(15, 50)) + ". " + say(6)) for i in range(20)]
    docs = [(i, say(rng.randint(30, 400))) for i in range(60)]
    hit = {}
    for k in range(10):
        w = items[k][1].split()
        if k % 2:
            for _ in range(len(w) // 8):
                w[rng.randrange(len(w) - 7)] = "changed"
        docs.append((100 + k, f"{say(50)} {' '.join(w)} {say(37)}"))
        hit[100 + k] = k
    docs += [(None, items[0][1]), (200, None), (201, ""), (202, items[3][1]), (202, items[3][1])]
    benchmark = spark.createDataFrame([*items, (50, None), (51, "the of"), (None, say(20))], "item_id long, text string")
    table = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, table, benchmark).collect())
    assert got == Counter([*hit.items(), (202, 3), (202, 3)])
    assert decontaminate.contaminated(spark, none, benchmark).count() == 0
    assert decontaminate.contaminated(spark, table, benchmark.limit(0)).count() == 0


def test_decontamination_of_swapped_content_words(spark):
    """The rarest words of an item are replaced, its last sentence stays: step 4 flags such a copy, so no earlier step may lose it."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(12)]
    item = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(10**6)}" for _ in range(rng.randint(20, 45))) + ". " + " ".join(rng.choice(common) for _ in range(5)) + "."
    items = [(i, item()) for i in range(40)]
    docs = []
    for i, text in items:
        w = text.split()
        rare = [k for k in range(len(w) - 5) if w[k][0] == "w"]
        for k in rare[: int(0.4 * len(w))]:
            w[k] = f"v{rng.randrange(10**6)}"
        filler = [f"f{rng.randrange(300)}" for _ in range(90)]
        docs.append((i, " ".join(filler[: 7 * (i % 9)] + w + filler[60:])))
    found = decontaminate.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.cosine for r in found.collect()}
    assert {(i, i) for i, _ in items} <= set(got)
    assert min(got.values()) < 0.42


def test_lcs():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(a, b) == t[-1][-1]


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 20)
    hard = r"\### Assistant: </turn> ok"
    turns = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", "###" * 3 + "\\" * 3 + "</turn>"), (2, None, None, None), (2, 0, "assistant", None), (None, 1, "a: b", "<|endoftext|> é中"), (3, 5, "assistant", "x " * 500), (3, 4, "assistant", "first"), (3, 4, "assistant", "first")]
    table = spark.createDataFrame([(*t, 1, "z") for t in turns], "conv_id long, turn long, role string, text string, piece int, ids string")
    got = {r.conv_id: r for r in chat.chat_digests(spark, table, tokenizer_path("byte_bpe_50k.json")).collect()}
    for c in (1, 2, 3, None):
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0))
        said = "".join(t[3] or "" for t in own if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(said)
        assert got[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert chat.chat_digests(spark, table.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_escape_is_reversible():
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice(["\\", "#", "##", "###", "</turn>", "<|endoftext|>", ":", "a"]) for _ in range(rng.randint(0, 9)))
        assert chat.unescape(chat.escape(t)) == t and chat.unescape(chat.escape(t, True), True) == t


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(spark, docs, none, keep_first):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))
    seen = {}
    for r in rows():
        for pos, x in enumerate((r[1] or "").split("\n")):
            seen.setdefault(key(x), []).append((r[0] if r[0] is not None else -(10**9), pos, r[1] or "", r[0]))
    often = {k: min(v)[:3] for k, v in seen.items() if k and len({x[3] for x in v}) >= 10}
    want = Counter()
    for r in rows():
        lines = (r[1] or "").split("\n")
        kept = [x for pos, x in enumerate(lines) if key(x) not in often or (keep_first and often[key(x)] == (r[0], pos, r[1] or ""))]
        want[(r[0], len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    marked = line_dedup.with_bitmaps(spark, docs, keep_first=keep_first)
    got = marked.select("doc_id", "n_lines", "n_dropped", line_dedup.kept_text(F.col("text"), F.col("keep_runs")))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert line_dedup.with_bitmaps(spark, none).count() == 0


def test_lattice(spark, docs, none):
    got = piece_lattice.sampled_segmentations(spark, docs, tokenizer_path("piece_bpe_32k.model"), 3).collect()
    assert len(got) == len(rows()) and all(r.decoded for r in got)
    for r in got:
        assert len(set(r.ids)) == len(r.ids) and r.perturbed == sorted(r.perturbed, reverse=True) and all(x <= 0 for x in r.log_inclusion)
    assert [r.ids for r in got if r.doc_id == 6][0] == [r.ids for r in got if r.doc_id == 6][1]
    assert [list(r.ids) for r in got if r.doc_id == 1] == [[b""]]
    assert piece_lattice.sampled_segmentations(spark, none, tokenizer_path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("text", ["the", "ab to", "中"])
def test_samples_follow_the_lattice(text):
    """Frequencies of first and second samples, probabilities, and an unbiased total, against all segmentations."""
    v = piece_lattice.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    weight = {v.text_of[i]: x for i, x in enumerate(v.weight) if x < 0}

    def ways(s):
        return [((), 0.0)] if not s else [((s[:n], *t), weight[s[:n]] + x) for n in range(1, len(s) + 1) if s[:n] in weight for t, x in ways(s[n:])]

    every = ways("▁" + text.replace(" ", "▁"))
    z = sum(math.exp(x) for _, x in every)
    p = {a: math.exp(x) / z for a, x in every}
    n = 3000
    first, second, total = Counter(), Counter(), 0.0
    for ids, logs, _, inclusion in piece_lattice.sample_slice(v, [text] * n, list(range(n)), 2):
        found = [tuple(v.text_of[i] for i in np.frombuffer(x, "<u2")) for x in ids]
        assert all(math.isclose(math.log(p[a]), b, abs_tol=1e-9) for a, b in zip(found, logs, strict=True))
        first[found[0]] += 1
        second.update(found[1:])
        total += sum(math.exp(a - b) for a, b in zip(logs, inclusion, strict=True)) / n
    assert math.isclose(total, 1, abs_tol=0.02)
    for a in p:
        q = sum(p[b] * p[a] / (1 - p[b]) for b in p if b != a)
        assert abs(first[a] / n - p[a]) < 0.03 and (len(p) < 2 or abs(second[a] / n - q) < 0.03)


def base(text):
    words = (text or "").encode().split()
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    c = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if c[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(len(w.decode()) for w in words), sum(x in "#*$%&|<>" for x in text or ""), dup, len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words)


def test_quality_base(spark, docs, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality(spark, docs).collect())
    assert got == Counter((r[0], *base(r[1])) for r in rows())
    assert quality_rules.quality(spark, none).count() == 0


def test_quality_rejects_outliers(spark):
    """The concentration steps against numpy, and what they reject."""
    rng = random.Random(6)
    clean = [" ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(60)) for _ in range(120)]
    odd = [" ".join("#$%&*" + w for w in t.split()) for t in clean[:8]]
    table = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(clean + odd)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality(spark, table).collect()}
    assert all(got[i].kept for i in range(120)) and not any(got[i].kept for i in range(120, 128))
    s, floors = quality_rules.SCALE, np.array(quality_rules.FLOORS)

    def point(t):
        n, chars, symbols, dup, repeat, _ = base(t)
        rate = lambda a, b: math.log(1 + 1000 * a / max(b, 1))
        return [round(x * s) / s for x in (math.log(chars / n), rate(symbols, chars), rate(dup, 1), rate(repeat, n))]

    x = np.array([point(t) for t in clean + odd])
    mean, cov = x.mean(0), np.cov(x.T, bias=True) + np.diag(floors**2)
    for _ in range(quality_rules.STEPS):
        d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
        b = np.floor(quality_rules.BINS_PER_OCTAVE * np.log2(np.maximum(d, 1e-6)))
        edge = min(v for v in set(b) if 4 * (b <= v).sum() >= 3 * len(b))
        core = x[b <= edge]
        mean, cov = core.mean(0), np.cov(core.T, bias=True) * quality_rules.CONSISTENCY + np.diag(floors**2)
    d = np.einsum("ni,ij,nj->n", x - mean, np.linalg.inv(cov), x - mean)
    assert np.allclose([got[i].distance2 for i in range(128)], d, rtol=1e-6, atol=1e-9)


def test_quality_judges_small_groups(spark):
    """Groups too small for an estimate of their own are judged by their language's, small languages by that of all."""
    rng = random.Random(8)
    say = lambda: " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(60))
    odd = lambda: " ".join("#$%&*" + w for w in say().split())
    rows = [(i, say(), "en", "big") for i in range(60)] + [(100 + i, say(), "en", f"s{i % 5}") for i in range(20)] + [(200, odd(), "en", "s1"), (201, odd(), "en", None), (202, odd(), "xx", "s"), (203, say(), "xx", "s"), (204, odd(), None, None)]
    got = {r.doc_id: r for r in quality_rules.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows) and all(r.distance2 is not None for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == {200, 201, 202, 204}


def test_quality_rejects_each_statistic_alone(spark):
    """Documents that are odd only by repeated lines, or only by repeated words, go; a few repeats stay."""
    rng = random.Random(9)
    words = lambda n: ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(n)]
    lines = lambda own, marked: "\n".join(" ".join(words(6)) + ("\nabcde\nfedcb" if i < marked else "") for i in range(own))
    w = words(76)
    rows = [(i, lines(10, 0)) for i in range(80)] + [(100, lines(8, 8)), (101, lines(20, 2)), (102, " ".join(w + w[:12])), (103, " ".join(words(200) + w[:8] + words(90) + w[:8]))]
    table = spark.createDataFrame([(*r, "en", "s") for r in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality(spark, table).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [(got[i].n_dup_lines, got[i].n_repeat_words) for i in (100, 101, 102, 103)] == [(14, 0), (2, 0), (0, 24), (0, 16)]
    assert {i for i, r in got.items() if not r.kept} == {100, 102}


def brute_force(text, item):
    """The checks of step 4 over every span of a whole text, with a plain table for each."""
    a, b, answer = (t.lower().split() for t in (item, text, decontaminate.answer_of(item)))

    def lcs(x, y):
        row = [0] * (len(x) + 1)
        for w in y:
            last = 0
            for k, v in enumerate(x):
                last, row[k + 1] = row[k + 1], last + 1 if v == w else max(row[k + 1], row[k])
        return row[-1]

    span = len(a) + len(a) // 4 + 1
    for s in range(max(0, len(b) - span) + 1):
        share = lcs(a, b[s : s + span]) / len(a)
        if share >= decontaminate.LCS_SURE or share >= decontaminate.LCS_LIKELY and lcs(answer, b[s : s + span]) / len(answer) >= decontaminate.ANSWER:
            return True
    return False


def test_decontamination_equals_all_pairs(spark):
    """Paraphrases of every strength: what all pairs of texts and items give by plain checks, at least 0.9 of it, and nothing else."""
    rng = random.Random(11)
    common = ["the", "of", "and", "to", "in", "a"]
    say = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(800)}" for _ in range(n))
    items = [(i, f"{say(rng.randint(14, 30))}. {say(5)}.") for i in range(12)]
    docs = []
    for i in range(60):
        w = items[i % 12][1].split()
        for k in rng.sample(range(len(w) - 5), int(rng.choice([0, 0.1, 0.2, 0.3, 0.4, 0.5]) * len(w))):
            w[k] = say(1)
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), say(3))
        docs.append((i, f"{say(rng.randint(0, 40))} {' '.join(w)} {say(rng.randint(0, 40))}"))
    want = {(d, i) for d, text in docs for i, item in items if brute_force(text, item)}
    found = decontaminate.contaminated(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert 30 < len(want) < 60 and got <= want and len(got) >= 0.9 * len(want)


def test_decontamination_of_short_items_and_rows(spark):
    """Short items stand alone as a line or sentence; rows without an id, repeated rows and a very long text are judged by their text."""
    long = "filler words here " * 30_000
    docs = [(1, "One.\nWhat is two plus two?\nmore"), (2, "so what is two plus two? no"), (3, "Yes. what is two plus two? Four."), (None, "WHAT IS TWO PLUS TWO?"), (5, None), (5, "clean"), (5, "clean"), (6, f"{long}\nwhat is two plus two?\n{long}")]
    benchmark = spark.createDataFrame([(1, "What is two plus two?"), (1, "What is two plus two?"), (2, "")], "item_id long, text string")
    table = spark.createDataFrame([(i, t, {"a": 1}, t) for i, t in docs], "doc_id long, text string, m map<string,int>, item_id string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(spark, table, benchmark).collect()) == [(1, 1), (3, 1), (6, 1)]
    left = decontaminate.uncontaminated(spark, table, benchmark)
    assert left.columns == table.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter([docs[1], (5, None), (5, "clean"), (5, "clean")])
    assert decontaminate.uncontaminated(spark, table, benchmark.limit(0)).count() == len(docs)
    assert decontaminate.uncontaminated(spark, table.limit(0), benchmark).count() == 0


def test_quality_leaves_a_contaminated_start(spark, monkeypatch):
    """A fifth of a group, all odd alike, moves the classical estimate; the estimate of several starts rejects all of them, no less clearly than the classical start alone."""
    rng = random.Random(13)
    say = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(4, 6))) for _ in range(n))
    odd = lambda: say(50).replace("a", "aklm").replace("b", "b##").replace("c", "c$")
    texts = [say(60) for _ in range(96)] + [odd() for _ in range(24)]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.quality(spark, table).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == set(range(96, 120))
    far = min(got[i].distance2 for i in range(96, 120))
    monkeypatch.setattr(quality_rules, "_robust_starts", lambda points: quality_rules._estimates(points.withColumn("start", F.lit(1)), True))
    alone = {r.doc_id: r for r in quality_rules.quality(spark, table).collect()}
    assert far >= 0.999 * min(alone[i].distance2 for i in range(96, 120))


def test_least_determinant_of_the_starts(spark):
    k = [f"l{i}{j}" for i in range(4) for j in range(i + 1)]
    line = lambda start, source, d: (start, "=en", source, *[0.5 * start] * 4, *[d if c[1] == c[2] else 9.0 for c in k])
    rows = [line(0, "a", 2.0), line(1, "a", 1.0), line(2, "a", 3.0), line(0, "b", 1.0), line(1, "b", 1.0)]
    columns = ["start int", "g_lang string", "g_source string", *[f"m{i} double" for i in range(4)], *[f"{c} double" for c in k]]
    best = quality_rules._least(spark.createDataFrame(rows, ", ".join(columns))).collect()
    assert sorted(map(tuple, best)) == sorted([rows[1], rows[3]])


def test_partial_overlaps_sum_to_the_overlap():
    """Fragments cut at pivots of the order: what they count per pair sums to the intersection, for pairs of one group only."""
    import pandas as pd

    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    docs = [(int(i), int(i % 3), np.unique(rng.choice(pool, 60))) for i in rng.permutation(12)]
    size = 1 << 10
    counts = np.zeros(size, np.uint32)
    for _, _, s in docs:
        np.add.at(counts, ngram_join._slot(s, size), 1)
    rank = np.ceil(4 * np.log2(np.maximum(counts, 1).astype(float))).astype(np.uint8)
    cuts = ngram_join.pivots(rank, counts)
    assert cuts == sorted(cuts)

    class Held:
        value = rank.tobytes()

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [d[0] for d in docs], "component": [d[1] for d in docs], "grams": [d[2].tobytes() for d in docs]})
    parts = next(ngram_join._fragments(Held, cuts)(iter([batch]))).to_pandas()
    assert parts["fragment"].nunique() > 4
    summed = Counter()
    for _, g in parts.groupby("fragment"):
        for r in ngram_join.partial_overlaps(pd.DataFrame(g)).itertuples():
            summed[(r.i, r.j)] += r.partial
            assert (r.ni, r.nj) == tuple(len(next(s for i, _, s in docs if i == x)) for x in (r.i, r.j))
    want = {(a, b): n for a, x, s in docs for b, y, t in docs if a < b and x == y and (n := len(np.intersect1d(s, t)))}
    assert dict(summed) == want


def test_ngram_join_by_fragments_and_in_tasks(spark, monkeypatch):
    """Groups on both sides of PAIR_GROUP give the same components as when all are resolved one way."""
    rng = random.Random(21)
    texts = []
    for _ in range(12):
        w = [f"w{rng.randrange(10**6)}" for _ in range(40)]
        for _ in range(rng.choice([2, 3, 5, 25])):
            v = list(w)
            for _ in range(rng.randrange(4)):
                v[rng.randrange(40)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for most in (16, 1, 1000):
        monkeypatch.setattr(ngram_join, "PAIR_GROUP", most)
        found.append(sorted(map(tuple, ngram_join.jaccard_components(spark, docs).collect())))
    assert found[0] == found[1] == found[2] and 12 <= len({c for _, _, c in found[0]}) < len(texts)


def plain_network(w, data):
    """Mean probabilities of a text's bytes by the recurrences as they are written, a window and a position at a time."""
    total = np.zeros(len(w["c"]))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for a in range(0, len(data), language_id.WINDOW):
        part = data[a : a + language_id.WINDOW]
        sides = []
        for side, order in (("f", part), ("b", bytes(language_id.WINDOW - len(part)) + part[::-1])):
            e, u, n = w["e" + side].astype(float), w["u" + side].astype(float), language_id.HIDDEN
            h, states = np.zeros(n), []
            for x in order:
                i, r = e[:, x], u @ h
                keep, reset = sigmoid(i[:n] + r[:n]), sigmoid(i[n : 2 * n] + r[n : 2 * n])
                h = keep * h + (1 - keep) * np.tanh(i[2 * n :] + reset * r[2 * n :])
                states.append(h)
            sides.append(states if side == "f" else states[::-1][: len(part)])
        for f, b in zip(*sides, strict=True):
            logits = w["of"] @ f + w["ob"] @ b + w["c"][:, 0]
            p = np.exp(logits - logits.max())
            total += p / p.sum()
    return total / len(data)


def test_network_equals_plain_recurrences():
    rng = np.random.default_rng(5)
    w = {k: rng.normal(size=v.shape).astype(np.float32) * 0.5 for k, v in language_id.start_weights(3).items()}
    texts = ["a", "the quick brown fox", "größe und länge " * 9, "x" * language_id.WINDOW, "é中𝒳" * 40]
    import pyarrow as pa

    raw, offs = language_id.column_bytes(pa.array(texts))
    chance, _ = language_id.Network(w).documents(raw, offs)
    for t, got in zip(texts, chance, strict=True):
        assert np.allclose(got, plain_network(w, t.encode()), atol=2e-4), t


def test_query_of_lattices_equals_all_segmentations(spark):
    """The operator over words of documents: every segmentation of a short text, its probability by all ways, and as many samples as there are when few."""
    words = ["the", "aa", "ab to", "dé", "x1", "of a"]
    v = piece_lattice.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    weight = {v.text_of[i]: x for i, x in enumerate(v.weight) if x < 0}

    def ways(s):
        if not s:
            return [((), 0.0)]
        out = [((s[:n], *t), weight[s[:n]] + x) for n in range(1, len(s) + 1) if s[:n] in weight for t, x in ways(s[n:])]
        return out

    docs = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, text string")
    for r in piece_lattice.sampled_segmentations(spark, docs, tokenizer_path("piece_bpe_32k.model"), 40).collect():
        every = dict(ways("▁" + words[r.doc_id].replace(" ", "▁")))
        z = math.log(sum(map(math.exp, every.values())))
        got = {tuple(v.text_of[i] for i in np.frombuffer(x, "<u2")): p for x, p in zip(r.ids, r.log_prob, strict=True)}
        assert len(got) == len(r.ids) == min(40, len(every)) and r.decoded
        assert all(math.isclose(p, every[a] - z, abs_tol=1e-9) for a, p in got.items())
        assert r.perturbed == sorted(r.perturbed, reverse=True) and (len(every) > 40 or all(x == 0 for x in r.log_inclusion))
