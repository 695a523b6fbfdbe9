"""The operators against plain re-statements of their rules."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, components, pairs, reports, search, similarity, structure, vectors
from corpusloom.plans import legal


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "clean"), [("ge-\ngevens", "gegevens"), ("coördi-\n natie", "coördinatie"), ("a\n\n\n\nb", "a\n\nb"), ("  a 　", "a"), ("", "")])
def test_clean_page(spark, raw, clean):
    assert one(spark, T.clean_page(F.col("t")), t=raw) == clean


def test_footers_go_in_order(spark):
    assert one(spark, T.clean_page(F.col("t"), [r"(?m)^Page \d+$", "x"]), t="a\nPage 3\nxb") == "a\n\nb"


def test_sentences(spark):
    assert one(spark, T.sentences(F.col("t")), t="A b. C d; e\n\n\nF:  g ") == ["A b.", "C d;", "e", "F:", "g"]
    assert one(spark, T.sentences(F.col("t")), t="") == []


@pytest.mark.parametrize(
    ("reply", "payload"),
    [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` {"b": 2}', '{"a": 1}'), ('<think>{"z": 0}</think>so {"a": {"b": 1}} end', '{"a": {"b": 1}}'), ("  none ", "none")],
)
def test_json_payload(spark, reply, payload):
    assert one(spark, T.json_payload(F.col("t")), t=reply) == payload


@pytest.mark.parametrize(("payload", "queries"), [('{"queries": ["a", "b"], "x": 1}', ["a", "b"]), ('{"queries": ["a", 1]}', None), ('{"q": []}', None), ('{"queries": []}', []), ('{"queries": "a"}', None), ("{cut", None)])
def test_valid_queries(spark, payload, queries):
    assert one(spark, pairs.valid_queries(F.col("t")), t=payload) == queries


@pytest.mark.parametrize(("value", "ok"), [("7", True), ("7.0", True), ('"7"', True), ("true", True), ("7.5", False), ("0", False), ("11", False), ('"x"', False), ("null", False)])
def test_valid_scores(spark, value, ok):
    text = '{"relevance": %s, "accuracy": 5, "clarity": 5, "specificity": 5, "overall": 6.5}' % value
    assert (one(spark, pairs.valid_scores(F.col("t")), t=text) is not None) == ok


def test_render_keeps_braces_of_values(spark):
    assert one(spark, T.render("{{{a}}} {b}", {"a": F.lit("{b}"), "b": F.lit("x")})) == "{{b}} x"


def plain_pack(text, budget, overlap):
    """Sentences filled into chunks of at most budget tokens, each next one with the last sentences that fit the overlap."""
    parts = [p for s in re.split(r"(?<=[.;:])\s+|\n{2,}", text) if (p := s.strip())]
    out, start, opened = [], 0, 0
    size = lambda a, b: sum(len(p) // 4 for p in parts[a:b])
    for i in range(len(parts)):
        if i > opened and size(start, i + 1) > budget:
            out.append(" ".join(parts[start:i]))
            opened, start = i, next(j for j in range(start, i + 1) if size(j, i) <= overlap)
    return out + [" ".join(parts[start:])] if parts else out


def parsed(spark, text, source):
    """One text's chunks in order."""
    found = structure.chunked(spark.createDataFrame([(source.label, text)], "source string, text string"), [source])
    return [r.asDict() for r in found.orderBy("chunk_id").collect()]


def test_pack_equals_loop(spark):
    rng = random.Random(3)
    for budget, overlap in ((20, 5), (10, 0)):
        for _ in range(6):
            parts = ["w" * rng.choice([3, 8, 17, 40, 90]) for _ in range(rng.randint(0, 14))]
            assert one(spark, chunking.pack(F.array(*map(F.lit, parts)) if parts else F.array().cast("array<string>"), budget, overlap)) == plain_pack(". ".join(parts).replace(". ", "\n\n"), budget, overlap)


def test_merge_small():
    def c(tokens, kind="artikel", article=1, annex="", path="a > b"):
        return {"text": "x" * (tokens * 4), "tokens": tokens, "section_type": kind, "article_number": article, "annex_number": annex, "hierarchy_path": path}

    merged = chunking.merge_small([c(60), c(10, path="a > c")])
    assert [m["hierarchy_path"] for m in merged] == ["a > b + c"]
    assert [m["hierarchy_path"] for m in chunking.merge_small([c(10), c(60, annex="I", path="a > c")])] == ["b + a > c"]
    assert len(chunking.merge_small([c(960), c(45)])) == 2
    assert len(chunking.merge_small([c(60), c(10, article=2)])) == 2
    assert len(chunking.merge_small([c(60, article=None), c(10, article=None)])) == 1
    assert chunking.merge_small([]) == []


def test_greedy_equals_loop(spark):
    rng = random.Random(5)
    for _ in range(2):
        edges = sorted({(i, j) for i, j in ((rng.randrange(8), rng.randrange(8)) for _ in range(18)) if i < j})
        rows = [(i, j, rng.choice([0.3, 0.5, 0.7])) for i, j in edges]
        used, want = Counter(), set()
        for i, j, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if used[i] < 2 and used[j] < 2:
                used.update((i, j))
                want.add((i, j))
        got = similarity.greedy(spark, spark.createDataFrame(rows, "i long, j long, sim double")).collect()
        assert {(r.i, r.j) for r in got} == want


def test_no_text_twice_in_a_batch(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else str(i)) for i in range(100)], "row_id long, text string")
    got = chunking.batches_without_repeats(rows, "text", 10)
    assert got.count() == 100
    assert got.groupBy("batch", "text").count().where("count > 1").count() == 0


def test_negative_columns():
    assert vectors.negative_columns(["anchor", "positive", "negative_10", "negative_2"]) == ["negative_2", "negative_10"]
    with pytest.raises(ValueError):
        vectors.negative_columns(["anchor", "positive"])


def test_zero_vector_has_similarity_zero(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "qid long, vec array<float>")
    c = spark.createDataFrame([(2, [1.0, 0.0]), (3, [0.0, 1.0])], "cid long, vec array<float>")
    assert [(r.cid, r.sim) for r in vectors.top_k(q, c, 5, [2]).orderBy("rank").collect()] == [(2, 0.0), (3, 0.0)]


def test_metrics_without_a_hit_count_zero(spark):
    hits = spark.createDataFrame([(2, 1, 1, True), (2, 1, 2, False), (2, 2, 1, False)], "dim int, qid long, rank int, hit boolean")
    m = vectors.metrics(hits, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "qid long, n_rel int")).first()
    assert (m.ndcg_10, m.mrr_10, m.recall_1, m.precision_5) == (0.5, 0.5, 0.5, 0.1)


def test_encode_is_per_text(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, text string")
    v = {r.id: r.vec for r in vectors.encode(rows, vectors.hashed_vectors(4)).collect()}
    assert v[1] == v[3] != v[2]


def test_split_sizes(spark):
    rows = spark.createDataFrame([(i, "a" if i < 20 else "b") for i in range(21)], "id long, s string")
    held = pairs.eval_ids(rows, "id", stratum="s").join(rows, "id").groupBy("s").count().collect()
    assert {r.s: r["count"] for r in held} == {"a": 3, "b": 1}
    assert pairs.eval_ids(rows, "id").count() == 3


def test_best_takes_the_earliest_of_equals(spark):
    rows = spark.createDataFrame([("m", 1, 0.5), ("m", 2, 0.9), ("m", 3, 0.9)], "model string, step int, score double")
    assert tuple(reports.best(rows, ["model"], "step", "score").first()) == ("m", 2, 0.9)


def test_structure_of_eu_text(spark):
    rows = parsed(spark, legal.EU_TEXT, legal.SOURCES[0])
    assert rows[0]["text"].startswith("Overwegende dat dit de eerste overweging is, met gegevens.")
    assert [r["article_number"] for r in rows if r["section_type"] == "artikel"] == [1, 2, 3]
    assert rows[-1]["annex_number"] == "I" and [r["chunk_id"] for r in rows] == list(range(len(rows)))
    third = next(r for r in rows if r["article_number"] == 3)
    assert (third["chapter_number"], third["section"]) == ("HOOFDSTUK II", "")
    first = next(r for r in rows if r["article_number"] == 1)
    assert first["text"].endswith("Eerste afdeling")


def test_structure_of_law_text(spark):
    rows = parsed(spark, legal.LAW_TEXT, legal.SOURCES[1])
    assert [(r["article_number"], r["article_title"], r["section"]) for r in rows] == [(1, "Begrippen", "Paragraaf 1.1 — Begrippen"), (12, "Slot", "Paragraaf 1.1 — Begrippen")]
    assert all("Lasten" not in r["text"] for r in rows)


def test_long_article_is_cut_at_its_paragraphs(spark):
    body = "Inleiding hier.\n" + "\n".join(f"{i}.\n" + "woord " * 500 + "." for i in (1, 2, 3))
    rows = parsed(spark, f"HOOFDSTUK I\nX\nArtikel 1\n{body}\n", structure.Source("s", "S"))
    assert [r["paragraph_number"] for r in rows] == [1, 2, 3]
    assert rows[0]["text"].startswith("Inleiding hier.\n\n1.\nwoord")
    assert parsed(spark, "geen artikelen", structure.Source("s", "S")) == []


EU = structure.Source("s", "S", definitions_article=9, annexes=True)
LAW = structure.Source("w", "W", layout="law")
LONG = "woord " * 700 + "einde."


@pytest.mark.parametrize(
    ("source", "text", "want"),
    [
        # Chapter titles over several lines of capitals; a section's heading is none.
        (EU, "HOOFDSTUK I\nALGEMENE\nBEPALINGEN\nAfdeling 2\nEen deel\nArtikel 1\nTitel\nTekst.\n", [("HOOFDSTUK I — ALGEMENE BEPALINGEN > Afdeling 2 — Een deel > Artikel 1 — Titel", "Titel\nTekst.")]),
        (EU, "HOOFDSTUK I\nAFDELING 1\nArtikel 1\nTitel\n", [(" > Artikel 1 — Titel", "Titel")]),
        # Empty recitals and articles are passages too, which join their neighbours.
        (EU, "(1)\n(2) Tweede.\nArtikel 1\n", [("Overwegingen > (1) + (2)", "\n\nTweede."), (" > Artikel 1", "")]),
        # A number alone on its line marks a paragraph, numbers inside lines do not.
        (EU, f"Artikel 1\n1. a\n2. b\n{LONG}\n", [("", None)]),
        (EU, f"Artikel 1\nTitel\n1.\n{LONG}\n2.\nKort.\n", None),
        # Definitions: an introduction of its own, then items; without items there is nothing.
        (EU, "Artikel 9\n" + "inleiding " * 30 + "\n1)een;\n2) twee.\n", [(" > Artikel 9 — " + ("inleiding " * 30).strip() + " > Inleiding, 1, 2", ("inleiding " * 30).strip() + "\n\n1)een;\n\n2) twee.")]),
        (EU, "Artikel 9\nGeen items.\n", []),
        # An annex's title is in the path, not in the text.
        (EU, "BIJLAGE I\nLijst\nEen.\nBIJLAGE II\n\nTwee.\n", [("Bijlage I — Lijst + Bijlage II", "Een.\n\nTwee.")]),
        # A law: dots are needed, sections are paragraphs, letters stay in the path.
        (LAW, "Hoofdstuk 1 Zonder punt\nHoofdstuk 2. Met punt\nAfdeling 3. Geen deel\nArtikel 4a. Titel\nTekst.\n", [("Hoofdstuk 2 — Met punt > Artikel 4a — Titel", "Tekst.")]),
    ],
)
def test_structure_rules(spark, source, text, want):
    got = [(r["hierarchy_path"], r["text"]) for r in parsed(spark, text, source)]
    if want is None:
        assert [p for p, _ in got] == [" > Artikel 1 — Titel > Lid 1", " > Artikel 1 — Titel > Lid 2"] or got[0][0].startswith(" > Artikel 1 — Titel > Lid 1 (deel 1/")
    elif want and want[0][1] is None:
        assert got and all("Lid" not in p for p, _ in got)
    else:
        assert got == want


def test_long_preamble_is_packed(spark):
    rows = parsed(spark, "Wij. " * 2000 + "\nHoofdstuk 1. Een\nArtikel 1. T\nTekst.\n", LAW)
    assert [r["section_type"] for r in rows] == ["preambule"] * (len(rows) - 1) + ["artikel"] and len(rows) > 2
    assert rows[0]["context_header"] == f"W > Preambule (deel 1/{len(rows) - 1}):"


def test_groups_without_a_kind(spark):
    """Chunks of an empty or null kind are in no group of strategies 2 and 3."""
    rows = spark.createDataFrame([(i, "", i, k) for i, k in enumerate(["", "", None, None, "a", "a", "b"])], "chunk_id long, chapter string, article long, kind string")
    got = similarity.hop_groups(rows).collect()
    assert [(r.strategy, r.chunk_id) for r in sorted(got, key=lambda r: r.chunk_id)] == [(2, 4), (2, 5)]


def test_queries_without_hits_count(spark):
    hits = spark.createDataFrame([(2, 1, 1, True)], "dim int, qid long, rank int, hit boolean")
    m = vectors.metrics(hits, spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "qid long, n_rel int")).first()
    assert (m.recall_10, m.accuracy_1, m.ndcg_10) == (0.5, 0.5, 0.5)


def test_first_of_two_as_near(spark):
    rows = spark.createDataFrame([("m", "s", d, "x", float(d), q) for d, q in ((768, 1), (1280, 0), (2048, 2))], "model string, eval_set string, dim int, metric string, value double, seq int")
    assert reports.nearest_dimension(rows, 1024).first()["value"] == 1280
    assert reports.nearest_dimension(rows, 900).first()["value"] == 768


def test_pairs_need_two_groups(spark):
    weights = spark.createDataFrame([(1, "a", 2, 1.0), (2, "a", 2, 1.0)], "doc_id long, term string, df long, weight double")
    one = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, g string")
    assert similarity.cosine_pairs(spark, weights, one, 0.1, 1.0).count() == 0
    assert similarity.cosine_pairs(spark, weights, spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, g string"), 0.1, 1.0).count() == 1


def test_greedy_rounds_over_many_ends(spark):
    """Hubs with very many equal pairs, and chains that settle from one end."""
    rng = random.Random(6)
    rows = [(0, j, 0.8) for j in range(1, 200)] + [(1, j, 0.8) for j in range(2, 100)] + [(1000 + i, 1001 + i, 0.9 - i / 1000) for i in range(8)]
    rows += [(2000 + i, 2000 + j, rng.choice([0.3, 0.5, 0.7])) for i, j in sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(150)}) if i < j]
    for cap in (1, 3):
        used, want = Counter(), set()
        for i, j, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if used[i] < cap and used[j] < cap:
                used.update((i, j))
                want.add((i, j, s))
        assert {tuple(r) for r in similarity.greedy(spark, spark.createDataFrame(rows, "i long, j long, sim double"), cap).collect()} == want
    assert similarity.greedy(spark, spark.createDataFrame([], "i long, j long, sim double")).count() == 0


def test_first_entries_with_ties():
    import numpy as np

    rng = np.random.default_rng(3)
    for n, k in ((1, 3), (7, 3), (40, 10)):
        sim = rng.integers(0, 4, (6, n)).astype(float)
        row, col = vectors._first(sim, k)
        want = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        assert row.tolist() == np.repeat(np.arange(6), want.shape[1]).tolist() and col.tolist() == want.ravel().tolist()


def test_calls_are_bounded_and_repeated():
    import threading

    import pandas as pd

    lock, now, most, tries = threading.Lock(), [0], [0], Counter()

    def client(prompts):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            tries[prompts[0]] += 1
        try:
            threading.Event().wait(0.02)
            if prompts[0] == "bad" or (prompts[0] == "late" and tries["late"] < 2):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]
        finally:
            with lock:
                now[0] -= 1

    frame = pd.DataFrame({"p": ["a", "bad", "late", *"bcdefgh"]})
    out = next(chunking.in_batches(iter([frame]), client, "p", concurrent=3, attempts=2))
    assert out["content"].tolist() == ["A", None, "LATE", *"BCDEFGH"] and out["error"].tolist()[1] == "no" and tries["bad"] == 2
    assert 1 < most[0] <= 3
    assert next(chunking.in_batches(iter([frame[:1]]), lambda p: [], "p"))["error"].notna().all()


def test_row_cap_and_labels(spark):
    rows = spark.createDataFrame([(2, "x"), (1, "y"), (3, None)], "i long, k string")
    assert [sorted(r.i for r in chunking.first_rows(rows, "i", n).collect()) for n in (2, 0, None)] == [[1, 2], [1, 2, 3], [1, 2, 3]]
    assert [r.x for r in rows.orderBy("i").select(T.label_of(F.col("k"), {"x": "one"}, "rest").alias("x")).collect()] == ["rest", "one", "rest"]
    with pytest.raises(Exception, match="no label for y"):
        rows.where("k is not null").select(T.label_of(F.col("k"), {"x": "one"})).collect()


def test_dense_index_over_ranges(spark):
    rows = spark.createDataFrame([(i % 3 if i % 5 else None, (i * 37) % 101, i) for i in range(100)], "_part long, o long, i long")
    got = similarity.dense_index(rows, ["_part"], ["o"], "n").collect()
    for g in (0, 1, 2, None):
        own = sorted((r.o, r.n) for r in got if r._part == g)
        assert [n for _, n in own] == list(range(len(own)))
    assert similarity.dense_index(rows.limit(0), [], ["o"], "n").count() == 0


def brute(queries, corpus, k, dims):
    """dim, qid, cid, sim, rank by all pairs within sets."""
    import numpy as np

    out = set()
    for s, qid, v, cap in queries:
        for d in dims:
            norm = lambda x: np.array(x[:d], float) / max(np.linalg.norm(x[:d]), 1e-9)  # noqa: B023, E731
            found = sorted((-round(float(norm(v) @ norm(w)), 12), cid) for t, cid, w in corpus if s == t and s is not None and float(norm(v) @ norm(w)) <= cap + 1e-12)
            out |= {(s, d, qid, cid, -x, r + 1) for r, (x, cid) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize(("q_block", "c_block"), [(7, 16), (50, 5), (1000, 1000)])
def test_bounded_search_equals_all_pairs(spark, q_block, c_block, monkeypatch):
    """Sets of all sizes, rows in several, none or clustered; zero vectors, ties, caps, sets without queries or corpus, fewer rows than k."""
    import numpy as np

    monkeypatch.setattr(search, "PER_PIVOT", 12)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 8))
    vec = lambda i: [0.0] * 8 if i % 41 == 0 else [0.0] * 4 + [1.0] * 4 if i % 37 == 0 else [float(round(x, 2)) for x in centres[i % 8] + rng.normal(size=8) * 0.05]
    vecs = [vec(i) for i in range(260)]
    sets = lambda i: ["all", "odd" if i % 2 else None, "few" if i < 24 else "corpus only" if i % 5 else "all2"]
    corpus = [(s, i, vecs[i]) for i in range(200) for s in sets(i)]
    queries = [(s, i, vecs[i], 0.995 if i % 3 else 2.0) for i in range(200, 260) for s in ("all", "odd", "few", "queries only", None)]
    q = spark.createDataFrame(queries, "eval_set string, qid long, vec array<double>, cap double")
    c = spark.createDataFrame(corpus, "eval_set string, cid long, vec array<double>")
    hits, pairs_met = search.search(q, c, 15, [8, 4], "eval_set", q_block, c_block)
    rows = hits.collect()
    want = brute(queries, corpus, 15, [8, 4])
    assert {(r.eval_set, r.dim, r.qid, round(r.sim, 6) + 0.0, r["rank"]) for r in rows} == {(s, d, i, round(x, 6) + 0.0, n) for s, d, i, _, x, n in want}
    assert len(rows) == len(want)
    met = {r.eval_set: (r.n_pairs, r.n_met) for r in pairs_met.collect()}
    assert set(met) == {"all", "odd", "few"} and all(m <= n for n, m in met.values())
    if q_block == 7:
        assert met["all"][0] >= 9 * 13


def test_bounds_skip_blocks_of_clustered_rows(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(search, "PER_PIVOT", 20)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + rng.normal(size=32) * 0.02).tolist()) for i in range(800)]
    c, q = spark.createDataFrame(rows, "cid long, vec array<double>"), spark.createDataFrame(rows[:200], "qid long, vec array<double>")
    hits, met = search.search(q, c, 10, [32], query_block=20, corpus_block=40)
    n, m = met.select("n_pairs", "n_met").first()
    assert n == 10 * 20 and m < 0.3 * n
    plain, _ = search.search(q, c, 10, [32])
    key = lambda r: (r.qid, r.cid, r["rank"])
    assert set(map(key, hits.collect())) == set(map(key, plain.collect()))
    print(f"skipped pairs: {1 - m / n:.2f}")


def test_metrics_of_dimensions_and_sets_without_hits(spark):
    hits = spark.createDataFrame([("a", 4, 1, 1, True), ("a", 4, 1, 2, False), ("b", 4, 2, 1, False)], "s string, dim int, qid long, rank int, hit boolean")
    relevant = spark.createDataFrame([("a", 1, 2), ("a", 9, 1), ("b", 2, 1), ("c", 3, 1), ("d", 4, 0), (None, 5, 1)], "s string, qid long, n_rel long")
    got = {(r.s, r.dim): (r.accuracy_1, r.recall_10) for r in vectors.metrics(hits, relevant, [4, 2], "s").collect()}
    assert got == {("a", 4): (0.5, 0.25), ("a", 2): (0.0, 0.0)} | {(s, d): (0.0, 0.0) for s in "bc" for d in (4, 2)}
    none = vectors.metrics(hits.where("false").drop("s"), relevant.drop("s"), [4, 2]).collect()
    assert {(r.dim, r.ndcg_10) for r in none} == {(4, 0.0), (2, 0.0)}
    assert vectors.metrics(hits.drop("s"), relevant.where("false").drop("s"), [4]).count() == 0


def united(edges):
    """The smallest node that each node can reach."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(8)
    chain = [(f"n{i:04}", f"n{i + 1:04}") for i in range(0, 300)]
    star = [("hub", f"leaf{i:04}") for i in range(2000)]
    loose = [(f"x{rng.randrange(80)}", f"y{rng.randrange(80)}") for _ in range(70)]
    edges = chain + star + loose + [("self", "self"), ("n0005", "n0005")]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(edges, "u string, v string").repartition(4)).collect()}
    assert got == {x: r for x, r in united(edges).items() if x != "self"}
    assert components.components(spark, spark.createDataFrame([], "u string, v string")).count() == 0


def test_split_by_components_leaks_nothing(spark):
    """A text of a third of all rows, texts with several chunks, rows without a text, a chunk, a stratum, and repeated rows."""
    rng = random.Random(2)
    rows = [("hot", f"h{i}", "a") for i in range(300)]
    rows += [(f"q{rng.randrange(500)}", f"c{rng.randrange(900)}", rng.choice(["a", "b", None, "lone"]) if i else "lone") for i in range(700)]
    rows += [(None, f"only{i}", "b") for i in range(20)] + [(f"t{i}", None, "b") for i in range(20)] + [(None, None, "b"), ("", "", "b")] + [("solo", "s1", "one"), ("solo", "s2", "one")]
    rows = [(i, *r, "extra") for i, r in enumerate(rows)] + [(5, "hot", "h5", "a", "extra")]
    frame = spark.createDataFrame(rows, "seq long, text string, chunk string, stratum string, weight string").repartition(3)
    got = components.split_components(frame, "text", "chunk", "stratum", ["seq"]).collect()
    assert Counter((r.seq, r.text, r.chunk, r.stratum, r.weight) for r in got) == Counter(rows)
    for side in ("text", "chunk"):
        parts = {}
        for r in got:
            if r[side] is not None:
                parts.setdefault(r[side], set()).add(r.part)
        assert all(len(p) == 1 for p in parts.values())
    assert {r.part for r in got if r.text == "hot"} == {"train"} and {r.part for r in got if r.text == "solo"} == {"train"}
    assert {r.part for r in got if r.text is None and r.chunk is None} == {"train"}
    # Components are those of a plain union; first rows give strata; shares are within the stated bounds.
    own = united([("c" + c, t) for _, t, c, *_ in rows if t is not None and c is not None])
    comp, first, chunks, part = {}, {}, {}, {}
    for r in sorted(got, key=lambda r: r.seq):
        if r.component is not None:
            first.setdefault(r.component, r.stratum)
            chunks.setdefault(r.component, set()).add(r.chunk)
            part.setdefault(r.component, set()).add(r.part)
            comp.setdefault(r.component, own.get("c" + r.chunk) if r.chunk is not None and r.text is not None else None)
    assert all(len(p) == 1 for p in part.values())
    named = [x for x in comp.values() if x is not None]
    assert len(named) == len(set(named))
    weight = {k: max(1, len(v - {None})) for k, v in chunks.items()}
    for s in set(first.values()):
        mine = [k for k in first if first[k] == s]
        room = int(sum(weight[k] for k in mine) * 0.15)
        held = sum(weight[k] for k in mine if part[k] == {"eval"})
        small = [weight[k] for k in mine if weight[k] <= max(1, room // 5)]
        if s != "one":
            assert held <= max(1, room)
            if sum(small) >= room:
                assert held >= room - max(1, room // 5)


def test_running_sum_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), i, rng.randrange(5)) for i in range(3000)]
    got = components.running_sum(spark.createDataFrame(rows, "g string, i long, v long"), "g", ["i"], "v", "sum").collect()
    total, want = Counter(), set()
    for g, i, v in rows:
        total[g] += v
        want.add((g, i, v, total[g]))
    assert {(r.g, r.i, r.v, r["sum"]) for r in got} == want


@pytest.mark.parametrize("block", [4, 1000])
def test_postings_of_a_term_in_half_of_all_documents(spark, block):
    rng = random.Random(3)
    docs = {}
    for i in range(120):
        words = {f"t{rng.randrange(12)}" for _ in range(3)} | {f"u{i // 4}"} | ({"everywhere"} if i % 2 else set())
        weights = {w: rng.random() + (1.5 if w[0] == "u" and i % 3 else 0.1) for w in words}
        norm = sum(x * x for x in weights.values()) ** 0.5
        docs[i] = {w: x / norm for w, x in weights.items()}
    df = Counter(w for d in docs.values() for w in d)
    frame = spark.createDataFrame([(i, w, df[w], x) for i, d in docs.items() for w, x in d.items()], "doc_id long, term string, df long, weight double")
    groups = {i: f"g{i % 5}" for i in docs}
    by = spark.createDataFrame(list(groups.items()), "doc_id long, g string")
    got = {(r.i, r.j, r.gi, r.gj): r.sim for r in similarity.cosine_pairs(spark, frame, by, 0.25, 0.85, block).collect()}
    want = {}
    for i in docs:
        for j in range(i + 1, 120):
            sim = sum(x * docs[j].get(w, 0.0) for w, x in docs[i].items())
            if groups[i] != groups[j] and 0.25 <= sim <= 0.85:
                want[i, j, groups[i], groups[j]] = sim
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    index = similarity.postings(spark, frame, by, 0.25, block)
    assert all(r["count"] <= 2 * block for r in index.groupBy("term", "x", "y").count().collect())
    if block == 4:
        # Blocks of light weights do not meet.
        n = index.where("term = 'everywhere'").select("block").distinct().count()
        assert n >= 5 and index.where("term = 'everywhere'").select("x", "y").distinct().count() < n * (n + 1) // 2


def test_structure_of_random_texts_equals_loops(spark):
    """Headings, marks, long and empty bodies, footers and end marks in any order, in both layouts; several documents of a source, null and unknown ones."""
    import plain_structure

    rng = random.Random(11)
    long = "woord " * 300 + "einde. "
    eu = ["HOOFDSTUK I\n", "HOOFDSTUK II\n", "ALGEMENE BEPALINGEN\n", "SLOT ÉN\nMEER\n", "Afdeling 1\n", "Eerste  afdeling\n", "Afdeling 2\nTweede\n", "Artikel 1\n", "Artikel 2\n", "Artikel 9\n", " Artikel 3\n", "Titel hier\n", "Tekst. Nog een zin; en meer.\n"]
    eu += ["(1)\n", "(2) Tweede.\n", "(1) Een weer\n", "1.\n", "2.\n", "3. geen\n", f"{long}\n", f"{long * 3}\n", "1) een;\n", "2) twee.\n", "3)drie\n", "BIJLAGE I\n", "BIJLAGE II\nLijst\n", "BIJLAGE III \n\nX\n", "ge-\ngeven\n", "\n", "\n\n\n", "pagina 3\n", "einde der\n", "é𝒳 teken\n"]
    law = ["Hoofdstuk 1. Een\n", "Hoofdstuk 2. Twee  woorden\n", "Paragraaf 1.1. Deel\n", "Paragraaf 2. D\n", "Artikel 1. T\n", "Artikel 4a. Titel x\n", "Artikel 5 zonder\n", "Wij, preambule. " * 20 + "\n", "tekst.\n", "1.\tlid een\n", "2.\tlid twee\n", f"{long * 4}\n", "pagina 4\n", "einde der\n", "\n"]
    sources = [
        structure.Source("e", "E", footers=(r"(?m)^pagina \d+$",), definitions_article=9, annexes=True),
        structure.Source("w", "W", layout="law", footers=(r"pagina \d+\n",), end_marker="einde der"),
        structure.Source("f", "F", end_marker="einde der"),
    ]
    docs = [(i, k, "".join(rng.choice(law if k == "w" else eu) for _ in range(rng.randrange(16)))) for i, k in enumerate(rng.choice("eewf") for _ in range(150))]
    docs += [(900, "e", None), (901, "other", "x"), (902, "w", "")]
    got = {}
    for r in structure.chunked(spark.createDataFrame(docs, "id long, source string, text string").repartition(3), sources, "id").collect():
        got.setdefault(int(r.id), []).append(r.asDict())
    known = {s.label: s for s in sources}
    columns = [c.split()[0] for c in structure.CHUNK.split(", ")]
    for i, k, text in docs:
        want = [{c: r.get(c) for c in columns} for r in plain_structure.passages(text or "", known[k])] if k in known else []
        assert [{c: r[c] for c in columns} for r in sorted(got.get(i, []), key=lambda r: r["chunk_id"])] == want


def test_pairs_of_blocks_grow_with_what_is_found(spark):
    """Documents that all share terms and are hardly alike: what leaves the tasks are the pairs in the band, in blocks of any size, and the histogram counts them in the tasks."""
    rng = random.Random(9)
    docs = {i: {f"t{k}": rng.random() * (0.2 if k < 8 else 1.0) for k in [*range(8), *rng.sample(range(8, 60), 5)]} for i in range(90)}
    docs = {i: {t: x / sum(v * v for v in d.values()) ** 0.5 for t, x in d.items()} for i, d in docs.items()}
    df = Counter(t for d in docs.values() for t in d)
    frame = spark.createDataFrame([(i, t, df[t], x) for i, d in docs.items() for t, x in d.items()], "doc_id long, term string, df long, weight double")
    groups = {i: None if i == 7 else f"g{i % 4}" for i in docs}
    by = spark.createDataFrame(list(groups.items()), "doc_id long, g string")
    sims = {(i, j): sum(x * docs[j].get(t, 0.0) for t, x in docs[i].items()) for i in docs for j in docs if i < j and None not in (groups[i], groups[j]) and groups[i] != groups[j]}
    want = {p: s for p, s in sims.items() if 0.4 <= s <= 0.7}
    assert 50 < len(want) < len(sims) / 2
    for block in (7, 40, 8192):
        got = similarity.cosine_pairs(spark, frame, by, 0.4, 0.7, block)
        rows = got.collect()
        assert {(r.i, r.j): round(r.sim, 9) for r in rows} == {p: round(s, 9) for p, s in want.items()} and len(rows) == len(want)
        assert all((r.gi, r.gj) == (groups[r.i], groups[r.j]) for r in rows)
        counts = similarity.pair_histogram(spark, frame, by, 0.4, 0.7, block)
        assert {(r.a, r.b): r.n for r in counts.collect()} == Counter(tuple(sorted((groups[i], groups[j]))) for i, j in want)
    # No candidates are joined with their terms.
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString().split("FlatMapGroupsInArrow")[0]


def test_small_blocks_grow_with_the_input(spark):
    """Pairs of blocks of a fixed small size grow as the square of the rows; results do not depend on the size."""
    import numpy as np

    assert [search.grown(n, 64, 8192) for n in (10, 4096, 6400, 10**6, 10**8)] == [64, 64, 100, 8192, 8192] and search.grown(10**6, 20_000, 8192) == 20_000
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1300)]
    c, q = spark.createDataFrame(rows, "cid long, vec array<double>"), spark.createDataFrame(rows[:400], "qid long, vec array<double>")
    hits, met = search.search(q, c, 3, [8], query_block=2, corpus_block=5)
    assert met.first()["n_pairs"] <= search.SMALL_BLOCKS**2
    key = lambda r: (r.qid, r.cid, r["rank"])
    assert set(map(key, hits.collect())) == set(map(key, search.search(q, c, 3, [8])[0].collect()))


def test_a_pair_of_blocks_is_bounded(monkeypatch):
    """A full block of queries at three dimensions and 100 rows each: rows that are returned, and what the products take beside them."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    frame = lambda name, n: pd.DataFrame({name: np.arange(n), "vec": list(rng.normal(size=(n, 64)).astype(np.float32))})
    q, c = frame("qid", search.QUERY_BLOCK), frame("cid", search.CORPUS_BLOCK)
    tracemalloc.start()
    out = search._best((64, 32, 16), 100)(("",), q, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 3 * 100 * len(q) and peak < 150e6


def test_a_worker_holds_columns_and_tiles():
    """What a full pair of blocks sends on is held once, as Arrow's columns, and pivots are met by some rows of a batch at a time, so that neither grows with a batch or with the number of pivots."""
    import tracemalloc

    import numpy as np
    import pandas as pd
    import pyarrow as pa

    def peak(run):
        tracemalloc.start()
        arrow = pa.total_allocated_bytes()
        out = run()
        most = tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - arrow
        tracemalloc.stop()
        return out, most

    rng = np.random.default_rng(2)
    frame = lambda name, n: pd.DataFrame({name: np.arange(n), "vec": list(rng.normal(size=(n, 64)).astype(np.float32))})
    q, c = frame("qid", search.QUERY_BLOCK), frame("cid", search.CORPUS_BLOCK)
    out, most = peak(lambda: search._best((64, 32, 16), 100)(("",), q, c))
    assert len(out) == 3 * 100 * len(q) and most < 60e6
    pivots, rows = rng.normal(size=(search.PIVOTS, 64)), frame("cid", 10_000)
    (placed,), most = peak(lambda: list(search._placed(pivots, (64, 16))([rows])))
    left, right = search.unit(search._stacked(rows), 64), search.unit(pivots, 64)
    assert (left * right[placed["pivot"]]).sum(axis=1) == pytest.approx((left @ right.T).max(axis=1)) and most < 40e6


def test_greedy_by_lists_equals_a_loop(spark):
    """Lists of a few pairs, filled again where they did not last, choose what a loop over all pairs does; only lists are written."""
    rng = random.Random(12)
    weights, groups = [], []
    for d in range(90):
        terms = rng.sample(range(12), 4)
        w = [rng.choice([0.2, 0.5, 0.9]) for _ in terms]
        n = sum(x * x for x in w) ** 0.5
        weights += [(d, f"t{t}", 5, x / n) for t, x in zip(terms, w, strict=True)]
        groups.append((d, rng.choice("xyz")))
    frame, by = spark.createDataFrame(weights, "doc_id long, term string, df long, weight double"), spark.createDataFrame(groups, "doc_id long, g string")
    pairs = similarity.cosine_pairs(spark, frame, by, 0.25, 0.85).collect()
    for cap, keep, block in ((2, 4, 50),):
        used, want = Counter(), set()
        for r in sorted(pairs, key=lambda r: (-r.sim, r.i, r.j)):
            if used[r.i] < cap and used[r.j] < cap:
                used.update((r.i, r.j))
                want.add((r.i, r.j))
        got = similarity.greedy_pairs(spark, frame, by, 0.25, 0.85, cap, block, keep).collect()
        assert len(got) == len(want) and {(r.i, r.j) for r in got} == want
    assert similarity.greedy_pairs(spark, frame, by.where("g = 'x'"), 0.25, 0.85).count() == 0


def test_documents_are_merged_as_they_pass(spark, monkeypatch):
    """No call of Python for each document: a task's documents pass through it in order, cut by no batch."""
    monkeypatch.setattr(chunking, "MERGED_ROWS", 5)
    rng = random.Random(14)
    rows = [(f"d{d}", p, "x" * n, n // 4, rng.choice("aab"), rng.choice([None, 1]), "", f"r > {p}") for d in range(40) for p in range(rng.randrange(1, 12)) for n in [rng.choice([8, 60, 400])]]
    rows.append((None, 0, "alone", 1, "a", None, None, "r"))
    names = [c.split()[0] for c in chunking.MERGED.split(", ")]
    want = set()
    for d in {r[0] for r in rows}:
        own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == d]
        want |= {tuple((r | {"pos": i}).values()) for i, r in enumerate(chunking.merge_small(own))}
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), chunking.MERGED).repartition(3)
    got = chunking.merged(shuffled)
    assert {tuple(r) for r in got.collect()} == want
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_in_pieces(monkeypatch):
    """Terms of several texts of a document, in pieces of a few words, against plain counts; no pair crosses two texts."""
    import pyarrow as pa

    rng = random.Random(15)
    docs = [(k, [[rng.choice("aä bb ccc dd".split()) for _ in range(rng.randrange(9))] for _ in range(rng.randrange(3))]) for k in range(30)] + [(99, None), (100, [[], ["aä"], []])]
    want = Counter()
    for d, texts in docs:
        for w in texts or []:
            want.update((d, t) for t in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "words": pa.array([t for _, t in docs], pa.list_(pa.list_(pa.string())))})
    for words in (1, 10, 10_000):
        monkeypatch.setattr(similarity, "WORDS", words)
        rows = [r for b in similarity._counted(iter([batch, batch.slice(0, 0)])) for r in b.to_pylist()]
        assert len(rows) == len(want) and {(r["doc_id"], r["term"]): r["tf"] for r in rows} == want


def test_pairs_of_blocks_are_met_without_a_copy_for_each(spark):
    """Tiles are dealt once and read by the tasks of their pairs; a shuffle by pairs of blocks would write each as often as there are blocks."""
    import numpy as np

    rng = np.random.default_rng(5)
    w = rng.random((64, 12)) * (rng.random((64, 12)) < 0.4)
    w[:, 0] = 0.1
    w /= np.sqrt((w**2).sum(1))[:, None]
    frame = spark.createDataFrame([(i, f"t{k}", 5, float(w[i, k])) for i in range(64) for k in range(12) if w[i, k]], "doc_id long, term string, df long, weight double")
    by = spark.createDataFrame([(i, "xyz"[i % 3]) for i in range(64)], "doc_id long, g string")
    want = {(i, j) for i in range(64) for j in range(i + 1, 64) if i % 3 != j % 3 and 0.25 <= round(float(w[i] @ w[j]), 12) <= 0.85}
    pairs = similarity.cosine_pairs(spark, frame, by, 0.25, 0.85, 8)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning" not in plan, plan
    assert {(r.i, r.j) for r in pairs.collect()} == want and pairs.count() == len(want)
    assert sum(r.n for r in similarity.pair_histogram(spark, frame, by, 0.25, 0.85, 8).collect()) == len(want)
