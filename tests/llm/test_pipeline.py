"""The pipeline's stages: schema, effect on planted rows, and run() as their composition."""

import random
from collections import Counter

from corpusloom.llm import language_id, ngram_join, runtime
from corpusloom.llm.queries import tokenizer_path
import corpus_pipeline


def table(rng):
    words = {"en": ["river", "stone", "window", "garden", "yellow", "market", "thunder", "pencil", "harbor", "silver"], "de": ["fluss", "stein", "fenster", "garten", "gelb", "markt", "donner", "stift", "hafen", "silber"]}
    say = lambda k, n: " ".join(rng.choice(words[k]) + str(rng.randrange(50)) for _ in range(n))
    rows = [(i, say(k := "de" if i % 3 == 0 else "en", 60), k, "s") for i in range(60)]
    item = say("en", 30)
    rows += [(100, rows[5][1], "en", "s"), (101, rows[7][1] + " and more", "en", "s"), (102, f"{say('en', 40)} {item} {say('en', 40)}", "en", "s"), (103, "12 34", "en", "s"), (104, None, None, None)]
    rows += [(200 + i, f"same line everywhere\n{say('en', 50)}", "en", "s") for i in range(12)]
    return [(*r, len(r[1] or "")) for r in rows], item


def test_pipeline(spark, tmp_path):
    rows, item = table(random.Random(8))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        seen.append({r.doc_id: r for r in docs.collect()})
    everything = {r[0] for r in rows}
    assert set(seen[0]) == everything - {103, 104}
    assert set(seen[1]) == set(seen[0])
    assert all("same line" not in r.text and r.n_chars == len(r.text) for i, r in seen[1].items() if i >= 200)
    assert set(seen[2]) == set(seen[1]) - {100, 101}
    assert set(seen[3]) == set(seen[2]) - {102}
    assert set(seen[4]) == set(seen[3]) and all(r.decoded for r in seen[4].values())
    assert tokenizer_path("piece_bpe_32k.model")
    assert {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[4]


def test_stages_judge_rows(spark, tmp_path):
    """Repeated rows, rows without an id, rows of equal ids and different texts, columns of other names, and an empty table."""
    say = lambda seed, k="en", n=40: " ".join(f"{w}{random.Random(f'{seed}{i}').randrange(90)}" for i, w in enumerate(random.Random(seed).choices({"en": ["river", "stone", "window"], "de": ["fluß", "größe", "gärten"]}[k], k=n)))
    one, two, three, item = say(1), say(2), say(3), say(4, n=30)
    rows = [(1, one), (1, one), (1, two), (None, three), (None, three), (2, two), (None, f"{three} {item}"), (3, item), (None, None), (4, ""), (None, one)]
    rows += [(50 + i, say(100 + i, "de" if i % 2 else "en")) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row long, c string, _doc string, first string, block int"
    docs = spark.createDataFrame([(i, t, "de" if t and "ß" in t else "en", None, None, 7, "c", None, "x", 1) for i, t in rows], schema)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    rest = [r for r in rows if (r[0] or 0) >= 50]

    near = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    # One of each text stays, that of the smallest id: texts of 40 words and of these with 30 more differ.
    assert texts(near) == sorted([(1, one), (1, two), (None, three), (None, f"{three} {item}"), (3, item), (None, None), (4, ""), *rest], key=repr)
    clean = corpus_pipeline.benchmark(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and texts(clean) == sorted([r for r in rows if item not in (r[1] or "")], key=repr)
    known = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert known.columns == docs.columns and texts(known) == sorted([r for r in rows if r[1]], key=repr)
    # A lettered text goes where the best language is not likely enough.
    mixed = " ".join(x for pair in zip(say(8).split(), say(9, "de").split()) for x in pair)
    lettered = docs.union(spark.createDataFrame([(90, mixed, None, None, None, 7, "c", None, "x", 1)], schema))
    scored = language_id.identify(spark, lettered).collect()
    top = max(r.score for r in scored)
    for lift in (1.2, 2 * top - 1e-9):
        want = [r.doc_id for r in scored if r.lang_pred != language_id.UNKNOWN and r.score >= lift / 2]
        assert Counter(r.doc_id for r in language_id.confident(spark, lettered, lift).collect()) == Counter(want)
    assert len(want) < len([r for r in rows if r[1]])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert texts(corpus_pipeline.lines(spark, docs, str(tmp_path))) == sorted(rows, key=repr)


def test_numbers_of_rows(spark, tmp_path, monkeypatch):
    """A table read from files, one made by more than reading, and one of too many files to list: equal verdicts, and numbers that no two rows share."""
    texts = [" ".join(f"{w}{i}" for i in range(12)) for w in ("a", "a", "b", "c", "c")] + [None, ""]
    made = spark.createDataFrame([(i % 4, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, number string").repartition(3)
    made.write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    kept = []
    for docs, limit in ((read, 100), (read.where("number = 'z'").repartition(2), 100), (read, 1)):
        monkeypatch.setattr(runtime, "FILES", limit)
        rows, path = runtime.numbered(spark, docs, "rows")
        assert (path is None) == (docs is read and limit == 100)
        assert len({r.number for r in rows.collect()}) == len(texts)
        assert len({r.number for r in runtime.numbered(spark, docs.union(docs), "rows")[0].collect()}) == 2 * len(texts)
        out = ngram_join.one_of_each(spark, docs)
        assert out.columns == docs.columns
        kept.append(sorted(((r.doc_id, r.text) for r in out.collect()), key=repr))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 5
