import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import tables
from corpusloom.streaming import arrivals


def test_json_lines(spark, tmp_path):
    (tmp_path / "a_pairs.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "b_scored_pairs.jsonl").write_text('{"id": 3}\n')
    p = str(tmp_path / "a_pairs.jsonl")
    assert tables.json_lines(spark, p, "id long").count() == 2
    assert tables.json_lines_if_any(spark, [p, str(tmp_path / "none.jsonl")], "id long").count() == 2
    assert tables.json_lines_if_any(spark, [str(tmp_path / "none.jsonl")], "id long").count() == 0
    assert {r.file for r in tables.json_lines_matching(spark, str(tmp_path), "*_pairs.jsonl", "id long").collect()} == {"a_pairs.jsonl"}
    assert tables.preferred(spark, p) == p
    (tmp_path / "a_pairs_filtered.jsonl").write_text("")
    assert tables.preferred(spark, p).endswith("a_pairs_filtered.jsonl")


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n{"id":\n')
    with pytest.raises(Exception):
        tables.json_lines(spark, str(tmp_path / "x.jsonl"), "id long").collect()


def test_maps(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "k string, v string")
    tables.write_json_map(rows, str(tmp_path / "m"), "k", "v")
    assert {tuple(r) for r in tables.json_map(spark, str(tmp_path / "m")).collect()} == {("a", "x"), ("b", "y")}
    (tmp_path / "q.json").write_text(json.dumps({"q": ["c", "c", "d"]}))
    assert {tuple(r) for r in tables.json_relations(spark, str(tmp_path / "q.json")).collect()} == {("q", "c"), ("q", "d")}


def test_pages_and_whole_texts(spark, tmp_path):
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "doc string, page int, text string")
    assert tables.page_texts(pages).first()["text"] == "a\nb"
    (tmp_path / "t.txt").write_text(" a\nEND b")
    assert tables.whole_texts(spark, str(tmp_path / "t.txt"), "END").first()["text"] == "a"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 8.0), (2, 5.0)], "id long, s double")
    tables.write_kept_rejected_scored(spark, rows, str(tmp_path / "o"), F.col("s") >= 7, "s")
    assert spark.read.json(str(tmp_path / "o/kept")).columns == ["id"]
    assert spark.read.json(str(tmp_path / "o/scored")).count() == 2
    a, b = tables.write_versioned(rows, str(tmp_path / "v")), tables.write_versioned(rows, str(tmp_path / "v"))
    assert a != b


def test_stream_splits_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = '{"relevance": 8, "accuracy": 8, "clarity": 8, "specificity": 8, "overall": 8}'
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"pair_id": i, "reply": r}) for i, r in enumerate([good, "none"])))
    for _ in range(2):
        arrivals.split_by_score(arrivals.scored_replies(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert [r.pair_id for r in spark.read.parquet(str(tmp_path / "out/kept")).collect()] == [0]
    assert spark.read.parquet(str(tmp_path / "out/rejected")).count() == 1
