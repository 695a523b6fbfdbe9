"""Batches, losses, resumed calls, binary pages and versioned results against plain re-statements."""

import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import calls, training
from corpusloom.sources import json_maps, tables, versions


@pytest.mark.parametrize("size", [1, 7, 64])
def test_full_batches(spark, size):
    rng = random.Random(size)
    texts = ["hot"] * 40 + [f"t{rng.randrange(60)}" for _ in range(150)] + [None] * 30 + [""] * 3
    rng.shuffle(texts)
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row_id long, text string, batch string").repartition(3)
    got = training.full_batches(frame.drop("batch"), "text", size).collect()
    assert Counter((r.row_id, r.text) for r in got) == Counter(enumerate(texts))
    sizes = Counter(r.batch for r in got)
    assert len(sizes) == max(-(-len(texts) // size), 40) and max(sizes.values()) <= size and max(sizes.values()) - min(sizes.values()) <= 1
    assert max(Counter((r.batch, r.text) for r in got if r.text is not None).values()) == 1
    assert training.full_batches(frame.limit(0).drop("batch"), "text", size).count() == 0


def test_contrastive_loss_in_chunks(spark):
    """A running maximum and sum give the loss of the whole matrix, with hard negatives, repeated and zero vectors, and similarities of both signs."""
    rng = np.random.default_rng(2)
    vec = lambda: rng.normal(size=8).tolist()
    rows = [(b, vec(), vec(), [vec() for _ in range(k % 3)]) for b, n in ((0, 5), (1, 1), (2, 11)) for k in range(n)]
    rows.append((2, [0.0] * 8, rows[-1][2], None))
    frame = spark.createDataFrame(rows, "batch long, anchor array<double>, positive array<double>, negatives array<array<double>>")
    want = {}
    for b in (0, 1, 2):
        mine = [r for r in rows if r[0] == b]
        for d in (8, 3):
            norm = lambda x: np.array([np.array(v[:d]) / max(np.linalg.norm(v[:d]), 1e-9) for v in x])  # noqa: B023, E731
            s = 20 * norm([r[1] for r in mine]) @ norm([r[2] for r in mine] + [v for r in mine for v in r[3] or []]).T
            want[b, d] = float(np.mean(np.log(np.exp(s).sum(axis=1)) - np.diag(s)))
    for chunk in (1, 4, 1000):
        losses = training.contrastive_losses(frame, [8, 3], chunk=chunk)
        got = {(r.batch, r.dim): r.loss for r in losses.collect()}
        assert got == pytest.approx(want, abs=1e-9)
    total = training.weighted_loss(losses, {8: 1.0, 3: 0.5}).first()
    assert total.n_batches == 3 and total.loss == pytest.approx(np.mean([want[b, 8] + 0.5 * want[b, 3] for b in (0, 1, 2)]))


def test_steps():
    assert training.steps(1000, 16, 4, 3) == {"rows_per_step": 64, "in_batch_negatives": 15, "steps_per_epoch": 15, "steps": 45}


def counting(folder, fails=(), stop=None):
    """A client that leaves a file for each call, fails for some prompts and ends its task at one of them."""

    def client(prompt):
        import uuid
        from pathlib import Path

        Path(folder, f"{prompt}-{uuid.uuid4().hex}").touch()
        if prompt == stop:
            raise SystemExit("the task is gone")
        if prompt in fails:
            raise TimeoutError("busy")
        return None if prompt == "null" else prompt.upper()

    return client


def asked(folder):
    return Counter(p.name.split("-")[0] for p in folder.iterdir())


def test_calls_are_resumed(spark, tmp_path):
    """A run that is stopped half-way and started again asks for nothing twice that was answered; copies and nulls are not asked for."""
    seen = [tmp_path / f"seen{i}" for i in range(3)]
    for s in seen:
        s.mkdir()
    prompts = spark.createDataFrame([(i, f"p{i % 30}" if i < 60 else None) for i in range(63)], "id long, prompt string")
    store = str(tmp_path / "store")
    with pytest.raises(Exception, match="task is gone"):
        calls.ask(spark, prompts, store, counting(str(seen[0]), stop="p17"), limit=1, tasks=1)
    kept = {r.digest for r in calls.kept_replies(spark, store).collect()}
    assert 0 < len(kept) < 30 and len(kept) + 1 == len(asked(seen[0]))
    second = calls.ask(spark, prompts, store, counting(str(seen[1]), fails={"p3", "p4"}), limit=6, attempts=2).collect()
    again = asked(seen[1])
    done = set(asked(seen[0])) - {"p17"}
    assert not done & (set(again) - {"p3", "p4"}) and set(again) | done == {f"p{i}" for i in range(30)}
    failed = {r.digest for r in second if r.error == "busy"}
    assert all(r.attempts == 2 for r in second if r.error) and len(failed) == len({"p3", "p4"} - done)
    calls.ask(spark, prompts, store, counting(str(seen[2])), limit=4, flush=100)
    assert set(asked(seen[2])) == {"p3", "p4"} - done
    replies = {(r.id, r.prompt): r.reply for r in calls.answered(prompts, "prompt", store).collect()}
    assert replies == {(i, f"p{i % 30}" if i < 60 else None): f"P{i % 30}" if i < 60 else None for i in range(63)}
    assert calls.ask(spark, prompts.limit(0), store, counting(str(seen[2]))).count() == 0


def test_window_of_calls_is_never_wider_than_the_limit(tmp_path):
    import threading
    import time

    import pandas as pd

    now, most, lock = [0], [0], threading.Lock()

    def client(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.2 if prompt == "slow" else 0.01)
        with lock:
            now[0] -= 1
        return prompt

    class Task:
        def partitionId(self):  # noqa: N802
            return 0

    frame = pd.DataFrame({"digest": [str(i) for i in range(20)], "prompt": ["slow"] + [f"q{i}" for i in range(19)]})
    with pytest.MonkeyPatch.context() as m:
        m.setattr(calls.TaskContext, "get", classmethod(lambda cls: Task()))
        out = [r for f in calls._asking(client, str(tmp_path), 3, 1, 1)(iter([frame])) for r in f["reply"]]
    # Others pass the slow call by, so it does not come first.
    assert most[0] == 3 and sorted(out) == sorted(frame["prompt"]) and out[0] != "slow"
    lines = [json.loads(x) for p in tmp_path.rglob("*.jsonl") for x in p.read_text().splitlines()]
    assert sorted(x["digest"] for x in lines) == sorted(frame["digest"])


def test_binary_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("één\ftwee\f".encode())
    (tmp_path / "b.txt").write_bytes(b"good\f\xff\xfe\fnever")
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "d.bin").write_bytes(b"other")
    got = {(r.doc.rpartition("/")[2], r.page, r.text, r.error) for r in tables.binary_pages(spark, str(tmp_path), pattern="*.txt").collect()}
    assert got == {("a.txt", 0, "één", None), ("a.txt", 1, "twee", None), ("a.txt", 2, "", None), ("b.txt", 0, "good", None), ("b.txt", 1, None, "UnicodeDecodeError")}
    whole = tables.page_texts(tables.binary_pages(spark, str(tmp_path), pattern="a.txt")).first()
    assert whole.text == "één\ntwee\n"
    missing = tables.binary_pages(spark, str(tmp_path), tables.pdf_pages, "a.txt").collect()
    assert len(missing) == 1 and missing[0].error


SCHEMA = "id long, score double"


def test_versions(spark, tmp_path):
    """A write that fails or is not committed leaves what was current; backups are read; sweeping removes the rest."""
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 9.0), (2, 3.0), (3, None)], SCHEMA)
    keep = F.coalesce("score", F.lit(0.0)) >= 7
    parts = {"kept": keep, "rejected": ~keep}
    with pytest.raises(LookupError):
        versions.read(spark, path, SCHEMA)
    first = versions.write(rows, path, parts)
    assert [r.id for r in versions.read(spark, path, SCHEMA, "kept").collect()] == [1]
    assert {r.id for r in versions.read(spark, path, SCHEMA, "rejected").collect()} == {2, 3}
    assert {(r.id, r.part) for r in versions.read(spark, path, SCHEMA).collect()} == {(1, "kept"), (2, "rejected"), (3, "rejected")}
    broken = rows.withColumn("score", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("score")))
    with pytest.raises(Exception, match="lost"):
        versions.write(broken, path, {"kept": F.lit(True)})
    with pytest.raises(Exception, match="no part"):
        versions.write(rows, path, {"kept": keep})
    staged = versions.stage(rows.where("id = 2"), path, parts)
    assert versions.committed(spark, path) == [first]
    versions.commit(spark, path, staged)
    assert versions.committed(spark, path) == [staged, first]
    assert versions.read(spark, path, SCHEMA, "kept").count() == 0 and versions.read(spark, path, SCHEMA, "kept", back=1).count() == 1
    with pytest.raises(ValueError, match="not a whole version"):
        versions.commit(spark, path, "nothing")
    plain = versions.write(rows, path)
    assert versions.read(spark, path, SCHEMA).columns == ["id", "score"]
    gone = versions.sweep(spark, path, 2)
    assert first in gone and versions.committed(spark, path) == [plain, staged]
    assert versions.read(spark, path, SCHEMA, back=1).count() == 1 and versions.sweep(spark, path, 2) == []


def test_json_maps_in_ranges_of_any_size(spark, tmp_path):
    """Escapes, backslashes and quotes across the edges of ranges, keys and values that look like the marks between them, and characters of several bytes."""
    rng = random.Random(4)
    odd = ["", ", ", ": ", '": "', "\\", '\\"', '"', '\\\\"', "}", "{", "é中𝒳", "\n\t", "\u2028", "a" * 300, "[1]"]
    files = {"plain": {f"k{i}": rng.choice(odd) + rng.choice(odd) for i in range(40)}, "keys": {k + str(i): "v" for i, k in enumerate(odd)}, "one": {"": ""}, "none": {}}
    for name, found in files.items():
        text = json.dumps(found, ensure_ascii=name == "keys", indent=rng.choice([None, 1]))
        (tmp_path / f"{name}.json").write_text(f" {text} \n", encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    want = Counter((k, v) for f in files.values() for k, v in f.items())
    for path in tmp_path.iterdir():
        length = path.stat().st_size
        for size in (1, 2, 3, 7, 64, 10_000):
            edges = [(s, min(s + size, length)) for s in range(0, length, size)]
            seen, got = 0, []
            for s, e in edges:
                got += json_maps._entries(str(path), s, e, seen)
                seen += len(json_maps._Range(str(path), s, e).quotes)
            assert Counter(got) == Counter(files.get(path.stem, {}).items()), (path, size)
    for size in (5, 1000):
        assert Counter(map(tuple, json_maps.json_map(spark, str(tmp_path), size).collect())) == want


@pytest.mark.parametrize("text", ['{"a": "b"', '{"a": 1}', '{"a": "b",}', '{"a": "b"} x', '["a", "b"]', '{"a" "b"}', '{"a": ["b"]}', '"a": "b"}', "x", '{"a": "b" "c": "d"}', '{"a": {"b": "c"}}', '{"a": "\x01"}'])
def test_malformed_maps_fail(tmp_path, text):
    path = tmp_path / "m.json"
    path.write_text(text)
    for size in (1, 3, 1000):
        with pytest.raises(ValueError, match="."):
            seen = 0
            for s in range(0, len(text), size):
                list(json_maps._entries(str(path), s, min(s + size, len(text)), seen))
                seen += len(json_maps._Range(str(path), s, min(s + size, len(text))).quotes)


def test_malformed_relations_fail(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"q": ["a", "b"')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        tables.json_relations(spark, str(tmp_path)).collect()


def test_outputs_committed_together(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 2.0)], SCHEMA)
    versions.commit(spark, path, versions.stage_outputs(spark, path, {"a": (rows, "parquet"), "b": (rows, "json")}))
    broken = rows.withColumn("score", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        versions.commit(spark, path, versions.stage_outputs(spark, path, {"a": (rows.limit(0), "parquet"), "b": (broken, "json")}))
    assert [tuple(r) for r in versions.read(spark, path, SCHEMA, "a", kind="parquet").collect()] == [tuple(r) for r in versions.read(spark, path, SCHEMA, "b").collect()] == [(1, 2.0)]


def test_renamed_columns(spark):
    rows = spark.createDataFrame([(1, "x", None)], "a long, `b.c` string, d string")
    assert tables.renamed(rows, {"b.c": "text", "a": "id"}).columns == ["text", "id"]
    assert tables.renamed(rows, {"a": "id"}, others=True).columns == ["id", "b.c", "d"]
    with pytest.raises(KeyError):
        tables.renamed(rows, {"z": "y"})
    with pytest.raises(ValueError, match="two columns"):
        tables.renamed(rows, {"a": "d"}, others=True)


def test_a_range_reads_little_behind_its_end(tmp_path, monkeypatch):
    """Small ranges read on by small steps, and a task opens a file once for all of its ranges."""
    import pandas as pd

    path = tmp_path / "map.json"
    path.write_text(json.dumps({str(i): "text " * 150 for i in range(300)}))
    n, read, opened = path.stat().st_size, [], []
    at, plain = json_maps._Range._at, json_maps.open_input
    monkeypatch.setattr(json_maps._Range, "_at", lambda r, lo, hi: read.append(hi - lo) or at(r, lo, hi))
    monkeypatch.setattr(json_maps, "open_input", lambda uri: opened.append(uri) or plain(uri))
    starts = list(range(0, n, 10_000))
    frame = pd.DataFrame({"path": str(path), "start": starts, "end": [min(s + 10_000, n) for s in starts]})
    counted = next(json_maps._counted(iter([frame])))
    seen = counted["quotes"].cumsum() - counted["quotes"]
    got = [x for f in json_maps._read(iter([frame.assign(seen=seen)])) for x in zip(f["id"], f["text"], strict=True)]
    assert got == [(str(i), "text " * 150) for i in range(300)]
    assert sum(read) < 3 * n and len(opened) == 2
