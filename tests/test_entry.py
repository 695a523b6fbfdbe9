from pathlib import Path

import pytest

DATA = "/root/testdata/sf0.001"


def test_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", ["retrieval_topk", "chunk_pack", "pairs_dedup_pair", "split_stratified", "score_filter", "multihop_groups", "results_pivot"])
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("documents", "labels", "conversations", "embeddings"):
        p = Path(DATA, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    df = e.queries()[name](spark, DATA)
    cur = con.execute(e.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, map(tuple, cur.fetchall())))
