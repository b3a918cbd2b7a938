"""Queries against their SQL on texts that the driver's small tables lack."""

import __spark_entry__ as entry
import pytest

DOCS = [(1, "ab"), (2, ""), (3, None), (4, "éx\U0001f469"), (5, "a\r\nb"), (6, ""), (7, None), (8, "ab"), (9, "ab"), (13, None), (14, "z\x00")]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in DOCS], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, "ab")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["fake_embedding", "memo_runs"])
def test_queries_against_sql(spark, odd_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd_dir}/{t}.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = entry.queries()[name](spark, odd_dir).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
