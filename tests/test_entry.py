from pathlib import Path

import __spark_entry__ as entry
import pytest

from jobs.registry import QUERIES as JOBS
from larkspur.operators import lexical
from larkspur.plans.queries import QUERIES, Inputs


ROOT = Path(__file__).resolve().parent.parent
#: Queries that SQL doesn't tell: other tests hold their operators against plain versions.
WITHOUT_SQL = {"ann_topk", "ann_benchmark", "ann_graph_topk"}


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "chunk_ord", "rank", "score"] and df.count() > 0


def test_every_query_of_the_library_is_registered():
    assert {*QUERIES, *JOBS} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def _rows(columns, rows):
    import math

    at = [columns.index(c) for c in sorted(columns)]
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted({**QUERIES, **JOBS}))
def test_queries_against_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    sql = entry.oracle_sql().get(name)
    got = entry.queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    if sql is None:
        assert name in WITHOUT_SQL and rows and len(set(got.columns)) == len(got.columns)
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(got.columns, rows) == _rows(names, cur.fetchall())


def test_plans(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    p = plan(lexical.search(i.index(), i.questions, 5))
    assert "WindowGroupLimit" in p and "CartesianProduct" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(i.index().terms)
    assert "Exchange" not in plan(lexical.term_frequencies(i.doc_chunks())) and "NestedLoop" not in plan(i.gold())


def test_the_library_stands_without_the_llm_subpackage():
    """With it, or with what it alone needs, out of reach, the other queries are there."""
    import subprocess
    import sys

    for hidden in ("larkspur.llm", "regex"):
        code = f"import sys; sys.modules['{hidden}'] = None; import __spark_entry__ as e; assert len(e.queries()) == len(e.QUERIES) + len(e.jobs.QUERIES) and e.llm is None"
        subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
