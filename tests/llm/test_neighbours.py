"""Vantage-point trees against the product of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import registry, vantage_trees


def plain_nearest(rows, queries, k):
    """rows: (id, vector); a vector that is null, empty, zero or not finite takes no part, the least vector of an id counts."""
    known = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            known[i] = min(known.get(i, v), v)
    out = {}
    for q in {q for q in queries if q in known}:
        v = np.array(known[q], float)
        scores = [(-round(float((v * np.array(w)).sum() / math.sqrt((v * v).sum() * (np.array(w) ** 2).sum())), 12), i) for i, w in known.items() if i != q and len(w) == len(v)]
        if scores:
            out[q] = sorted(scores)[:k]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["query_id"], []).append((r["rank"], -round(r["score"], 12), r["vec_id"]))
    ranks = {q: [x[0] for x in sorted(rows)] for q, rows in out.items()}
    assert all(r == list(range(1, len(r) + 1)) for r in ranks.values())
    return {q: [x[1:] for x in sorted(rows)] for q, rows in out.items()}


def vectors(rng, n):
    """Vectors of halves and quarters, in which cosines tie; a third of them are copies of one."""
    rows = [(k, [rng.randrange(-3, 4) / 4 for _ in range(6)]) for k in range(n)]
    same = [0.5, -0.25, 1.0, 0.0, 0.75, 0.25]
    rows += [(n + k, same) for k in range(n // 2)]
    bad = [None, [], [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [1.0] * 5, [float("inf")] + [1.0] * 5]
    rows += [(5000 + k, v) for k, v in enumerate(bad)] + [(None, same), (6000, [1.0, 2.0]), (6010, [2.0, 1.0]), (6020, [3.0])]
    return rows + [(0, [9.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (4, same), (4, same)]


@pytest.mark.parametrize("shard_rows, query_bytes", [(10_000, 1 << 20), (90, 500)])
def test_factor_one_is_exact(spark, monkeypatch, shard_rows, query_bytes):
    monkeypatch.setattr(vantage_trees, "QUERY_BYTES", query_bytes)
    rows = vectors(random.Random(1), 400)
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("shard", F.lit("clash")).withColumn("unit", F.lit("clash"))
    index = vantage_trees.build_index(df, id_col="id", vector_col="v", shard_rows=shard_rows)
    got = vantage_trees.search(index, df.where("id % 10 = 0 or id > 4999"), 5, id_col="id", vector_col="v")
    assert found(got) == plain_nearest(rows, [i for i, _ in rows if i is not None and (i % 10 == 0 or i > 4999)], 5)
    assert index.shards.agg(F.sum("n")).first()[0] == len({i for i, v in rows if i is not None and i not in range(5000, 5006)})


def test_trees_leave_out_what_cannot_be_near():
    """On clusters exact search compares a part of the vectors only; larger factors compare less and never find a nearer one."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.standard_normal((40, 16)), 50, axis=0) + rng.standard_normal((2000, 16)) * 0.05
    tree = vantage_trees.Tree.build(np.arange(2000), x)
    q = np.arange(0, 2000, 37)
    last, exact = None, None
    for factor in vantage_trees.FACTORS:
        query, ids, score, compared = tree.nearest(q, x[q], 5, factor)
        assert (compared <= 2000 + len(tree.nodes)).all() and len(ids) == 5 * len(q)
        if last is None:
            u = x / np.linalg.norm(x, axis=1)[:, None]
            c = u[q] @ u.T
            c[np.arange(len(q)), q] = -2
            assert (np.sort(ids.reshape(-1, 5)) == np.sort(np.argsort(-c, axis=1)[:, :5])).all() and compared.mean() < 500
            exact = score
        else:
            assert compared.mean() <= last + 1e-9 and (score <= exact + 1e-12).all()
        last = compared.mean()


def test_equal_vectors_are_one_point():
    x = np.ones((5000, 4))
    tree = vantage_trees.Tree.build(np.arange(5000)[::-1].copy(), x)
    query, ids, score, compared = tree.nearest(np.array([0, 3, 9000]), x[:3], 4, 1.0)
    assert ids.tolist() == [1, 2, 3, 4, 0, 1, 2, 4, 0, 1, 2, 3] and (score == 1.0).all() and compared.tolist() == [1, 1, 1]


def test_empty_and_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    index = vantage_trees.build_index(df)
    assert found(vantage_trees.search(index, df.where("vec_id = 0"), 5)) == {0: [(-round(math.sqrt(0.5), 12), 2), (0.0, 1)]}
    assert vantage_trees.search(index, df.where("false"), 5).count() == 0
    none = vantage_trees.build_index(df.where("false"))
    assert vantage_trees.fit_factor(none) == 1.0 and vantage_trees.search(none, df, 5).count() == 0


def test_query_finds_nine_of_ten(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, df = plain_nearest(rows, [i for i, _ in rows if i % 50 == 0], 5), registry.op11_nearest_neighbours(spark, sf)
    assert [f.dataType.simpleString() for f in df.schema.fields[:4]] == ["bigint", "int", "bigint", "double"]
    got = found(df)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in x}) for q, x in want.items())
    assert set(got) == set(want) and hits >= 0.95 * sum(map(len, want.values())) and all(len(x) == 5 for x in got.values())
    assert all((s, i) not in got[q] or (s, i) in want[q] or s >= want[q][-1][0] for q in got for s, i in got[q])
