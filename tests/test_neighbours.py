"""Approximate vector search: the neighbour graph and the stored cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import cells, neighbours, vector


def frame(spark, x, name="chunk_ord"):
    return spark.createDataFrame([(k, None if v is None else [float(c) for c in v]) for k, v in enumerate(x)], f"{name} long, embedding array<double>")


def clusters(n, each, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return np.repeat(rng.standard_normal((n, dim)), each, axis=0) + rng.standard_normal((n * each, dim)) * 0.15


def nearest(x, q, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ u.T, 6)
    return [np.lexsort((np.arange(len(x)), -row))[:k].tolist() for row in s]


def test_graph_search(spark):
    x = clusters(30, 40)
    df = frame(spark, x)
    graph = neighbours.build(df, degree=8)
    q = df.where("chunk_ord % 40 = 0").withColumnRenamed("chunk_ord", "qid")
    want = nearest(x, x[::40], 10)
    hits = lambda found: sum(len({r["key"] for r in found if r["qid"] == 40 * i} & set(w)) for i, w in enumerate(want))
    last = -1
    for rounds in (1, 2, 40):  # more rounds never lower the recall
        found = neighbours.search(graph, q, 10, effort=40, rounds=rounds).collect()
        assert hits(found) >= last
        last = hits(found)
    assert last >= 0.9 * 300
    assert all(r["key"] == r["qid"] for r in found if r["rank"] == 1)  # a vector that is in the table finds itself
    assert sorted(map(tuple, neighbours.search(graph, q, 10, effort=40).collect())) == sorted(map(tuple, found))
    scored, pairs = neighbours.share_scored(graph, q, 10, effort=40)
    assert 0 < scored < 0.7 * pairs == 0.7 * 30 * 1200
    degree = graph.edges.groupBy("level", "src").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("src") == F.col("dst")).alias("loops")).agg(F.max("n"), F.max("loops")).first()
    assert degree[0] <= 16 and degree[1] == 0


def test_graph_of_copies_and_bad_vectors(spark):
    """Copies of one vector are one node, however many; its first keys count."""
    x = [*clusters(20, 20), *([[1.0] + [0.5] * 15] * 600)]
    bad = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, []]
    df = frame(spark, [*x, *bad]).unionAll(spark.createDataFrame([(None, [1.0] * 16)], "chunk_ord long, embedding array<double>"))
    graph = neighbours.build(df, degree=8)
    assert graph.size == 401 and graph.members.count() == 1000
    q = frame(spark, [[2.0] + [1.0] * 15, *bad], "qid")
    found = neighbours.search(graph, q, 4).orderBy("rank").collect()
    assert [(r["qid"], r["key"], r["score"]) for r in found] == [(0, k, 1.0) for k in range(400, 404)]
    with pytest.raises(Exception, match="dimension"):
        neighbours.search(graph, frame(spark, [[1.0, 2.0]], "qid"), 3).collect()
    with pytest.raises(ValueError, match="dimension"):
        neighbours.build(frame(spark, [[1.0], [1.0, 2.0]]))


def test_small_graphs_are_exact(spark):
    x = clusters(5, 6)
    graph = neighbours.build(frame(spark, x))
    found = neighbours.search(graph, frame(spark, x, "qid"), 3).orderBy("qid", "rank").collect()
    assert graph.levels == 0 and [r["key"] for r in found] == sum(nearest(x, x, 3), [])
    none = neighbours.build(frame(spark, x).where("false"))
    assert none.size == 0 and neighbours.search(none, frame(spark, x, "qid"), 3).count() == 0
    assert neighbours.search(graph, frame(spark, x, "qid").where("false"), 3).count() == 0


def test_stored_cells_equal_the_scan(spark, tmp_path, monkeypatch):
    x = clusters(40, 25)
    df, q = frame(spark, [*x, None]), frame(spark, [*x[::50], None], "qid")
    index = vector.fit_cells(df, probes=3)
    path = str(tmp_path / "cells")
    monkeypatch.setattr(cells, "VECTORS", 16)
    monkeypatch.setattr(cells, "QUERIES", 3)
    cells.write_cells(df, index, path)
    want = sorted(map(tuple, vector.ann_search(df, q, index, 5).select("qid", "chunk_ord", "score", "rank").collect()))
    for few in (64 << 20, 0):
        monkeypatch.setattr(cells, "FEW", few)
        assert sorted(map(tuple, cells.search_cells(spark, path, q, index, 5).select("qid", "chunk_ord", "score", "rank").collect())) == want
    with pytest.raises(Exception, match="dimension|mismatch"):
        cells.search_cells(spark, path, frame(spark, [[1.0, 2.0]], "qid"), index, 3).collect()


def test_only_probed_cells_are_opened(spark, tmp_path):
    x = clusters(40, 25)
    df = frame(spark, x)
    index, path = vector.fit_cells(df, probes=1), str(tmp_path / "cells")
    cells.write_cells(df, index, path)
    found = cells.search_cells(spark, path, frame(spark, x[:1], "qid"), index, 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    assert "dynamicpruning" in plan.toString()
    seen, todo = [], [plan]
    while todo:  # the scan's own count of the partitions that it read
        node = todo.pop()
        if node.getClass().getSimpleName() in ("AdaptiveSparkPlanExec", "ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            todo.append(node.executedPlan() if "Adaptive" in node.getClass().getSimpleName() else node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            seen.append(node.metrics().get("numPartitions").get().value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert seen == [1] and len(list((tmp_path / "cells").glob("cell=*"))) > 10


def test_repeated_vectors_in_the_sample(spark):
    same = frame(spark, [[1.0, 2.0]] * 1000)
    index = vector.fit_cells(same, sample=100)
    assert len(index.centroids) == 1
    q = frame(spark, [[1.0, 2.0]], "qid")
    assert [r["chunk_ord"] for r in vector.ann_search(same, q, index, 3).orderBy("rank").collect()] == [0, 1, 2]
    none = vector.Cells(np.zeros((0, 0)), 0)
    assert vector.ann_search(same, q, none, 3).count() == 3  # no cells: the exact search


def test_best_of_tiles_against_a_sort(monkeypatch):
    """Ties by key, scores that round alike, nan, infinities and string keys, in tiles and rounds of any size; what waits to be sorted is bounded."""
    rng = np.random.default_rng(5)
    scores = np.round(rng.standard_normal((7, 400)), 1) + rng.choice([0, 2e-7, -2e-7], (7, 400))
    scores[0, :50], scores[1, 3], scores[2], scores[3, 5] = np.nan, np.inf, -np.inf, -np.inf
    for keys in (rng.permutation(400), np.array([f"k{x:03d}" for x in rng.permutation(400)], dtype=object)):
        want = [[(round(float(s), 6), x) for s, x in sorted(((s, x) for s, x in zip(np.round(row, 6), keys, strict=True) if s > -np.inf), key=lambda p: (-p[0], p[1]))][:10] for row in scores]
        for waiting, wide, high in ((1 << 19, 400, 7), (30, 9, 3), (30, 150, 1)):
            monkeypatch.setattr(vector, "WAITING", waiting)
            best = vector._Best(7, 10)
            for i in range(0, 400, wide):
                for q in range(0, 7, high):
                    best.add(np.arange(7)[q : q + high], scores[q : q + high, i : i + wide], keys[i : i + wide])
                    assert best.size <= waiting
            best.sort()
            got = [[(float(s), x) for n, s, x in zip(*best.best, strict=True) if n == q] for q in range(7)]
            assert got == want


def test_tiles_are_bounded():
    cells = vector.Cells(np.eye(64).repeat(20, axis=0), 40)
    x = np.random.default_rng(1).standard_normal((3000, 64))
    parts = vector._tiles(len(x), len(cells.centroids))
    assert len(parts) > 1 and all(len(x[p]) * len(cells.centroids) <= vector.TILE for p in parts)
    assert (cells.nearest(x) == np.argmax(x @ cells.centroids.T, axis=1)).all()
    order = np.argsort(-(x @ cells.centroids.T), axis=1, kind="stable")[:, :40]
    assert (np.flatnonzero(cells.looks_into(x)[7]) == np.sort(order[7])).all() and (cells.looks_into(x).sum(axis=1) == 40).all()


def test_graph_in_shards(spark, monkeypatch):
    """Vectors without neighbourhoods, in several shards: nine tenths of the nearest are found, each query finds itself, and no pair of a query and a node is shuffled."""
    monkeypatch.setattr(neighbours, "SHARD", 1000)
    x = np.random.default_rng(3).standard_normal((4000, 64))
    df = frame(spark, x)
    graph = neighbours.build(df)
    assert graph.shards == 4 and graph.size == 4000
    q = df.where("chunk_ord % 20 = 0").withColumnRenamed("chunk_ord", "qid")
    got = neighbours.search(graph, q, 10)
    found = got.collect()
    want = nearest(x, x[::20], 10)
    assert sum(len({r["key"] for r in found if r["qid"] == 20 * i} & set(w)) for i, w in enumerate(want)) >= 0.9 * 2000
    assert all(r["key"] == r["qid"] for r in found if r["rank"] == 1) and len(found) == 2000
    sent = neighbours._walk(graph, q, 10, 64, 40, "embedding").count()
    assert sent <= 4 * 200 * 12
    assert neighbours.share_scored(graph, q, 10)[1] == 200 * 4000
