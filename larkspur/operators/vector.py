"""Exact and approximate vector search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.frames import stacked
from larkspur.operators.lexical import DIGITS, count_better, rank

#: Bytes of query vectors that go to every worker at once.
QUERY_BYTES = 32 << 20
#: Scores that a worker holds at once; found ones that wait to be sorted; vectors and found rows at a time.
TILE, WAITING, ROWS = 1 << 20, 1 << 19, 2048
#: More than any product of two unit vectors is below 0; a power of 2.
OFFSET = 1024.0


def check_dims(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """vectors, with an error where one has another dimension."""
    return vectors.where(F.assert_true(F.size(column) == dim, F.lit("dimension mismatch")).isNull())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a column of arrays of dim numbers, taken from Arrow's buffers: no number becomes an object. Null: nan."""
    if pc.any(pc.not_equal(pc.list_value_length(column), dim)).as_py():
        raise ValueError("dimension mismatch")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), dim)


class _Best:
    """The k best keys of each of n queries among all scores that were added, ties by key. Scores below a query's k-th so far are never sorted."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.waiting, self.size = k, np.full(n, -np.inf), [], 0
        self.best: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def add(self, queries: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of some queries (numbers) and keys, not rounded; nan and -inf are none."""
        scores = np.where(np.isnan(scores), -np.inf, scores) if np.isnan(scores.sum()) else scores
        # What rounding may lift to the k-th is let through.
        least = np.maximum(self.least[queries] - 10.0**-DIGITS, np.finfo(float).min)
        found = scores >= least[:, None]
        if self.k < len(keys) and np.count_nonzero(found) > 2 * self.k * len(queries):
            kth = np.partition(scores, len(keys) - self.k, axis=1)[:, len(keys) - self.k]
            found = scores >= np.maximum(least, kth - 10.0**-DIGITS)[:, None]
        q, at = np.nonzero(found)
        if len(q):
            self.waiting.append((queries[q], np.round(scores[q, at], DIGITS) + 0.0, keys[at]))
            self.size += len(q)
        if self.size > WAITING:
            self.sort()

    def sort(self) -> None:
        if not self.waiting:
            return
        q, score, key = (np.concatenate(x) for x in zip(*([self.best] if self.best else []), *self.waiting, strict=True))
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(-score[order], kind="stable")]
        order = order[np.argsort(q[order], kind="stable")]
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, order, place = q[place < self.k], order[place < self.k], place[place < self.k]
        self.best, self.waiting, self.size = (q, score[order], key[order]), [], 0
        full = place == self.k - 1
        self.least[q[full]] = self.best[1][full]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, *, key: str = "chunk_ord", column: str = "embedding", cells: Cells | None = None) -> DataFrame:
    """The k vectors (key, column) with the largest dot product for each query (qid, column): (qid, key, score, rank). Ties by key.

    Queries are a stated set: they go to the workers in blocks of QUERY_BYTES. Vectors are multiplied with them in tiles of TILE scores; a task hands on its own
    k best of each query, so what is shuffled is a fraction of all pairs. Rows without a vector are left out. With cells, a query is held only against the vectors of those it looks into.
    """
    found = None
    qs = queries.where(F.col(column).isNotNull()).select("qid", column)
    first = qs.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(column)).alias("dim")).first()
    blocks = max(1, math.ceil(first["n"] * 4 * (first["dim"] or 1) / QUERY_BYTES))
    kind = vectors.schema[key].dataType.simpleString()
    for block in range(blocks):
        part = qs if blocks == 1 else qs.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        rows = part.toPandas()
        ids = rows["qid"].tolist()
        matrix = np.array(rows[column].tolist(), dtype=float).reshape(len(ids), -1)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, cells))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, cells = shared.value
            # A row for each cell: which queries look into it.
            asked = np.ascontiguousarray(cells.looks_into(matrix).T) if cells is not None and len(ids) else None
            best, every, of = _Best(len(ids), k), np.arange(len(ids)), None
            for whole in batches:
                of = whole.schema.field(0).type
                for start in range(0, whole.num_rows if ids else 0, ROWS):
                    p = whole.slice(start, ROWS)
                    x, keys = _matrix(p.column(1), matrix.shape[1]), p.column(0).to_numpy(zero_copy_only=False)
                    at = np.zeros(len(x), int) if asked is None else cells.nearest(x)
                    for c in np.unique(at):
                        rows, some = np.flatnonzero(at == c), every if asked is None else np.flatnonzero(asked[c])
                        step = max(1, TILE // len(rows))
                        for i in range(0, len(some), step):
                            best.add(some[i : i + step], matrix[some[i : i + step]] @ x[rows].T, keys[rows])
            best.sort()
            if best.best:
                q, score, keys = best.best
                for i in range(0, len(q), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[q[part]], pa.int64()), pa.array(keys[part], of), pa.array(score[part])], names=["qid", key, "score"])

        out = vectors.where(F.col(column).isNotNull()).select(key, column).mapInArrow(run, f"qid long, {key} {kind}, score double")
        found = out if found is None else stacked(found, out)
    return rank(found, order=key).where(F.col("rank") <= k)


@dataclass(frozen=True)
class Cells:
    """An index of cells: unit centroids, and how many cells a query looks into."""

    centroids: np.ndarray
    probes: int

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)

    def looks_into(self, x: np.ndarray) -> np.ndarray:
        """Which cells each query looks into: the `probes` nearest, its own first."""
        out = np.zeros((len(x), len(self.centroids)), bool)
        for part in _tiles(len(x), len(self.centroids)):
            order = np.argsort(-(x[part] @ self.centroids.T), axis=1, kind="stable")[:, : self.probes]
            np.put_along_axis(out[part], order, True, axis=1)
        return out


def _tiles(n: int, width: int) -> list[slice]:
    """Rows of a matrix of this width, TILE numbers at a time."""
    step = max(1, TILE // max(1, width))
    return [slice(i, i + step) for i in range(0, n, step)]


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, int), *[np.argmax(x[part] @ centroids.T, axis=1) for part in _tiles(len(x), len(centroids))]])


def fit_cells(vectors: DataFrame, *, column: str = "embedding", k: int = 10, target: float = 0.97, probes: int | None = None, sample: int = 20_000, rounds: int = 8, seed: int = 42) -> Cells:
    """Cells for vectors, fitted on about `sample` distinct ones, drawn by a hash: that many come to the driver, whatever the table and however often one vector stands in it.

    As many cells as the root of the number of vectors, at most a quarter of the sample, by spherical k-means. probes: by default the fewest with which up to 200 vectors of
    the sample find `target` of their k nearest in it. Vectors without neighbourhoods need most cells: then the search is close to the exact one, in its cost as well.
    """
    rows = vectors.where(F.col(column).isNotNull()).select(column)
    n = rows.agg(F.approx_count_distinct(F.xxhash64(column), 0.01)).first()[0]
    share = min(1.0, sample / max(1, n))
    some = rows.where(F.shiftrightunsigned(F.xxhash64(column, F.lit("cells")), 1) <= (int(share * (1 << 62)) << 1) - 1).distinct().toPandas()[column].tolist()
    if not some:
        return Cells(np.zeros((0, 0)), 0)
    x = np.array(sorted(map(tuple, some)), float)
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-30)
    rng = np.random.default_rng(seed)
    count = max(1, min(round(math.sqrt(n)), len(x) // 4))
    centroids = x[rng.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-30), centroids)
    if probes is None:
        q = x[rng.choice(len(x), min(200, len(x)), replace=False)]
        near = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
        place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(place, _nearest(x, centroids)[near], axis=1).ravel())
        probes = int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1
    return Cells(centroids, min(probes, count))


def ann_search(vectors: DataFrame, queries: DataFrame, cells: Cells, k: int = 5, *, key: str = "chunk_ord", column: str = "embedding") -> DataFrame:
    """Like search, over the vectors of the cells that a query looks into, or over all, if there are no cells. More probes never lower the recall; a vector that is in the table finds itself first."""
    return search(vectors, queries, k, key=key, column=column, cells=cells if cells.probes else None)


def share_scored(vectors: DataFrame, queries: DataFrame, cells: Cells, *, column: str = "embedding") -> DataFrame:
    """One row: n_scored, the pairs that ann_search multiplies, and n_pairs, all pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(max(1, len(cells.centroids)), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                n += np.bincount(cells.nearest(_matrix(whole.column(0).slice(start, ROWS), cells.centroids.shape[1])), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], names=["cell", "size"])

    @F.pandas_udf("array<int>")
    def looks(v: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(r).astype(np.int32) for r in cells.looks_into(np.array(v.tolist(), float))] if len(v) else [], dtype=object)

    sizes = vectors.where(F.col(column).isNotNull()).select(column).mapInArrow(count, "cell int, size long").groupBy("cell").agg(F.sum("size").alias("size"))
    asked = queries.where(F.col(column).isNotNull()).select(F.explode(looks(column)).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    scored = sizes.join(asked, "cell", "left").agg(F.sum(F.col("size") * F.coalesce("asked", F.lit(0))).alias("n_scored"), F.sum("size").alias("n"))
    return scored.crossJoin(queries.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("q"))).select("n_scored", (F.col("n") * F.col("q")).alias("n_pairs"))


def recall(found: DataFrame, truth: DataFrame, key: str = "chunk_ord") -> DataFrame:
    """One row: the share of the true pairs (qid, key) that were found."""
    hits = truth.select("qid", key).join(found.select("qid", key).withColumn("hit", F.lit(1)), ["qid", key], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"), F.round(F.coalesce(F.count("hit") / F.count(F.lit(1)), F.lit(0.0)), 6).alias("recall"))


def best_ranks(vectors: DataFrame, queries: DataFrame, targets: DataFrame, *, key: str = "chunk_ord", column: str = "embedding") -> DataFrame:
    """(qid, rank): the best rank over all vectors of a query's targets (qid, chunk_ord), as search would give it without a k. Vectors that beat a target are counted where they are multiplied."""
    rows = queries.where(F.col(column).isNotNull()).select("qid", column).toPandas().sort_values("qid")
    qids, matrix = rows["qid"].to_numpy(), np.array(rows[column].tolist(), dtype=float).reshape(len(rows), -1)

    def run(keep: Callable, schema: str) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]

        def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in parts:
                for i in range(0, len(p), 512):
                    part = p.iloc[i : i + 512]
                    # Scores of all pairs count here: they are moved above 0, where none is.
                    made = keep(part[key].to_numpy(), np.round(np.array(part[column].tolist(), dtype=float) @ matrix.T, DIGITS) + OFFSET)
                    if made is not None:
                        yield pd.DataFrame(dict(zip(names, made, strict=True)))

        return vectors.where(F.col(column).isNotNull()).select(key, column).mapInPandas(blocks, schema)

    return count_better(qids, run, targets.select("qid", F.col(key).alias("chunk_ord")).distinct().toArrow())
