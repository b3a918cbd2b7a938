"""Nearest neighbours by cosine with vantage-point trees, one for each shard of the vectors.

A node of a tree has a vantage point, and holds its vectors in two halves: those nearer to the point, and the others, with the least and largest distance from the point
to each half. Distances are chords of the unit sphere, sqrt(2 - 2 cosine), so the triangle inequality tells how near a half can come to a query: at least as far as
the query's distance from the point lies outside of the half's distances. A half is left out if that bound, times a factor, exceeds the distance of the k-th vector found.
Factor 1 is exact search; a larger one believes that vectors come nearer than the bound by less than it allows, and leaves more out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.embedding_dedup import valid
from larkspur.llm.names import col
from larkspur.llm.storage import write_table
from larkspur.llm.wordhash import small_batches, tidy
from larkspur.operators.frames import stacked

#: Vectors of a shard, about; vectors of a leaf, at most; candidates for a vantage point; bytes of queries in a block; seed of the choice.
SHARD, LEAF, TRIES, QUERY_BYTES, SEED = 8192, 64, 6, 64 << 20, 20240611
#: Chords of nearly equal vectors are known within this; a cosine within this of another may be the larger one.
NEAR, CLOSE = 1e-7, 1e-12
#: Queries and shards that the choice of a factor looks at, and the factors it chooses from.
SAMPLE, SHARDS, FACTORS = 200, 4, (1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0, 12.0)

_NODE = np.dtype([("lo", "<i4"), ("mid", "<i4"), ("hi", "<i4"), ("point", "<i4"), ("inside", "<i4"), ("outside", "<i4"), ("in_lo", "<f8"), ("in_hi", "<f8"), ("out_lo", "<f8"), ("out_hi", "<f8")])


def chords(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class Tree:
    """Distinct vectors x in the order of the leaves, their units u, nodes, and the ids of each vector in ascending order (ids[first[i]:first[i + 1]])."""

    def __init__(self, x: np.ndarray, nodes: np.ndarray, ids: np.ndarray, first: np.ndarray):
        self.x, self.nodes, self.ids, self.first = x, nodes, ids, first
        self.norm = np.sqrt((x * x).sum(axis=1))
        self.u = x / self.norm[:, None]

    @staticmethod
    def build(ids: np.ndarray, x: np.ndarray, leaf: int = LEAF) -> Tree:
        """Equal vectors are one; halves are equal in number, so the depth is a logarithm whatever the distances."""
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        _, one, of = np.unique(x.view([("", x.dtype)] * x.shape[1]).ravel(), return_index=True, return_inverse=True)
        distinct, rng = x[one], np.random.default_rng(SEED)
        u = distinct / np.sqrt((distinct * distinct).sum(axis=1))[:, None]
        at, nodes = np.arange(len(one)), []

        def grow(lo: int, hi: int) -> int:
            number = len(nodes)
            nodes.append((lo, hi, hi, -1, -1, -1, 0.0, 0.0, 0.0, 0.0))
            if hi - lo > leaf:
                here = at[lo:hi]
                some = here[rng.choice(hi - lo, min(hi - lo, 256), replace=False)]
                # The point from which distances differ most tells the halves apart best.
                point = some[int(chords(u[some[:TRIES]] @ u[some].T).std(axis=1).argmax())]
                far = chords(u[here] @ u[point])
                by = np.argsort(far, kind="stable")
                at[lo:hi], far = here[by], far[by]
                half = (hi - lo) // 2
                inside, outside = grow(lo, lo + half), grow(lo + half, hi)
                nodes[number] = (lo, lo + half, hi, point, inside, outside, far[0], far[half - 1], far[half], far[-1])
            return number

        grow(0, len(one))
        made = np.array(nodes, _NODE)
        place = np.empty(len(at), np.int64)
        place[at] = np.arange(len(at))
        inner = made["point"] >= 0
        made["point"][inner] = place[made["point"][inner]]
        slot = place[of]
        by = np.argsort(slot, kind="stable")  # ids ascend within a vector
        return Tree(distinct[at], made, ids[by], np.searchsorted(slot[by], np.arange(len(at) + 1)))

    def nearest(self, own: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For queries q with ids own: (query, id, cosine) of the k nearest found of other ids, ties to smaller ids, and how many vectors each query was compared with."""
        found = _Found(self, own, q, k, factor)
        near = np.full(len(q), -1)
        # First the leaf that each query lies in, then all that its k-th distance doesn't rule out, each node once for all queries.
        found.descend(0, np.arange(len(q)), near)
        found.visit(0, np.arange(len(q)), near)
        return *found.best(), found.compared


class _Found:
    def __init__(self, tree: Tree, own: np.ndarray, q: np.ndarray, k: int, factor: float):
        self.tree, self.own, self.q, self.k, self.factor = tree, own, q, k, factor
        self.norm = np.sqrt((q * q).sum(axis=1))
        self.u = q / self.norm[:, None]
        self.score = np.full((len(q), k), -np.inf)
        self.id = np.full((len(q), k), np.iinfo(np.int64).max)
        self.compared = np.zeros(len(q), np.int64)

    def descend(self, number: int, rows: np.ndarray, near: np.ndarray) -> None:
        node = self.tree.nodes[number]
        if node["point"] < 0:
            near[rows] = number
            self._compare(int(node["lo"]), int(node["hi"]), rows)
            return
        far = chords(self.u[rows] @ self.tree.u[node["point"]])
        inside = far <= (node["in_hi"] + node["out_lo"]) / 2
        for child, some in ((node["inside"], rows[inside]), (node["outside"], rows[~inside])):
            if len(some):
                self.descend(int(child), some, near)

    def visit(self, number: int, rows: np.ndarray, near: np.ndarray) -> None:
        node = self.tree.nodes[number]
        if node["point"] < 0:
            rows = rows[near[rows] != number]
            if len(rows):
                self._compare(int(node["lo"]), int(node["hi"]), rows)
            return
        far = chords(self.u[rows] @ self.tree.u[node["point"]])
        self.compared[rows] += 1
        for child, lo, hi in ((node["inside"], node["in_lo"], node["in_hi"]), (node["outside"], node["out_lo"], node["out_hi"])):
            bound = np.maximum(np.maximum(far - hi, lo - far) - NEAR, 0.0)
            some = rows[bound * self.factor <= chords(self.score[rows, -1]) + NEAR]
            if len(some):
                self.visit(int(child), some, near)

    def _compare(self, lo: int, hi: int, rows: np.ndarray) -> None:
        t, k = self.tree, self.k
        self.compared[rows] += hi - lo
        cosine = self.u[rows] @ t.u[lo:hi].T
        # A vector may be the query's own: one more than k of a leaf can count.
        least = self.score[rows, -1]
        if hi - lo > k + 1:
            least = np.maximum(least, np.partition(cosine, hi - lo - k - 1, axis=1)[:, hi - lo - k - 1])
        i, j = np.nonzero(cosine >= least[:, None] - CLOSE)
        if not len(i):
            return
        # Products of blocks depend on the blocks in their last digits; the score of a pair mustn't.
        exact = np.concatenate([(self.q[rows[i[a : a + 8192]]] * t.x[lo + j[a : a + 8192]]).sum(axis=1) for a in range(0, len(i), 8192)]) / (self.norm[rows[i]] * t.norm[lo + j])
        copies = np.minimum(t.first[lo + j + 1] - t.first[lo + j], k + 1)
        take = np.repeat(t.first[lo + j] - (np.cumsum(copies) - copies), copies) + np.arange(int(copies.sum()))
        query, score, found = np.repeat(rows[i], copies), np.repeat(exact, copies), t.ids[take]
        other = found != self.own[query]
        some = np.unique(query[other])
        query = np.concatenate([query[other], np.repeat(some, k)])
        score = np.concatenate([score[other], self.score[some].ravel()])
        found = np.concatenate([found[other], self.id[some].ravel()])
        by = np.lexsort((found, -score, query))
        query = query[by]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        by, query, rank = by[rank < k], query[rank < k], rank[rank < k]
        self.score[query, rank], self.id[query, rank] = score[by], found[by]

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, rank = np.nonzero(np.isfinite(self.score))
        return query, self.id[query, rank], self.score[query, rank]


@dataclass(frozen=True)
class VantageIndex:
    """shards: a stored table (dim, shard, n, ids, x, nodes, firsts), a row for each tree; n_shards of each dimension."""

    shards: DataFrame
    n_shards: int


def _vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that take part; of an id that repeats, the least vector."""
    rows = df.select(col(id_col).cast("long").alias("id"), col(vector_col).cast("array<double>").alias("v")).where("id is not null").where(valid("v"))
    if rows.groupBy("id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    return rows


def build_index(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD) -> VantageIndex:
    """Trees over all rows with an id and a vector that has elements, all finite, and not all zero; rows without take no part, nor do second rows of an id (its least vector counts).

    Shards are dealt by a hash of the id, so copies of one vector, however many, spread over all of them; within a shard they are one point with many ids. A task holds one shard.
    Vectors of different lengths are in different trees. An empty table gives an index without shards.
    """
    rows = write_table(_vectors(df, id_col, vector_col), "vectors")
    n = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("shard")).repartitionById(n, F.col("shard"))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        sizes, flat = t.column("v").combine_chunks().value_lengths().to_numpy(), t.column("v").combine_chunks().flatten().to_numpy()
        starts, ids = np.cumsum(sizes) - sizes, t.column("id").to_numpy()
        for dim in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dim)
            tree = Tree.build(ids[at], flat[starts[at][:, None] + np.arange(dim)])
            blobs = [pa.array([a.tobytes()], pa.binary()) for a in (tree.ids, tree.x, tree.nodes, tree.first)]
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([t.column("shard")[0].as_py()], pa.int32()), pa.array([len(at)], pa.int64()), *blobs], names=["dim", "shard", "n", "ids", "x", "nodes", "firsts"])

    return VantageIndex(write_table(dealt.mapInArrow(tidy(grow), "dim int, shard int, n long, ids binary, x binary, nodes binary, firsts binary"), "vantage-trees"), n)


def _tree(row: dict) -> Tree:
    x = np.frombuffer(row["x"], np.float64).reshape(-1, row["dim"])
    return Tree(x, np.frombuffer(row["nodes"], _NODE), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["firsts"], np.int64))


def fit_factor(index: VantageIndex, k: int = 5, *, recall: float = 0.98) -> float:
    """The largest of FACTORS with which SAMPLE vectors of each of SHARDS trees find this share of their k nearest in the tree.

    The sample is bounded, whatever the size of the index: it fits one number; what is searched with it is every row. 1.0 (exact search) if there is nothing to fit on.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tree = _tree(row)
                some = np.linspace(0, len(tree.x) - 1, min(SAMPLE, len(tree.x))).astype(np.int64)
                own, q = tree.ids[tree.first[some]], tree.x[some]
                exact = set(zip(*(a.tolist() for a in tree.nearest(own, q, k, 1.0)[:2]), strict=True))
                hits = [len(exact & set(zip(*(a.tolist() for a in tree.nearest(own, q, k, f)[:2]), strict=True))) for f in FACTORS]
                yield pa.RecordBatch.from_arrays([pa.array(FACTORS, pa.float64()), pa.array(hits, pa.int64()), pa.array([len(exact)] * len(FACTORS), pa.int64())], names=["factor", "hits", "of"])

    some = index.shards.where(F.col("shard") < SHARDS).repartition(SHARDS, "shard")
    by = some.mapInArrow(tidy(measure), "factor double, hits long, of long").groupBy("factor").agg(F.sum("hits").alias("hits"), F.sum("of").alias("of"))
    return by.where(F.col("hits") >= recall * F.col("of")).agg(F.max("factor")).first()[0] or 1.0


def search(index: VantageIndex, queries: DataFrame, k: int = 5, *, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, compared): the k vectors with the largest cosine found for each query, ties to smaller ids, and with how many vectors it was compared in all.

    score is the cosine in double precision. A query's own id is no answer. Queries that are null, empty, zero or hold null or non-finite components, or have
    no id, get no rows, nor do those of a length that no vector has; with fewer than k other vectors, all of them. The query set is a stated one: its blocks of
    QUERY_BYTES meet the tree of each shard, a task a pair, in which queries stream by. So a task holds one tree, a batch of queries and their answers.
    """
    spark = queries.sparkSession
    asked = write_table(_vectors(queries, id_col, vector_col).withColumn("dim", F.size("v")), "queries")
    size = asked.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0] * 8
    blocks = max(1, math.ceil(size / QUERY_BYTES))
    n = index.n_shards * blocks
    none = {"id": "long", "v": "array<double>", "ids": "binary", "x": "binary", "nodes": "binary", "firsts": "binary"}
    empty = lambda *names: [F.lit(None).cast(none[c]).alias(c) for c in names]
    trees = index.shards.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("side"), *empty("id", "v"), "ids", "x", "nodes", "firsts")
    held = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(index.n_shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("side"), "id", "v", *empty("ids", "x", "nodes", "firsts"))
    units = stacked(trees, held).withColumn("unit", F.col("shard") * blocks + F.col("block")).repartitionById(n, F.col("unit").cast("int")).sortWithinPartitions("unit", "dim", "side")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, of = None, None
        for b in small_batches(batches, 2048):
            sides, dims, units = (b.column(c).to_numpy() for c in ("side", "dim", "unit"))
            cuts = (np.flatnonzero((sides[1:] == 0) | (sides[:-1] == 0) | (dims[1:] != dims[:-1]) | (units[1:] != units[:-1])) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                part = b.slice(i, j - i)
                if sides[i] == 0:
                    tree, of = _tree(part.select(["dim", "ids", "x", "nodes", "firsts"]).to_pylist()[0]), (int(units[i]), int(dims[i]))
                elif of == (int(units[i]), int(dims[i])):
                    own = part.column("id").to_numpy()
                    q = part.column("v").flatten().to_numpy().reshape(len(own), -1)
                    query, found, score, compared = tree.nearest(own, q, k, factor)
                    # A tree's work goes with the first of its answers.
                    work = np.where(np.diff(query, prepend=-1) > 0, compared[query], 0)
                    yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(found), pa.array(score), pa.array(work)], names=["query_id", "vec_id", "score", "compared"])

    found = units.mapInArrow(tidy(look), "query_id long, vec_id long, score double, compared long")
    of = Window.partitionBy("query_id")
    ranked = found.select("query_id", "vec_id", "score", F.sum("compared").over(of).alias("compared"), F.row_number().over(of.orderBy(F.desc("score"), "vec_id")).alias("rank"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "compared")
