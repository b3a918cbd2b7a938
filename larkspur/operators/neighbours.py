"""A graph of near vectors in shards, built and searched where a shard is.

Equal vectors are one node. Nodes are dealt by a hash into shards of about SHARD. Within a shard each node is tied to its nearest ones, pruned to a bounded degree: nearer neighbours before those
that lie behind them; reverse edges are added. A search walks in every shard: it begins at TOP drawn nodes, and at the query itself, if the shard has it, keeps the best nodes that
it has seen and opens those that it hasn't opened yet, until all are. How many it keeps is fitted in each shard, on SAMPLE of its nodes against all of it. What is shuffled are vectors,
queries once for a shard, and the best of each shard: no pair of a query and a node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.frames import stacked, written
from larkspur.operators.lexical import DIGITS

#: Nodes of a shard, about; those at which a search begins; nodes on which a search's effort is fitted, and the share of their nearest that it must find.
SHARD, TOP, SAMPLE, TARGET = 8192, 256, 32, 0.97
#: Rows of vectors that a worker turns into one matrix; queries that walk together.
ROWS, QUERIES = 512, 64


@dataclass(frozen=True)
class NeighbourGraph:
    """nodes (shard, node, v, near): distinct unit vectors, each called by its least key, and the nodes it is tied to; edges (level, src, dst): the same, None if there are TOP nodes at most;
    members (node, key); how many levels have a graph (one at most), how many nodes and shards there are."""

    nodes: DataFrame
    edges: DataFrame | None
    members: DataFrame
    levels: int
    size: int
    shards: int


def _unit(df: DataFrame, column: str) -> DataFrame:
    """df, where column has elements, all finite, and not all zero, with v: its unit vector in double precision."""
    v = F.transform(column, lambda x: x.cast("double"))
    # Divided by the largest component first, so that no square overflows or vanishes.
    rows = df.withColumn("v", v).where(F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("most", F.array_max(F.transform("v", F.abs))).withColumn("v", F.transform("v", lambda x: x / F.col("most"))).drop("most")
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))
    return rows.withColumn("v", F.transform("v", lambda x: x / F.col("norm"))).drop("norm")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[pa.RecordBatch]]:
    """The rows of each shard (the first column), which come one after the other."""

    def parts() -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            shard = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for i, j in zip(cuts, cuts[1:]):
                yield int(shard[i]), b.slice(i, j - i)

    for _, rows in groupby(parts(), itemgetter(0)):
        yield map(itemgetter(1), rows)


def _tied(x: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of a graph of these unit vectors: of its 2 * degree nearest a node takes those nearer to it than to any one taken before, then others, nearest first, up to the degree; and up to degree reverse edges."""
    n, most = len(x), min(2 * degree, len(x) - 1)
    degree, out = min(degree, most), []
    for i in range(0, n, ROWS):
        own = x[i : i + ROWS]
        near = own @ x.T
        near[np.arange(len(own)), np.arange(i, i + len(own))] = -np.inf
        at = np.argpartition(-near, most - 1, axis=1)[:, :most]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(near, at, axis=1), axis=1, kind="stable"), axis=1)
        near = np.take_along_axis(near, at, axis=1)
        among = x[at] @ x[at].transpose(0, 2, 1)
        taken = np.zeros(at.shape, bool)
        for j in range(most):
            taken[:, j] = ~(taken[:, :j] & (among[:, j, :j] >= near[:, j, None])).any(axis=1) & (taken[:, :j].sum(axis=1) < degree)
        out.append(np.take_along_axis(at, np.argsort(~taken, axis=1, kind="stable")[:, :degree], axis=1))
    source, target = np.repeat(np.arange(n), degree), np.concatenate(out).ravel()
    score = np.concatenate([(x[source[i : i + ROWS]] * x[target[i : i + ROWS]]).sum(axis=1) for i in range(0, len(source), ROWS)])
    order = np.lexsort((source, -score, target))
    back = target[order]
    kept = order[np.arange(len(back)) - np.searchsorted(back, back) < degree]
    return np.divmod(np.unique(np.r_[source * n + target, target[kept] * n + source[kept]]), n)


def _graphs(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            t = pa.Table.from_batches(list(rows)).combine_chunks()
            ids, n = t.column("node").to_numpy(), t.num_rows
            source, target = _tied(_matrix(t.column("v").combine_chunks()), degree) if n > TOP else (np.zeros(0, int), np.zeros(0, int))
            near = pa.ListArray.from_arrays(pa.array(np.searchsorted(source, np.arange(n + 1)).astype(np.int32)), pa.array(ids[target]))
            for b in t.append_column("near", near).to_batches(max_chunksize=ROWS):
                yield b

    return run


def build(vectors: DataFrame, *, key: str = "chunk_ord", column: str = "embedding", degree: int = 16, seed: int = 42) -> NeighbourGraph:
    """The graph of all rows with a key (a long) and a valid vector (with elements, all finite, not all zero) of one length; others take no part. Equal directions within rounding may be several nodes."""
    rows = written(_unit(vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), column), column).select("key", "v"))
    nodes = written(rows.groupBy("v").agg(F.min("key").alias("node")))
    first = nodes.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("dim")).first()
    if first["least"] != first["dim"]:
        raise ValueError("dimension mismatch")
    n, shards = first["n"], max(1, -(-first["n"] // SHARD))
    dealt = nodes.select(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), "node", "v").repartitionById(shards, "shard").sortWithinPartitions("shard", "node")
    whole = written(dealt.mapInArrow(_graphs(degree), "shard int, node long, v array<double>, near array<long>"))
    edges = whole.select(F.lit(0).alias("level"), F.col("node").alias("src"), F.explode("near").alias("dst")) if n > TOP else None
    members = rows.join(nodes, "v").select("node", "key")
    return NeighbourGraph(whole, edges, written(members), int(n > TOP), n, shards)


class _Walker:
    """A shard: its nodes, in order of their ids, and the nodes that each is tied to."""

    def __init__(self, rows: list[pa.RecordBatch], k: int, effort: int):
        t = pa.Table.from_batches(rows).combine_chunks()
        self.ids, self.x = t.column("node").to_numpy(), _matrix(t.column("v").combine_chunks())
        near = t.column("near").combine_chunks()
        size = near.value_lengths().to_numpy()
        self.tied = np.full((len(size), max(1, int(size.max()))), -1)
        source = np.repeat(np.arange(len(size)), size)
        self.tied[source, np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size)] = np.searchsorted(self.ids, near.flatten().to_numpy())
        self.place = {v.tobytes(): i for i, v in enumerate(self.x)}
        rng = np.random.default_rng(len(size))
        self.entries = rng.permutation(len(size))[:TOP]
        self.k, self.effort = k, max(k, effort)
        # Its nodes' nearest are looked for without beginning at these themselves.
        sample = self.x[rng.permutation(len(size))[:SAMPLE]]
        true = np.sort(sample @ self.x.T, axis=1)[:, ::-1][:, :k]
        while self.effort < len(size):
            found = self.walk(sample, None, 1 << 30)[1]
            if (found[:, : true.shape[1]] >= true[:, -1:] - 1e-9).mean() >= TARGET:
                break
            self.effort *= 2

    def walk(self, q: np.ndarray, own: list[int | None] | None, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the best nodes seen (places, -1 for none), best first, their scores, and how many were scored."""
        n, b, size = len(self.ids), len(q), min(self.effort, len(self.ids))
        opens = max(1, size // 4)
        seen, first = np.zeros((b, n), bool), np.zeros((b, n), np.int32)
        at = np.tile(self.entries, (b, 1))
        seen[:, self.entries] = True
        extra = np.array([-1 if own is None or (o := own[i]) is None or seen[i, o] else o for i in range(b)])
        here = np.flatnonzero(extra >= 0)
        seen[here, extra[here]] = True
        at = np.c_[at, extra]
        score = np.where(at >= 0, np.c_[q @ self.x[self.entries].T, (q * self.x[extra]).sum(axis=1)], -np.inf)
        unopened = at >= 0
        scored = unopened.sum(axis=1)
        at, score, unopened = self._best(size, at, score, unopened)
        for _ in range(rounds):
            nth = np.cumsum(unopened, axis=1)
            row, col = np.nonzero(unopened & (nth <= opens))
            if not len(row):
                break
            unopened[row, col] = False
            to = self.tied[at[row, col]]
            row, to = np.repeat(row, to.shape[1]), to.ravel()
            new = (to >= 0) & ~seen[row, np.maximum(to, 0)]
            row, to = row[new], to[new]
            number = np.arange(len(row), dtype=np.int32)
            first[row, to] = number  # a node that several opened ones are tied to counts once
            once = first[row, to] == number
            row, to = row[once], to[once]
            if not len(row):
                continue
            seen[row, to] = True
            count = np.bincount(row, minlength=b)
            scored += count
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            at2, score2 = np.full((b, int(count.max())), -1), np.full((b, int(count.max())), -np.inf)
            at2[row, place] = to
            for i in range(0, len(row), 1 << 14):
                part = slice(i, i + (1 << 14))
                score2[row[part], place[part]] = np.einsum("ij,ij->i", q[row[part]], self.x[to[part]])
            at, score, unopened = self._best(size, np.c_[at, at2], np.c_[score, score2], np.c_[unopened, at2 >= 0])
        return at, score, scored

    @staticmethod
    def _best(size: int, *columns: np.ndarray) -> list[np.ndarray]:
        """at, score and unopened, the `size` best of each row, best first."""
        if columns[1].shape[1] > size:
            part = np.argpartition(-columns[1], size - 1, axis=1)[:, :size]
            columns = [np.take_along_axis(c, part, axis=1) for c in columns]
        order = np.lexsort((columns[0], -columns[1]), axis=1)
        return [np.take_along_axis(c, order, axis=1) for c in columns]

    def answers(self, rows: pa.RecordBatch, rounds: int) -> pa.RecordBatch:
        """(qid, node, score, scored) of the k best nodes for each query, and those that round alike; scored: the pairs of a query, in its first row."""
        if pc.any(pc.not_equal(pc.list_value_length(rows.column("v")), self.x.shape[1])).as_py():
            raise ValueError("dimension mismatch")
        q = _matrix(rows.column("v"))
        at, score, scored = self.walk(q, [self.place.get(v.tobytes()) for v in q], rounds)
        rounded = np.round(score, DIGITS)
        kth = rounded[:, min(self.k, rounded.shape[1]) - 1]
        row, col = np.nonzero((at >= 0) & (rounded >= kth[:, None]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows.column("node").to_numpy()[row], self.ids[at[row, col]], score[row, col], np.where(col == 0, scored[row], 0))], names=["qid", "node", "score", "scored"])


def _walk(graph: NeighbourGraph, queries: DataFrame, k: int, effort: int, rounds: int, column: str) -> DataFrame:
    """(qid, node, score, scored): the best nodes of each shard for each query."""
    asked = _unit(queries.where("qid is not null").select(F.col("qid").cast("long").alias("qid"), column), column)
    # A query goes to each shard; a shard's nodes come before the queries.
    shards = queries.sparkSession.range(graph.shards).select(F.col("id").cast("int").alias("shard"))
    asked = asked.crossJoin(F.broadcast(shards)).select("shard", F.lit(True).alias("asked"), F.col("qid").alias("node"), "v", F.lit(None).cast("array<long>").alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_shard(batches):
            held, walker = [], None
            for b in rows:
                cut = b.num_rows - int(pc.sum(b.column("asked")).as_py())
                if cut:
                    held.append(b.slice(0, cut))
                if cut < b.num_rows and held:
                    walker = walker or _Walker(held, k, effort)
                    for at in range(cut, b.num_rows, QUERIES):
                        yield walker.answers(b.slice(at, QUERIES), rounds)

    both = stacked(graph.nodes.select("shard", F.lit(False).alias("asked"), "node", "v", "near"), asked)
    return both.repartitionById(graph.shards, "shard").sortWithinPartitions("shard", "asked", "node").mapInArrow(run, "qid long, node long, score double, scored long")


def search(graph: NeighbourGraph, queries: DataFrame, k: int = 5, *, effort: int = 64, rounds: int = 40, column: str = "embedding") -> DataFrame:
    """(qid, key, score, rank): the k keys with the largest cosine found for each query (qid, column), ties by key. Queries without a valid vector have none.

    effort: how many nodes are kept in a shard for a query, at least: it is doubled until SAMPLE nodes find TARGET of their k nearest in the shard. A quarter of them are opened at once, until
    all are or `rounds` are done; more rounds never lower the recall. A query that is in the table finds itself. A node's members share its score: its first k keys count.
    """
    state = _walk(graph, queries, k, effort, rounds, column).select("qid", "node", F.round("score", DIGITS).alias("score"))
    # A node has a member at least, so what is behind k nodes, and rounds otherwise, is no hit.
    state = state.withColumn("place", F.rank().over(Window.partitionBy("qid").orderBy(F.desc("score")))).where(F.col("place") <= k).drop("place")
    first = F.row_number().over(Window.partitionBy("node").orderBy("key"))
    members = graph.members.withColumn("place", first).where(F.col("place") <= k)
    rows = state.join(members, "node").select("qid", "key", "score")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)


def share_scored(graph: NeighbourGraph, queries: DataFrame, k: int = 5, *, effort: int = 64, rounds: int = 40, column: str = "embedding") -> tuple[int, int]:
    """The pairs of queries and nodes that a search scores, and all of them."""
    got = _walk(graph, queries, k, effort, rounds, column).agg(F.coalesce(F.sum("scored"), F.lit(0)), F.countDistinct("qid")).first()
    return got[0], got[1] * graph.size
