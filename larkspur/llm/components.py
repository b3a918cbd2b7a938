"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import drop_table, write_table


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to a star for each component among them: at most as many as came in."""
    for b in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.get(top, top) != top:
                top = root[top]
            while root.get(x, x) != top:
                root[x], x = top, root[x]
            return top

        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root.setdefault(x, x)
            root.setdefault(y, y)
            if x != y:
                root[max(x, y)] = min(x, y)
        found = [(x, t) for x in root if (t := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], names=["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a > b). Large: each vertex hands its larger neighbours its least neighbour; small: its smaller ones and itself.

    The minima are written first: the join then has an exchange on either side, whose skewed partitions adaptive
    execution splits, so a vertex with a third of all edges makes no large task.
    """
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = write_table(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-minima")
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = write_table(out.where("a <> b").distinct(), "star-edges")
    drop_table(least)
    return out


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component) of every id with an edge to another: component is the least id reachable.

    Edges with a null end and loops are left out; direction and repeats don't matter. All state is in tables in the
    shared folder; rounds grow with the logarithm of the longest path. An empty table gives an empty result.
    """
    ends = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    at = write_table(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).mapInArrow(_forest, "a long, b long"), "edges")
    seen = None
    for _ in range(most_rounds):
        first = _star(at, large=True)
        drop_table(at)
        at = _star(first, large=False)
        drop_table(first)
        now = tuple(at.agg(F.count(F.lit(1)), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())
        if now == seen or now[0] == 0:
            # Stars: each vertex has one edge, to the least of its component.
            return at.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(at.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components not settled after {most_rounds} rounds")
