"""Vectors stored by cell, so that a search opens the cells alone that its queries look into.

A stored row is a block of one cell's vectors; a query is a row for each cell that it looks into, and rows of a cell are blocks too. They are joined on the cell, which is
the partition column of the stored table: Spark prunes the others' files at run time. A cell with a third of all vectors is many blocks in many files, not one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.frames import written
from larkspur.operators.lexical import DIGITS, rank
from larkspur.operators.vector import Cells

#: Vectors and queries in a block, and bytes of queries, one for each cell that they look into, that may be broadcast.
VECTORS, QUERIES, FEW = 256, 64, 64 << 20


def _cell(cells: Cells):
    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(cells.nearest(np.array(v.tolist(), float)) if len(v) else [], dtype="int32")

    return cell


def _looks(cells: Cells):
    @F.pandas_udf("array<int>")
    def looks(v: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(r).astype(np.int32) for r in cells.looks_into(np.array(v.tolist(), float))] if len(v) else [], dtype=object)

    return looks


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """(cell, id, v), sorted by cell within partitions, to (cell, ids, vs): up to `most` vectors of a cell after each other."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, ids, v = b.column("cell").to_numpy(), b.column("id"), b.column("v")
            cuts = np.flatnonzero(cell[1:] != cell[:-1]) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
                for at in range(i, j, most):
                    n = min(most, j - at)
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[at])], pa.int32()), pa.array([ids.slice(at, n)], pa.list_(pa.int64())), pa.array([v.slice(at, n).flatten()], pa.list_(pa.float64()))], names=["cell", "ids", "vs"])

    return rows.select("cell", "id", F.col("v").cast("array<double>").alias("v")).mapInArrow(pack, "cell int, ids array<long>, vs array<double>")


def write_cells(vectors: DataFrame, cells: Cells, path: str, *, key: str = "chunk_ord", column: str = "embedding") -> None:
    """Stores all vectors (key, column) that aren't null under path, partitioned by cell. Files of a cell are even in size: adaptive execution splits large cells and joins small ones."""
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).alias("v"))
    rows = rows.withColumn("cell", _cell(cells)("v")).hint("rebalance", "cell").sortWithinPartitions("cell")
    _blocks(rows, VECTORS).write.mode("overwrite").partitionBy("cell").parquet(path)


def search_cells(spark: SparkSession, path: str, queries: DataFrame, cells: Cells, k: int = 5, *, key: str = "chunk_ord", column: str = "embedding") -> DataFrame:
    """(qid, key, score, rank), as ann_search gives it, from the stored vectors. Queries without a vector have none."""
    asked = queries.where(F.col(column).isNotNull()).select(F.col("qid").alias("id"), F.col(column).alias("v"))
    asked = asked.withColumn("cell", F.explode(_looks(cells)("v")))
    # A cell's queries come together by one shuffle; many queries of one cell are many blocks.
    wanted = written(_blocks(asked.repartition("cell").sortWithinPartitions("cell"), QUERIES).select("cell", F.col("ids").alias("qids"), F.col("vs").alias("qs")))
    few = wanted.agg(F.coalesce(F.sum(F.size("qs")), F.lit(0))).first()[0] * 8 <= FEW
    # Partitions are pruned at run time only by a side that has a filter: this one holds always.
    wanted = wanted.where("cell >= 0")
    pairs = spark.read.parquet(path).join(F.broadcast(wanted) if few else wanted, "cell").select("ids", "vs", "qids", "qs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, qids = (np.asarray(b.column(c)[i].values) for c in ("ids", "qids"))
                x, q = (np.asarray(b.column(c)[i].values).reshape(n, -1) for c, n in (("vs", len(ids)), ("qs", len(qids))))
                if x.shape[1] != q.shape[1]:
                    raise ValueError("dimension mismatch")
                order = np.argsort(ids, kind="stable")
                scores = np.round(q @ x[order].T, DIGITS) + 0.0
                top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, top.shape[1])), pa.array(ids[order][top.ravel()]), pa.array(np.take_along_axis(scores, top, axis=1).ravel())], names=["qid", key, "score"])

    return rank(pairs.mapInArrow(score, f"qid long, {key} long, score double"), order=key).where(F.col("rank") <= k)
