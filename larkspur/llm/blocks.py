"""All pairs of a group, in blocks: what a task holds has a bound, whatever the size of the group, and no pair becomes a row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import table_bytes, write_table
from larkspur.llm.wordhash import tidy


def large_groups(rows: DataFrame, block: int, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(key, n_main, n_rest): the blocks of the groups over `block` rows, apart for rows with rest (a boolean) and the others; a broadcast if it is under broadcast_bytes."""
    by = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("rest").alias("rest")).where(F.col("n") > block)
    large = write_table(by.select("key", F.ceil((F.col("n") - F.col("rest")) / block).cast("int").alias("n_main"), F.ceil(F.col("rest") / block).cast("int").alias("n_rest")), "large-groups")
    return F.broadcast(large) if table_bytes(large) <= broadcast_bytes else large


def deal(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows (key, id, rest, ...) with n_blocks, lo, hi, side and unit beside their own columns: in a large group each block of rest meets every block, itself among them; the other blocks don't meet each other.

    So a group whose rest is small costs its size. A group that isn't large is one block.
    """
    x = rows.join(large, "key", "left").withColumn("n_blocks", F.col("n_main") + F.col("n_rest"))
    block = lambda n: F.pmod(F.xxhash64("id"), F.greatest(F.col(n), F.lit(1))).cast("int")
    x = x.withColumn("own", F.when(F.col("n_blocks").isNull(), 0).when(F.col("rest"), F.col("n_main") + block("n_rest")).otherwise(block("n_main")))
    first = F.when(F.col("rest"), 0).otherwise(F.col("n_main"))
    partners = F.when(F.col("n_blocks").isNull(), F.array(F.lit(0))).when(F.col("n_blocks") > first, F.sequence(first, F.col("n_blocks") - 1))
    x = x.withColumn("other", F.explode(partners)).withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    return x.withColumn("side", (F.col("own") > F.col("other")).cast("int")).withColumn("unit", F.xxhash64("key") + F.coalesce(F.col("lo") * F.col("n_blocks") + F.col("hi"), F.lit(0)))


def run_blocks(dealt: DataFrame, columns: list[str], work: Callable[[int, pa.Table, pa.Table | None], list | None], schema: str) -> DataFrame:
    """Rows that work(key, a, b) makes of each pair of blocks, as arrays of the schema's columns or None; a and b have `columns`, b is None for pairs within one block.

    schema: "name type, ..." of long, int and boolean columns. One shuffle, in which the pairs of blocks of a group go to partitions in turn, then one pass over each
    sorted partition.
    """
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = dealt.select("key", "lo", "hi", "side", *columns, F.pmod("unit", F.lit(n)).cast("int").alias("to_partition")).repartitionById(n, F.col("to_partition"))
    ordered = spread.drop("to_partition").sortWithinPartitions("key", "lo", "hi", "side")
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    arrow = pa.schema([(name, types[kind]) for name, kind in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple[int, int, int] | None = None
        held: list[pa.RecordBatch] = []
        out: list[list] = []
        size = 0

        def done() -> int:
            rows = sum(b.num_rows for b in held)
            if rows < 2:
                return 0
            t = pa.Table.from_batches(held).combine_chunks()
            a = int(np.count_nonzero(t.column("side").to_numpy() == 0))
            t = t.select(columns)
            made = (work(now[0], t, None) if now[1] == now[2] else work(now[0], t.slice(0, a), t.slice(a)) if 0 < a < rows else None) or None
            if made is not None and len(made[0]):
                out.append(made)
                return len(made[0])
            return 0

        def batch() -> pa.RecordBatch:
            found = [np.concatenate(x) for x in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, arrow, strict=True)], schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            key, lo, hi = (b.column(i).to_numpy() for i in range(3))
            cuts = (np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1).tolist()
            for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                unit = (int(key[i]), int(lo[i]), int(hi[i]))
                if unit != now:
                    size += done()
                    now, held = unit, []
                    if size > 50_000:
                        yield batch()
                        size = 0
                held.append(b.slice(i, j - i))
        done()
        if out:
            yield batch()

    return ordered.mapInArrow(tidy(run), schema)
