"""Ordinals and order statistics of whole tables without a task that holds one: rows in ranges of their order, counted by range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.frames import written

#: Bits of monotonically_increasing_id that count within a partition.
INSIDE = 33


def ordinals(df: DataFrame, *by: str | Column, name: str = "ordinal") -> DataFrame:
    """df with the place of each row, from 0, in the order of `by`, which should leave no ties (places of equal rows are any of theirs).

    One range shuffle of df: hand in keys alone, and join the rest back. Equal rows lie in one range; add a key to split very many of them. Only a count for each range is summed up in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", INSIDE).alias("_part")
    sizes = rows.select(part).groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_start"))
    placed = rows.select("*", part).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << INSIDE) - 1))).drop("_id", "_part", "_start")


def items_at(df: DataFrame, group: str, value: str, key: str, share: float, name: str = "item") -> DataFrame:
    """(group, name): item floor(n * share) (the last at most) of each group's n values in ascending order, nulls last. key tells rows apart, so that a group of equal values spreads over ranges.

    However few groups there are, no task holds one: places are those in the order of all rows, less the group's first.
    """
    rows = ordinals(df.select(group, value, key), F.col(group).asc_nulls_first(), F.col(value).asc_nulls_last(), F.col(key), name="at")
    of = rows.groupBy(group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    wanted = of.select(F.col(group).alias("of"), (F.col("first") + F.least(F.floor(F.col("n") * F.lit(share)), F.col("n") - 1)).alias("at"))
    return rows.join(wanted, "at").select(F.col("of").alias(group), F.col(value).alias(name))
