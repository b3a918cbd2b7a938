"""Frames put together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

#: Spark's switch for unions that claim the partitioning of their inputs.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def stacked(*frames: DataFrame, by_name: bool = False) -> DataFrame:
    """All rows of frames of one schema, by the place of columns or by name.

    Spark 4.1 takes a union of frames that are partitioned alike as partitioned like them, and groups it without a shuffle. Where adaptive execution then coalesces
    the frames' shuffles differently, groups fall apart and results are wrong: so this turns that switch off in the session. Versions without it ignore the setting.
    """
    frames[0].sparkSession.conf.set(UNION_PARTITIONING, "false")
    return reduce(DataFrame.unionByName if by_name else DataFrame.unionAll, frames)


def written(df: DataFrame) -> DataFrame:
    """df as it is now: written to the checkpoint folder, if the session has one, so that a lost executor makes nothing anew; else cached."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return df.checkpoint() if folder else df.cache()
