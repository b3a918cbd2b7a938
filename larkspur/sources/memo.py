"""What a model has answered, kept by key as Parquet, so that no run asks for the same again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.frames import stacked
from larkspur.sources.shared import exists


@dataclass(frozen=True)
class Memo:
    """Answers of one model: files at `path` by model name and batch, with a key column and `fields` (DDL) of values.

    Several models may share a path: reading one opens its partitions alone. A batch is written with dynamic partition overwrite, so what a failed run left of it is
    replaced when it is repeated; other batches stay. Two writers may work at once on batches of different names: a key that both answer stands twice, and the first batch
    by name counts. Null keys are never asked nor kept.
    """

    path: str
    name: str
    key: str
    fields: str
    key_type: str = "string"

    def _stored(self, spark: SparkSession) -> DataFrame:
        schema = f"`{self.key}` {self.key_type}, {self.fields}, model string, batch string"
        if not exists(spark, self.path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path).where(F.col("model") == self.name)

    def entries(self, spark: SparkSession) -> DataFrame:
        """(key, values, batch), one row a key."""
        rows = self._stored(spark)
        values = [c for c in rows.columns if c not in (self.key, "model", "batch")]
        first = rows.groupBy(self.key).agg(F.min_by(F.struct(*values, "batch"), "batch").alias("of"))
        return first.select(self.key, *[F.col("of")[c].alias(c) for c in (*values, "batch")])

    def missing(self, asked: DataFrame) -> DataFrame:
        """The rows of asked whose key has no answer yet, one a key: rows of one key are taken to ask the same."""
        wanted = asked.where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        return wanted.join(self._stored(asked.sparkSession).select(self.key), self.key, "left_anti")

    def fill(self, asked: DataFrame, answer: Callable[[DataFrame], DataFrame], batch: str) -> None:
        """Ask `answer` (rows of asked to key and values, one row a key) for what is missing, and write it as the batch.

        A batch that was written before keeps its rows, and what is new joins them: repeating a run asks for nothing and changes nothing.
        """
        spark = asked.sparkSession
        own = self._stored(spark).where(F.col("batch") == batch).dropDuplicates([self.key])
        found = answer(self.missing(asked)).select(*[c for c in own.columns if c not in ("model", "batch")])
        found = found.withColumn("model", F.lit(self.name)).withColumn("batch", F.lit(batch)).to(own.schema)
        rows = stacked(own, found).hint("rebalance")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "batch").parquet(self.path)

    def look_up(self, asked: DataFrame) -> DataFrame:
        """asked with the values of its keys; null where there is no answer."""
        return asked.join(self.entries(asked.sparkSession).drop("batch"), self.key, "left")

    def answered(self, asked: DataFrame, answer: Callable[[DataFrame], DataFrame], batch: str) -> DataFrame:
        """fill, then look_up."""
        self.fill(asked, answer, batch)
        return self.look_up(asked)

    def compacted(self, spark: SparkSession, into: str, keys: DataFrame | None = None) -> Memo:
        """A memo at a new path with this model's entries, one a key and in few files; with `keys`, only those (each column of it but the key is left out)."""
        rows = self.entries(spark)
        if keys is not None:
            rows = rows.join(keys.select(self.key).where(F.col(self.key).isNotNull()), self.key, "left_semi")
        rows = rows.withColumn("model", F.lit(self.name)).withColumn("batch", F.lit("compacted")).hint("rebalance")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "batch").parquet(into)
        return Memo(into, self.name, self.key, self.fields, self.key_type)
