"""Answers kept by key: asked once, whatever fails and is repeated."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.functions.models import embed_missing, expand_questions
from larkspur.sources.memo import Memo


class Counting:
    """An answer that leaves a file for each key it is asked for, and fails on keys in `bad`."""

    def __init__(self, folder, bad=()):
        self.folder, self.bad = str(folder), set(bad)
        folder.mkdir(exist_ok=True)

    def __call__(self, rows):
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
        folder, bad = self.folder, self.bad

        def run(parts):
            for part in parts:
                for k in part["k"]:
                    if k in bad:
                        raise ValueError("model down")
                    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                        f.write(k)
                yield pd.DataFrame({"k": part["k"], "v": [len(k) for k in part["k"]]})

        return rows.select("k").mapInPandas(run, "k string, v long")

    def asked(self):
        from pathlib import Path

        return sorted(f.read_text() for f in Path(self.folder).iterdir())


def frame(spark, *keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, other long")


def test_a_second_run_asks_for_nothing(spark, tmp_path):
    memo, model = Memo(str(tmp_path / "m"), "org/model one", "k", "v long"), Counting(tmp_path / "asked")
    rows = frame(spark, "a", "bb", "bb", None, "")
    got = {(r["k"], r["other"]): r["v"] for r in memo.answered(rows, model, "1").collect()}
    assert got == {("a", 0): 1, ("bb", 1): 2, ("bb", 2): 2, (None, 3): None, ("", 4): 0} and model.asked() == ["", "a", "bb"]
    for batch in ("1", "2"):
        memo.fill(rows, model, batch)
        assert model.asked() == ["", "a", "bb"] and memo.entries(spark).count() == 3
    # A batch that grows keeps its rows; another asks only for what is new.
    memo.fill(frame(spark, "ccc"), model, "1")
    memo.fill(frame(spark, "a", "ccc", "dddd"), model, "3")
    assert model.asked() == ["", "a", "bb", "ccc", "dddd"]
    assert {r["k"]: r["batch"] for r in memo.entries(spark).collect()} == {"": "1", "a": "1", "bb": "1", "ccc": "1", "dddd": "3"}
    memo.fill(rows.where("false"), model, "4")
    assert memo.missing(frame(spark, "a", "e", "e", None)).select("k").collect() == [("e",)]


def test_a_failed_run_is_repeated_without_duplicates(spark, tmp_path):
    memo = Memo(str(tmp_path / "m"), "m", "k", "v long")
    memo.fill(frame(spark, "a"), Counting(tmp_path / "asked"), "1")
    rows = frame(spark, "a", "b", "c", "d").repartition(4)
    with pytest.raises(Exception, match="model down"):
        memo.fill(rows, Counting(tmp_path / "asked", bad="d"), "2")
    assert [r["k"] for r in memo.entries(spark).collect()] == ["a"]
    # What half a commit leaves: some of the batch's rows, one of them twice.
    half = spark.createDataFrame([("b", 1, "m", "2")] * 2, "k string, v long, model string, batch string")
    half.write.mode("append").partitionBy("model", "batch").parquet(memo.path)
    again = Counting(tmp_path / "again")
    memo.fill(rows, again, "2")
    assert again.asked() == ["c", "d"]
    assert sorted(r["k"] for r in spark.read.parquet(memo.path).collect()) == ["a", "b", "c", "d"]


def test_models_apart_pruning_and_compaction(spark, tmp_path):
    one, two = (Memo(str(tmp_path / "m"), n, "k", "v long") for n in ("one", "two"))
    model = Counting(tmp_path / "asked")
    for batch, key in enumerate("abc"):
        one.fill(frame(spark, key), model, str(batch))
    assert two.entries(spark).count() == 0 and sorted(r["k"] for r in two.missing(frame(spark, "a", "z")).collect()) == ["a", "z"]
    two.fill(frame(spark, "a"), model, "0")
    assert model.asked() == ["a", "a", "b", "c"]
    plan = one.missing(frame(spark, "a"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and "ReadSchema: struct<k:string>" in plan
    # Two writers answered the same key: the first batch counts.
    spark.createDataFrame([("a", 9, "one", "9")], "k string, v long, model string, batch string").write.mode("append").partitionBy("model", "batch").parquet(one.path)
    small = one.compacted(spark, str(tmp_path / "small"), frame(spark, "a", "a", "c", "nowhere", None))
    assert sorted(map(tuple, small.entries(spark).select("k", "v").collect())) == [("a", 1), ("c", 1)]
    assert one.compacted(spark, str(tmp_path / "all")).entries(spark).count() == 3
    small.fill(frame(spark, "a", "b"), model, "next")
    assert model.asked() == ["a", "a", "b", "b", "c"]


def test_expansions_and_vectors_are_kept(spark, tmp_path):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])

    class Random:
        name, dim = "r", 1

        def expand(self, question):
            return [question, uuid.uuid4().hex]

        def embed(self, texts):
            return [[float(uuid.uuid4().int % 1000)] for _ in texts]

    questions = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, None)], "qid long, query string")
    memo = Memo(str(tmp_path / "e"), "llm", "text", "variants array<string>")
    first, second = (sorted(map(tuple, expand_questions(questions, Random(), memo, b).collect()), key=str) for b in "12")
    assert first == second and len(first) == 7 and (3, 0, None) in first and len({r[2] for r in first}) == 5
    vectors = Memo(str(tmp_path / "v"), "r", "chunk_id", "embedding array<float>")
    chunks = questions.select(F.col("qid").cast("string").alias("chunk_id"), F.col("query").alias("text"))
    runs = [sorted((r["chunk_id"], r["embedding"][0]) for r in embed_missing(chunks.where(w), vectors, Random, b).collect()) for w, b in (("chunk_id < '3'", "1"), ("true", "2"))]
    assert len(runs[1]) == 4 and runs[1][:3] == runs[0]
