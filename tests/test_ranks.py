"""Places and order statistics against sorted lists."""

import random

from pyspark.sql import functions as F

from larkspur.operators import ranks
from larkspur.sources import corpus


def test_ordinals(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(3), f"n{rng.randrange(10**6)}-{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, name string").repartition(7)
    got = {(r["k"], r["name"]): r["ordinal"] for r in ranks.ordinals(df, "k", "name").collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows))}
    back = ranks.ordinals(df, F.desc("name"), name="place").orderBy("place").collect()
    assert [r["name"] for r in back] == sorted((n for _, n in rows), reverse=True) and [r["place"] for r in back] == list(range(1000))
    assert ranks.ordinals(df.where("false"), "k").count() == 0


def test_items_of_groups_with_ties_and_one_value(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", None]), float(rng.randrange(5))) for k in range(301)] + [(1000, "c", 7.0), (1001, "d", None), (1002, "d", 1.0)]
    rows += [(2000 + k, "e", 4.0) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    for share in (0.0, 0.5, 0.9, 1.0):
        want = {}
        for g in ("a", "b", None, "c", "d", "e"):
            values = sorted((v for _, h, v in rows if h == g), key=lambda v: (v is None, v))
            want[g] = values[min(int(len(values) * share), len(values) - 1)]
        assert {r["g"]: r["item"] for r in ranks.items_at(df, "g", "v", "id", share).collect()} == want


def test_no_task_orders_texts(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / f"{name}.md").write_text(f"text of {name}")
    docs = corpus.load_docs(spark, [str(tmp_path)])
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert [(r["doc_ord"], r["doc_id"], r["text"]) for r in docs.orderBy("doc_ord").collect()] == [(0, "a", "text of a"), (1, "b", "text of b")]
    assert "SinglePartition" not in "".join(x for x in plan.splitlines() if "value" in x)
