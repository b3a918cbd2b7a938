"""The stored index against the scan over the same chunks."""

import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import lexical, stored


def corpus_of(spark, seed, n):
    """Few words in very many chunks, many in few; some chunks are empty, some equal."""
    rng = random.Random(seed)
    word = lambda: f"w{min(int(rng.paretovariate(0.5)), 400)}"
    rows = [(k, f"t{k % 7}", " ".join(word() for _ in range(rng.choice([0, 3, 20, 80])))) for k in range(n)]
    rows += [(n + k, None, "w1 w1 w2 same same") for k in range(20)] + [(n + 20, None, None)]
    return spark.createDataFrame(rows, "chunk_ord long, title string, text string")


def hits(df):
    return sorted(map(tuple, df.select("qid", "chunk_ord", "score", "rank").collect()))


@pytest.mark.parametrize("batches, block", [(1, 1024), (3, 16)])
def test_search_equals_the_scan(spark, tmp_path, monkeypatch, batches, block):
    monkeypatch.setattr(stored, "BLOCK", block)
    chunks = corpus_of(spark, batches, 400)
    path = str(tmp_path / "index")
    for k in range(batches):
        stored.append(chunks.where(F.col("chunk_ord") % batches == k), path, k)
        stored.append(chunks.where(F.col("chunk_ord") % batches == k), path, k)  # a repeated batch replaces itself
    index = stored.read(spark, path)
    qs = [(0, "w1 w2 w3 w400"), (1, "w1"), (2, "w397 w1 w1 w2"), (3, "nothing"), (4, None), (5, "same w1"), (6, " ".join(f"w{k}" for k in range(1, 60))), (7, "t3 w2")]
    questions = spark.createDataFrame(qs, "qid long, query string")
    for k in (1, 5, 1000):
        assert hits(stored.search(index, questions, k)) == hits(lexical.search(lexical.build_index(chunks), questions, k))


def test_cells_that_cannot_matter_are_left_out(spark, tmp_path):
    """A rare word decides: the postings of the words in every chunk aren't read."""
    rows = [(k, "", f"common usual plain filler{k}" + (" rare rarer" if k % 500 == 0 else "")) for k in range(3000)]
    stored.append(spark.createDataFrame(rows, "chunk_ord long, title string, text string"), str(tmp_path), 0)
    index = stored.read(spark, str(tmp_path))
    q = spark.createDataFrame([(0, "common rare rarer usual plain")], "qid long, query string")
    r = stored.share_read(index, q, 3).first()
    assert r["n_postings"] == 9012 and r["n_kept"] <= 12
    assert [x["chunk_ord"] for x in stored.search(index, q, 3).orderBy("rank").collect()] == [0, 500, 1000]


def test_plan_opens_wanted_buckets_without_texts(spark, tmp_path):
    stored.append(corpus_of(spark, 9, 100), str(tmp_path), 0)
    index = stored.read(spark, str(tmp_path))
    q = spark.createDataFrame([(0, "w1 w400")], "qid long, query string")
    plan = stored.bounds(index, q)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and not any("text:" in s or "entries" in s for s in scans)
    assert any("dynamicpruning" in s and "bucket" in s for s in scans)


def test_a_batch_without_chunks_counts_for_nothing(spark, tmp_path):
    chunks = corpus_of(spark, 4, 50)
    stored.append(chunks, str(tmp_path), 0)
    index = stored.read(spark, str(tmp_path))
    q = spark.createDataFrame([(0, "w1 same")], "qid long, query string")
    want = hits(stored.search(index, q))
    stored.append(chunks, str(tmp_path / "other"), 1)
    (tmp_path / "other" / "postings" / "batch=1").rename(tmp_path / "postings" / "batch=1")
    assert hits(stored.search(stored.read(spark, str(tmp_path)), q)) == want


def test_many_questions_are_scored_in_one_pass(spark, tmp_path, monkeypatch):
    """Questions that share their terms ask for every posting once: no pair of a question and a chunk is looked up, and a number's blocks are made without shuffling postings."""
    monkeypatch.setattr(stored, "BLOCK", 64)
    chunks = corpus_of(spark, 7, 300)
    stored.append(chunks, str(tmp_path), 0)
    index = stored.read(spark, str(tmp_path))
    questions = spark.createDataFrame([(q, f"w1 w2 w{q} w5 w400") for q in range(40)], "qid long, query string")

    def none(*_):
        raise AssertionError("looked up")

    monkeypatch.setattr(stored, "_looked_up", none)
    for k in (1, 5, 1000):
        assert hits(stored.search(index, questions, k)) == hits(lexical.search(lexical.build_index(chunks), questions, k))


def test_append_deals_texts_not_terms(spark, tmp_path, monkeypatch):
    """Terms as arrays are several times their texts: they are made where their blocks are."""
    frame, seen = type(spark.range(1)), []
    deal = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: seen.append(self.dtypes) or deal(self, *a))
    stored.append(corpus_of(spark, 3, 40), str(tmp_path), 0)
    assert seen and all(kind != "array<string>" for columns in seen for _, kind in columns)
