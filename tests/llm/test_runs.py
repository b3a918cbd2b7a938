"""Periodic runs against definitions spelled out."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import periodic_runs, registry


def plain_runs(x, shortest=12, exponent=2):
    """Every distance is walked from end to end; of equal stretches the smallest distance is the period."""
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1 if j == i else j
    return sorted((a, b - a, q) for (a, b), q in out.items())


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        n, letters = rng.randrange(90), rng.choice([1, 2, 3, 5, 20])
        x = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:  # a planted run, some with changes
            s, p = rng.randrange(n), rng.randrange(1, 30)
            x[s:] = [x[s + (i - s) % min(p, n - s)] for i in range(s, n)]
            for _ in range(rng.randrange(3)):
                x[rng.randrange(n)] = rng.randrange(letters)
        shortest, exponent = rng.choice([12, 12, 1, 4, 20, 33]), rng.choice([2, 2, 3])
        assert periodic_runs.runs_of(np.array(x, np.int32), shortest=shortest, exponent=exponent) == plain_runs(x, shortest, exponent)


def test_every_period_has_a_scale_that_its_runs_repeat():
    for n in (2, 12, 40, 400):
        for shortest in (1, 12, 50):
            at = 1
            for b, lo, hi in periodic_runs._scales(n, shortest):
                assert lo == at and all(2 * b - 1 <= max(shortest - q, q) < 4 * b - 1 for q in range(lo, hi + 1))
                at = hi + 1
            assert at == n // 2 + 1


def test_seeds_in_parts_give_the_same(monkeypatch):
    x = np.array([k % 3 for k in range(40)] + list(range(10)) * 3 + [7] * 20, np.int32)
    want = periodic_runs.runs_of(x)
    monkeypatch.setattr(periodic_runs, "SEEDS", 3)
    assert periodic_runs.runs_of(x) == want == plain_runs(x.tolist())


def test_long_sequences_take_no_square_of_time():
    began = time.time()
    word = ["a", "ab"]
    while len(word[1]) < 100_000:
        word = [word[1], word[1] + word[0]]
    for x, most in ((np.zeros(300_000, np.int32), 1), (np.arange(200_000, dtype=np.int32) % 7, 1), (np.tile(np.arange(40_000, dtype=np.int32), 3), 1), (np.frombuffer(word[1].encode(), np.uint8) - 97, len(word[1]))):
        assert 1 <= len(periodic_runs.runs_of(x.astype(np.int32))) <= most
    assert time.time() - began < 60


def test_exponents_under_two_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.runs_of(np.zeros(20, np.int32), exponent=1)


def test_rows_keep_their_columns(spark):
    texts = [None, "", " \n\t", "one two", "x " * 12, "a b c d\v" * 3 + "end", "a b c d " * 3, "a b c d " * 3, "x " * 11 + "X", "é" * 50_000, "p q r " * 20_000 + "end"]
    df = spark.createDataFrame([(k if k != 5 else None, x, "clash", "other") for k, x in enumerate(texts)], "id long, body string, Runs string, text_of string")
    rows = periodic_runs.find_runs(df, text_col="body").orderBy("id").collect()
    assert sorted(r["body"] or "" for r in rows) == sorted(x or "" for x in texts) and {r["text_of"] for r in rows} == {"other"}
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r["body"] or "")
        runs = [tuple(x) for x in r["runs"]]
        assert r["n_words"] == len(words)
        if len(words) < 1000:
            assert runs == plain_runs(words)
        else:
            assert runs == [(0, 60_000, 3)] and r["collapsed"] == "p q r end"
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r["collapsed"] == " ".join(w for i, w in enumerate(words) if i not in gone)
    empty = periodic_runs.find_runs(df.where("false"), text_col="body")
    assert empty.count() == 0 and empty.columns == ["id", "body", "text_of", "n_words", "runs", "collapsed"]


def test_query_against_brute_force(spark, tmp_path):
    """The driver's short texts, and planted ones: nulls, repeated rows, junk of one word, many runs in one text."""
    of = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rng = random.Random(3)
    more = [None, "", "  ", "spam " * 60, "a b " * 8 + "c d e " * 7 + "c d e", " ".join(rng.choice("ab") for _ in range(200)), "l1\nl2\n" * 9]
    rows = [(k, x) for k in range(1000, 1060) for x in more] + [(None, "u v w " * 9), (1000, "spam " * 60)]
    docs = of.where("length(text) < 2500").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    docs.withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    got, want = [], []
    for r in registry.op12_periodic_runs(spark, str(tmp_path)).collect():
        got.append((r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]))
    for doc_id, text in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = min(((-length, s, q) for s, length, q in runs), default=None)
        best = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((doc_id, len(runs), *best, digest("".join(f"{s},{length},{q}\n" for s, length, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[1] > 0 for x in got) > 100
