"""The jobs over growing input, failures, other settings, and their command lines."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import common, feed_index, retrieval_report
from larkspur.operators import lexical, segment, stored
from larkspur.sources import corpus

ROOT = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string"
ROWS = [(k, f"Title {k}\nword{k} and common text\n" * (1 + k % 4 * 10), ["en", "", None][k % 3], "s") for k in range(12)]


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def chunks_of(spark, rows):
    docs = corpus.documents_as_docs(spark.createDataFrame(rows, DOCS).where("doc_id is not null").dropDuplicates(["doc_id"]), "lang")
    return segment.chunk_fixed(docs, 300, 60)


def same_as_a_batch(spark, out, rows):
    columns = ["chunk_ord", "chunk_id", "text", "source", "lang", "start", "end"]
    got, want = spark.read.parquet(f"{out}/chunks"), chunks_of(spark, rows)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    q = spark.createDataFrame([(0, "word5 common"), (1, "title")], "qid long, query string")
    hits = lambda x: sorted(map(tuple, x.select("qid", "chunk_ord", "score", "rank").collect()))
    assert hits(stored.search(stored.read(spark, out), q)) == hits(lexical.search(lexical.build_index(want), q))


def test_feed_takes_only_what_is_new(spark, tmp_path):
    source, out, ck = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "ck")
    first = [*ROWS[:6], (None, "no id", "en", "s"), (100, None, "en", "s"), (101, "", "en", None)]
    spark.createDataFrame(first, DOCS).coalesce(1).write.parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    assert feed_index.run(spark, source, out, ck) == {"batches": 1, "documents": 9}
    same_as_a_batch(spark, out, first)
    was = files(out)
    assert feed_index.run(spark, source, out, ck) == {"batches": 0, "documents": 0} and files(out) == was  # nothing new, nothing written
    spark.createDataFrame([*ROWS[4:], (5, *ROWS[5][1:])], DOCS).coalesce(1).write.mode("append").parquet(source)  # 4 and 5 come again
    assert feed_index.run(spark, source, out, ck)["documents"] == 9
    assert was.items() <= files(out).items()  # earlier batches stay as they are
    same_as_a_batch(spark, out, [*first, *ROWS[6:]])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert {r[0] for r in spark.read.parquet(f"{out}/chunks").select("lang_key").distinct().collect()} == {"en", "none"}


def test_a_batch_that_fails_is_repeated_without_traces(spark, tmp_path, monkeypatch):
    source, out, ck = str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "ck")
    spark.createDataFrame(ROWS, DOCS).write.parquet(source)
    append = stored.append

    def fails(chunks, path, batch, **more):
        append(chunks, path, batch, **more)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(stored, "append", fails)
        with pytest.raises(Exception, match="lost"):
            feed_index.run(spark, source, out, ck)
    assert feed_index.run(spark, source, out, ck)["documents"] == len(ROWS)
    same_as_a_batch(spark, out, ROWS)


def test_feed_in_small_batches_is_the_same(spark, tmp_path):
    source, out = str(tmp_path / "docs"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(ROWS[4 * k : 4 * k + 4], DOCS).coalesce(1).write.mode("append").parquet(source)
    assert feed_index.run(spark, source, out, str(tmp_path / "ck"), {"files_per_batch": 1}) == {"batches": 3, "documents": 12}
    same_as_a_batch(spark, out, ROWS)


def test_report_replaces_its_routes_only(spark, tmp_path):
    docs, questions, out = str(tmp_path / "docs"), str(tmp_path / "questions"), str(tmp_path / "out")
    spark.createDataFrame([*ROWS, (100, None, None, None), (101, "", None, None)], DOCS).write.parquet(docs)
    spark.createDataFrame([(0, "word5 and common"), (1, "word7 and"), (2, "nowhere at all"), (3, None)], "item_id long, text string").write.parquet(questions)
    report = retrieval_report.run(spark, docs, questions, out)
    assert report == {"documents": 14, "questions": 4, "answerable": 2, "outcomes": 12}
    rows = spark.read.parquet(f"{out}/outcomes")
    got = sorted(map(tuple, rows.where("mode = 'bm25'").select("qid", "rank", "pool_rank").collect()))
    assert got == [(0, 0, 0), (1, 0, 0), (2, -1, -1), (3, -1, -1)]
    was, all_rows = files(out), sorted(map(str, rows.collect()))
    retrieval_report.run(spark, docs, questions, out, {"modes": ["bm25"]})
    now = files(out)
    assert {p for p in was if "mode=bm25" not in p} == {p for p in now if "mode=bm25" not in p} and was.keys() != now.keys()
    assert sorted(map(str, spark.read.parquet(f"{out}/outcomes").collect())) == all_rows
    assert spark.read.parquet(f"{out}/summary").where("mode = 'bm25'").first()["mrr"] == 1.0


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"size": 100}))
    assert common.config_of(feed_index.__file__, str(tmp_path / "c.json"), spark) == {"size": 100, "overlap": 60, "files_per_batch": 64}
    (tmp_path / "c.json").write_text(json.dumps({"sise": 100}))
    with pytest.raises(ValueError, match="sise"):
        common.config_of(feed_index.__file__, str(tmp_path / "c.json"), spark)


def test_command_line(spark, tmp_path):
    spark.createDataFrame(ROWS, DOCS).write.parquet(str(tmp_path / "docs"))
    (tmp_path / "c.json").write_text(json.dumps({"overlap": 0}))
    args = [sys.executable, "-m", "jobs.feed_index", "--documents", str(tmp_path / "docs"), "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "ck"), "--config", str(tmp_path / "c.json")]
    done = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "read 12 documents" in done.stderr
    assert spark.read.parquet(str(tmp_path / "out" / "chunks")).agg(F.max("end")).first()[0] == max(len(r[1]) for r in ROWS)


def test_feed_index_is_read_back_without_joining_texts(spark):
    """Texts become digests before chunks meet their postings."""
    from jobs.registry import job1_feed_index

    plan = job1_feed_index(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("md5(")
