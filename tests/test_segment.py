import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.operators import segment


def docs(spark, *texts):
    return spark.createDataFrame([(k, f"d{k}", "t", x, "s", "l") for k, x in enumerate(texts)], "doc_ord long, doc_id string, title string, text string, source string, license string")


def spans(df):
    return [(r["start"], r["end"]) for r in df.orderBy("chunk_ord").collect()]


def test_fixed_and_overlapping_windows(spark):
    d = docs(spark, "x" * 1000)
    fixed = spans(segment.chunk_fixed(d, 300, 0))
    assert len(fixed) == 4 and fixed[0] == (0, 300) and fixed[-1][1] == 1000
    assert spans(segment.chunk_fixed(d, 300, 60))[1][0] == 240


def test_first_blank_window_ends_the_chunking(spark):
    d = docs(spark, "a" * 300 + " " * 300 + "b" * 300, "", "   ", "a" * 300)
    rows = segment.chunk_fixed(d, 300, 0).collect()
    assert sorted(r["chunk_id"] for r in rows) == ["d0#0", "d3#0"]


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (10, 10), (10, -1)])
def test_bad_windows(spark, size, overlap):
    with pytest.raises(ValueError):
        segment.chunk_fixed(docs(spark, "a"), size, overlap)


def windows(text, size, overlap):
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if not text[at:end].strip():
            break
        out.append((at, end))
        if end == len(text):
            break
        at += size - overlap
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab 。\n", max_size=60), min_size=1, max_size=6), st.integers(1, 12), st.integers(0, 11))
def test_windows_against_a_sequential_model(spark, texts, size, overlap):
    overlap = min(overlap, size - 1)
    d = docs(spark, *texts)
    chunks = segment.chunk_fixed(d, size, overlap)
    got = {}
    for r in chunks.orderBy("chunk_ord").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    assert got == {f"d{k}": w for k, x in enumerate(texts) if (w := windows(x, size, overlap))}
    assert segment.chunk_faults(d, chunks).count() == 0


def test_sentences_keep_runs_of_marks(spark):
    rows = segment.sentence_spans(docs(spark, "一。！二\n\n  \n三; four. five")).orderBy("n").collect()
    assert [r["text"] for r in rows] == ["一。！", "二\n\n", "三; four. five"]
    assert [(r["n"], r["start"], r["end"]) for r in rows] == [(0, 0, 3), (1, 3, 6), (2, 9, 22)]


def test_structure_keeps_sentences_whole(spark):
    text = "# 标题\n第一句很长很长。第二句也很长很长。\n\n第二段第一句。第二段第二句话。"
    chunks = segment.chunk_structure(docs(spark, text), 20)
    assert all(r["text"].rstrip()[-1] in "。！？；" or r["text"].strip().startswith("#") for r in chunks.collect())
    assert segment.chunk_faults(docs(spark, text), chunks).count() == 0


def test_children_lie_in_their_parents(spark):
    text = "第一句。第二句话。第三句。\n\n" * 20
    d = docs(spark, text)
    rows = segment.chunk_parent_child(d, 25, 200).collect()
    assert rows and all(r["text"] in r["context"] for r in rows)
    assert len({r["chunk_id"] for r in rows}) == len(rows)
    mean = lambda xs: sum(map(len, xs)) / len(xs)
    assert mean([r["text"] for r in rows]) < mean([r["text"] for r in segment.chunk_fixed(d, 300, 0).collect()]) / 2


def test_stats_and_strategies(spark):
    d = docs(spark, "a" * 700, "b" * 100)
    r = segment.chunk_stats(d, segment.chunk_by(d, "fixed")).first()
    assert (r["n_docs"], r["n_chars"], r["n_chunks"], r["min_len"], r["p50_len"], r["max_len"]) == (2, 800, 4, 100, 300, 300)
    with pytest.raises(ValueError):
        segment.chunk_by(d, "none")
    assert segment.chunk_holes(segment.chunk_by(d, "overlap")).count() == 0
    assert segment.chunk_by(d.where(F.lit(False)), "parent-child").count() == 0


def test_spans_are_numbers_until_they_are_rows(spark):
    """Spans come from Arrow buffers: null, empty and astral texts, in batches of any size."""
    texts = [None, "", "# A\n\nbody one. 𝒳𝒳。two\n\n# B\nrest", "x" * 50, "\n \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_ord long, text string")
    for size in ("1", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = sorted((r["doc_ord"], r["n"], r["span"]["a"], r["span"]["b"]) for r in segment._spans(df, lambda t: segment.structure_of(t, 20), ["a", "b"]).collect())
        assert got == [(k, n, *s) for k, t in enumerate(texts) for n, s in enumerate(segment.structure_of(t or "", 20))]
    assert "ArrowEvalPython" in segment._spans(df, lambda t: [], ["a"])._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
