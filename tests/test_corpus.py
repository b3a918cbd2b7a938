import numpy as np
import pytest

from pyspark.sql import functions as F

from larkspur.functions.models import LlmExpander, MapExpander, Settings, embed_column, expand_questions
from larkspur.operators import lexical, segment, stored
from larkspur.sources import corpus
from larkspur.streaming import index as stream


def test_front_matter(spark):
    raw = ["---\r\ntitle: A: b\nlicense : CC\nbad line\n---\n\n body \n", "no header", "---\ntitle: x\n---\n"]
    rows = corpus.parse_front_matter(spark.createDataFrame([(k, f"d{k}", x) for k, x in enumerate(raw)], "doc_ord long, doc_id string, raw string")).orderBy("doc_ord").collect()
    assert (rows[0]["title"], rows[0]["license"], rows[0]["source"], rows[0]["text"]) == ("A: b", "CC", "unknown", "body")
    assert (rows[1]["title"], rows[1]["text"]) == ("d1", "no header") and rows[2]["text"] == ""


def test_load_folders_and_gold(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for name in ("b/z.md", "b/a.md", "b/skip.txt"):
        (tmp_path / name).write_text(f"---\ntitle: {name}\n---\ntext")
    (tmp_path / "gold.jsonl").write_text('{"id": "g1", "question": "q", "goldDocIds": ["a"], "mustContain": ["x"], "note": "n"}\n\n')
    rows = corpus.load_docs(spark, [str(tmp_path / "missing"), str(tmp_path / "b")]).orderBy("doc_ord").collect()
    assert [r["doc_id"] for r in rows] == ["a", "z"]
    assert corpus.load_docs(spark, [str(tmp_path / "missing")]).count() == 0
    g = corpus.load_gold(spark, str(tmp_path / "gold.jsonl")).collect()
    assert len(g) == 1 and g[0]["gold_doc_ids"] == ["a"] and g[0]["expect"] is None


def test_chunk_files(spark, tmp_path):
    docs = spark.createDataFrame([(0, "d", "t", "text " * 100, "s", "l")], "doc_ord long, doc_id string, title string, text string, source string, license string")
    chunks = segment.chunk_fixed(docs)
    corpus.write_jsonl(chunks, str(tmp_path / "c"))
    assert sorted(corpus.read_chunks(spark, str(tmp_path / "c")).collect()) == sorted(chunks.collect())


def test_tail_and_slug(spark):
    rows = spark.createDataFrame([("body\n 参考文献 \nlater", 7), ("body 参考文献", 1234), ("a/b: c", 1)], "t string, i int")
    got = rows.select(corpus.strip_tail(F.col("t")).alias("t"), corpus.slug(F.col("t"), F.col("i")).alias("s")).collect()
    assert got[0]["t"] == "body" and got[1]["t"] == "body 参考文献" and got[1]["s"].startswith("wiki-1234-") and got[2]["s"] == "wiki-001-a_b__c"


def test_ingest(spark):
    articles = spark.createDataFrame([("have", "x" * 300), ("gone", None), ("short", "x"), ("ok", "x" * 300)], "title string, raw string")
    r = corpus.ingest_report(corpus.ingest(articles, spark.createDataFrame([("have",)], "title string"))).first()
    assert (r["n_ok"], r["n_miss"], r["n_chars"]) == (1, 2, 300)


def test_fetch_waits_and_gives_up():
    waits, answers = [], [(429, {"retry-after": "2"}, None), (503, {}, None), (200, {}, {"query": {"pages": [{"extract": "text"}]}})]
    assert corpus.fetch_article(lambda t: answers.pop(0), "t", sleep=waits.append) == "text" and waits == [2.0, 15.0]
    assert corpus.fetch_article(lambda t: (200, {}, {"query": {"pages": [{"missing": True}]}}), "t") is None
    with pytest.raises(RuntimeError):
        corpus.fetch_article(lambda t: (500, {}, None), "t", sleep=waits.append)
    with pytest.raises(RuntimeError):
        corpus.fetch_article(lambda t: (404, {}, None), "t")


def test_a_question_is_expanded_once(spark):
    class Counted:
        def expand(self, question):
            import uuid

            return [question, uuid.uuid4().hex]

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
    df = spark.createDataFrame([(k, "same") for k in range(20)] + [(20, "other")], "qid long, query string").repartition(4)
    rows = expand_questions(df, Counted()).collect()
    assert len(rows) == 42 and len({r["query"] for r in rows if r["variant"] == 1}) == 2


def test_article_urls_and_the_schema_of_answers():
    assert corpus.article_url("a b&c", "https://host/w/api.php").endswith("&redirects=1&titles=a%20b%26c")
    from larkspur.schema import answer_json_schema

    s = answer_json_schema()
    assert "refusalReason" not in s["required"] and s["properties"]["claims"]["items"]["properties"]["quote"]["minLength"] == 2


def test_seeded_numbers(spark):
    from larkspur.functions.vectors import mulberry32

    def by_hand(seed, n):
        out, a = [], seed
        for _ in range(n):
            a = (a + 0x6D2B79F5) % 2**32
            t = (a ^ a >> 15) * (a | 1) % 2**32
            t = (t + (t ^ t >> 7) * (t | 61)) % 2**32 ^ t
            out.append((t ^ t >> 14) / 2**32)
        return out

    got = [r[0] for r in spark.range(40).coalesce(1).select(mulberry32(2026, F.col("id"))).collect()]
    assert got == by_hand(2026, 40)


def test_vectors_round_trip_bit_by_bit(spark):
    x = np.random.default_rng(0).standard_normal((3, 8)).astype(np.float32)
    df = spark.createDataFrame([(f"c{k}", "m", v.tolist()) for k, v in enumerate(x)], "chunk_id string, model string, embedding array<float>")
    back = corpus.unpack_vectors(corpus.pack_vectors(df)).orderBy("chunk_id").collect()
    assert all(np.array(r["embedding"], np.float32).tobytes() == v.tobytes() for r, v in zip(back, x, strict=True))
    chunks = spark.createDataFrame([("c0", 0), ("c9", 9)], "chunk_id string, chunk_ord long")
    assert [r["chunk_id"] for r in corpus.embed_todo(chunks, df, "m").collect()] == ["c9"]
    assert corpus.embed_todo(chunks, df, "other").count() == 2
    assert corpus.cache_compact(df, chunks, "m").count() == 1
    assert tuple(corpus.vector_coverage(chunks, df).first()) == (2, 1)


def lengths():
    """A test embedder, defined where the workers need no module of the tests."""

    class Lengths:
        name, dim = "lengths", 2

        def embed(self, texts):
            return [[len(t), 1.0] for t in texts]

        def embed_query(self, text):
            return [0.0, float(len(text))]

    return Lengths()


def test_models(spark, monkeypatch):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(__import__("sys").modules[__name__])
    load = lengths
    df = spark.createDataFrame([(0, "abc"), (1, None)], "qid long, query string")
    assert [list(r["v"]) for r in df.orderBy("qid").select(embed_column(F.col("query"), load).alias("v")).collect()] == [[3.0, 1.0], [0.0, 1.0]]
    got = expand_questions(df.where("qid = 0"), MapExpander({"abc": ["x"]})).orderBy("variant").collect()
    assert [r["query"] for r in got] == ["abc", "x"]
    assert LlmExpander(lambda s, p: '{"rewrites": ["ab"]}').expand("q") == ["q", "ab"]
    with pytest.raises(ValueError):
        LlmExpander(lambda s, p: '{"passage": "short"}', "hyde").expand("q")
    with pytest.raises(ValueError):
        Settings(api_key="sk-xxx").require_key()
    assert Settings(api_key="k" * 20).require_key() == "k" * 20


def test_stream_builds_the_same_index_as_a_batch(spark, tmp_path):
    schema = "doc_ord long, doc_id string, title string, text string, source string, license string"
    rows = [(k, f"d{k}", "t", f"word{k} common text", "s", "l") for k in range(6)]
    batch = lambda xs: spark.createDataFrame(xs, schema)
    for part in (rows[:3], rows[2:]):  # d2 comes twice
        batch(part).write.mode("append").parquet(str(tmp_path / "in"))
        query = stream.write_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), segment.chunk_fixed, str(tmp_path / "out"), str(tmp_path / "ck"))
        assert query.awaitTermination(120)
    q = spark.createDataFrame([(0, "word2 common")], "qid long, query string")
    want = lexical.search(lexical.build_index(segment.chunk_fixed(batch(rows))), q).collect()
    columns = ["qid", "chunk_ord", "score", "rank"]
    assert sorted(stored.search(stored.read(spark, str(tmp_path / "out")), q).select(columns).collect()) == sorted(tuple(r[c] for c in columns) for r in want)
