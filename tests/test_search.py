import base64

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions.text import STOP_WORDS, han_tokens, tokens
from larkspur.functions.vectors import dot, fake_embed, l2_normalize
from larkspur.operators import fusion, lexical, vector
from larkspur.plans.pipeline import Retriever
from larkspur.functions.vectors import overlap_score


def chunks(spark, *texts, titles=None):
    rows = [(k, k, f"d{k}", (titles or [""] * len(texts))[k], x, 0, None) for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_ord long, doc_ord long, doc_id string, title string, text string, start int, context string")


def questions(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, query string")


def hits(index, spark, text, k=5):
    return [(r["chunk_ord"], r["score"], r["matched"]) for r in lexical.search(index, questions(spark, text), k, matched=True).orderBy("rank").collect()]


def test_tokens(spark):
    df = spark.createDataFrame([("玄武岩的 CIPW 45%～52%",)], "t string")
    r = df.select(tokens(F.col("t")).alias("a"), han_tokens(F.col("t"), ["玄武岩"]).alias("b")).first()
    assert "cipw" in r["a"] and "45" in r["a"] and "52" in r["a"]
    assert r["b"] == ["玄武岩", "cipw", "45", "52"]
    assert "的" in STOP_WORDS


def test_bm25_intuition(spark):
    index = lexical.build_index(chunks(spark, "common rare", "common other", "common more"))
    idf = {r["term"]: r["idf"] for r in index.df.crossJoin(index.stats).select("term", lexical.idf(F.col("n"), F.col("df")).alias("idf")).collect()}
    assert idf["rare"] > idf["common"]
    index = lexical.build_index(chunks(spark, "word filler filler", "word " * 10 + "filler"))
    got = hits(index, spark, "word")
    assert got[0][0] == 1 and got[0][1] < 3 * got[1][1]
    index = lexical.build_index(chunks(spark, "word short", "word " + "long " * 50))
    assert [h[0] for h in hits(index, spark, "word")] == [0, 1]


def test_bm25_titles_ties_matches_and_unknown_terms(spark):
    index = lexical.build_index(chunks(spark, "body", "body", titles=["heading", ""]))
    assert [h[0] for h in hits(index, spark, "heading")] == [0]
    assert hits(index, spark, "nowhere") == []
    assert [h[0] for h in hits(lexical.build_index(chunks(spark, "same text", "same text")), spark, "text same text")] == [0, 1]
    assert hits(lexical.build_index(chunks(spark, "beta alpha")), spark, "alpha beta gamma")[0][2] == ["alpha", "beta"]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0])], "a array<float>, z array<float>, s array<float>")
    r = df.select(l2_normalize("a").alias("n"), l2_normalize("z").alias("z"), dot(F.col("a"), F.col("a")).alias("d")).first()
    assert np.allclose(r["n"], [0.6, 0.8]) and r["z"] == [0.0, 0.0] and r["d"] == 25.0
    with pytest.raises(Exception, match="dimension"):
        df.select(dot(F.col("a"), F.col("s"))).collect()
    with pytest.raises(Exception, match="dimension"):
        vector.check_dims(df, 4, "a").collect()


def test_vector_search_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 8)).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "chunk_ord long, embedding array<float>")
    q = df.where("chunk_ord < 7").withColumnRenamed("chunk_ord", "qid")
    want = {i: np.lexsort((np.arange(60), -np.round(x.astype(float) @ x[i].astype(float), 6)))[:5].tolist() for i in range(7)}
    for size in (32 << 20, 64):
        monkeypatch.setattr(vector, "QUERY_BYTES", size)
        got = {}
        for r in vector.search(df, q, 5).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["chunk_ord"])
        assert got == want


def vectors_of(spark, x):
    return spark.createDataFrame([(k, v.astype(np.float32).tolist()) for k, v in enumerate(x)], "chunk_ord long, embedding array<float>")


def test_matrices_and_joins_score_alike(spark, monkeypatch):
    import random

    rng = random.Random(1)
    words = [f"w{k}" for k in range(40)]
    c = chunks(spark, *[" ".join(rng.choices(words[: rng.choice([5, 40])], k=rng.randint(0, 30))) for _ in range(90)], titles=[rng.choice(words) for _ in range(90)]).repartition(3)
    q = questions(spark, "w0 w1 w1 w39", "nowhere", "", "w7", *[" ".join(rng.choices(words, k=6)) for _ in range(9)])
    index = lexical.build_index(c)
    rows = lambda: sorted((r["qid"], r["rank"], r["chunk_ord"], round(r["score"], 5)) for r in lexical.search(index, q, 7).collect())
    fast = rows()
    monkeypatch.setattr(lexical, "HELD", 50)
    assert rows() == fast and len(fast) > 50
    targets = spark.createDataFrame([(k, o) for k in range(13) for o in (3 * k, 80 - k)] + [(99, 1)], "qid long, chunk_ord long")
    best = lambda: {r["qid"]: r["rank"] for r in lexical.best_ranks(index, q, targets).collect()}
    ranks = best()
    monkeypatch.setattr(lexical, "WANTED", 0)
    assert rows() == fast and best() == ranks and len(ranks) > 5


def test_cells_find_nine_tenths_of_random_vectors(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df, q = vectors_of(spark, x), vectors_of(spark, rng.uniform(-1, 1, (20, 32))).withColumnRenamed("chunk_ord", "qid")
    truth, cells = vector.search(df, q, 10), vector.fit_cells(df)
    got = [vector.recall(vector.ann_search(df, q, vector.Cells(cells.centroids, p), 10), truth).first()["recall"] for p in (1, cells.probes, len(cells.centroids))]
    assert got[1] >= 0.9 and got[0] <= got[1] <= got[2] == 1.0
    itself = vector.ann_search(df, df.where("chunk_ord < 30").withColumnRenamed("chunk_ord", "qid"), vector.Cells(cells.centroids, 1), 1)
    assert itself.where("qid = chunk_ord").count() == 30
    assert (vector.fit_cells(df).centroids == cells.centroids).all()


def test_cells_scan_little_where_vectors_have_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    x = np.concatenate([base + 0.03 * rng.standard_normal(base.shape) for _ in range(12)])
    df = vectors_of(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    q = df.where("chunk_ord < 20").withColumnRenamed("chunk_ord", "qid")
    cells = vector.fit_cells(df)
    assert vector.recall(vector.ann_search(df, q, cells, 10), vector.search(df, q, 10)).first()["recall"] >= 0.9
    share = vector.share_scored(df, q, cells).first()
    assert share["n_pairs"] == 20 * 480 and share["n_scored"] < 0.3 * share["n_pairs"]
    none = df.where("false")
    assert vector.search(none, q, 3).count() == 0 and vector.ann_search(none, q, vector.fit_cells(none), 3).count() == 0
    one = vectors_of(spark, x[:1])
    assert vector.ann_search(one, q, vector.fit_cells(one), 3).count() == 20


def test_contained_strings(spark, monkeypatch):
    from larkspur.operators import containment

    texts = spark.createDataFrame([(0, "abcd"), (1, "bc"), (2, None), (3, ""), (4, "xbcx abcd")], "doc_id long, text string")
    strings = spark.createDataFrame([(0, "bc"), (1, "abcd"), (2, ""), (3, None), (4, "none"), (5, "bc")], "qid long, query string")
    want = {(0, 0), (0, 1), (0, 4), (5, 0), (5, 1), (5, 4), (1, 0), (1, 4), (2, 0), (2, 1), (2, 3), (2, 4)}
    got = [tuple(r) for r in containment.find_contained(texts, strings, "doc_id").collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("seed, chars", [(0, 1 << 19), (1, 50)])
def test_contained_strings_against_brute_force(spark, monkeypatch, seed, chars):
    """Strings of all lengths, repeated ones, such that only begin or end like a text's, Han text, characters beyond the 16-bit ones, and a bitmap that lets all through."""
    import random

    from larkspur.operators import containment

    monkeypatch.setattr(containment, "SPARSE", 1)
    monkeypatch.setattr(containment, "CHARS", chars)
    rng = random.Random(seed)
    letters = "ab \U0001d4d0玄武岩"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 120))) for _ in range(60)] + [None, "", "ab" * 300]
    strings = ["", None, "zz", "a", "玄", "ab" * 200, "ab" * 299 + "a" * 3]
    for t in texts[:60]:
        for _ in range(3):
            n = rng.randrange(1, 40)
            at = rng.randrange(0, max(1, len(t)))
            s = t[at : at + n]
            strings.append(s)
            strings.append(s[: len(s) // 2] + "q" + s[len(s) // 2 + 1 :])  # one character changed
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(strings)), "qid long, query string")
    got = sorted(map(tuple, containment.find_contained(df, asked, "doc_id").collect()))
    assert got == sorted((i, k) for i, s in enumerate(strings) for k, t in enumerate(texts) if s is not None and t is not None and s in t)


def test_two_lists_in_one_session_do_not_mix(spark):
    from larkspur.operators import containment

    texts = spark.createDataFrame([(0, "first list"), (1, "second list")], "doc_id long, text string")
    for k, word in enumerate(("first", "second") * 3):
        strings = spark.createDataFrame([(0, word)], "qid long, query string")
        assert [tuple(r) for r in containment.find_contained(texts, strings, "doc_id").collect()] == [(0, k % 2)]


def test_titles_of_any_script_without_nested_loops(spark):
    rows = [(0, "玄武岩", "玄武岩是喷出岩"), (1, "喷出岩", "与玄武岩有关"), (2, "Granite rock", "x 喷出岩 y"), (3, "a", "Granite rock, a"), (4, None, None), (5, "", ""), (6, "玄武岩", "same title")]
    docs = spark.createDataFrame(rows, "doc_ord long, title string, text string")
    edges = fusion.title_graph(docs)
    text = {k: t or "" for k, _, t in rows}
    want = {}
    for owner, title, _ in rows:
        for holder in text:
            if title and len(title) >= 2 and owner != holder and title in text[holder]:
                phase = 0 if owner < holder else 2
                want[holder, owner] = min(want.get((holder, owner), 9), phase)
                want[owner, holder] = min(want.get((owner, holder), 9), 1)
    assert {(r["src"], r["dst"]): r["phase"] for r in edges.collect()} == want
    plan = edges._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join Cross" not in plan


def test_two_hops_and_ties_of_names(spark):
    edges = spark.createDataFrame([(0, 1), (1, 0), (1, 2), (2, 1)], "src long, dst long")
    assert sorted(map(tuple, fusion.two_hops(edges).collect())) == [(0, 2), (2, 0)]
    lists = spark.createDataFrame([(0, r, k, 1) for r, k in (("a", "Zebra"), ("b", "apple"), ("c", "Äpfel"))], "qid long, route string, key string, rank int")
    assert [r["key"] for r in fusion.rrf(lists, key="key").orderBy("rank").collect()] == ["Äpfel", "apple", "Zebra"] or [r["key"] for r in fusion.rrf(lists, key="key").orderBy("rank").collect()] == ["apple", "Äpfel", "Zebra"]


def ranked(spark, **lists):
    return spark.createDataFrame([(0, r, key, k + 1) for r, keys in lists.items() for k, key in enumerate(keys)], "qid long, route string, chunk_ord long, rank int")


def test_rrf(spark):
    out = fusion.rrf(ranked(spark, a=[1, 2, 3], b=[2, 3, 4])).orderBy("rank").collect()
    assert out[0]["chunk_ord"] == 2 and out[0]["ranks"] == {"a": 2, "b": 1}
    assert [r["chunk_ord"] for r in fusion.rrf(ranked(spark, a=[5, 4, 9])).orderBy("rank").collect()] == [5, 4, 9]
    gap = lambda k: (lambda s: s[0] - s[1])([r["score"] for r in fusion.rrf(ranked(spark, a=[1, 2]), k=k).orderBy("rank").collect()])
    assert gap(1) > gap(60)


def test_guarantee_evicts_the_tail(spark):
    route = lambda *keys: ranked(spark, x=keys).drop("route")
    lex, sem, pool = route(1, 2, 3), route(7, 8, 3), route(3, 1, 7)
    got = [r["chunk_ord"] for r in fusion.guarantee(pool, [lex, sem], 3, 2).orderBy("rank").collect()]
    assert got == [3, 2, 8]  # 1 and 7 were among the best of their routes, yet the cut takes them


DOC = "doc_ord long, title string, text string"


def test_title_graph(spark):
    docs = spark.createDataFrame([(0, "alpha", "mentions beta"), (1, "beta", "nothing"), (2, "x", "alpha here"), (3, "gone", "none"), (4, "one two three", "see gone"), (5, "late", "has one two three inside")], DOC)
    edges = {(r["src"], r["dst"]): r["phase"] for r in fusion.title_graph(docs).collect()}
    assert edges == {(0, 1): 2, (1, 0): 1, (2, 0): 0, (0, 2): 1, (4, 3): 0, (3, 4): 1, (5, 4): 0, (4, 5): 1}
    s = fusion.graph_stats(docs, fusion.title_graph(docs)).first()
    assert (s["nodes"], s["edges"], s["n_isolated"]) == (6, 4, 0) and s["top_hubs"][0]["degree"] == 2


def test_title_graph_by_classes(spark, monkeypatch):
    """Copies, shared titles and titles in other texts, against pairs spelled out; classes larger than a block; no pair of documents is shuffled."""
    monkeypatch.setattr(fusion, "BLOCK", 3)
    rows = [(k, "alpha", "alpha" + " beta" * (k % 2)) for k in range(8)] + [(k, "beta", "beta then gamma") for k in range(8, 13)]
    rows += [(13, "gamma", "no title"), (14, "gamma", "gamma"), (15, "twice", "twice"), (16, "twice", "twice"), (17, "alone", "alone"), (18, None, "alpha"), (19, "g", None), (20, "delta", None), (21, "three", "three"), (22, "three", "three"), (23, "three", "three"), (24, None, None)]
    docs = spark.createDataFrame(rows, DOC)
    mention = {(a, b) for a, _, text in rows for b, title, _ in rows if a != b and text and title and len(title) >= 2 and title in text}
    want = {}
    for a, b in mention:
        for edge, phase in (((a, b), 0 if b < a else 2), ((b, a), 1)):
            want[edge] = min(want.get(edge, phase), phase)
    graph = fusion.title_classes(docs)
    edges = graph.edges()
    got = edges.collect()
    assert {(r["src"], r["dst"]): r["phase"] for r in got} == want and len(got) == len(want) and all(r["ord"] == r["dst"] for r in got)
    some = graph.edges(spark.createDataFrame([(1,), (13,), (13,), (24,)], "doc_ord long")).collect()
    assert sorted((r["src"], r["dst"], r["phase"]) for r in some) == sorted((*e, p) for e, p in want.items() if e[0] in (1, 13))
    hops = {(a, d) for a, b in want for c, d in want if b == c and a != d}
    two = graph.two_hops()
    assert sorted(map(tuple, two.collect())) == sorted(hops) and (15, 16) not in hops and (21, 22) in hops
    degrees = {r["doc_ord"]: r["d"] for r in graph.degrees().collect()}
    assert degrees == {a: sum(x == a for x, _ in want) for a, _ in want}
    assert fusion.graph_stats(docs, graph).first() == fusion.graph_stats(docs, spark.createDataFrame([(*e, 0, 0) for e in want], "src long, dst long, phase int, ord long")).first()
    for df in (fusion.title_graph(docs), two):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan[: plan.index("Generate")] and "Repartition" not in plan[: plan.index("Generate")]


def test_expansion_grows_a_small_pool(spark):
    docs = spark.createDataFrame([(0, "hub", "t"), (1, "aa", "hub"), (2, "bb", "hub"), (3, "cc", "hub")], DOC)
    first = docs.select(F.col("doc_ord").alias("chunk_ord"), "doc_ord", F.lit(0).alias("start"))
    pool = spark.createDataFrame([(0, 0, 1)], "qid long, chunk_ord long, rank int")
    got = [r["chunk_ord"] for r in fusion.expand_pool(pool, fusion.title_graph(docs), first).orderBy("rank").collect()]
    assert got == [1, 2, 3]


def test_rerank(spark):
    rows = spark.createDataFrame([(0, k, k + 1, s) for k, s in enumerate([1.0, 1.0, 5.0])], "qid long, chunk_ord long, rank int, s double")
    got = [(r["chunk_ord"], r["before"]) for r in fusion.rerank(rows, F.col("s"), 3).orderBy("rank").collect()]
    assert got == [(2, 3), (0, 1), (1, 2)]
    assert fusion.rerank(rows.where("false"), F.col("s")).count() == 0


def test_pipeline_modes(spark):
    c = chunks(spark, *[f"word{k} common" for k in range(12)])
    q = questions(spark, "word3 common", "word5")
    vectors = c.select("chunk_ord", fake_embed(F.col("text"), 16).alias("embedding"))
    r = Retriever(c, index=lexical.build_index(c), vectors=vectors, embed_query=lambda x: fake_embed(x, 16), pool_size=6, top_k=2, guarantee=2, rerank_top=3, rerank_score=overlap_score)
    pool, top = r.search(q)
    assert top.groupBy("qid").count().where("count <> 2").count() == 0 and pool.where("rank > 6").count() == 0
    assert top.where("rank = 1 and qid = 0").first()["chunk_ord"] == 3 and top.where("before > 3").count() == 0
    assert r.label == "hybrid+rerank"
    for mode in ("bm25", "vector", "hybrid"):
        with pytest.raises(ValueError):
            Retriever(c, mode=mode).search(q)
    with pytest.raises(ValueError):
        Retriever(c, mode="other").search(q)
    variants = spark.createDataFrame([(0, 0, "nowhere"), (0, 1, "word7"), (1, 0, "word2")], "qid long, variant int, query string")
    got = Retriever(c, mode="bm25", index=lexical.build_index(c)).search_variants(variants)[1]
    assert {(r["qid"], r["chunk_ord"]) for r in got.collect()} == {(0, 7), (1, 2)}


def test_guarantee_is_the_same_however_shuffles_are_coalesced(spark):
    """Routes of very different sizes, ranked by windows: each question has its ten seats, the five best of each route among them. The session's unions claim no partitioning."""
    from larkspur.operators.frames import UNION_PARTITIONING
    from larkspur.operators.lexical import rank

    made = spark.range(0, 40_000, 1, 8).select((F.col("id") % 200).alias("qid"), (F.col("id") + 0).alias("chunk_ord"), F.lit("x" * 200).alias("pad"))
    first = rank(made.withColumn("score", F.xxhash64("chunk_ord").cast("double"))).where("rank <= 10").select("qid", "chunk_ord", "rank")
    second = rank(made.where("chunk_ord >= 30000 and qid < 150").drop("pad").withColumn("score", F.xxhash64("chunk_ord", F.lit(1)).cast("double"))).where("rank <= 10").select("qid", "chunk_ord", "rank")
    pool = fusion.fuse_routes({"a": first, "b": second}, 10).select("qid", "chunk_ord", "rank")
    got = fusion.guarantee(pool, [first, second], 10, 5).collect()
    assert spark.conf.get(UNION_PARTITIONING) == "false"
    lists = [{}, {}]
    for at, r in enumerate((first, second)):
        for x in r.collect():
            lists[at].setdefault(x["qid"], {})[x["rank"]] = x["chunk_ord"]
    expected = {}
    for q, a in lists[0].items():
        b, score = lists[1].get(q, {}), {}
        for r in (a, b):
            for place, c in r.items():
                score[c] = score.get(c, 0) + 1 / (60 + place)
        fused = sorted(score, key=lambda c: (-round(score[c], 9), c))[:10]
        wanted = [a[i] for i in range(1, 6)] + [b[i] for i in range(1, 6) if i in b]
        missing = [c for c in dict.fromkeys(wanted) if c not in fused]
        expected[q] = fused[: 10 - len(missing)] + missing
    by = {}
    for x in sorted(got, key=lambda x: x["rank"]):
        by.setdefault(x["qid"], []).append(x["chunk_ord"])
    assert by == expected


def test_matrices_come_from_sliced_arrow_arrays():
    import pyarrow as pa

    rows = pa.array([[1.0, 2.0], [3.0, None], [5.0, 6.0], [7.0, 8.0]], pa.list_(pa.float32()))
    got = vector._matrix(rows.slice(1, 2), 2)
    assert got.dtype == float and np.array_equal(got, [[3.0, np.nan], [5.0, 6.0]], equal_nan=True) and vector._matrix(rows.slice(0, 0), 2).shape == (0, 2)
    with pytest.raises(ValueError, match="dimension"):
        vector._matrix(pa.array([[1.0, 2.0], [3.0]]), 2)


def test_the_benchmark_makes_its_copies_once(spark, sf_dir, monkeypatch, tmp_path):
    from larkspur.plans import queries

    monkeypatch.setattr(queries, "new_folder", lambda spark, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    rows = queries.QUERIES["ann_benchmark"](spark, sf_dir).collect()
    n = queries.Inputs(spark, sf_dir).table("embeddings").count()
    assert sorted(spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()) == [n, 10 * n, 50 * n] and all(r["recall"] >= 0.9 and 0 < r["share_scored"] <= 1 for r in rows)


def test_matched_terms_are_found_in_hits_alone(spark, monkeypatch):
    """No gain of a posting is made a row where questions' terms fit in a scan; terms come in the question's order, each once."""
    chunks = spark.createDataFrame([(1, "one", "red green blue"), (2, None, "green green"), (3, "red", "x1 blue"), (4, None, None)], "chunk_ord long, title string, text string")
    questions = spark.createDataFrame([(0, "blue red blue unseen green"), (1, "green"), (2, "unseen"), (3, None)], "qid long, query string")
    index = lexical.build_index(chunks)
    want = {(r["qid"], r["chunk_ord"]): r["matched"] for r in lexical.score(index, questions).collect()}

    def none(*_):
        raise AssertionError("joined with postings")

    monkeypatch.setattr(lexical, "gains", none)
    got = {(r["qid"], r["chunk_ord"]): r["matched"] for r in lexical.search(index, questions, 5, matched=True).collect()}
    assert got == want and got[0, 1] == ["blue", "red", "green"]


def test_a_worker_makes_numbers_of_few_chunks_at_a_time():
    import pyarrow as pa

    from larkspur.operators import lexical

    sizes = [b.num_rows for b in lexical.sliced([pa.RecordBatch.from_arrays([pa.array(range(1300))], names=["x"])])]
    assert sizes == [512, 512, 276]


def test_modes_search_each_route_once(spark, monkeypatch):
    from larkspur.functions.vectors import fake_embed
    from larkspur.operators import lexical, vector
    from larkspur.plans.pipeline import Retriever
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame([(k, k, f"t{k}", f"word{k} common text") for k in range(6)], "chunk_ord long, doc_ord long, title string, text string")
    asked = spark.createDataFrame([(0, "word3 common"), (1, "word5")], "qid long, query string")
    embed = lambda c: fake_embed(c, 8)
    route = lambda mode: Retriever(chunks, mode=mode, index=lexical.build_index(chunks), vectors=chunks.select("chunk_ord", embed(F.col("text")).alias("embedding")), embed_query=embed, pool_size=4, top_k=2)
    want = {m: [sorted(map(tuple, x.collect())) for x in route(m).search(asked)] for m in ("bm25", "vector", "hybrid")}
    calls = []
    for module in (lexical, vector):
        monkeypatch.setattr(module, "search", lambda *a, f=module.search, n=module.__name__, **k: calls.append(n) or f(*a, **k))
    got = route("hybrid").search_modes(asked, ["bm25", "vector", "hybrid"])
    assert {m: [sorted(map(tuple, x.collect())) for x in v] for m, v in got.items()} == want and len(calls) == 2


def test_a_string_that_stands_often_is_a_row_for_each_text(spark, monkeypatch):
    from larkspur.operators import containment

    strings = [(0, "the"), (1, "he"), (2, "of the day"), (3, "x"), (4, ""), (5, "the end of the"), (6, "the")]
    texts = [(k, "the end of the day " * (40 * k)) for k in range(4)] + [(9, None)]
    met, real = [], containment.written
    monkeypatch.setattr(containment, "written", lambda df: (met.append(df.count()), real(df))[1])
    got = containment.find_contained(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(strings, "qid long, query string"), "doc_id")
    assert sorted(map(tuple, got.collect())) == sorted((q, d) for q, s in strings for d, t in texts if t is not None and s in t)
    assert max(met) <= 10
