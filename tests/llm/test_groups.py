"""Operators that bring rows together: joins, near duplicates, mixing, language-model scores, and the pipeline."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.llm import components, embedding_dedup, lm_score, mixing, registry, shingle_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components_against_brute_force(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(40)] + [(rng.randint(50, 120), rng.randint(50, 120)) for _ in range(50)] + [(200, k) for k in range(201, 260)]
    rng.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 3), (7, 7), edges[0]], "a long, b long").repartition(5)
    want = roots(300, edges)
    got = {r["id"]: r["component"] for r in components.connected_components(df).collect()}
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1]} | {x: want[x] for x in got}
    assert components.connected_components(df.where("false")).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def by_hand(texts):
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return [len(s) for s in sets], roots(len(sets), pairs)


def near_copies(rng, n_families=6, copies=14, most=0.12):
    texts = []
    passage = " ".join(f"common{k}" for k in range(60))
    for f in range(n_families):
        n = rng.choice([3, 6, 12, 17, 30, 80, 200])
        w = [f"f{f}w{rng.randint(0, 4000)}" for _ in range(n)]
        for _ in range(copies):
            x = [v if rng.random() > rng.random() * most / 3 else "edit" + str(rng.randint(0, 9)) for v in w]
            x = x[: len(x) - rng.randint(0, max(0, len(x) // 15))]
            texts.append(" ".join(x) + (" " + passage if rng.random() < 0.3 else ""))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_shingle_join_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(shingle_join, "FEW", 3)
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    monkeypatch.setattr(shingle_join, "BUCKET_KEYS", 50)
    rng = random.Random(seed)
    texts = [*near_copies(rng), None, "", " \n", "One two", "one TWO", "one two three", "x", "x", "word " * 3000]
    texts += texts[:7]
    rng.shuffle(texts)
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, component_id string").repartition(3)
    rows, _ = shingle_join.link_documents(df)
    sizes, want = by_hand(texts)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()} == {k: (sizes[k], want[k]) for k in range(len(texts))}


def test_shingle_join_edges(spark):
    rows = [(5, "a b c d e f g"), (5, "totally other words in this one here"), (7, "a b c d e f g"), (None, "a b c d e f g"), (2, "totally other words in this one here"), (9, None), (5, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["id"], r["n_shingles"], r["component_id"]) for r in shingle_join.link_documents(df)[0].collect()), key=str)
    assert got == sorted([(5, 3, 2), (5, 3, 2), (5, 3, 2), (7, 3, 2), (2, 3, 2), (9, 0, 9), (None, 3, None)], key=str)
    assert shingle_join.link_documents(df.where("false"))[0].count() == 0
    kept = shingle_join.drop_near_duplicates(df).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "9", "None"]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1 * rng.random()], rng.integers(0, 1 << 63, int(rng.integers(0, n // 12 + 1)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if len(b) and 100 * shared >= 80 * (len(a) + len(b) - shared):
            assert shingle_join.may_link(len(a), shingle_join.dense_sketch(a), len(b), shingle_join.dense_sketch(b))
            for common in (np.zeros(1 << 22, bool), np.ones(1 << 22, bool)):
                assert np.intersect1d(shingle_join.join_keys(a, common), shingle_join.join_keys(b, common)).size


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((25, 24))
    x = np.concatenate([base + s * rng.standard_normal(base.shape) for s in (0.0, 0.05, 0.1, 0.15, 0.2, 0.3)] + [base[:1] + 0.08 * rng.standard_normal((60, 24))]).astype(np.float32)
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 24, 0), (1002, [float("nan")] * 24, 0), (1003, [], 0), (1004, [1.0, None], 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (None, x[0].tolist(), 0), (1005, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int").repartition(3)
    got = {r["id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.dedup(df).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = y @ y.T >= 0.95
    np.fill_diagonal(linked, False)
    want = roots(len(x), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked))])
    found = sum(got[k][0] for k in range(len(x)))
    assert all(got[k][0] <= linked[k].sum() for k in range(len(x))) and found >= 0.98 * linked.sum()
    assert np.mean([got[k][1] == want[k] for k in range(len(x))]) > 0.98
    assert all(got[k] == (0, k, True) for k in (1000, 1001, 1002, 1003, 1004)) and got[1005] == (1, 1005, True) and got[1006] == (1, 1005, False) and got[None] == (0, None, False)
    assert embedding_dedup.dedup(df.where("false")).count() == 0


def test_embedding_query_on_driver_rows(spark):
    rows = registry.op5_embedding_dedup(spark, "/root/testdata/sf0.01")
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(e["embedding"].tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.95
    np.fill_diagonal(linked, False)
    assert {r["vec_id"]: r["n_links"] for r in rows.collect()} == dict(zip(e["vec_id"], linked.sum(axis=1)))


def test_copies_of_a_vector_are_one(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3, 16)).astype(np.float32)
    x[1] = x[0] + 0.01
    rows = [(k, x[0].tolist()) for k in range(400)] + [(400 + k, x[1].tolist()) for k in range(3)] + [(500, x[2].tolist())]
    met = []
    real = embedding_dedup.find_links
    monkeypatch.setattr(embedding_dedup, "find_links", lambda rows, **more: (met.append(rows.count()), real(rows, **more))[1])
    got = {r["id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect()}
    assert met == [3]
    assert all(got[k] == (402, 0) for k in range(403)) and got[500] == (0, 500)


def test_blocks_meet_as_often_as_needed(spark):
    from larkspur.llm import blocks

    rows = spark.range(90).select((F.col("id") % 2).alias("key"), "id", (F.col("id") % 9 == 0).alias("rest"))
    large = blocks.large_groups(rows, 10)

    def work(key, a, b):
        x, y = (t.column("id").to_numpy() for t in (a, a if b is None else b))
        i, j = np.meshgrid(x, y, indexing="ij")
        keep = (i < j) if b is None else np.ones(i.shape, bool)
        return [i[keep], j[keep]]

    got = [tuple(sorted(r)) for r in blocks.run_blocks(blocks.deal(rows, large), ["id"], work, "a long, b long").collect()]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if i % 2 == j % 2 and (i % 9 == 0 or j % 9 == 0)}
    assert len(got) == len(set(got)) and want == set(got)


def test_estimates_are_bounds():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((300, 64))
    b = a + 0.2 * rng.standard_normal(a.shape)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
    odd = pa.array([*a.tolist(), None, [], [1.0, None], [float("inf")], [0.0, 0.0], [3.0, 4.0]])
    assert {v.shape[1]: at.tolist() for at, v in embedding_dedup.unit_vectors(odd)} == {64: list(range(300)), 2: [305]}
    turn = embedding_dedup.rotations(64, 1)[0]
    assert np.allclose(turn @ turn.T, np.eye(64))
    cosine = (x * y).sum(axis=1)
    for t in (0.5, 0.9, 0.97):
        may = np.diag(embedding_dedup.may_pair(embedding_dedup.codes(x @ turn), embedding_dedup.codes(y @ turn), 64, t))
        assert may[cosine >= t].mean() > 0.995 if (cosine >= t).any() else True
    both = embedding_dedup.codes(x @ turn)
    assert (embedding_dedup.may_pair(both, both, 64, 0.9) == embedding_dedup.may_pair(both, both.copy(), 64, 0.9)).all()


def test_mixing_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, "w " * rng.randint(0, 30), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None]), rng.choice(["x", "y"])) for k in range(400)] + [(400, None, "en", "a", "x"), (400, None, "en", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    cells = Counter()
    for _, t, lang, s, topic in rows:
        cells[s or "", lang or "", topic] += len((t or "").split())
    weights, total = {k: float(v) for k, v in cells.items()}, sum(cells.values())
    target = []
    for d in range(3):
        by = Counter()
        for k, v in cells.items():
            by[k[d]] += v
        mass = {k: v**0.5 for k, v in by.items()}
        target.append({k: m / sum(mass.values()) * total for k, m in mass.items()})
    for _ in range(200):
        for d in range(3):
            by = Counter()
            for k, v in weights.items():
                by[k[d]] += v
            weights = {k: v * target[d][k[d]] / by[k[d]] for k, v in weights.items()}
    for size in (16 << 20, -1):
        got = mixing.mix(df.withColumn("Weight", F.lit("clash")).withColumn("tokens", F.lit("other")), broadcast_bytes=size).collect()
        assert len(got) == len(rows)
        for r in got:
            k = (r["source"] or "", r["lang"] or "", r["topic"])
            assert abs(r["weight"] - weights[k] / cells[k]) < 1e-7 and abs(r["probability"] - min(1, 0.8 * r["weight"])) < 1e-12 and r["tokens"] == "other"
            assert r["copies"] in (math.floor(0.8 * r["weight"]), math.floor(0.8 * r["weight"]) + 1) and r["sampled"] == (r["copies"] > 0)
    assert abs(sum(r["weight"] * r["n_tokens"] for r in got) / total - 1) < 1e-9
    assert len({r["sampled"] for r in got if r["doc_id"] == 400}) == 1
    assert mixing.mix(df.where("false")).count() == 0


def test_raking_ends_when_weights_rest(spark, monkeypatch):
    cells = spark.createDataFrame([("a", "x", 8.0), ("a", "y", 2.0), ("b", "x", 1.0), ("b", "y", 9.0)], "source string, lang string, tokens double")
    half = lambda values: spark.createDataFrame([(v, 0.5) for v in values], "value string, share double")
    written = []
    real = mixing.write_table
    monkeypatch.setattr(mixing, "write_table", lambda df, name: (written.append(name), real(df, name))[1])
    got = {(r["source"], r["lang"]): r["weight"] for r in mixing.rake(cells, {"source": half("ab"), "lang": half("xy")}).collect()}
    rounds = written.count("cells") - 1
    assert abs(got["a", "x"] + got["a", "y"] - 10) < 1e-6 and abs(got["a", "x"] + got["b", "x"] - 10) < 1e-6 and 2 <= rounds < 40
    # No weights meet targets for a value without tokens: it ends, and the others have what they can.
    none = mixing.rake(cells.where("lang = 'x'"), {"source": half("ab"), "lang": half("xz")}, rounds=5).collect()
    assert len(none) == 2


def test_few_cells_are_raked_by_one_job_as_by_rounds(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(a, b, c, float(rng.randint(0, 50) * rng.choice([0, 1, 1, 40]))) for a in "abcde" for b in "xyz" for c in ("p", "", "q") if rng.random() < 0.8]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    targets = {d: mixing.tempered_shares(cells, d) for d in mixing.DIMENSIONS}
    for asked in (targets, targets | {"lang": targets["lang"].where("value <> 'y'")}):
        for rounds in (1, 12):
            one, many = ({(r["source"], r["lang"], r["topic"], r["tokens"]): r["weight"] for r in f(cells, asked, rounds=rounds).collect()} for f in (mixing.rake_few, mixing.rake))
            assert one.keys() == many.keys() and all(abs(one[k] - w) <= 1e-9 * max(1.0, w) for k, w in many.items())
    assert mixing.rake_few(cells.where("false"), targets).count() == 0
    written = []
    real = mixing.write_table
    monkeypatch.setattr(mixing, "write_table", lambda df, name: (written.append(name), real(df, name))[1])
    docs = spark.createDataFrame([(k, "w " * (k % 7), "ab"[k % 2], "xy"[k % 3 % 2], "p") for k in range(60)], "doc_id long, text string, source string, lang string, topic string")
    assert mixing.mix(docs).count() == 60 and written.count("cells") == 1


def test_the_mix_meets_its_targets_on_driver_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), "text")
    got = mixing.marginals(mixing.mix(docs)).collect()
    assert {r["dimension"] for r in got} == {"source", "lang", "topic"} and len({r["value"] for r in got if r["dimension"] == "topic"}) >= 4
    assert max(abs(r["mixed"] - r["target"]) for r in got) < 0.01 and max(abs(r["raw"] - r["target"]) for r in got) > 0.1


def lm_by_hand(train, texts):
    """log10 probabilities of texts, from dictionaries and loops. Hashes of words, tails and features are the operator's."""
    L = lm_score

    def read(text):
        t = next(L.read_tokens(pa.array([text], pa.string())))[2]
        return list(zip(t.keys.tolist(), t.tails.tolist(), t.word.tolist(), *[f.tolist() for f in t.features()]))

    seen = [read(t) for t in train]
    count, tail = Counter(), {}
    for text in seen:
        for key, last, word, *_ in text:
            if word:
                count[key] += 1
                tail[key] = last
    frequent = sorted((k for k in count if count[k] >= 2), key=lambda k: (-count[k], k))
    mass, at, cls = sum(count[k] for k in frequent), 0, {}
    for k in frequent:
        cls[k] = min(L.HEAD - 1, at * L.HEAD // mass)
        at += count[k]
    size = Counter(cls.values())

    def leaf(key, last, word):
        if not word:
            return L.END, 0
        if key in cls:
            return cls[key], key % L.SLOTS if size[cls[key]] <= 2 * L.SLOTS else last % L.SLOTS
        return L.HEAD + last % (L.RARE * L.SLOTS) // L.SLOTS, last % L.SLOTS

    tokens, words = Counter(), Counter()
    for k, n in count.items():
        tokens[leaf(k, tail[k], True)] += n
        words[leaf(k, tail[k], True)] += 1
    tokens[L.END, 0] = len(train)
    total = sum(tokens.values())
    by_class = [sum(tokens[c, s] for s in range(L.SLOTS)) for c in range(L.CLASSES)]
    class_share = [(n + 1) / (total + L.CLASSES) for n in by_class]
    slot_share = [[(tokens[c, s] + 0.5) / (by_class[c] + 0.5 * L.SLOTS) for s in range(L.SLOTS)] for c in range(L.CLASSES)]
    n_class, n_slot = L.weight_rows(len(count) + 1)
    weights = {}

    def rows(features, c):
        yield 0, L.CLASSES, class_share, [f % n_class for f in features], c
        if c != L.END:
            yield 1, L.SLOTS, slot_share[c], [c * n_slot + (f >> (64 - n_slot.bit_length() + 1)) for f in features], None

    def softmax(table, width, share, at):
        z = [share[k] * math.exp(sum(weights.get((table, r, k), 0.0) for r in at)) for k in range(width)]
        return [x / sum(z) for x in z]

    for rate in L.RATES:
        met, expected = Counter(), Counter()
        for text in seen:
            for key, last, word, *features in text:
                c, s = leaf(key, last, word)
                for table, width, share, at, outcome in rows(features, c):
                    p = softmax(table, width, share, at)
                    for r in at:
                        met[table, r, s if outcome is None else outcome] += 1
                        for k in range(width):
                            expected[table, r, k] += p[k]
        for table, r, k in expected:
            prior = L.PRIOR / (L.SLOTS if table else L.CLASSES)
            w = weights.get((table, r, k), 0.0) + rate * math.log((met[table, r, k] + prior) / (expected[table, r, k] + prior))
            weights[table, r, k] = float(np.float16(max(-L.LIMIT, min(L.LIMIT, w))))
    out = []
    for text in texts:
        total = 0.0
        for key, last, word, *features in read(text):
            c, s = leaf(key, last, word)
            for table, width, share, at, outcome in rows(features, c):
                total += math.log10(softmax(table, width, share, at)[s if outcome is None else outcome])
            if word:
                total += math.log10((count[key] + 0.1) / (tokens[c, s] + 0.1 * (words[c, s] + 1)))
        out.append(total)
    return out


def test_language_model_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PRIOR", 2.0)
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)] + ["End.", "é,", "#1"]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([5, 63])]) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "unseen words", "W1 w1", "tie one", "one tie"]
    df = spark.createDataFrame([(k, t, 1.0, "other") for k, t in enumerate(texts)], "doc_id long, text string, Score double, n string")
    train = df.where("doc_id < 50")
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    counts = Counter(w for t in texts[:50] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    scores = lm_by_hand(texts[:50], texts)
    for parts in (2, 8):
        got = {r["doc_id"]: r for r in lm_score.score(df.repartition(parts), lm_score.train(train.repartition(parts))).collect()}
        for k, t in enumerate(texts):
            w = tokens(t)
            base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"], got[k]["n"]) == (len(w), sum(counts[x] > 0 for x in w), n, "other")
            assert abs(got[k]["base_score"] - base) < 1e-9 and abs(got[k]["score"] - scores[k]) < 1e-3 * max(1, abs(scores[k]))
    monkeypatch.setattr(lm_score, "FREQUENT", 7)  # most words come from the table
    got = {r["doc_id"]: r for r in lm_score.score(df, lm_score.train(train)).collect()}
    assert all(abs(got[k]["base_score"] - sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tokens(t))) < 1e-9 for k, t in enumerate(texts))
    empty = lm_score.score(df, lm_score.train(train.where("false"))).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in empty) and len(empty) == len(texts)
    assert lm_score.score(df.where("false"), lm_score.train(train)).count() == 0


def test_language_model_beats_its_base_on_held_out_rows(spark):
    rows = registry.op9_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > 0.97 * rows["b"]


def test_scores_do_not_depend_on_the_number_of_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    by = [{r["doc_id"]: r["score"] for r in lm_score.score(docs, lm_score.train(docs.repartition(n)), keep=["doc_id"]).collect()} for n in (2, 8)]
    assert all(abs(by[0][k] - by[1][k]) < 1e-4 * abs(by[0][k]) for k in by[0])


def test_history_tells_words_of_one_class_apart(spark):
    df = spark.createDataFrame([("aaaa bbbb",), ("cccc dddd",)] * 3000, "text string")
    model = lm_score.train(df)
    got = [r["score"] for r in lm_score.score(spark.createDataFrame([("aaaa bbbb",), ("aaaa dddd",)], "text string").coalesce(1), model).collect()]
    assert got[0] > got[1] + 0.5


def test_probabilities_of_all_first_words_sum_to_one(spark):
    words = [f"w{k}" for k in range(300)]
    model = lm_score.train(spark.createDataFrame([(" ".join(words[k:]),) for k in range(0, 300, 7)], "text string"))
    end = lm_score.score(spark.createDataFrame([("",)], "text string"), model).first()["score"]
    leaves, total = model.leaves, 0.0
    tokens = next(lm_score.read_tokens(pa.array(words)))[2]
    features = [f[:1] for f in tokens.features()]  # of a text's first token, whichever it is
    shares = [np.log(x).astype(np.float32) for x in leaves.shares()]
    p = lm_score._exponentials(lm_score.class_rows(features, len(model.weights[0])), model.weights[0], shares[0])[0]
    p /= p.sum()
    assert abs(math.log10(p[lm_score.END]) - end) < 1e-4
    for c in range(lm_score.END):
        q = lm_score._exponentials(lm_score.slot_rows(features, np.array([c]), len(model.weights[1]) // lm_score.END), model.weights[1], shares[1][[c]])[0]
        total += p[c] * (q / q.sum()).sum()
    assert abs(total + p[lm_score.END] - 1) < 1e-5
    counts = {r["key"] % (1 << 64): r["n"] for r in model.vocabulary.where("tail >= 0").collect()}
    first = tokens.first[:-1]
    leaf, inside = leaves.find(tokens)[1][first], Counter()
    for key, at in zip(tokens.keys[first].tolist(), leaf.tolist(), strict=True):
        inside[at] += (counts[key] + 0.1) / (leaves.tokens[at] + 0.1 * (leaves.words[at] + 1))
    # What is missing in a slot is for one unknown word.
    assert all(abs(v + 0.1 / (leaves.tokens[at] + 0.1 * (leaves.words[at] + 1)) - 1) < 1e-9 for at, v in inside.items())


def test_rows_of_weights_follow_the_vocabulary():
    assert lm_score.weight_rows(0)[0] == lm_score.LEAST_ROWS and lm_score.weight_rows(300_000)[0] == 1 << 15 and lm_score.weight_rows(10**9)[0] == lm_score.MOST_ROWS


def test_pipeline_against_brute_force(spark):
    """Each stage, on what the one before has kept, against a plain version of it."""
    from test_rows import language_by_hand, lines_by_hand
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    d = "/root/testdata/sf0.001"
    raw = spark.read.parquet(f"{d}/documents.parquet")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    docs = rows(raw)
    assert raw.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    names = [n for n, _ in p.STAGES]
    stage = dict(p.STAGES)
    run = lambda name, docs: stage[name](spark, spark.createDataFrame(docs, raw.schema), d)

    train = [(r[1], r[2]) for r in docs if zlib.crc32(str(r[0]).encode()) % 5]
    find = language_by_hand(train)
    found = [(r, find(r[1])) for r in docs]
    want = sorted(((r[0], r[1], lang, *r[3:]) for r, (lang, score) in found if lang != "und" and score >= p.MIN_SCORE), key=str)
    got = run(names[0], docs)
    assert got.columns == raw.columns and rows(got) == want

    docs = want
    texts = lines_by_hand([(r[3], r[1]) for r in docs], p.LINE_RATIO, p.LINE_PAGES, p.LINE_LOSS)
    want = sorted(((r[0], t, *r[2:4], len(t)) for r, t in zip(docs, texts, strict=True)), key=str)
    assert rows(run(names[1], docs)) == want and any(t != r[1] for r, t in zip(docs, texts, strict=True))

    docs = want
    _, component = by_hand([r[1] for r in docs])
    ids = [r[0] for r in docs]
    least = {}
    for k, c in enumerate(component):
        least[c] = min(least.get(c, ids[k]), ids[k])
    want = [r for r in docs if r[0] in set(least.values())]
    assert rows(run(names[2], docs)) == want and len(want) < len(docs)

    docs = want
    topic = {r["doc_id"]: r["topic"] for r in spark.createDataFrame(docs, raw.schema).select("doc_id", mixing.topic_of(F.col("text")).alias("topic")).collect()}
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in docs}
    cell = {r[0]: (r[3] or "", r[2] or "", topic[r[0]]) for r in docs}
    tokens = Counter()
    for k, c in cell.items():
        tokens[c] += size[k]
    weights, total = {c: float(n) for c, n in tokens.items()}, sum(tokens.values())
    for _ in range(100):
        for at in range(3):
            by, target = Counter(), Counter()
            for c in weights:
                by[c[at]] += weights[c]
                target[c[at]] += tokens[c]
            mass = sum(n**0.5 for n in target.values())
            weights = {c: w * total * target[c[at]] ** 0.5 / mass / by[c[at]] if by[c[at]] else 0.0 for c, w in weights.items()}
    import hashlib

    want = []
    for r in docs:
        times = p.KEEP * weights[cell[r[0]]] / tokens[cell[r[0]]] if tokens[cell[r[0]]] else 0.0
        draw = int(hashlib.md5(f"{r[0]}:mix".encode()).hexdigest()[:8], 16) / 2**32
        want += [r] * (math.floor(times) + (draw < times - math.floor(times)))
    assert rows(run(names[3], docs)) == want and len(want) > len(set(want))

    t = Tokenizer.from_file(registry.tokenizer_path())
    last = rows(run(names[4], want))
    assert last == sorted(((r[0], r[3], r[2], len(x := t.encode(r[1] or "", add_special_tokens=False).ids), x) for r in want), key=str)
    assert rows(p.run(spark, d)) == last


def test_pipeline_drops_lines_but_not_copies(spark):
    import corpus_pipeline as p

    rows = [(k, ("menu\n" if k % 12 == 0 else "chance\n" if k < 10 else "") + f"own {k}\nmore {k}", "en", "a", 9) for k in range(300)]
    rows += [(300 + k, "all of\nthis is\na copy", "en", "a", 9) for k in range(40)]
    got = {r["doc_id"]: r["text"] for r in p.dedup_lines(spark, spark.createDataFrame(rows, DOCS), "none").collect()}
    assert len(got) == 340 and all("menu" not in t for t in got.values()) and sum("chance" in t for t in got.values()) == 9
    assert sum(t == "all of\nthis is\na copy" for t in got.values()) == 40


def test_pipeline_decodes_what_it_encodes(spark, monkeypatch):
    import corpus_pipeline as p

    df = spark.createDataFrame([(1, "a text", "en", "a", 6), (2, None, "en", "a", 0)], DOCS)
    assert p.encode_tokens(spark, df, "none").count() == 2
    encode = p.bpe.encode
    monkeypatch.setattr(p.bpe, "encode", lambda *a, **b: encode(*a, **b).withColumn("decoded", F.concat("decoded", F.lit("?"))))
    with pytest.raises(Exception, match="decode to another text"):
        p.encode_tokens(spark, df, "none").collect()


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline as p

    docs = spark.createDataFrame([], DOCS)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, "none")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_of_this_subpackage(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d, con = "/root/testdata/sf0.01", duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{d}/documents.parquet')")
    cur = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    got = registry.queries()[name](spark, d).select(*columns)
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_verification_takes_a_pair_of_each_document_first(spark, monkeypatch):
    """Twenty near copies have 190 pairs; 19 are enough. A pair that its end's first pair doesn't tell is looked at all the same. Sketches have two bits a shingle at most."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:i], "edit", *words[i + 1 :]]) for i in range(0, 200, 10)]
    docs = spark.createDataFrame([*enumerate(texts), (50, "quite other words than these in here")], "id long, text string")
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(i)] + [(60, 50), (60, 3)], "a long, b long")
    docs = docs.unionAll(spark.createDataFrame([(60, texts[3] + " end")], docs.schema))
    looked = []
    real = shingle_join.verify
    monkeypatch.setattr(shingle_join, "verify", lambda p, *a, **k: looked.append(p.count()) or real(p, *a, **k))
    links, joined = shingle_join.verify_components(pairs, docs)
    assert looked[0] == 20 and sum(looked) <= 22
    assert {r["id"]: r["component"] for r in joined.collect()} == {k: 0 for k in [*range(20), 60]}
    assert links.count() == 20
    first = shingle_join.verify_components(pairs.where("a < 60 or b = 50"), docs)
    assert first[1].where("id in (50, 60)").count() == 0
    assert len(shingle_join.dense_sketch(np.arange(1000, dtype=np.uint64))) * 8 <= 2000


def test_a_group_is_dealt_with_its_own_columns(spark):
    from larkspur.llm import blocks

    rows = spark.createDataFrame([(1, k, k < 3, 100 + k, 7) for k in range(30)] + [(2, k, k < 1, 100 + k, 8) for k in range(4)], "key long, id long, rest boolean, n long, c long")
    dealt = blocks.deal(rows, blocks.large_groups(rows, 10))
    assert {(r["key"], r["id"], r["n"], r["c"]) for r in dealt.collect()} == {tuple(r) for r in rows.select("key", "id", "n", "c").collect()}


def test_near_copies_that_neither_hub_nor_ring_links(spark):
    """Copies of a text that isn't there, with three edits each: a copy links with few of the others, and these are to be found."""
    rng = random.Random(4)
    base, texts = [f"w{k}" for k in range(150)], []
    for k in range(120):
        w = base.copy()
        for e in range(3):
            w[rng.randrange(150)] = f"x{k}y{e}"
        texts.append(" ".join(w))
    rows, _ = shingle_join.link_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    _, want = by_hand(texts)
    assert [r["component_id"] for r in rows.orderBy("id").collect()] == want and len(set(want)) < 110
