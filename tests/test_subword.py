"""Subwords against plain versions, and models that run from a file and a vocabulary alone."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.functions.models import OnnxEmbedder, OnnxReranker, embed_column, rerank_column
from larkspur.functions.subword import Subwords

PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "ab", "abc", "b", "##b", "##bc", "##c", "##ca", "##", "#", "c", "cafe", "##s", "!", ",", "-", "我", "们", "##们", "e", "o"]
TEXTS = ["abc ab abca abbc", "a,b-c!", "Cafés CAFÉ\tcafe\n", "我们abc我", "", " ", "x ab", "a" * 101 + " b", "##b #", "\x00a​b�c", "a　b c", "$a€b c©", "É", "\U0001f600 a", "İ ß", "áb"]


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    path = tmp_path_factory.mktemp("vocabulary") / "vocab.txt"
    path.write_text("\n".join(PIECES) + "\n", encoding="utf-8")
    return str(path)


def plain(word):
    """Longest piece first, by trying every length."""
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in PIECES), None)
        if end is None or len(word) > 100:
            return [1]
        out.append(PIECES.index(("##" if at else "") + word[at:end]))
        at = end
    return out


def test_cut_is_greedy(vocabulary):
    s, r = Subwords(vocabulary), random.Random(5)
    for _ in range(3000):
        word = "".join(r.choices("abcs我们", k=r.randint(1, 9)))
        assert s.cut(word) == plain(word), word
    assert s.cut("a" * 101) == [1] and s.cut("") == []


@pytest.mark.parametrize("lower", [True, False])
def test_equals_the_library(vocabulary, lower):
    theirs = pytest.importorskip("tokenizers").BertWordPieceTokenizer(vocabulary, lowercase=lower, strip_accents=lower)
    s, r = Subwords(vocabulary, lower=lower, most=10_000), random.Random(6)
    for text in TEXTS + ["".join(r.choices("abcsBÉ我们,! \t-", k=r.randint(1, 60))) for _ in range(300)]:
        assert s.texts([text])["input_ids"].tolist() == [theirs.encode(text).ids], text
    theirs.enable_truncation(12)
    short = Subwords(vocabulary, lower=lower, most=12)
    for k in range(0, 30, 3):
        for n in range(0, 30, 4):
            want, got = theirs.encode("a " * k, "b " * n), short.pairs([("a " * k, "b " * n)])
            assert (got["input_ids"].tolist(), got["token_type_ids"].tolist()) == ([want.ids], [want.type_ids]), (k, n)
    assert short.texts(["ab " * 50])["input_ids"].shape == (1, 12)


def test_batches_are_padded(vocabulary):
    got = Subwords(vocabulary).texts(["abca", None, "a"])
    assert plain("abca") == [1] and got["input_ids"].tolist() == [[2, 1, 3], [2, 3, 0], [2, 5, 3]]
    assert got["attention_mask"].tolist() == [[1, 1, 1], [1, 1, 0], [1, 1, 1]] and not got["token_type_ids"].any()
    assert Subwords(vocabulary).texts([])["input_ids"].shape[0] == 0
    with pytest.raises(OSError):
        Subwords(vocabulary + "x").texts(["a"])


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    """(number, value) in the wire format: ints as numbers, bytes and text with their length."""
    out = b""
    for n, v in fields:
        v = v.encode() if isinstance(v, str) else v
        out += number(n << 3) + number(v) if isinstance(v, int) else number(n << 3 | 2) + number(len(v)) + v
    return out


def model(table, nodes, out_rank):
    """A model file that gathers rows of a table by input_ids, then applies nodes (operation, inputs, output)."""
    value = lambda name, kind, rank: message((1, name), (2, message((1, message((1, kind), (2, message(*[(1, message((2, f"{name}{d}"))) for d in range(rank)])))))))
    tensor = message(*[(1, d) for d in table.shape], (2, 1), (8, "table"), (9, table.astype("<f4").tobytes()))
    steps = [(1, message(*[(1, x) for x in xs], (2, y), (4, op))) for op, xs, y in [("Gather", ["table", "input_ids"], "rows"), *nodes]]
    graph = message(*steps, (2, "g"), (5, tensor), (11, value("input_ids", 7, 2)), (12, value(nodes[-1][2], 1, out_rank)))
    return message((1, 8), (7, graph), (8, message((1, ""), (2, 13))))


def test_models_from_a_path_and_a_vocabulary(spark, vocabulary, tmp_path):
    pytest.importorskip("onnxruntime")
    table = np.random.default_rng(1).normal(size=(len(PIECES), 4)).astype(np.float32)
    (tmp_path / "e.onnx").write_bytes(model(table, [("Identity", ["rows"], "hidden")], 3))
    (tmp_path / "r.onnx").write_bytes(model(table[:, :1], [("ReduceMean", ["rows"], "logit")], 3))
    encoder, reranker = str(tmp_path / "e.onnx"), str(tmp_path / "r.onnx")
    df = spark.createDataFrame([(0, "abc b", "a"), (1, "我", "c c"), (2, None, "")], "i long, t string, u string")
    got = df.select("i", embed_column(F.col("t"), lambda: OnnxEmbedder(encoder, vocabulary, dim=4)).alias("v"), rerank_column(F.col("u"), F.coalesce("t", F.lit("")), lambda: OnnxReranker(reranker, vocabulary)).alias("s")).orderBy("i").collect()
    s = Subwords(vocabulary)
    for r, (_, t, u) in zip(got, [(0, "abc b", "a"), (1, "我", "c c"), (2, "", "")], strict=True):
        mean = table[s.texts([t])["input_ids"][0]].astype(float).mean(axis=0)
        assert np.allclose(r["v"], mean / np.linalg.norm(mean), atol=1e-6)
        assert np.isclose(r["s"], table[s.pairs([(u, t)])["input_ids"][0], 0].mean(), atol=1e-5)
    with pytest.raises(ValueError):
        OnnxEmbedder(encoder).embed(["a"])
