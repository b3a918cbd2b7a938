"""Operators that work row by row: quality rules, language ID, line dedup, chat formatting, BPE and token files."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat_format, language_id, line_dedup, mixing, quality_rules, registry, token_file, wordhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}" for k in range(30_000))
TEXTS = [None, "", "  \n\t ", "one two three", "a b c d e f a b c d e f", "Ärger über öl\nline\nline\n line", "#$% |x|", LONG, "same same", "same same"]


def docs(spark, texts=TEXTS, lang="en"):
    return spark.createDataFrame([(k if k != 5 else None, x, lang if k % 3 else None, "s" if k % 2 else None, 0) for k, x in enumerate(texts)], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_counts(text):
    w, t = words(text), text or ""
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_against_brute_force(spark):
    df = docs(spark)
    weights = quality_rules.ratio_weights(df, spark.createDataFrame([(3,)], "id long"))
    rows = quality_rules.rate(df.withColumn("Score", F.lit("clash")).withColumn("raw", F.lit("clash")).withColumn("_words", F.lit("other")), weights).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == base_counts(r["text"])
        assert r["base_failed"] == (got[0] < 10 or 100 * got[4] > 20 * got[0])
        assert not (r["base_failed"] and r["kept"]) and r["raw"] == "clash" and r["_words"] == "other"


def spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v if isinstance(v, bytes) else (v % (1 << 64)).to_bytes(8, "little"), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def test_quality_ratio_against_brute_force(spark):
    texts = ["good words here now", "good words there", "bad bad junk words", "junk $$$"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = quality_rules.rate(df, quality_rules.ratio_weights(df, spark.createDataFrame([(0,), (1,)], "id long"))).collect()

    def grams(text):
        h = [spark_hash(w.encode()) for w in words(text)]
        return [x % quality_rules.BUCKETS for x in h] + [spark_hash(a, b) % quality_rules.BUCKETS for a, b in zip(h, h[1:])]

    raw, good = Counter(g for t in texts for g in grams(t)), Counter(g for t in texts[:2] for g in grams(t))
    n, m, b = sum(raw.values()), sum(good.values()), quality_rules.BUCKETS
    for r in rows:
        want = [math.log((good[g] + 1) / (m + b)) - math.log((raw[g] + 1) / (n + b)) for g in grams(r["text"])]
        assert abs(r["score"] - sum(want) / len(want)) < 1e-9
    # The smoothing of a few words over all buckets moves every score alike.
    assert min(r["score"] for r in rows[:2]) > max(r["score"] for r in rows[2:])


def test_quality_of_empty_tables_and_labels(spark):
    df = docs(spark).where("false")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, None), (3, 1, 1), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    ids = quality_rules.trusted_sample(labels)
    assert [r["id"] for r in ids.collect()] == [2]
    assert quality_rules.rate(df, quality_rules.ratio_weights(df, ids)).count() == 0
    some = quality_rules.rate(docs(spark), quality_rules.ratio_weights(docs(spark), ids.where("false")))
    assert {r["score"] for r in some.collect()} == {0.0}


def test_quality_separates_junk(spark):
    rows = registry.op1_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    by = {(r["quality"], r["kept"]): r["count"] for r in rows.where("not base_failed").groupBy("quality", "kept").count().collect()}
    assert by.get((1, False), 0) <= 0.01 * by[1, True] and by[0, False] > 5 * by.get((0, True), 0)


def test_language_edges(spark):
    model = language_id.train(docs(spark, ["the house is big"] * 6 + ["la maison est grande"] * 3))
    got = [(r["text"], r["lang_pred"], r["score"]) for r in language_id.predict(docs(spark).withColumn("score", F.lit(1)), model).collect()]
    assert {(p, s) for t, p, s in got if not t or not any(c.isalpha() for c in t)} == {("und", 0.0)}
    assert all(0 <= s <= 1 for _, _, s in got) and all(p == "en" for t, p, _ in got if t and "same" in t)
    nothing = language_id.train(docs(spark).where("false"))
    assert {r["lang_pred"] for r in language_id.predict(docs(spark), nothing).collect()} == {"und"}
    assert language_id.predict(docs(spark).where("false"), model).count() == 0


def test_language_accuracy_on_held_out_rows(spark):
    rows = registry.op2_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    r = rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] > 100 and r["a"] > 0.97


def language_by_hand(train, n_max=4):
    """A function from a text to (language, score), with dictionaries."""
    letters = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    seen = [{} for _ in range(n_max + 1)]
    for t, lang in train:
        for w in letters(t or "") if lang is not None else []:
            for n in range(n_max + 1):
                for g in [w] if n == 0 else [w[i : i + n] for i in range(len(w) - n + 1)]:
                    seen[n].setdefault(g, Counter())[lang] += 1
    langs = sorted({x for by in seen for c in by.values() for x in c})
    total = [Counter() for _ in seen]
    for n, by in enumerate(seen):
        for c in by.values():
            total[n].update(c)
    log = lambda n, g, x: math.log((seen[n][g][x] + 0.5) / (total[n][x] + 0.5 * (len(seen[n]) + 1)))

    def find(text):
        sums = dict.fromkeys(langs, 0.0)
        for w in letters(text or ""):
            for n in [0, *range(n_max, 0, -1)]:
                grams = [g for g in ([w] if n == 0 else [w[i : i + n] for i in range(len(w) - n + 1)]) if g in seen[n]]
                if grams:
                    for x in langs:
                        sums[x] += sum(log(n, g, x) for g in grams) / len(grams)
                    break
        if not langs or not letters(text or ""):
            return "und", 0.0
        best = max(langs, key=lambda x: (round(sums[x], 9), [-ord(c) for c in x]))
        return best, 1 / sum(math.exp(sums[x] - sums[best]) for x in langs)

    return find


def test_language_against_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    parts = {"aa": ["ba", "na", "na2ta"], "bb": ["sch", "ung", "ö"], "cc": ["ba", "ung"], "dd": []}
    parts["dd"] = parts["bb"]  # a tie with bb, unless other counts decide
    train = [("".join(rng.choice(parts[x]) + rng.choice(["", " ", ". "]) for _ in range(rng.randint(1, 30))), x) for x in parts for _ in range(12)]
    train += [("same words here", "ee"), ("same words here", "ef"), (None, "aa"), ("lost", None)]
    texts = [t for t, _ in train] + ["same words", "words unseenungba", "ZZZ QQQ", "", None, "123", "İstanbul ba", "ba " * 300 + "ung" * 50 + " ö"]
    df = spark.createDataFrame([(k, t, x) for k, (t, x) in enumerate(train)], "doc_id long, text string, lang string").repartition(3)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("LANG_pred", F.lit(1))
    model = language_id.train(df)
    assert model.languages == ["aa", "bb", "cc", "dd", "ee", "ef"]
    for most in (1 << 20, 64):
        monkeypatch.setattr(language_id.letter_words, "__defaults__", (most,))
        got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(rows, model).collect()}
        find = language_by_hand(train)
        for k, t in enumerate(texts):
            lang, score = find(t)
            assert got[k][0] == lang and abs(got[k][1] - score) < 1e-6, t
    assert got[texts.index("same words")][0] == "ee"  # of ee and ef the first


def test_language_model_keeps_every_word_of_its_sample(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.concat(F.lit("l"), F.col("id") % 300).alias("lang"))
    model = language_id.train(df)
    assert model.entries[0].table.n == 3000 and len(model.languages) == 300
    got = language_id.predict(df, model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got == 1.0
    assert 0 < language_id.train(df, max_documents=300).entries[0].table.n < 600 and language_id.train(df, max_chars=1200).entries[0].table.n < 600


def lines_by_hand(rows, ratio=0.05, least=1, loss=1.0):
    total, pages = Counter(h for h, _ in rows), Counter()
    trim = lambda x: x.strip(" \t\v\f\r")
    for h, t in rows:
        pages.update((h, x) for x in {trim(y) for y in (t or "").split("\n")} if x)
    gone = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for h, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (h, trim(x)) not in gone]
        whole = len(lines) - len(kept) > loss * sum(bool(trim(x)) for x in lines)
        out.append(t if t is None or whole else "\n".join(kept))
    return out


@pytest.mark.parametrize("rule", [{}, {"max_ratio": 0.1, "min_pages": 5}, {"min_pages": 2, "max_loss": 0.5}, {"max_ratio": 0.3, "max_loss": 0.99}])
def test_line_dedup_against_brute_force(spark, rule):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b"]), "\n".join(rng.choice(["menu", " menu ", "foot", "", f"own {rng.randint(0, 999)}"]) for _ in range(rng.randint(0, 6)))) for _ in range(120)]
    rows += [("a", None), ("a", ""), ("c", "menu"), ("d", "menu"), ("d", "menu\nx"), ("a", "menu\nfoot"), ("b", f"menu\n{LONG}")] + [("a", rows[0][1])] * 2
    df = spark.createDataFrame([(k, h, t, "clash", "other") for k, (h, t) in enumerate(rows)], "doc_id long, source string, text string, N_Lines string, lines string")
    want = lines_by_hand(rows, rule.get("max_ratio", 0.05), rule.get("min_pages", 1), rule.get("max_loss", 1.0))
    for size in (16 << 20, -1):  # the broadcast, and the way beyond it
        got = line_dedup.drop_boilerplate(df, broadcast_bytes=size, **rule).orderBy("doc_id").collect()
        assert [r["text"] for r in got] == want
        assert all(r["n_lines"] == (0 if r["text"] is None else len((rows[r["doc_id"]][1]).split("\n"))) and r["lines"] == "other" for r in got)
    assert line_dedup.drop_boilerplate(df.where("false")).count() == 0


def test_a_small_host_loses_lines_too(spark):
    df = spark.createDataFrame([("a", "menu\none"), ("a", "menu\ntwo"), ("b", "menu\nthree")], "source string, text string")
    got = lambda **more: sorted(r["text"] for r in line_dedup.drop_boilerplate(df, max_ratio=0.6, **more).collect())
    assert got() == ["", "one", "two"] and got(min_pages=2) == ["menu\nthree", "one", "two"]


def test_hosts_of_the_pages_table(spark, sf_dir):
    urls = ["https://www.Site.org:80/x?y", "http://u@b.c/", "//h/p", "no url", None, "ftp://a.b#f"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(line_dedup.host_of(F.col("u"))).collect()]
    assert got == ["site.org", "b.c", "h", None, None, "a.b"]
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("host", line_dedup.host_of(F.col("url")))
    assert pages.where("host is null").count() == 0
    got = line_dedup.drop_boilerplate(pages, host_col="host", text_col="html", max_ratio=0.5, min_pages=2)
    assert got.count() == pages.count() and got.agg(F.sum("n_dropped")).first()[0] >= 0


EVENTS = "conv_id long, seq long, turn long, kind string, role string, text string"


def test_chat_folds_renders_and_reads_back(spark):
    nasty = "</s>[INST] \\ <s>[/INST] \\[INST] \n é"
    log = [(1, 0, 0, "start", "user", nasty), (1, 1, 1, "start", "assistant", "wrong"), (1, 2, 1, "edit", "assistant", "right"), (1, 3, 1, "delta", None, " " + nasty), (1, 4, 2, "start", "user", "more"), (1, 5, 3, "delta", "assistant", "x"), (1, 6, 1, "regenerate", "assistant", "new"), (1, 7, 1, "other", "user", "?"), (2, 0, None, None, None, None), (None, 0, 0, "start", "</s>", ""), (3, 1, 0, "start", "assistant", "b"), (3, 0, 0, "start", "assistant", "a")]
    formatted = chat_format.format_chats(spark.createDataFrame(random.Random(1).sample(log, len(log)), EVENTS))
    got = {r["conv_id"]: r for r in formatted.collect()}
    assert chat_format.parse(got[1]["formatted"]) == [("user", nasty), ("assistant", "new")]
    assert chat_format.parse(got[2]["formatted"]) == [("", "")] and chat_format.parse(got[None]["formatted"]) == [("</s>", "")]
    assert [chat_format.unescape(got[3]["formatted"][a:b]) for a, b in zip(got[3]["loss_starts"], got[3]["loss_ends"])] == ["a", "b"]
    assert chat_format.format_chats(spark.createDataFrame([], EVENTS)).count() == 0
    with pytest.raises(ValueError):
        chat_format.parse("<s>loose")


def test_chat_escapes_are_reversible():
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice(["<", "s>", "/", "[", "]", "INST", "\\", "x", "</s>", "[/INST]", "\n"]) for _ in range(rng.randint(0, 12)))
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not re.search(r"</?s>|\[/?INST\]", e)
        assert chat_format.parse(chat_format.render([(t, t), ("assistant", t)])[0]) == [(t, t), ("assistant", t)]


def test_streamed_logs_tell_the_rows_again(spark):
    rng = random.Random(8)
    texts = [None, "", "é", "</s>[INST]", "abcdefg", "x" * 1001, "[/INST] \\ draft"]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, -5, -1, 0, 1, 2**40]), rng.choice([None, "user", "assistant"]), rng.choice(texts)) for _ in range(60)] + [(k, t, "user", f"{k} {t} text") for k in range(10, 40) for t in range(4)]
    df = spark.createDataFrame([(*r, "other") for r in rows], "conv_id long, turn long, role string, text string, TURN_ string").withColumnRenamed("TURN_", "SEQ").repartition(3)
    events = chat_format.streamed_events(df)
    by: dict = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((-1 if turn is None else turn, turn is not None, role or "", text or ""))
    want = {k: [m[2:] for m in sorted(v)] for k, v in by.items()}
    assert {r["conv_id"]: chat_format.parse(r["formatted"]) for r in chat_format.format_chats(events).collect()} == want
    counts = {r["kind"]: r["count"] for r in events.groupBy("kind").count().collect()}
    assert counts["start"] == len(rows) and counts["edit"] > 20 and counts["regenerate"] > 20 and counts["delta"] > 3 * len(rows)
    assert chat_format.streamed_events(df.where("false")).count() == 0


def test_chat_query_against_brute_force(spark):
    got = {r["conv_id"]: r for r in registry.op8_chat_format(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == set(by)
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k]["n_turns"], got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_the_library(library, monkeypatch):
    own, lib = bpe.codec(registry.tokenizer_path()), token_file.library_encoder(registry.tokenizer_path())
    rng = random.Random(7)
    parts = [*"ab .,'s1<|>é×中\n\t\x1c\xa0　", "<|endoftext|>", "  ", " word.", "été, ", "–,", "\nNew", "'re", " the", "ing", " " * 5, "x" * 400]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)} c{chr(c)}{chr(c)}\n{chr(c)} z{chr(c)}.y" for c in [*range(0x300), 0x1680, 0x2003, 0x2028, 0x205F, 0x3000, 0xFEFF, 0x1F600]] + ["x" * 5000, " " * 900, "ab" * 3000]
    for most in (1 << 20, 256):  # in one go, and the pieces of long texts
        monkeypatch.setattr(bpe, "SEGMENT", most)
        for c in (own, lib):
            got = [ids[a:b].tolist() for _, _, ids, first in c.encode_texts(pa.array([*texts, None])) for a, b in zip(first, first[1:])]
            assert got == [*(ids_of(library, t) for t in texts), []]
    for t in texts:
        want = ids_of(library, t)
        assert own.decode(np.array(want, np.uint32)) == library.decode(want, skip_special_tokens=False) == t


def test_bpe_starts_anew_when_its_table_is_full(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 50)
    own = bpe.Bpe(registry.tokenizer_path())
    for k in range(30):
        t = " ".join(f"word{k * j}x" for j in range(40))
        assert own.encode(t).tolist() == ids_of(library, t)
        assert own.table.n <= 50 + 41


def test_files_with_other_settings_are_refused(tmp_path):
    spec = json.loads(open(registry.tokenizer_path(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"type": "Unigram"}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}, {"model": spec["model"] | {"dropout": 0.1}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change), encoding="utf-8")
        for read in (bpe.Bpe, token_file.LibraryEncoder):
            with pytest.raises(ValueError, match="byte-level BPE"):
                read(str(tmp_path / "t.json"))


def test_bpe_query(spark, library):
    df = docs(spark).withColumn("IDS", F.lit("clash")).withColumn("text_to_encode", F.lit("other"))
    rows = bpe.encode(df, registry.tokenizer_path(), digests=True).collect()
    for r in rows:
        want = ids_of(library, r["text"])
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decode(bpe.encode(df, registry.tokenizer_path()), registry.tokenizer_path()).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert bpe.encode(df.where("false"), registry.tokenizer_path()).count() == 0


@pytest.mark.parametrize("ids", [[], [0], [2**32 - 1, 0, 5], list(range(0, 60000, 7)), [3] * 2000])
def test_blobs_give_random_access(ids):
    b = token_file.Blob(token_file.encode_blob(np.array(ids, np.uint32)))
    assert b.all().tolist() == ids and len(b) == len(ids)
    assert [b[i] for i in range(0, len(ids), 13)] == ids[::13]
    with pytest.raises(IndexError):
        b[len(ids)]
    with pytest.raises(ValueError):
        token_file.Blob(b"none" + bytes(9))


def test_widths_are_the_shortest():
    ids = np.array([1] * 100 + [40000] * 3, np.uint32)
    best = len(token_file.encode_blob(ids))
    rng = np.random.default_rng(0)
    widths = token_file.best_widths(ids)
    cost = lambda ws: sum((ids >> sum(ws[:k]) > 0).sum() * (w + (k + 1 < len(ws))) if k else len(ids) * (w + (len(ws) > 1)) for k, w in enumerate(ws))
    for _ in range(200):
        cuts = sorted(set(rng.integers(1, 16, rng.integers(0, 4)).tolist()))
        assert cost(widths) <= cost([int(b - a) for a, b in zip([0, *cuts], [*cuts, 16])])
    assert best < 4 * len(ids)


def test_token_file_against_the_library(spark, library, monkeypatch):
    df = docs(spark)
    for segment in (1 << 20, 10):
        monkeypatch.setattr(token_file, "SEGMENT", segment)
        file = token_file.write_token_file(df, registry.tokenizer_path(), end_id=2)
        rows = token_file.read_token_file(file, digests=True).collect()
        order = sorted(range(len(TEXTS)), key=lambda k: (k != 5, k))
        every, want = [], []
        for k in order:
            ids = [*ids_of(library, TEXTS[k]), 2]
            want.append((None if k == 5 else k, len(every), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids[len(ids) // 2]))
            every += ids
        assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
        places = [0, 7, 12, len(every) // 2, len(every) - 1, len(every)]
        assert {r["position"]: r["id"] for r in token_file.tokens_at(file, places).collect()} == {p: every[p] for p in places[:-1]}
    empty = token_file.write_token_file(df.where("false"), registry.tokenizer_path())
    assert token_file.read_token_file(empty).count() == 0 and token_file.tokens_at(empty, [0]).count() == 0
    none = token_file.read_token_file(token_file.write_token_file(df.where("text is null"), registry.tokenizer_path()), digests=True).collect()
    assert [(r["n_tokens"], r["middle_id"]) for r in none] == [(0, None)]


def test_rows_of_one_id_are_split(spark):
    df = spark.range(2000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")).repartition(4)
    file = token_file.write_token_file(df, registry.tokenizer_path(), end_id=2)
    assert file.groupBy("part").agg(F.sum("n_docs").alias("n")).where("n < 1500").count() > 1
    rows = token_file.read_token_file(file, digests=True)
    assert rows.count() == 2000 and rows.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()[0:1] == rows.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0:1]


def test_word_hashes_and_windows():
    wordhash._POWERS[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # other tests of this process let them grow
    seen, tails = {}, {}
    texts = [None, "", " a b", "A b c D e f", "é ü", LONG[:500], "x" * 50, "y " + "x" * 50 + " z"]
    for most in (8, 1 << 20):
        for row, n, h, last, first in wordhash.word_runs(pa.array(texts), lower=True, tail=3, most=most):
            g, of = wordhash.windows(h, first, 5)
            for i in range(n):
                w = [x.lower() if x.isascii() else x for x in words(texts[row + i])]
                shingles = [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])
                for key, value in [*zip(w, h[first[i] : first[i + 1]], strict=True), *zip(shingles, g[of[i] : of[i + 1]], strict=True)]:
                    assert seen.setdefault(key, value) == value
                for x, value in zip(w, last[first[i] : first[i + 1]], strict=True):
                    assert tails.setdefault(x.encode()[-3:], value) == value
    assert len(set(seen.values())) == len(seen) and len(set(tails.values())) == len(tails)
    assert sum(map(len, wordhash._POWERS)) < 4 * wordhash.SEGMENT + 4


def test_key_tables():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) & ~np.uint64(7)  # many that begin at one slot
    keys = np.unique(keys)
    t = wordhash.KeyTable(keys[:10])
    for i in range(10, len(keys), 700):
        t.add(keys[i : i + 700])
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1)) == -1).all()
    assert (wordhash.KeyTable().find(keys) == -1).all()


def test_texts_of_some_megabytes(spark, library):
    """Every operator that reads texts, on texts longer than what is hashed at once: many words, one long word, one long line."""
    from larkspur.llm import lm_score, shingle_join

    many = " ".join(f"w{k % 70001}" for k in range(300_000))
    texts = [many, many + " end", "x" * 1_000_000, "a short text of words for the model to learn"]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS).repartition(4)
    out = {r["doc_id"]: r for r in bpe.encode(df.where("doc_id <> 2"), registry.tokenizer_path(), ids=False, digests=True).drop("text").collect()}
    for k in (0, 1, 3):
        want = np.array(ids_of(library, texts[k]), "<u4")
        assert out[k]["ids_sha256"] == hashlib.sha256(want.tobytes()).hexdigest() and out[k]["decoded_sha256"] == hashlib.sha256(texts[k].encode()).hexdigest()
    rows = {r["id"]: (r["n_shingles"], r["component_id"]) for r in shingle_join.link_documents(df)[0].collect()}
    assert rows == {0: (70001, 0), 1: (70002, 0), 2: (1, 2), 3: (6, 3)}
    langs = language_id.predict(df, language_id.train(df)).select("doc_id", "lang_pred").collect()
    assert {r["lang_pred"] for r in langs} == {"en"}
    lm = {r["doc_id"]: r for r in lm_score.score(df.select("doc_id", "text"), lm_score.train(df), keep=["doc_id"]).collect()}
    assert [lm[k]["n_tokens"] for k in range(4)] == [300_001, 300_002, 2, 11]
    q = {r["doc_id"]: r["n_words"] for r in quality_rules.rate(df.select("doc_id", "text"), quality_rules.ratio_weights(df, spark.createDataFrame([(3,)], "id long"))).collect()}
    assert q == {0: 300_000, 1: 300_001, 2: 1, 3: 10}
    assert {r["n_tokens"] for r in mixing.mix(df.withColumn("topic", F.lit("t"))).collect()} == {300_000, 300_001, 1, 10}
    assert line_dedup.drop_boilerplate(df, min_pages=2).agg(F.sum("n_dropped")).first()[0] == 0
    chats = spark.createDataFrame([(1, 0, 0, "start", "user", texts[2]), (1, 1, 1, "start", "assistant", "<s>\\" * 500_000)], EVENTS)
    assert chat_format.digests(chat_format.format_chats(chats)).first()["loss_chars"] == 2_000_000
