import pytest
from pyspark.sql import functions as F

from larkspur.operators import attribution, evaluate
from larkspur.plans.pipeline import answer_loop
from larkspur.schema import ANSWER, EVIDENCE, GOLD

HONEST = dict(refused=False, reason=None, claims=[("silica is 45 to 52", "A#1", "silica is 45 to 52"), ("grey rock", "B#0", "a grey rock")], gaps=[], summary="45 to 52, see A#1")


def answers(spark, *changes):
    rows = []
    for k, change in enumerate(changes):
        a = HONEST | change
        rows.append((f"a{k}", a["refused"], a["reason"], a["claims"], a["gaps"], a["summary"], a.get("insufficient", False)))
    return spark.createDataFrame(rows, ANSWER + ", insufficient boolean")


def evidence(spark, n):
    rows = [r for k in range(n) for r in ((f"a{k}", 0, "A#1", "child", "silica is 45 to 52 percent"), (f"a{k}", 1, "B#0", "it is a grey\n rock", None))]
    return spark.createDataFrame(rows, EVIDENCE)


def rules(spark, *changes):
    a = answers(spark, *changes)
    found = attribution.issues(a, evidence(spark, len(changes)))
    out = {k: [] for k in range(len(changes))}
    for r in found.orderBy("ord").collect():
        out[int(r["answer_id"][1:])].append(r["rule"])
    return list(out.values())


def test_each_rule(spark):
    claims = HONEST["claims"]
    got = rules(
        spark,
        {},
        {"insufficient": True},
        {"refused": True, "reason": "none"},
        {"refused": True, "reason": " ", "claims": []},
        {"claims": []},
        {"claims": [("98 of it", "C#9", "x")]},
        {"claims": [(*claims[0][:2], "silica is about 45")]},
        {"claims": [("silica is 45 to 58", "A#1", claims[0][2])]},
        {"summary": "in all 77.5, see A#1"},
        {"summary": "in all 77.5", "refused": True, "reason": "r", "claims": []},
        {"claims": [("silica is 5", "A#1", " 　\n")]},
    )
    assert got == [[], ["refusal.required"], ["refusal.with-claims"], ["refusal.no-reason"], ["claims.empty", "summary.unclaimed-number"], ["cite.unknown-chunk", "summary.unclaimed-number"], ["quote.not-substring"], ["number.unsupported", "summary.unclaimed-number"], ["summary.unclaimed-number"], [], ["summary.unclaimed-number"]]


def test_verdicts_repairs_and_reports(spark):
    a = answers(spark, {}, {"claims": [("silica is 45 to 58", "A#1", "silica is 45")], "summary": ""}, {"refused": True, "reason": None, "claims": []})
    found = attribution.issues(a, evidence(spark, 3))
    v = {r["answer_id"]: (r["errors"], r["warns"], r["claims"], r["passed"]) for r in attribution.verdicts(a, found).collect()}
    assert v == {"a0": (0, 0, 2, True), "a1": (1, 0, 1, False), "a2": (0, 1, 0, True)}
    repairs = {r["answer_id"]: r["repair"] for r in attribution.repair_texts(found).collect()}
    assert list(repairs) == ["a1"] and "1. [number.unsupported] claims[0]: " in repairs["a1"] and "58" in repairs["a1"]
    reports = {r["answer_id"]: r["report"] for r in attribution.report_texts(a, found).collect()}
    assert reports["a0"].startswith("✅") and reports["a1"].startswith("❌") and "silica is 45 to 58" in reports["a1"]


def test_answer_loop_repairs_only_what_fails(spark):
    asked = []

    def generate(prompts):
        ids = sorted(r["answer_id"] for r in prompts.collect())
        asked.append(ids)
        bad = {"claims": [("silica is 99", "A#1", "silica is 45")]} if len(asked) == 1 else {}
        return answers(spark, {}, bad).drop("insufficient").where(F.col("answer_id").isin(ids))

    prompts = spark.createDataFrame([("a0", "p", False), ("a1", "p", False)], "answer_id string, prompt string, insufficient boolean")
    kept, verdicts = answer_loop(prompts, evidence(spark, 2), generate)
    assert asked == [["a0", "a1"], ["a1"]] and kept.count() == 2
    assert {r["answer_id"]: (r["passed"], r["rounds"]) for r in verdicts.collect()} == {"a0": (True, 1), "a1": (True, 2)}


def test_honesty_threshold_and_evidence(spark):
    rows = spark.createDataFrame([("answer", False, []), ("refuse", True, []), ("partial", False, ["g"]), ("partial", False, []), ("answer", True, [])], "e string, r boolean, g array<string>")
    assert [x[0] for x in rows.select(attribution.honest(F.col("e"), F.col("r"), F.col("g"))).collect()] == [True, True, True, False, False]
    s = spark.createDataFrame([(1.0,), (None,), (3.0,)], "s double")
    assert [x[0] for x in s.select(attribution.insufficient(F.col("s"), 2.0)).collect()] == [True, False, False]
    hits = spark.createDataFrame([(0, 2, "b", "bt", None), (0, 1, "a", "at", "actx")], "qid long, rank int, chunk_id string, text string, context string")
    assert attribution.evidence_block(hits).first()["block"] == "【片段 a】\nactx\n\n【片段 b】\nbt"


def test_metrics(spark):
    hits = spark.createDataFrame([(0, "x", 1), (0, "y", 2), (0, "x", 3), (0, "z", 4), (1, "y", 1), (2, "z", 1)], "qid long, doc_id string, rank int")
    cases = spark.createDataFrame([(0, ["z"]), (1, ["q"]), (2, [])], "qid long, gold array<string>")
    assert [(r["doc_id"], r["rank"]) for r in evaluate.doc_ranking(hits).where("qid = 0").orderBy("rank").collect()] == [("x", 1), ("y", 2), ("z", 3)]
    out = {r["qid"]: (r["rank"], r["pool_rank"], r["pool_rank_chunk"]) for r in evaluate.case_outcomes(cases, hits.where("rank <= 2"), hits).collect()}
    assert out == {0: (-1, 2, 3), 1: (-1, -1, -1), 2: (-1, -1, -1)}
    s = evaluate.summarize(evaluate.case_outcomes(cases, hits, hits), cases.where(F.size("gold") > 0)).first()
    assert (s["n"], s["recall_1"], s["recall_3"], s["pool_recall"]) == (2, 0.0, 0.5, 0.5) and abs(s["mrr"] - 1 / 6) < 1e-6
    facts = spark.createDataFrame([(0, ["ab", "cd"]), (1, None)], "qid long, must_contain array<string>")
    ctx = spark.createDataFrame([(0, 1, "x ab"), (0, 2, "cd y"), (0, 6, "z")], "qid long, rank int, context string")
    got = {r["qid"]: (r["fact_recall"], r["fact_complete"], r["missing"]) for r in evaluate.fact_scores(facts, ctx).collect()}
    assert got == {0: (1.0, 1, []), 1: (1.0, 1, [])}


def test_lint(spark):
    rows = [("g1", "q", None, ["a"], ["fact"], "n"), ("g1", " ", None, ["a"], None, "n"), ("g2", "q", None, ["nope"], None, ""), ("g3", "q", "refuse", [], ["fact"], "n"), ("g4", "q", "partial", ["a"], ["missing"], "n"), ("g5", "q", None, [], None, "n")]
    cases = spark.createDataFrame(rows, GOLD).withColumn("ord", F.monotonically_increasing_id())
    docs = spark.createDataFrame([("a", "the fact")], "doc_id string, text string")
    got = sorted((r["case_id"], r["problem"]) for r in evaluate.lint_gold(cases, docs).collect())
    assert got == [("g1", "blank question"), ("g1", "duplicate id"), ("g2", "blank note"), ("g2", "unknown document"), ("g3", "fact not in gold documents"), ("g3", "refusal with facts"), ("g4", "fact not in gold documents"), ("g4", "partial with documents")]
    e = cases.select("case_id", evaluate.expected(F.col("expect"), F.col("gold_doc_ids")).alias("e")).collect()
    assert [r["e"] for r in e] == ["answer", "answer", "answer", "refuse", "partial", "refuse"]


def test_reports(spark):
    rows = [(0, "c", "answer", False, True, 0, 0), (1, "c", "answer", True, False, 0, 0), (0, "d", "refuse", True, True, 0, 0), (1, "d", "refuse", True, True, 0, 0)]
    rows += [(0, "e", "partial", True, True, 0, 0), (1, "e", "partial", False, True, 1, 0), (0, "f", "answer", False, True, 0, 2), (1, "f", "answer", False, True, 0, 0), (1, "g", "refuse", False, False, 0, 0)]
    runs = spark.createDataFrame([(*r, 1.0) for r in rows], "run int, case_id string, expected string, refused boolean, honest boolean, rounds int, errors long, cost double")
    rates = {r["run"]: tuple(r)[1:] for r in evaluate.answer_rates(runs).collect()}
    # n, honest, refuse_ok, partial_ok, answered, conservative, clean, cost
    assert rates == {0: (4, 4, 1, 1, 2, 1, 1, 4.0), 1: (5, 3, 1, 1, 1, 0, 2, 5.0), None: (9, 7, 2, 2, 3, 1, 3, 9.0)}
    assert sorted(r["case_id"] for r in evaluate.flaky_cases(runs).collect()) == ["c", "e", "f"]
    s = evaluate.run_stability(runs).first()
    assert (s["honest_mean"], s["honest_sd"], s["clean_mean"], s["clean_sd"], s["runs"]) == (0.75, 0.25, 0.75, 0.25, 2)
    alone = evaluate.run_stability(runs.where("expected = 'partial'")).first()
    assert (alone["honest_mean"], alone["clean_mean"]) == (1.0, 1.0)
    found = spark.createDataFrame([("r", "error"), ("r", "error"), ("w", "warn")], "rule string, severity string")
    assert [tuple(r) for r in evaluate.rule_histogram(found).collect()] == [("r", 2)]
    assert evaluate.report_table(spark.createDataFrame([("bm25", 0.5, 3), ("hybrid", None, 4)], "label string, recall double, n int")) == "        bm25   hybrid\nrecall  0.500  -\nn       3      4"


def test_slices_of_a_gold_set(spark):
    cases = spark.createDataFrame([(f"g{k}", k, e, ["d"] if k % 2 else []) for k, e in enumerate([None, None, "partial", "refuse", None])], "case_id string, ord long, expect string, gold_doc_ids array<string>")
    ids = lambda **more: sorted(r["case_id"] for r in evaluate.select_cases(cases, **more).collect())
    assert ids() == ["g0", "g1", "g2", "g3", "g4"] and ids(refusal=True) == ["g0", "g2", "g3", "g4"]
    assert ids(start="g3") == ["g3", "g4"] and ids(start="none", limit=2) == ["g0", "g1"] and ids(refusal=True, start="g2", limit=1) == ["g2"]


def test_score_gaps(spark):
    gaps = spark.createDataFrame([("a", True, 5.0, 1.0), ("b", True, 7.0, 2.0), ("c", False, 1.0, 0.5)], "case_id string, answerable boolean, top1 double, gap double")
    c = {r["answerable"]: (r["median_top1"], r["threshold"]) for r in evaluate.calibrate(gaps).collect()}
    assert c == {True: (7.0, 3.0), False: (1.0, 3.0)} and evaluate.overlapping(gaps).count() == 0


def test_gold_is_looked_for_once(spark, monkeypatch):
    """Answers, evidence and what is made of both ask for the same gold documents."""
    from larkspur.plans import queries

    calls = []
    look = queries.find_contained
    monkeypatch.setattr(queries, "find_contained", lambda *a: calls.append(1) or look(*a))
    i = queries.Inputs(spark, "/root/testdata/sf0.001")
    assert i.gold().count() == i.questions.count()
    i.answers(), i.evidence(), i.issues(), i.runs()
    assert len(calls) == 1
