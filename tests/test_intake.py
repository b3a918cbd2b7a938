"""Answers of models, valid and not."""

import json

from larkspur.operators import intake

GOOD = {"refused": False, "claims": [{"text": "t", "chunkId": "c#1", "quote": "qq"}], "gaps": ["g"], "summary": ""}


def but(**changes):
    return json.dumps({k: v for k, v in (GOOD | changes).items() if v is not ...})


def claim(**changes):
    return but(claims=[GOOD["claims"][0], {k: v for k, v in (GOOD["claims"][0] | changes).items() if v is not ...}])


CASES = [
    (but(), []),
    (but(extra={"a": [1]}, refusalReason="r"), []),
    (but(claims=[], gaps=[]), []),
    (claim(quote="\U0001d4d0", other=1), []),  # two UTF-16 units
    (claim(quote="q"), ["claims[1].quote: short"]),
    (claim(text="", chunkId=...), ["claims[1].text: short", "claims[1].chunkId: missing"]),
    (claim(text=5, quote=None), ["claims[1].text: type", "claims[1].quote: type"]),
    (but(claims=["x"]), ["claims[0]: type"]),
    (but(claims={}), ["claims: type"]),
    (but(refused="true"), ["refused: type"]),
    (but(refused=..., summary=None), ["refused: missing", "summary: type"]),
    (but(refusalReason=None), ["refusalReason: type"]),
    (but(gaps=["a", 1, None]), ["gaps[1]: type", "gaps[2]: type"]),
    (but(gaps=...), ["gaps: missing"]),
    ("[]", ["not an object"]),
    ("null", ["not an object"]),
    ('"text"', ["not an object"]),
    ("{}", ["refused: missing", "claims: missing", "gaps: missing", "summary: missing"]),
    (but()[:-1], ["malformed"]),
    ("", ["malformed"]),
    (None, ["malformed"]),
    ("I can't answer that.", ["malformed"]),
]


def test_reasons_and_rows(spark):
    raw = spark.createDataFrame([(str(k), x) for k, (x, _) in enumerate(CASES)], "answer_id string, json string")
    rows = {int(r["answer_id"]): r for r in intake.check_answers(raw).collect()}
    assert {k: r["reasons"] for k, r in rows.items()} == {k: want for k, (_, want) in enumerate(CASES)}
    for k, (text, want) in enumerate(CASES):
        r = rows[k]
        if want:
            assert (r["refused"], r["claims"], r["gaps"], r["summary"]) == (None,) * 4
        else:
            x = json.loads(text)
            assert r["refused"] == x["refused"] and r["gaps"] == x["gaps"] and r["summary"] == x["summary"] and r["refusal_reason"] == x.get("refusalReason")
            assert [tuple(c) for c in r["claims"]] == [(c["text"], c["chunkId"], c["quote"]) for c in x["claims"]]


def test_taken_left_and_counted(spark):
    raw = spark.createDataFrame([(str(k), x) for k, (x, _) in enumerate(CASES)], "answer_id string, json string")
    taken, left = intake.take_answers(raw)
    assert taken.columns == ["answer_id", "refused", "refusal_reason", "claims", "gaps", "summary"] and taken.count() == 4
    assert {r["answer_id"]: (r["reasons"], r["json"]) for r in left.collect()} == {str(k): (want, x) for k, (x, want) in enumerate(CASES) if want}
    counts = {r["reason"]: r["n"] for r in intake.reason_counts(intake.check_answers(raw)).collect()}
    assert counts["malformed"] == 4 and counts["gaps[]: type"] == 2 and counts["claims[].quote: short"] == 1
    assert intake.check_answers(raw.where("false")).count() == 0
