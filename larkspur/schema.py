"""Schemas of the entities, as Spark DDL."""

DOC = "doc_ord BIGINT, doc_id STRING, title STRING, text STRING, source STRING, license STRING"
CHUNK = "chunk_ord BIGINT, chunk_id STRING, doc_id STRING, n INT, title STRING, text STRING, start INT, end INT, source STRING, context STRING"
GOLD = "case_id STRING, question STRING, expect STRING, gold_doc_ids ARRAY<STRING>, must_contain ARRAY<STRING>, note STRING"
CLAIM = "STRUCT<text: STRING, chunk_id: STRING, quote: STRING>"
ANSWER = f"answer_id STRING, refused BOOLEAN, refusal_reason STRING, claims ARRAY<{CLAIM}>, gaps ARRAY<STRING>, summary STRING"
EVIDENCE = "answer_id STRING, ord INT, chunk_id STRING, text STRING, context STRING"
ISSUE = "answer_id STRING, ord INT, rule STRING, severity STRING, path STRING, message STRING, detail STRING"
VECTORS = "chunk_id STRING, model STRING, dim INT, embedding ARRAY<FLOAT>"
#: A chunk's ordinal is its document's, shifted, plus its number: unique and ordered without a global sort.
CHUNK_SHIFT = 20


def answer_json_schema() -> dict:
    """What a language model is asked for, as JSON Schema (draft 7): the fields of ANSWER in the spelling of JSON."""
    text = lambda least, about: {"type": "string", "description": about} | ({"minLength": least} if least else {})
    claim = {"text": text(1, "one statement that the chunk supports"), "chunkId": text(1, "the id of a retrieved chunk"), "quote": text(2, "its words, copied exactly")}
    fields = {
        "refused": {"type": "boolean", "description": "true if the chunks don't suffice for an answer"},
        "refusalReason": text(0, "why, if it is refused"),
        "claims": {"type": "array", "items": {"type": "object", "properties": claim, "required": list(claim), "additionalProperties": False}},
        "gaps": {"type": "array", "items": {"type": "string"}, "description": "parts of the question that no chunk covers"},
        "summary": text(0, "the whole answer for the reader"),
    }
    return {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "properties": fields, "required": [f for f in fields if f != "refusalReason"], "additionalProperties": False}
