"""Models' answers in: JSON texts to rows of ANSWER, by the rules of `schema.answer_json_schema`, and what is wrong with those that break them. Native expressions on variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields of an answer and of a claim that must be there, their types, and for a claim's the least length (in UTF-16 units, as JSON Schema's validators count).
FIELDS = (("refused", "BOOLEAN"), ("claims", "ARRAY"), ("gaps", "ARRAY"), ("summary", "STRING"))
CLAIM_FIELDS = (("text", 1), ("chunkId", 1), ("quote", 2))
_NONE = "array<string>"


def _kind(v: Column, name: str) -> Column:
    """The type of a field, null if it isn't there. A JSON null is of type VOID."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), r"^[A-Z]+", 0)


def _text(v: Column, name: str) -> Column:
    return F.when(_kind(v, name) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def _wrong(v: Column, name: str, kind: str, label: Column, optional: bool = False) -> Column:
    """An array of what is wrong with a field: nothing, or that it is missing or of another type."""
    found = _kind(v, name)
    missing = F.array().cast(_NONE) if optional else F.array(F.concat(label, F.lit(": missing")))
    return F.when(found.isNull(), missing).when(found != kind, F.array(F.concat(label, F.lit(": type")))).otherwise(F.array().cast(_NONE))


def _claim_faults(c: Column, i: Column) -> Column:
    at = F.concat(F.lit("claims["), i.cast("string"), F.lit("]"))
    parts = []
    for name, least in CLAIM_FIELDS:
        label = F.concat(at, F.lit(f".{name}"))
        short = F.length(F.encode(_text(c, name), "UTF-16BE")) / 2 < least
        parts.append(F.when(short, F.array(F.concat(label, F.lit(": short")))).otherwise(_wrong(c, name, "STRING", label)))
    return F.when(F.schema_of_variant(c).startswith("OBJECT"), F.concat(*parts)).otherwise(F.array(F.concat(at, F.lit(": type"))))


def check_answers(raw: DataFrame) -> DataFrame:
    """(answer_id, json) to the columns of ANSWER with reasons (array, empty for a valid answer), a row for each row.

    Not JSON (or with a key twice): "malformed"; other than an object: "not an object". Fields that aren't known are ignored, as are those of claims; a field that may be
    absent may not be null. A row with reasons has null columns but its id. Null json is malformed.
    """
    rows = raw.select("answer_id", F.try_parse_json("json").alias("v"))
    v, is_object = F.col("v"), F.schema_of_variant("v").startswith("OBJECT")
    fields = [_wrong(v, name, kind, F.lit(name)) for name, kind in FIELDS] + [_wrong(v, "refusalReason", "STRING", F.lit("refusalReason"), optional=True)]
    claims = F.when(_kind(v, "claims") == "ARRAY", F.try_variant_get(v, "$.claims", "array<variant>"))
    gaps = F.when(_kind(v, "gaps") == "ARRAY", F.try_variant_get(v, "$.gaps", "array<variant>"))
    rows = rows.withColumn("claims_of", claims).withColumn("gaps_of", gaps)
    of_claims = F.flatten(F.transform("claims_of", _claim_faults))
    of_gaps = F.filter(F.transform("gaps_of", lambda g, i: F.when(F.schema_of_variant(g) != "STRING", F.concat(F.lit("gaps["), i.cast("string"), F.lit("]: type")))), lambda x: x.isNotNull())
    none = F.array().cast(_NONE)
    reasons = F.when(v.isNull(), F.array(F.lit("malformed"))).when(~is_object, F.array(F.lit("not an object"))).otherwise(F.concat(*fields, F.coalesce(of_claims, none), F.coalesce(of_gaps, none)))
    rows = rows.withColumn("reasons", reasons)
    valid = F.size("reasons") == 0
    claim = F.transform("claims_of", lambda c: F.struct(_text(c, "text").alias("text"), _text(c, "chunkId").alias("chunk_id"), _text(c, "quote").alias("quote")))
    return rows.select(
        "answer_id",
        F.when(valid, F.try_variant_get(v, "$.refused", "boolean")).alias("refused"),
        F.when(valid, _text(v, "refusalReason")).alias("refusal_reason"),
        F.when(valid, claim).alias("claims"),
        F.when(valid, F.transform("gaps_of", lambda g: F.try_variant_get(g, "$", "string"))).alias("gaps"),
        F.when(valid, _text(v, "summary")).alias("summary"),
        "reasons",
    )


def take_answers(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid answers as rows of ANSWER, and the others as (answer_id, reasons, json)."""
    checked = check_answers(raw)
    accepted = checked.where(F.size("reasons") == 0).drop("reasons")
    return accepted, checked.where(F.size("reasons") > 0).select("answer_id", "reasons").join(raw.select("answer_id", "json"), "answer_id")


def reason_counts(checked: DataFrame) -> DataFrame:
    """(reason, n): how often each reason stands, with places of claims and gaps left out."""
    return checked.select(F.explode("reasons").alias("r")).groupBy(F.regexp_replace("r", r"\[\d+\]", "[]").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
