"""Checks of structured answers against their evidence: string predicates over claims, one issue a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import contains, is_blank, numbers, quote_form, without_ids
from larkspur.operators.frames import stacked

#: What each rule says; %s stands for the id or the numbers in question.
MESSAGES = {
    "refusal.required": "检索未提供足够证据，必须如实拒答而不是硬答",
    "refusal.with-claims": "既然拒答，就不应同时给出断言",
    "refusal.no-reason": "拒答未说明理由",
    "claims.empty": "既未拒答，也没有任何带出处的断言",
    "cite.unknown-chunk": "引用了本次检索结果中不存在的片段「%s」——幻觉引用",
    "quote.not-substring": "引文不是被引片段的原文子串——改写、拼接或臆造",
    "number.unsupported": "断言中的数字「%s」未出现在被引片段中——数字幻觉",
    "summary.unclaimed-number": "回答正文出现了未被任何断言覆盖的数字「%s」",
}
#: Rules that warn; all others are errors.
WARNINGS = ("refusal.no-reason", "summary.unclaimed-number")
#: The lines around the list of repairs.
REPAIR_HEAD = "上一版回答未通过归因校验，请只针对以下问题定向修复，其余不变："
REPAIR_TAIL = "提醒：quote 必须从片段原文逐字复制；断言中的数字必须来自被引片段；无证据时请如实拒答。"
_ISSUE = ["answer_id", "ord", "rule", "severity", "path", "message", "detail"]


def _issue(rows: DataFrame, rule: str, when: Column, order: Column, path: Column, about: Column | None = None, detail: Column | None = None) -> DataFrame:
    message = F.lit(MESSAGES[rule]) if about is None else F.format_string(MESSAGES[rule], about)
    severity = "warn" if rule in WARNINGS else "error"
    return rows.where(when).select("answer_id", order.cast("int").alias("ord"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), path.alias("path"), message.alias("message"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


def refusal_issues(answers: DataFrame) -> DataFrame:
    """answers may have a boolean column insufficient: no usable evidence was retrieved."""
    rows = answers if "insufficient" in answers.columns else answers.withColumn("insufficient", F.lit(False))
    refused, claims = F.coalesce("refused", F.lit(False)), F.coalesce(F.size("claims"), F.lit(0))
    none = F.coalesce(is_blank(F.col("refusal_reason")), F.lit(True))
    at = lambda k: F.lit(k)
    out = _issue(rows, "refusal.required", F.coalesce("insufficient", F.lit(False)) & ~refused, at(0), F.lit("refused"))
    out = stacked(out, _issue(rows, "refusal.with-claims", refused & (claims > 0), at(1), F.lit("claims")))
    out = stacked(out, _issue(rows, "refusal.no-reason", refused & none, at(2), F.lit("refusalReason")))
    return stacked(out, _issue(rows, "claims.empty", ~refused & (claims <= 0), at(3), F.lit("claims")))


def claim_sources(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, i, claim_text, chunk_id, quote, source) of each claim; source is null if the chunk isn't among the answer's evidence. Of equal chunk ids the last counts."""
    claims = answers.select("answer_id", F.posexplode("claims").alias("i", "c")).select("answer_id", "i", F.col("c.text").alias("claim_text"), F.col("c.chunk_id").alias("chunk_id"), F.col("c.quote").alias("quote"))
    by = evidence.groupBy("answer_id", "chunk_id").agg(F.max_by(F.coalesce("context", "text"), F.coalesce("ord", F.lit(0))).alias("source"))
    return claims.join(by, ["answer_id", "chunk_id"], "left")


def claim_issues(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    rows = claim_sources(answers, evidence).withColumn("bad", F.filter(numbers(F.col("claim_text")), lambda n: ~contains(F.col("source"), n)))
    path = F.concat(F.lit("claims["), F.col("i").cast("string"), F.lit("]"))
    at = lambda k: 10 + 3 * F.col("i") + k
    known = F.col("source").isNotNull()
    out = _issue(rows, "cite.unknown-chunk", ~known, at(0), path, F.col("chunk_id"))
    out = stacked(out, _issue(rows, "quote.not-substring", known & ~contains(quote_form(F.col("source")), quote_form(F.col("quote"))), at(1), path, None, F.substring("quote", 1, 60)))
    return stacked(out, _issue(rows, "number.unsupported", known & (F.size("bad") > 0), at(2), path, F.concat_ws("、", "bad"), F.substring("claim_text", 1, 60)))


def summary_issues(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Numbers of the summary (without the evidence's ids) that no claim's text has; repeats stay."""
    ids = evidence.groupBy("answer_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("ids"))
    rows = answers.join(ids, "answer_id", "left")
    claimed = F.flatten(F.transform(F.coalesce("claims", F.expr("array()")), lambda c: numbers(c["text"])))
    rows = rows.withColumn("claimed", claimed).withColumn("orphan", F.filter(numbers(without_ids(F.col("summary"), F.coalesce("ids", F.array().cast("array<string>")))), lambda n: ~F.array_contains("claimed", n)))
    return _issue(rows, "summary.unclaimed-number", ~F.coalesce("refused", F.lit(False)) & (F.size("orphan") > 0), F.lit(2_000_000_000), F.lit("summary"), F.concat_ws("、", "orphan"))


def issues(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """All issues, (answer_id, ord, rule, severity, path, message, detail); ord gives their order in an answer."""
    return stacked(refusal_issues(answers), claim_issues(answers, evidence), summary_issues(answers, evidence)).select(_ISSUE)


def verdicts(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(answer_id, errors, warns, claims, passed): only errors block."""
    by = found.groupBy("answer_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warns"))
    rows = answers.select("answer_id", F.greatest(F.coalesce(F.size("claims"), F.lit(0)), F.lit(0)).cast("long").alias("claims")).join(by, "answer_id", "left")
    return rows.select("answer_id", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warns", F.lit(0)).alias("warns"), "claims", (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


def repair_texts(found: DataFrame) -> DataFrame:
    """(answer_id, repair): what to tell the model about an answer's errors. Answers without errors have no row."""
    by = found.where("severity = 'error'").groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("ord", "rule", "path", "message"))).alias("xs"))
    lines = F.transform("xs", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". ["), x["rule"], F.lit("] "), x["path"], F.lit(": "), x["message"]))
    return by.select("answer_id", F.concat_ws("\n", F.lit(REPAIR_HEAD), lines, F.lit(REPAIR_TAIL)).alias("repair"))


def report_texts(answers: DataFrame, found: DataFrame) -> DataFrame:
    """(answer_id, report): the verdict and each issue, for people."""
    v = verdicts(answers, found)
    by = found.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("ord", "rule", "severity", "path", "message", "detail"))).alias("xs"))
    line = lambda x: F.concat(F.when(x["severity"] == "error", "  ✗ [").otherwise("  ⚠ ["), x["rule"], F.lit("] "), x["path"], F.lit(": "), x["message"], F.coalesce(F.concat(F.lit("\n      「"), x["detail"], F.lit("…」")), F.lit("")))
    head = F.when(F.col("passed"), F.format_string("✅ 归因校验通过（%d 条断言逐条溯源，%d 条提醒）", "claims", "warns")).otherwise(F.format_string("❌ 归因校验未通过：%d 个错误 / %d 条提醒", "errors", "warns"))
    return v.join(by, "answer_id", "left").select("answer_id", F.concat_ws("\n", head, F.transform("xs", line)).alias("report"))


def honest(expected: Column, refused: Column, gaps: Column) -> Column:
    """Whether an answer does what its case expects: answer, refuse, or (partial) refuse or name gaps."""
    return F.when(expected == "answer", ~refused).when(expected == "refuse", refused).otherwise(refused | (F.coalesce(F.size(gaps), F.lit(0)) > 0))


def insufficient(top_score: Column, threshold: float | None) -> Column:
    """Whether the best rerank score is under the threshold; without either it isn't."""
    return F.lit(False) if threshold is None else F.coalesce(top_score < threshold, F.lit(False))


def evidence_block(hits: DataFrame) -> DataFrame:
    """(qid, block): the hits (qid, rank, chunk_id, text, context) as the prompt shows them."""
    by = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.coalesce("context", "text").alias("t")))).alias("xs"))
    return by.select("qid", F.array_join(F.transform("xs", lambda x: F.concat(F.lit("【片段 "), x["chunk_id"], F.lit("】\n"), x["t"])), "\n\n").alias("block"))
