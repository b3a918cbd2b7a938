"""Retrieval metrics, gold lint and run reports, set-based over all cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import contains, is_blank
from larkspur.operators.frames import stacked
from larkspur.operators.ranks import items_at


def expected(expect: Column, gold_doc_ids: Column) -> Column:
    return F.coalesce(expect, F.when(F.coalesce(F.size(gold_doc_ids), F.lit(0)) > 0, "answer").otherwise("refuse"))


def doc_ranking(ranked: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(qid, doc, rank) of ranked chunks to documents by first occurrence, ranked anew from 1."""
    firsts = ranked.groupBy("qid", doc).agg(F.min("rank").alias("first"))
    return firsts.select("qid", doc, F.row_number().over(Window.partitionBy("qid").orderBy("first")).alias("rank"))


def case_outcomes(cases: DataFrame, hits: DataFrame, pool: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(qid, rank, pool_rank, pool_rank_chunk): 0-based places of the first gold document among the hits' and the pool's documents, and of its first chunk in the pool; -1 for none.

    cases: (qid, gold) with an array of documents; hits and pool: (qid, doc, rank) of chunks.
    """
    gold = cases.select("qid", F.explode("gold").alias(doc)).distinct()
    best = lambda ranked, name: gold.join(ranked, ["qid", doc]).groupBy("qid").agg((F.min("rank") - 1).alias(name))
    parts = [best(doc_ranking(hits, doc), "rank"), best(doc_ranking(pool, doc), "pool_rank"), best(pool.select("qid", doc, "rank"), "pool_rank_chunk")]
    out = cases.select("qid")
    for p in parts:
        out = out.join(p, "qid", "left")
    return out.select("qid", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("rank", "pool_rank", "pool_rank_chunk")])


def summarize(outcomes: DataFrame, answerable: DataFrame) -> DataFrame:
    """One row over the answerable cases (qid): n, recall_1, 3, 5 and 10, mrr and pool_recall; 0 without cases."""
    rows = outcomes.join(answerable.select("qid"), "qid", "left_semi")
    share = lambda x: F.round(F.coalesce(F.avg(x.cast("double")), F.lit(0.0)), 6)
    hit = lambda k: (F.col("rank") >= 0) & (F.col("rank") < k)
    return rows.agg(F.count(F.lit(1)).alias("n"), *[share(hit(k)).alias(f"recall_{k}") for k in (1, 3, 5, 10)], share(F.when(hit(10), 1.0 / (F.col("rank") + 1)).otherwise(0.0)).alias("mrr"), share(F.col("pool_rank") >= 0).alias("pool_recall"))


def fact_scores(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(qid, n_facts, n_found, fact_recall, fact_complete, missing) of cases (qid, must_contain): which facts are in the first k contexts, joined by newlines. No facts: recall 1."""
    joined = hits.where(F.col("rank") <= k).groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "context"))), lambda x: x["context"]), "\n").alias("all_text"))
    rows = cases.join(joined, "qid", "left").withColumn("must", F.coalesce("must_contain", F.array().cast("array<string>")))
    missing = F.filter("must", lambda m: ~contains(F.coalesce("all_text", F.lit("")), m))
    rows = rows.withColumn("missing", missing).withColumn("n_facts", F.size("must").cast("long")).withColumn("n_found", (F.size("must") - F.size("missing")).cast("long"))
    rate = F.when(F.col("n_facts") == 0, F.lit(1.0)).otherwise(F.col("n_found") / F.col("n_facts"))
    return rows.select("qid", "n_facts", "n_found", F.round(rate, 6).alias("fact_recall"), (F.col("n_found") == F.col("n_facts")).cast("int").alias("fact_complete"), "missing")


def lint_gold(cases: DataFrame, docs: DataFrame) -> DataFrame:
    """(case_id, problem, about) of a gold set: repeated id, blank question or note, unknown document, a fact that no gold document has, a refusal with facts, a partial case with documents.

    cases has ord, the order of the file.
    """
    none = F.lit(None).cast("string")
    out = lambda rows, problem, about=none: rows.select("case_id", F.lit(problem).alias("problem"), about.alias("about"))
    again = F.row_number().over(Window.partitionBy("case_id").orderBy("ord"))
    gold = cases.select("case_id", "ord", F.explode("gold_doc_ids").alias("doc_id"))
    facts = cases.select("case_id", "ord", F.posexplode("must_contain").alias("i", "fact"))
    held = facts.join(gold.select("ord", "doc_id"), "ord").join(docs.select("doc_id", "text"), "doc_id").where(contains(F.col("text"), F.col("fact"))).select("ord", "i").distinct()
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    parts = [
        out(cases.withColumn("r", again).where("r > 1"), "duplicate id"),
        out(cases.where(F.coalesce(is_blank(F.col("question")), F.lit(True))), "blank question"),
        out(cases.where(F.coalesce(is_blank(F.col("note")), F.lit(True))), "blank note"),
        out(gold.join(docs.select("doc_id"), "doc_id", "left_anti"), "unknown document", F.col("doc_id")),
        out(facts.join(held, ["ord", "i"], "left_anti"), "fact not in gold documents", F.col("fact")),
        out(cases.where((expected(F.col("expect"), F.col("gold_doc_ids")) == "refuse") & (size("must_contain") > 0)), "refusal with facts"),
        out(cases.where((F.col("expect") == "partial") & (size("gold_doc_ids") > 0)), "partial with documents"),
    ]
    return stacked(*parts)


def first_pass(rounds: Column, errors: Column) -> Column:
    """Whether an answer was accepted as it first came: no repairs, no errors left."""
    return (rounds == 0) & (errors == 0)


def answer_rates(rows: DataFrame) -> DataFrame:
    """Per run, and for all runs (run null), of answers (run, expected, refused, honest, rounds, errors, cost).

    n, n_honest and cost of all; refuse_ok: cases to refuse that were; partial_ok: honest partial cases, conservative those of them that were refused; answered:
    cases to answer that weren't refused, clean those that passed at once.
    """
    n, is_ = F.count_if, lambda e: F.col("expected") == e
    return rows.rollup("run").agg(
        F.count(F.lit(1)).alias("n"),
        n(F.col("honest")).alias("n_honest"),
        n(is_("refuse") & F.col("refused")).alias("refuse_ok"),
        n(is_("partial") & F.col("honest")).alias("partial_ok"),
        n(is_("answer") & ~F.col("refused")).alias("answered"),
        n(is_("partial") & F.col("refused")).alias("conservative"),
        n(is_("answer") & first_pass(F.col("rounds"), F.col("errors"))).alias("clean"),
        F.round(F.sum("cost"), 6).alias("cost"),
    )


def rule_histogram(found: DataFrame) -> DataFrame:
    """How often each rule was broken; warnings don't count."""
    return found.where("severity = 'error'").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def run_stability(rows: DataFrame) -> DataFrame:
    """One row: over runs, the mean and the population's standard deviation of the honest share of the cases to refuse, and of the clean share of those to answer. A run without such cases counts as 1."""
    share = lambda cases, good: F.coalesce(F.count_if(cases & good) / F.nullif(F.count_if(cases), F.lit(0)), F.lit(1.0))
    refuse, answer = F.col("expected") == "refuse", F.col("expected") == "answer"
    by = rows.groupBy("run").agg(share(refuse, F.col("honest")).alias("honest"), share(answer, first_pass(F.col("rounds"), F.col("errors"))).alias("clean"))
    stat = lambda c: [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_sd")]
    return by.agg(*stat("honest"), *stat("clean"), F.count(F.lit(1)).alias("runs"))


def flaky_cases(rows: DataFrame) -> DataFrame:
    """Cases of two rows or more that differ in honest, or in passing at once. rows: (case_id, honest, rounds, errors)."""
    by = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("honest").alias("n_honest"), F.count_if(first_pass(F.col("rounds"), F.col("errors"))).alias("n_clean"))
    mixed = lambda c: (F.col(c) > 0) & (F.col(c) < F.col("n"))
    return by.where((F.col("n") >= 2) & (mixed("n_honest") | mixed("n_clean")))


def select_cases(cases: DataFrame, *, refusal: bool = False, start: str | None = None, limit: int | None = None) -> DataFrame:
    """A slice of a gold set (case_id, ord, ...) in its order: only cases that aren't to be answered; from a case on (an unknown one changes nothing); the first `limit`."""
    rows = cases.where(expected(F.col("expect"), F.col("gold_doc_ids")) != "answer") if refusal else cases
    if start is not None:
        first = rows.where(F.col("case_id") == start).agg(F.min("ord").alias("first"))
        rows = rows.crossJoin(F.broadcast(first)).where(F.col("first").isNull() | (F.col("ord") >= F.col("first"))).drop("first")
    return rows.orderBy("ord").limit(limit) if limit else rows


def report_table(summaries: DataFrame, label: str = "label") -> str:
    """Summaries, one row a configuration, side by side as text: a line for each measure. The rows are few: they come to the driver."""
    rows = summaries.collect()
    names = [c for c in summaries.columns if c != label]
    show = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    table = [["", *(str(r[label]) for r in rows)], *([n, *(show(r[n]) for r in rows)] for n in names)]
    widths = [max(len(line[k]) for line in table) for k in range(len(rows) + 1)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip() for line in table)


def score_gaps(scores: DataFrame) -> DataFrame:
    """(case_id, answerable, top1, top_last, gap) of ranked scores (case_id, answerable, rank, score)."""
    by = scores.groupBy("case_id", "answerable").agg(F.min_by("score", "rank").alias("top1"), F.max_by("score", "rank").alias("top_last"))
    return by.withColumn("gap", F.round(F.col("top1") - F.col("top_last"), 6))


def calibrate(gaps: DataFrame) -> DataFrame:
    """Per group: cases, least, upper median and greatest top1, and the mean gap; with the threshold midway if the groups are apart, else null."""
    by = gaps.groupBy("answerable").agg(F.count(F.lit(1)).alias("n"), F.min("top1").alias("min_top1"), F.max("top1").alias("max_top1"), F.round(F.avg("gap"), 6).alias("mean_gap"))
    medians = items_at(gaps, "answerable", "top1", "case_id", 0.5, "median_top1").withColumnRenamed("answerable", "of")
    by = by.join(medians, F.col("answerable").eqNullSafe(F.col("of"))).select("answerable", "n", "min_top1", "median_top1", "max_top1", "mean_gap")
    ends = gaps.agg(F.min(F.when(F.col("answerable"), F.col("top1"))).alias("lo"), F.max(F.when(~F.col("answerable"), F.col("top1"))).alias("hi"))
    return by.crossJoin(F.broadcast(ends)).select(*by.columns, F.when(F.col("lo") > F.col("hi"), F.round((F.col("lo") + F.col("hi")) / 2, 6)).alias("threshold"))


def overlapping(gaps: DataFrame) -> DataFrame:
    """Cases whose top1 lies where the other group's does: answerable ones at or under the greatest of the others, others at or over the least of these."""
    ends = gaps.agg(F.min(F.when(F.col("answerable"), F.col("top1"))).alias("lo"), F.max(F.when(~F.col("answerable"), F.col("top1"))).alias("hi"))
    return gaps.crossJoin(F.broadcast(ends)).where((F.col("answerable") & (F.col("top1") <= F.col("hi"))) | (~F.col("answerable") & (F.col("top1") >= F.col("lo")))).select("case_id", "answerable", "top1")
