"""Measures retrieval by all routes over a corpus and a set of questions, as a report by route.

    python -m jobs.retrieval_report --documents FOLDER --questions FOLDER --out FOLDER [--config FILE]

Documents (Parquet: doc_id, text, source) are what is searched, questions (Parquet: item_id, text) what is asked; a document that holds a question's text is its gold. For
each route (bm25, vector, hybrid) the places of the first gold document among the hits and in the pool are written to out/outcomes, and the
metrics to out/summary, both partitioned by route. A run replaces the routes that it measures and leaves the others' files alone.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import config_of, logger, session
from larkspur.functions.vectors import fake_embed
from larkspur.operators import evaluate, lexical
from larkspur.operators.containment import find_contained
from larkspur.operators.frames import stacked, written
from larkspur.plans.pipeline import Retriever
from larkspur.sources import corpus

log = logger("retrieval_report")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode").parquet(path)


def run(spark: SparkSession, documents: str, questions: str, out: str, config: dict | None = None) -> dict[str, int]:
    """Writes (mode, qid, rank, pool_rank, pool_rank_chunk) to out/outcomes and a row of metrics for each mode to out/summary; -1 stands for no gold document.

    Null texts are found by no question; a question with a null text has no gold and no hits.
    """
    settings = config_of(__file__) | (config or {})
    table = spark.read.parquet(documents)
    docs = corpus.documents_as_docs(table)
    asked = spark.read.parquet(questions).select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    chunks = docs.select(F.col("doc_ord").alias("chunk_ord"), "doc_ord", F.col("doc_id").alias("chunk_id"), "doc_id", "title", "text", F.lit(0).alias("start"), F.lit(None).cast("string").alias("context"))
    embed = lambda c: fake_embed(c, settings["dim"])
    vectors = docs.select(F.col("doc_ord").alias("chunk_ord"), embed(F.col("text")).alias("embedding"))
    hits = find_contained(table.select("doc_id", "text"), asked, "doc_id").groupBy("qid").agg(F.array_sort(F.collect_list("doc_id")).alias("gold"))
    gold = written(asked.select("qid").join(hits, "qid", "left").select("qid", F.coalesce("gold", F.array().cast("array<long>")).alias("gold")))
    parts = []
    routes = Retriever(chunks, index=lexical.build_index(chunks), vectors=vectors, embed_query=embed, pool_size=settings["pool_size"], top_k=settings["top_k"])
    for mode, (pool, found) in routes.search_modes(asked, settings["modes"]).items():
        as_docs = lambda x: x.select("qid", F.col("chunk_ord").alias("doc_id"), "rank")
        outcomes = evaluate.case_outcomes(gold, as_docs(found), as_docs(pool))
        parts.append(outcomes.select(F.lit(mode).alias("mode"), "qid", *[F.col(c).cast("long").alias(c) for c in ("rank", "pool_rank", "pool_rank_chunk")]))
    _write(stacked(*parts), f"{out}/outcomes")
    rows = spark.read.parquet(f"{out}/outcomes").where(F.col("mode").isin(settings["modes"]))
    answerable = gold.where(F.size("gold") > 0)
    _write(stacked(*[evaluate.summarize(rows.where(F.col("mode") == m), answerable).select(F.lit(m).alias("mode"), "*") for m in settings["modes"]]), f"{out}/summary")
    report = {"documents": table.count(), "questions": gold.count(), "answerable": answerable.count(), "outcomes": rows.count()}
    log.info("read %(documents)d documents and %(questions)d questions, %(answerable)d of them answerable", report)
    log.info("wrote %d outcomes to %s/outcomes", report["outcomes"], out)
    for r in spark.read.parquet(f"{out}/summary").orderBy("mode").collect():
        log.info("%s", r.asDict())
    return report


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "questions", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    spark = session("retrieval_report")
    try:
        run(spark, args.documents, args.questions, args.out, config_of(__file__, args.config, spark))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
