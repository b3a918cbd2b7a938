"""The jobs as queries: each runs twice into one new folder and returns the whole output as it stands then. And the SQL that tells it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import feed_index, retrieval_report
from larkspur.plans.oracles import BOTH, DOCS, GOLD, fused, terms, windows
from larkspur.sources.shared import new_folder


def job1_feed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "feed_index")
    for _ in range(2):
        feed_index.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    postings = spark.read.parquet(f"{folder}/index/postings").select(F.explode("entries").alias("e")).groupBy(F.col("e.chunk_ord").alias("chunk_ord")).agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("e.tf").alias("n_occurrences"))
    # Digests, not texts, are joined.
    chunks = spark.read.parquet(f"{folder}/index/chunks").select("chunk_ord", "chunk_id", "source", "lang", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_terms")
    return chunks.join(postings, "chunk_ord", "left").select(*chunks.columns, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_distinct", "n_occurrences")])


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "retrieval_report")
    for _ in range(2):
        retrieval_report.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    summary = spark.read.parquet(f"{folder}/summary").select("mode", "recall_10", "mrr", "pool_recall")
    rows = spark.read.parquet(f"{folder}/outcomes").join(summary, "mode")
    return rows.select(F.col("mode").cast("string").alias("mode"), "qid", "rank", "pool_rank", "pool_rank_chunk", "recall_10", "mrr", "pool_recall")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_feed_index, job2_retrieval_report)}

_TERMS = terms("title || ' ' || text")
ORACLES = {
    "job1_feed_index": f"""WITH {DOCS}, {windows(300, 60)}, lang_of AS (SELECT doc_id AS doc_ord, lang FROM documents)
SELECT chunk_ord, chunk_id, d.source, l.lang, start, "end", md5(c.text) AS text_md5, len({_TERMS.replace("title", "c.title").replace("text)", "c.text)")})::BIGINT AS n_terms,
  len(list_distinct({_TERMS.replace("title", "c.title").replace("text)", "c.text)")}))::BIGINT AS n_distinct, len({_TERMS.replace("title", "c.title").replace("text)", "c.text)")})::BIGINT AS n_occurrences
FROM chunks c JOIN docs d USING (doc_ord) JOIN lang_of l USING (doc_ord)""",
    "job2_retrieval_report": f"""WITH {BOTH}, {fused(20)}, {GOLD},
found AS (SELECT 'bm25' AS mode, qid, chunk_ord, rank FROM lex WHERE rank <= 20 UNION ALL SELECT 'vector', qid, chunk_ord, rank FROM sem WHERE rank <= 20 UNION ALL SELECT 'hybrid', qid, chunk_ord, rank FROM pool),
best AS (SELECT mode, f.qid, min(CASE WHEN rank <= 10 THEN rank - 1 END) AS rank, min(rank - 1) AS pool_rank FROM found f JOIN gold_pairs g ON g.qid = f.qid AND g.doc_id = f.chunk_ord GROUP BY ALL),
outcomes AS (SELECT m.mode, q.qid, coalesce(b.rank, -1) AS rank, coalesce(b.pool_rank, -1) AS pool_rank FROM questions q CROSS JOIN (SELECT unnest(['bm25', 'vector', 'hybrid']) AS mode) m LEFT JOIN best b ON b.mode = m.mode AND b.qid = q.qid),
summary AS (SELECT mode, round(coalesce(avg((rank >= 0)::INT), 0), 6) AS recall_10, round(coalesce(avg(CASE WHEN rank >= 0 THEN 1.0::DOUBLE / (rank + 1) ELSE 0 END), 0), 6) AS mrr, round(coalesce(avg((pool_rank >= 0)::INT), 0), 6) AS pool_recall
  FROM outcomes WHERE qid IN (SELECT qid FROM gold_pairs) GROUP BY mode)
SELECT mode, qid, rank, pool_rank, pool_rank AS pool_rank_chunk, recall_10, mrr, pool_recall FROM outcomes JOIN summary USING (mode)""",
}
