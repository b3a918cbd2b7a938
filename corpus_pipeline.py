"""From raw documents to token ids in five stages, each on all that the one before kept.

Language ID rejects documents without a language and relabels the others; line dedup takes out site boilerplate; the shingle join leaves one
document of each group of near duplicates; mixing draws documents by raked weights, some more than once; BPE encodes what is left, and decodes it to see that nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, language_id, line_dedup, mixing, shingle_join
from larkspur.llm.registry import KEEP, LINE_PAGES, LINE_RATIO, tokenizer_path
from larkspur.llm.storage import write_table

#: A page that would lose more than this share of its lines is a copy of a document, not a page in a frame: it stays whole, for the next stage to judge.
LINE_LOSS = 0.5
#: A language is rejected below this share of the posterior.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or with no likely language; lang becomes the predicted one."""
    model = language_id.train(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    found = language_id.predict(docs, model).where((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= MIN_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines of each source out of the texts; n_chars follows."""
    return line_dedup.drop_boilerplate(docs, max_ratio=LINE_RATIO, min_pages=LINE_PAGES, max_loss=LINE_LOSS).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_join.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by their weights; one of a large weight is repeated, so that the sample has the shares it was raked to."""
    mixed = mixing.mix(docs.withColumn("topic", mixing.topic_of(F.col("text"))), keep=KEEP)
    return mixed.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and ids; an error if the ids of a text decode to another."""
    coded = bpe.encode(docs.select("doc_id", "source", "lang", "text"), tokenizer_path(), decoded=True)
    same = F.assert_true(F.col("decoded") == F.coalesce("text", F.lit("")), F.lit("ids decode to another text"))
    return coded.where(same.isNull()).select("doc_id", "source", "lang", "n_tokens", "ids")


STAGES = [
    ("language id", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", drop_near_duplicates),
    ("mixing to target weights", mix_sources),
    ("bpe encoding", encode_tokens),
]

#: SQL can express neither language ID nor BPE: tests/llm hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
