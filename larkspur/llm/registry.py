"""The queries of this subpackage, and the SQL that tells their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat_format, embedding_dedup, language_id, line_dedup, lm_score, mixing, periodic_runs, quality_rules, shingle_join, token_file, vantage_trees
from larkspur.llm.storage import write_table
from larkspur.operators.frames import stacked

#: A line on more than this share of a source's pages, and on more than one of them, is boilerplate.
LINE_RATIO, LINE_PAGES = 0.05, 2
#: How often a document of weight 1 goes into the mix, on average.
KEEP = 0.8


def tokenizer_path() -> str:
    """Where the installed vocabulary of public tokenizers keeps the byte-level BPE file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    weights = quality_rules.ratio_weights(docs, quality_rules.trusted_sample(_read(spark, sf_dir, "labels")))
    return quality_rules.rate(docs.select("doc_id", "text"), weights).drop("text")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = language_id.train(docs.where(~held_out))
    rows = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return language_id.predict(rows, model, keep=["doc_id", "held_out"])


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shingle_join.link_documents(_read(spark, sf_dir, "documents"))
    return rows.withColumnRenamed("id", "doc_id")


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = token_file.write_token_file(_read(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return token_file.read_token_file(file, digests=True)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.dedup(_read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), "text")
    return mixing.mix(docs, keep=KEEP).drop("text").withColumn("weight", F.round("weight", 6)).withColumn("probability", F.round("probability", 6))


def _op6_sql(rounds: int = 24) -> str:
    """As many rounds as leave no weight of the driver's tables to move."""
    steps, at = [], "cells0"
    for k in range(rounds):
        for d in mixing.DIMENSIONS:
            to = f"{d}{k + 1}"
            steps.append(f"{to} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * coalesce(t.share, 0) * (SELECT sum(tokens) FROM cells0) / sum(c.weight) OVER (PARTITION BY c.{d}) AS weight FROM {at} c JOIN target_{d} t ON t.value = c.{d})")
            at = to
    targets = [f"target_{d} AS MATERIALIZED (SELECT value, mass / sum(mass) OVER () AS share FROM (SELECT {d} AS value, pow(sum(tokens), 0.5) AS mass FROM cells0 GROUP BY {d}))" for d in mixing.DIMENSIONS]
    has = lambda mark: f"contains(lower(text), '{mark}')"
    topic = " ".join(f"WHEN {' OR '.join(map(has, marks))} THEN '{name}'" for name, marks in mixing.MARKERS)
    return (
        rf"""WITH docs AS MATERIALIZED (SELECT doc_id, source, lang, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens,
  CASE {topic} WHEN regexp_matches(text, '[0-9]') THEN 'numeric' ELSE 'prose' END AS topic, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
  FROM documents),
cells0 AS MATERIALIZED (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight FROM docs GROUP BY ALL),
"""
        + ",\n".join([*targets, *steps])
        + f""",
drawn AS (SELECT *, {KEEP}::DOUBLE * w AS times FROM (SELECT d.*, CASE WHEN c.tokens > 0 THEN c.weight / c.tokens ELSE 0 END AS w FROM docs d JOIN {at} c
  ON coalesce(d.source, '') = c.source AND coalesce(d.lang, '') = c.lang AND d.topic = c.topic))
SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(w, 6) AS weight, round(least(1, times), 6) AS probability,
  (floor(times) + (draw < times - floor(times))::INT)::BIGINT AS copies, floor(times) + (draw < times - floor(times))::INT > 0 AS sampled FROM drawn"""
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, max_ratio=LINE_RATIO, min_pages=LINE_PAGES)


OP7_SQL = f"""
WITH pages AS MATERIALIZED (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
lines AS (SELECT page, source, i, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages)),
hosts AS (SELECT source, count(*) AS total FROM pages GROUP BY source),
boiler AS (SELECT p.source, p.t FROM (SELECT source, t, count(DISTINCT page) AS pages FROM lines WHERE t <> '' GROUP BY source, t) p
  JOIN hosts h ON p.source IS NOT DISTINCT FROM h.source WHERE p.pages >= {LINE_PAGES} AND p.pages > {LINE_RATIO}::DOUBLE * h.total),
marked AS (SELECT l.*, b.t IS NOT NULL AS gone FROM lines l LEFT JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.t = b.t),
folded AS (SELECT page, string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i) AS text, count(*) AS n_lines,
  count(*) FILTER (WHERE gone) AS n_dropped FROM marked GROUP BY page)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(f.text, '') END AS text, coalesce(f.n_lines, 0)::BIGINT AS n_lines,
  coalesce(f.n_dropped, 0)::BIGINT AS n_dropped
FROM pages d LEFT JOIN folded f ON d.page = f.page
"""


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    # A conversation that was streamed, and whose answer was generated anew, then edited and streamed on.
    user = [(-7, 0, 0, "start", "user", "</s>[INST] "), (-7, 1, 0, "delta", "user", "ok [/INST]")]
    first = [(-7, 2, 1, "start", "assistant", "no"), (-7, 3, 1, "regenerate", "assistant", ""), (-7, 4, 1, "delta", "assistant", "no, ")]
    log = [*user, *first, (-7, 5, 1, "edit", "assistant", "</s>[INST] ok"), (-7, 6, 1, "delta", "assistant", " [/INST]")]
    streamed = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string")
    return chat_format.digests(write_table(chat_format.format_chats(stacked(chat_format.streamed_events(rows), streamed, by_name=True)), "chats"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    model = lm_score.train(docs.where(~held_out))
    return lm_score.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), ids=False, digests=True).drop("text")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = vantage_trees.build_index(vectors)
    return vantage_trees.search(index, vectors.where(F.col("vec_id") % 50 == 0), 5, factor=vantage_trees.fit_factor(index, 5))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda x: x != "")
    docs = docs.withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.greatest(F.size("words"), F.lit(0)).cast("long"))
    a = F.when(F.col("n") > 0, g % F.col("n")).cast("int")
    docs = docs.withColumn("a", a).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    # From word a on, words a .. a + p - 1 again and again.
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times)), F.lit(1), (F.col("n") - F.col("a")).cast("int"))
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    rows = periodic_runs.find_runs(docs.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    rows = rows.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))
    run = rows.select("*", F.col("longest.start").alias("start"), (-F.col("longest.less")).alias("length"), F.col("longest.period").alias("period"))
    return run.select("doc_id", "n_words", "n_runs", "start", "length", "period", F.floor(1000 * F.col("length") / F.col("period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_shingle_join, op4_token_file, op5_embedding_dedup, op6_mixing, op7_line_dedup, op8_chat_format, op9_lm_score, op10_bpe, op11_nearest_neighbours, op12_periodic_runs, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": _op6_sql(), "op7_line_dedup": OP7_SQL}
