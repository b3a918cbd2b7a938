"""Quality rules: counts of a text, then its hashed n-gram log-likelihood ratio. DataFrame functions only.

Words are `[^\\x20\\x09-\\x0D]+`. The ratio compares two multinomials over hashed unigrams and bigrams: one of trusted
documents, one of the whole raw corpus. A document's score is the mean of log(p_trusted / p_raw) over its n-grams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.names import col, others, quoted, unused

BLANKS = " \t\n\x0b\x0c\r"
BUCKETS = 1 << 16
SMOOTHING = 1.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is computed once (an outer expression in a lambda would be computed for each element)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def ngram_buckets(hashes: Column) -> Column:
    """Buckets of the unigrams and bigrams of a text's word hashes."""
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    pairs = F.transform(F.sequence(F.lit(1), F.size(hashes) - 1), lambda i: bucket(F.xxhash64(hashes[i - 1], hashes[i])))
    return F.concat(F.transform(hashes, bucket), F.when(F.size(hashes) > 1, pairs).otherwise(F.array().cast("array<int>")))


def repeat_words(hashes: Column, n: int = 5) -> Column:
    """Words in n-word windows found twice or more (windows by 64-bit hash)."""
    made = F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[hashes[i + k] for k in range(n)]))

    def covered(s: Column) -> Column:
        # s: windows sorted by (hash, position); those whose neighbour has the same hash occur again.
        again = F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"])) | ((i < F.size(s) - 1) & (s[F.least(i + 1, F.size(s) - 1)]["h"] == x["h"])))
        at = F.sort_array(F.transform(again, lambda x: x["p"]))
        return let(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i == F.size(p) - 1, F.lit(n)).otherwise(F.least(F.lit(n), p[F.least(i + 1, F.size(p) - 1)] - x))), F.lit(0), lambda a, x: a + x))

    def count(w: Column) -> Column:
        # Few texts repeat a window: sorting plain longs and comparing sizes finds out cheaply.
        full = let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), covered)
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(full)

    return F.when(F.size(hashes) < n, F.lit(0)).otherwise(let(made, count)).cast("long")


def word_hashes(words: Column) -> Column:
    """64-bit hashes of words."""
    return F.transform(words, lambda w: F.xxhash64(w))


def ratio_weights(df: DataFrame, trusted_ids: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, `weights`: per bucket, log(p_trusted / p_raw), add-one smoothed. trusted_ids: one bounded column `id`.

    Counts cover all rows. Each task sums its n-grams into at most BUCKETS rows before the shuffle. No trusted
    or no raw n-grams at all give weights of 0, which pass every document.
    """
    marked = df.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(trusted_ids.select("id").distinct().withColumn("t", F.lit(1))), "id", "left")
    hashed = marked.withColumn("words", words(F.col("text"))).withColumn("hashes", word_hashes(F.col("words")))
    grams = hashed.select(F.coalesce("t", F.lit(0)).alias("t"), F.explode(ngram_buckets(F.col("hashes"))).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("trusted"))
    every = df.sparkSession.range(0, BUCKETS, 1, 1).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("trusted", F.lit(0)).alias("trusted"))
    one = every.agg(F.sum("raw").alias("n_raw"), F.sum("trusted").alias("n_trusted"), F.array_sort(F.collect_list(F.struct("bucket", "raw", "trusted"))).alias("by"))
    w = lambda x: F.log((x["trusted"] + SMOOTHING) / (F.col("n_trusted") + SMOOTHING * BUCKETS)) - F.log((x["raw"] + SMOOTHING) / (F.col("n_raw") + SMOOTHING * BUCKETS))
    return one.select(F.transform("by", lambda x: F.when((F.col("n_trusted") == 0) | (F.col("n_raw") == 0), F.lit(0.0)).otherwise(w(x))).alias("weights"))


def trusted_sample(labels: DataFrame, *, id_col: str = "doc_id", most: int = 20_000) -> DataFrame:
    """Ids (`id`) of about `most` documents (the bound of what is broadcast) of good quality and not toxic, drawn by a hash of the id. Conflicting labels: not trusted."""
    by = labels.where(col(id_col).isNotNull()).groupBy(col(id_col).alias("id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x"))
    good = by.where("q = 1 and coalesce(x, 0) = 0").select("id")
    share = min(1.0, most / max(1, good.count()))
    return good.where(F.pmod(F.xxhash64("id", F.lit("trusted")), F.lit(1 << 62)) < int(share * (1 << 62)))


def rate(df: DataFrame, weights: DataFrame, *, text_col: str = "text", min_words: int = 10, max_repeat: float = 0.2, min_score: float = -0.2) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept added (columns of these names, in any case, are replaced).

    n_dup_lines: lines with a word that equal an earlier line. base_failed: fewer than min_words words, or more than max_repeat of them repeated.
    kept: not base_failed, and score >= min_score. Null and blank texts: all counts 0, base_failed, score 0. Row by row, so repeated rows agree.
    """
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    names = others(df.columns, new)
    raw, split, hashed, table = unused([*names, *new], "raw", "split", "hashed", "table")
    text = F.coalesce(F.col(raw), F.lit(""))
    # A scalar subquery: the optimizer moves it into the expression that reads it, so the array isn't copied to rows.
    rows = df.select(*map(quoted, names), col(text_col).alias(raw)).withColumn(split, words(F.col(raw))).withColumn(hashed, word_hashes(F.col(split))).withColumn(table, weights.scalar())
    filled = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    buckets = ngram_buckets(F.col(hashed))
    score = F.when(F.size(split) == 0, F.lit(0.0)).otherwise(F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.col(table)[b]) / (2 * F.size(split) - 1))
    counted = rows.select(
        *map(quoted, names),
        F.size(split).cast("long").alias("n_words"),
        F.length(F.array_join(split, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]++", "")).cast("long").alias("n_symbols"),
        let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col(hashed)).alias("n_repeat_words"),
        score.alias("score"),
    )
    failed = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(round(100 * max_repeat)) * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= min_score))
