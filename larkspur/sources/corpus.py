"""Corpora, gold sets, chunk files and vector stores in and out."""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import TAIL_HEADINGS, first_line, utrim
from larkspur.operators.ranks import ordinals
from larkspur.schema import CHUNK, GOLD

DEFAULT_FOLDERS = ("data/corpus", "data/corpus-wiki")


def parse_front_matter(raw: DataFrame) -> DataFrame:
    """(doc_ord, doc_id, raw) to documents. Header lines are split at their first colon (not in first place), the last of equal keys counts; without a header the text is raw, untrimmed."""
    header = F.regexp_extract("raw", r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n?", 1)
    whole = F.regexp_extract("raw", r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?", 0)
    found = F.length(whole) > 0
    pairs = F.filter(F.transform(F.split(header, "\n"), lambda x: F.struct(utrim(F.substring_index(x, ":", 1)).alias("k"), utrim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"), (F.instr(x, ":") > 1).alias("ok"))), lambda p: p["ok"])
    # A -1 index of an empty array would be an error: an extra null in front stands for "none".
    safe = lambda key: F.when(found, F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter("pairs", lambda p: p["k"] == key), lambda p: p["v"])), -1))
    body = F.when(found, utrim(F.expr("substring(raw, length(whole) + 1)"))).otherwise(F.col("raw"))
    rows = raw.withColumn("pairs", pairs).withColumn("whole", whole)
    return rows.select("doc_ord", "doc_id", F.coalesce(safe("title"), F.col("doc_id")).alias("title"), body.alias("text"), F.coalesce(safe("source"), F.lit("unknown")).alias("source"), F.coalesce(safe("license"), F.lit("unknown")).alias("license"))


def load_docs(spark: SparkSession, folders: list[str] | tuple[str, ...] = DEFAULT_FOLDERS) -> DataFrame:
    """Markdown documents of the folders in turn, by file name. Missing folders are skipped."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = []
    for k, folder in enumerate(folders):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(conf).exists(path):
            files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
            parts.append(files.select(F.lit(k).alias("k"), F.col("value").alias("raw"), F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1)).alias("doc_id")))
    if not parts:
        return spark.createDataFrame([], "doc_ord long, doc_id string, title string, text string, source string, license string")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    # Names alone are put in order; texts are read by the join, and lie in no one task.
    places = ordinals(rows.select("k", "doc_id"), "k", "doc_id", name="doc_ord")
    return parse_front_matter(rows.join(places, ["k", "doc_id"]))


def documents_as_docs(documents: DataFrame, *more: str) -> DataFrame:
    """The documents table as documents of the engine, with `more` columns of it: the title is the first line."""
    return documents.select(F.col("doc_id").alias("doc_ord"), F.col("doc_id").cast("string").alias("doc_id"), first_line(F.col("text")).alias("title"), "text", "source", F.lit("unknown").alias("license"), *more)


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Cases, one JSON object a line; blank lines are skipped."""
    source = "id STRING, question STRING, expect STRING, goldDocIds ARRAY<STRING>, mustContain ARRAY<STRING>, note STRING"
    rows = spark.read.schema(source).json(path).where("id is not null")
    return rows.select(F.col("id").alias("case_id"), "question", "expect", F.col("goldDocIds").alias("gold_doc_ids"), F.col("mustContain").alias("must_contain"), "note").to(spark.createDataFrame([], GOLD).schema)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).json(path)


def strip_tail(text: Column) -> Column:
    """An article's text up to its first closing section, if that isn't at the very start; trimmed."""
    at = F.regexp_instr(text, F.lit(r"\n(?U:\s)*(?:" + "|".join(TAIL_HEADINGS) + r")(?U:\s)*\n"))
    return utrim(F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text))


def slug(title: Column, i: Column) -> Column:
    """A file name: a three-digit number (longer ones stay whole), and the title without characters that file names can't have."""
    return F.concat(F.lit("wiki-"), F.lpad(i.cast("string"), F.greatest(F.lit(3), F.length(i.cast("string"))), F.lit("0")), F.lit("-"), F.regexp_replace(title, r'(?U)[/\\:*?"<>|\s]', "_"))


def ingest(articles: DataFrame, existing: DataFrame, least: int = 200) -> DataFrame:
    """(title, raw) not in existing (title), with status: missing (null), short (its text under `least` characters) or ok."""
    rows = articles.join(existing.select("title"), "title", "left_anti").withColumn("text", strip_tail(F.col("raw")))
    return rows.withColumn("status", F.when(F.coalesce(F.length("raw"), F.lit(0)) == 0, "missing").when(F.length("text") < least, "short").otherwise("ok"))


def ingest_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") != "ok").alias("n_miss"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.length("text"))), F.lit(0)).cast("long").alias("n_chars"))


def fetch_article(get: Callable[[str], tuple[int, dict, dict | None]], title: str, *, retries: int = 4, sleep: Callable[[float], None] = time.sleep, wait: float = 5.0) -> str | None:
    """An article's text by get(title) -> (status, headers, JSON). 429 and 5xx wait (Retry-After, else `wait` seconds and thrice as long each time); None if there is no such page."""
    for attempt in range(retries + 1):
        status, headers, body = get(title)
        if status == 429 or status >= 500:
            if attempt == retries:
                break
            told = str(headers.get("retry-after", ""))
            sleep(float(told) if told.replace(".", "", 1).isdigit() and float(told) > 0 else wait)
            wait *= 3
        elif status >= 400:
            break
        else:
            page = next(iter(((body or {}).get("query") or {}).get("pages") or []), None)
            return page.get("extract") if page and not page.get("missing") else None
    raise RuntimeError(f"HTTP {status}")


def article_url(title: str, api: str) -> str:
    """Asks a MediaWiki API for an article's text, without markup, redirects followed."""
    ask = {"action": "query", "format": "json", "formatversion": 2, "prop": "extracts", "explaintext": 1, "exsectionformat": "plain", "redirects": 1, "titles": title}
    return f"{api}?{urllib.parse.urlencode(ask, quote_via=urllib.parse.quote)}"


def http_get(api: str, agent: str, timeout: float = 30.0) -> Callable[[str], tuple[int, dict, dict | None]]:
    """A get for fetch_article over the network."""

    def get(title: str) -> tuple[int, dict, dict | None]:
        request = urllib.request.Request(article_url(title, api), headers={"User-Agent": agent})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status, {k.lower(): v for k, v in answer.headers.items()}, json.load(answer)
        except urllib.error.HTTPError as e:
            return e.code, {k.lower(): v for k, v in e.headers.items()}, None

    return get


def embed_todo(chunks: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector of this model."""
    return chunks.join(cache.where(F.col("model") == model).select("chunk_id"), "chunk_id", "left_anti")


def cache_compact(cache: DataFrame, chunks: DataFrame, model: str) -> DataFrame:
    """The vectors of this model for current chunks, with their order."""
    return cache.where(F.col("model") == model).join(chunks.select("chunk_id", "chunk_ord"), "chunk_id")


def vector_coverage(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """How many chunks there are, and how many have a vector."""
    have = vectors.select("chunk_id").distinct().withColumn("have", F.lit(1))
    return chunks.join(have, "chunk_id", "left").agg(F.count(F.lit(1)).alias("n_chunks"), F.count("have").alias("n_vectors"))


def pack_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """float32 vectors as base64 of little-endian bytes, bit for bit."""

    @F.pandas_udf("string")
    def pack(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode())

    return df.withColumn(column, pack(column))


def unpack_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    @F.pandas_udf("array<float>")
    def unpack(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else np.frombuffer(base64.b64decode(x), "<f4"))

    return df.withColumn(column, unpack(column))
