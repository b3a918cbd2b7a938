"""Documents to sentences and chunks. Offsets are in code points; a chunk's text is the document's from start to end."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import is_blank
from larkspur.schema import CHUNK_SHIFT

_SENTENCE = re.compile(r"[^。！？；\n]*[。！？；\n]+|[^。！？；\n]+\Z")
_HEADING = re.compile(r"#{1,6}\s")


def sentence_spans(docs: DataFrame) -> DataFrame:
    """(doc_ord, n, start, end, text): a run of terminators belongs to the sentence before it; blank sentences are left out, n counts the others. A document is a row, so nothing is shuffled."""

    @F.pandas_udf("array<struct<start: int, end: int, text: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in _sentences(t or "")])

    return docs.select("doc_ord", F.posexplode(run("text")).alias("n", "s")).select("doc_ord", "n", "s.start", "s.end", "s.text")


def _sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text) if m[0].strip("﻿ \t\r\n\x0b\x0c　\xa0").strip()]


def _pack(spans: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Neighbours joined while the whole stays within `most`; a longer one stands alone."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and b - out[-1][0] <= most:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def structure_of(text: str, most: int) -> list[list[int]]:
    """Spans that follow headings and blank lines; small neighbours are joined by length, large blocks packed by sentence."""
    begins, at = [0], 0
    for line in text.split("\n"):
        if at > begins[-1] and (_HEADING.match(line) or not line.strip()):
            begins.append(at)
        at += len(line) + 1
    out: list[list[int]] = []
    for a, b in zip(begins, [*begins[1:], len(text)], strict=True):
        if not text[a:b].strip():
            continue
        if b - a > most:
            out += _pack([(a + x, a + y) for x, y in _sentences(text[a:b])], most)
        elif out and out[-1][1] - out[-1][0] + b - a <= most:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def _spans(docs: DataFrame, of, columns: list[str]) -> DataFrame:
    """of(text): the spans of a text, as lists of ints named columns; an Arrow UDF, since each depends on the one before. A worker holds one text at a time as an object; spans are numbers in a buffer."""

    @F.arrow_udf("array<struct<" + ", ".join(f"{c}: int" for c in columns) + ">>")
    def run(texts: pa.Array) -> pa.Array:
        numbers, ends, width = array("i"), array("i", [0]), len(columns)
        for t in texts:
            for s in of(t.as_py() or ""):
                numbers.extend(s)
            ends.append(len(numbers) // width)
        table = np.frombuffer(numbers, np.int32).reshape(-1, width)
        spans = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(table[:, i])) for i in range(width)], names=columns)
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), spans)

    return docs.select("*", F.posexplode(run("text")).alias("n", "span"))


def _chunks(rows: DataFrame, start: Column, end: Column, context: Column, text: Column | None = None) -> DataFrame:
    """The columns of a chunk, of documents with a number n and a span; title_terms and lang, if documents have them, go along."""
    more = [c for c in ("title_terms", "lang") if c in rows.columns]
    return rows.select(*more, (F.shiftleft(F.col("doc_ord"), CHUNK_SHIFT) + F.col("n")).alias("chunk_ord"), F.concat("doc_id", F.lit("#"), F.col("n").cast("string")).alias("chunk_id"), "doc_id", F.col("n").cast("int").alias("n"), "title", (F.substring("text", start + 1, end - start) if text is None else text).alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"), "source", context.alias("context"))


def chunk_fixed(docs: DataFrame, size: int = 300, overlap: int = 60) -> DataFrame:
    """Windows of `size` characters, each beginning size - overlap after the last. The first blank window and all after it are left out."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive, and overlap at least 0 and less than size")
    stride = size - overlap
    # A text is cut once, into pieces of the stride; a window is some neighbouring pieces, so a long text costs what its length does.
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{stride}}}"), F.lit(0))
    rows = docs.withColumn("pieces", F.when(F.length("text") > 0, pieces).otherwise(F.array().cast("array<string>")))
    count = F.greatest(F.ceil((F.length("text") - size) / F.lit(stride)), F.lit(0)) + 1
    window = lambda i: F.substring(F.array_join(F.slice("pieces", i + 1, F.lit(-(-size // stride))), ""), 1, size)
    windows = F.when(F.size("pieces") > 0, F.transform(F.sequence(F.lit(0), (F.greatest(count, F.lit(1)) - 1).cast("int")), window)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("windows", windows)
    # Only a window without a character that isn't blank can end the chunking: most texts have none, so look for one first.
    some = F.col("text").rlike(rf"(?U)[\s\x{{FEFF}}]{{{min(size, 16)}}}|^[\s\x{{FEFF}}]|[\s\x{{FEFF}}]$")
    rows = rows.withColumn("blank", F.when(some, F.array_position(F.transform("windows", is_blank), F.lit(True)))).drop("pieces")
    rows = rows.withColumn("windows", F.when(F.col("blank") > 0, F.slice("windows", F.lit(1), (F.col("blank") - 1).cast("int"))).otherwise(F.col("windows")))
    # The outer form: for the other one Spark adds a filter on the array's size, and pushes it, with all that makes the array, below.
    rows = rows.select("*", F.posexplode_outer("windows").alias("n", "window")).where("n is not null").withColumn("at", F.col("n") * stride)
    return _chunks(rows, F.col("at"), F.col("at") + F.length("window"), F.lit(None).cast("string"), F.col("window"))


def chunk_structure(docs: DataFrame, most: int = 300) -> DataFrame:
    return _chunks(_spans(docs, lambda t: structure_of(t, most), ["start", "end"]), F.col("span.start"), F.col("span.end"), F.lit(None).cast("string"))


def chunk_parent_child(docs: DataFrame, child: int = 120, parent: int = 400) -> DataFrame:
    """Children of whole sentences within structure spans; the parent's text is the context."""

    def of(text: str) -> list[list[int]]:
        return [[a + x, a + y, a, b] for a, b in structure_of(text, parent) for x, y in _pack(_sentences(text[a:b]), child)]

    rows = _spans(docs, of, ["start", "end", "pstart", "pend"])
    return _chunks(rows, F.col("span.start"), F.col("span.end"), F.substring("text", F.col("span.pstart") + 1, F.col("span.pend") - F.col("span.pstart")))


def chunk_by(docs: DataFrame, strategy: str, *, size: int = 300, overlap: int = 60, child: int = 120, parent: int = 400) -> DataFrame:
    """strategy: fixed (no overlap), overlap, structure or parent-child."""
    plans = {"fixed": lambda: chunk_fixed(docs, size, 0), "overlap": lambda: chunk_fixed(docs, size, overlap), "structure": lambda: chunk_structure(docs, size), "parent-child": lambda: chunk_parent_child(docs, child, parent)}
    if strategy not in plans:
        raise ValueError(f"no strategy {strategy}")
    return plans[strategy]()


def chunk_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, characters, chunks, and the lengths' least, median, 90th percentile and greatest (items floor(n * p) of the sorted lengths)."""
    by_length = chunks.groupBy(F.length("text").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    n = F.sum("c").over(Window.partitionBy())
    ranked = by_length.withColumn("upto", F.sum("c").over(Window.orderBy("len"))).withColumn("n", n)
    item = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))), F.col("len")))
    lengths = ranked.agg(F.max("n").alias("n_chunks"), F.min("len").alias("min_len"), item(0.5).alias("p50_len"), item(0.9).alias("p90_len"), F.max("len").alias("max_len"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars")).join(lengths)


def chunk_faults(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose text isn't the document's between their offsets: none, if all is well."""
    d = docs.select("doc_id", F.col("text").alias("doc_text"))
    return chunks.join(d, "doc_id").where(F.col("text") != F.substring("doc_text", F.col("start") + 1, F.col("end") - F.col("start"))).select("chunk_ord")


def chunk_holes(chunks: DataFrame) -> DataFrame:
    """Chunks that begin after the one before has ended."""
    before = F.lag("end").over(Window.partitionBy("doc_id").orderBy("n"))
    return chunks.withColumn("before", F.coalesce(before, F.lit(0))).where("start > before").select("chunk_ord")
