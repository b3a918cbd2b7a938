"""Which strings stand in which texts, by equi joins alone, whatever the number of strings.

A string of L characters is known by L and its first and last windows of 2^j characters, the largest power of two within L, which overlap or meet. A place of a text where a string may begin has a
first window, and so many characters on a last one, that are among those of strings, and both together are too: bitmaps of bounded size that every worker has tell this, and let few others through. What is left is
a row for each text and string, not for each place, and is joined with the strings. Windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.frames import written

#: Characters of texts that are hashed at once; places and lengths that are held against each other at once; bits of the bitmap at most (32 MB) and for each hash.
CHARS, CELLS, BITS, SPARSE = 1 << 16, 1 << 18, 1 << 28, 64
#: Which bits of a hash say where its bits in the bitmap are. A place that is let through by chance is held against all lengths of a level, so there are few.
SHIFTS = (0, 18, 36)
#: Bits in a bucket of Spark's bitmap functions.
BUCKET = 32768


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(chars: np.ndarray, levels: int) -> Iterator[np.ndarray]:
    """For each j below levels: a hash of the 2^j characters from each place on. A window is hashed from its halves; places too near the end are left out."""
    h = _mix(chars.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for j in range(levels):
        yield h
        half = 1 << j
        if len(h) <= half:
            return
        h = _mix(h[:-half] * np.uint64(0x9FB21C651E98DF25) + (h[half:] ^ np.uint64(j + 1)))


def _characters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _both(a: np.ndarray, b: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """A hash of strings of n characters, from those of their first and last windows."""
    return _mix(a * np.uint64(0x9FB21C651E98DF25) + _mix(b + np.asarray(n, np.uint64)))


def _string_ends(strings: DataFrame) -> DataFrame:
    """(qid, n, a, b, g) of strings (qid, string): how many characters, hashes of the first and the last window, and of both; zeros for the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b = [], [], []
            for string in batch.column("string").to_pylist():
                h, size = np.zeros(1, np.uint64), len(string)
                if size:
                    *_, h = window_hashes(_characters(string), size.bit_length())
                n.append(size)
                a.append(h[0])
                b.append(h[-1])
            n, a, b = np.array(n, np.int64), np.array(a, np.uint64), np.array(b, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), *[pa.array(x.view(np.int64)) for x in (n, a, b, _both(a, b, n))]], names=["qid", "n", "a", "b", "g"])

    return strings.select("qid", "string").mapInArrow(run, "qid long, n long, a long, b long, g long")


def _bitmap(ends: DataFrame) -> tuple[np.ndarray, int, list[int]]:
    """Bytes of a bitmap with some bits (SHIFTS) for each hash of the strings' ends, how many bits it has, and the lengths there are: at most BITS, however many strings."""
    lengths = sorted(r[0] for r in ends.select("n").distinct().collect())
    hashes = ends.where("n > 0").select(F.explode(F.array("a", "b", "g")).alias("h")).distinct()
    n = hashes.count()
    bits = BUCKET
    while bits < min(BITS, SPARSE * n):
        bits *= 2
    parts = F.explode(F.array(*[F.shiftrightunsigned("h", s) for s in SHIFTS]))
    bit = F.pmod("h", F.lit(bits)) + 1
    rows = hashes.select(parts.alias("h")).select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for bucket, part in rows.toLocalIterator():
        out[(bucket - 1) * BUCKET // 8 : bucket * BUCKET // 8] = np.frombuffer(bytes(part), np.uint8)
    return out, bits, lengths


def _text_ends(texts: DataFrame, key: str, bitmap: np.ndarray, bits: int, lengths: list[int]) -> DataFrame:
    """(key, n, a, b), once for a text, of the places of texts that the bitmap lets through."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)
    of_level = {j: np.array([n for n in lengths if n.bit_length() - 1 == j], np.int64) for j in {n.bit_length() - 1 for n in lengths if n}}
    empty, top = 0 in lengths, max(of_level, default=-1)
    mask = np.uint64(bits - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value

        def through(h: np.ndarray) -> np.ndarray:
            """The places of the hashes that all their bits let through."""
            at = None
            for s in SHIFTS:
                bit = (h if at is None else h[at]) >> np.uint64(s) & mask
                hit = np.flatnonzero(bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                at = hit if at is None else at[hit]
            return at

        def rows(ids: list, texts: list[str]) -> pa.RecordBatch:
            parts = [_characters(t) for t in texts]
            sizes = np.array([len(p) for p in parts], np.int64)
            ends = np.cumsum(sizes)
            chars, text = np.concatenate(parts), np.repeat(np.arange(len(parts)), sizes)
            found = [(np.arange(len(parts)), *[np.zeros(len(parts), x) for x in (np.int64, np.uint64, np.uint64)])] if empty else []
            for j, h in enumerate(window_hashes(chars, top + 1)):
                if j not in of_level:
                    continue
                begins, sizes_here = through(h), of_level[j]
                step = max(1, CELLS // len(sizes_here))
                for k in range(0, len(begins), step):
                    at = begins[k : k + step]
                    i, m = np.nonzero(at[:, None] + sizes_here <= ends[text[at]][:, None])
                    at, n = at[i], sizes_here[m]
                    last = h[at + n - (1 << j)]
                    keep = through(last)
                    at, n, last = at[keep], n[keep], last[keep]
                    first = h[at]
                    g = _both(first, last, n)
                    keep = through(g)
                    keep = keep[np.argsort(g[keep], kind="stable")]
                    of, g = text[at[keep]], g[keep]
                    # A string's first place in a text decides.
                    new = np.r_[True, (g[1:] != g[:-1]) | (of[1:] != of[:-1])][: len(g)]
                    keep = keep[new]
                    found.append((of[new], n[keep], first[keep], last[keep]))
            of, n, a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(ids, kind_of).take(pa.array(of)), *[pa.array(x.view(np.int64)) for x in (n, a, b)]], names=[key, "n", "a", "b"])

        for b in batches:
            kind_of = b.schema.field(0).type
            ids, held, size = [], [], 0
            for i in range(b.num_rows):
                text = b.column(1)[i].as_py()
                if text is None:
                    continue
                if held and size + len(text) > CHARS:
                    yield rows(ids, held)
                    ids, held, size = [], [], 0
                ids.append(b.column(0)[i].as_py())
                held.append(text)
                size += len(text)
            if held:
                yield rows(ids, held)

    kind = texts.schema[key].dataType.simpleString()
    return texts.where(F.col(key).isNotNull()).select(key, "text").mapInArrow(run, f"{key} {kind}, n long, a long, b long")


def find_contained(texts: DataFrame, strings: DataFrame, key: str) -> DataFrame:
    """(qid, key), once each, for each string (qid, query) that stands in a text (key, text); the empty string stands in every text, null in none. Texts with a null key are left out; keys tell texts apart.

    All joins are on equal keys, of rows that have passed the bitmap, at most one (but for hashes of the same bits) for a text and a string that it holds; texts are read once and never shuffled.
    """
    ends = written(_string_ends(strings.where(F.col("query").isNotNull()).select(F.col("qid").cast("long").alias("qid"), F.col("query").alias("string"))))
    found = _text_ends(texts, key, *_bitmap(ends))
    return found.join(ends.select("qid", "n", "a", "b"), ["n", "a", "b"]).select("qid", key).distinct()
