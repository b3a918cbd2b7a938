"""Vector columns and deterministic test models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a bge-small-zh query starts with.
QUERY_PREFIX = "为这个句子生成表示以用于检索相关文章："


def dot(a: Column, b: Column) -> Column:
    """In double precision; an error if the dimensions differ, null if a side is null."""
    same = F.assert_true(F.size(a) == F.size(b), F.lit("dimension mismatch"))
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.when(same.isNull(), total))


def l2_normalize(v: Column) -> Column:
    """Of unit length, as floats; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(F.array(F.when(norm == 0, F.lit(1.0)).otherwise(norm)), lambda n: F.transform(v, lambda x: (x.cast("double") / n).cast("float")))[0]


def fake_embed(text: Column, dim: int = 64) -> Column:
    """A stand-in for a model: how many characters have each code modulo dim, of unit length. An Arrow batch at a time, as a model would be."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            counts = np.bincount(np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) % dim, minlength=dim).astype(float)
            out.append((counts / (np.sqrt((counts * counts).sum()) or 1.0)).astype(np.float32))
        return pd.Series(out, dtype=object)

    return run(text)


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: how many distinct non-blank characters of the query the text has."""
    chars = F.filter(F.array_distinct(F.split(query, "")), lambda c: c.rlike(r"(?U)\S"))
    return F.size(F.filter(chars, lambda c: F.contains(text, c))).cast("double")


def mulberry32(seed: int, i: Column) -> Column:
    """The number in [0, 1) that the 32-bit generator mulberry32 gives after i steps more than one, by its place alone: no state, any order."""
    mask = F.lit(0xFFFFFFFF)
    right = lambda x, n: F.shiftrightunsigned(x, n)

    def times(a: Column, b: Column) -> Column:
        """a * b modulo 2^32, without a product beyond 64 bits."""
        high = (a * right(b, 16)).bitwiseAND(F.lit(0xFFFF))
        return (F.shiftleft(high, 16) + a * b.bitwiseAND(F.lit(0xFFFF))).bitwiseAND(mask)

    low = F.lit(0x6D2B79F5)  # fixed value: the generator's step
    a = (F.lit(seed & 0xFFFFFFFF).cast("long") + times((i.cast("long") + 1).bitwiseAND(mask), low.cast("long"))).bitwiseAND(mask)
    return F.transform(F.array(a), lambda x: F.transform(F.array(times(x.bitwiseXOR(right(x, 15)), x.bitwiseOR(F.lit(1)))), lambda t: F.transform(F.array((t + times(t.bitwiseXOR(right(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask).bitwiseXOR(t)), lambda u: u.bitwiseXOR(right(u, 14)) / F.lit(4294967296.0))[0])[0])[0]
