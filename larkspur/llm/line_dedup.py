"""Boilerplate lines by site: a line on too large a share of a host's pages goes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.names import col, others, quoted, unused
from larkspur.llm.storage import table_bytes, write_table

#: ASCII white space at either end of a line does not tell lines apart.
BLANKS = " \t\x0b\x0c\r"


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading www; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS)) == ""


def _key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line, F.lit(BLANKS)))


def drop_boilerplate(df: DataFrame, *, host_col: str = "source", text_col: str = "text", max_ratio: float = 0.05, min_pages: int = 1, max_loss: float = 1.0, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """df with boilerplate lines out of text_col, and n_lines, n_dropped (long) added (they replace columns of these names, in any case).

    A line (trimmed; blank lines never count and always stay) is boilerplate of a host if more than max_ratio of the host's pages hold it. Pages are rows: a repeated row counts
    again, a line twice on a page counts once. A null host is a host of its own. Null text: null, 0 lines. Lines are told apart by 64-bit hashes.

    Two exemptions, both off by default: with min_pages, a line on fewer pages stays (2: one that stands on a single page, which repeats nothing however small the host is);
    with max_loss, a page that would lose more than this share of its lines that aren't blank stays whole (it is a copy of a whole
    document rather than a page in a frame, for the removal of duplicates to thin out).

    Only hashes of lines are shuffled, counted before the shuffle, so a host with a third of the rows makes no large
    task. A page has L distinct lines on average, so at most L / max_ratio lines of a host exceed the ratio:
    these per-host lists are broadcast if the whole table of them is under broadcast_bytes, else joined by
    a shuffle whose skewed partitions adaptive execution splits.
    """
    pages = df.select(col(host_col).alias("host"), F.array_distinct(F.transform(F.filter(_lines(col(text_col)), lambda x: ~_blank(x)), _key)).alias("lines"))
    # Host totals come with the line counts, as a null line of every page: one scan, one aggregation.
    every = F.concat(F.array(F.lit(None).cast("long")), F.coalesce("lines", F.array().cast("array<long>")))
    counts = pages.select("host", F.explode(every).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    counts = write_table(counts.where((F.col("pages") >= max(2, min_pages)) | F.col("line").isNull()) if min_pages > 1 else counts, "line-counts")
    totals = counts.where("line is null").select(F.col("host").alias("of"), F.col("pages").alias("total"))
    frequent = counts.where("line is not null").join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("pages") > F.lit(max_ratio) * F.col("total"))
    names = others(df.columns, ["n_lines", "n_dropped"])
    of, drop_col, lines, here, kept = unused([*names, "n_lines", "n_dropped"], "of", "drop", "lines", "here", "kept")
    drop = write_table(frequent.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias(drop_col)).withColumnRenamed("host", of), "boilerplate")
    drop = F.broadcast(drop) if table_bytes(drop) <= broadcast_bytes else drop
    joined = df.select(*map(quoted, names), _lines(col(text_col)).alias(lines)).join(drop, col(host_col).eqNullSafe(col(of)), "left")
    # The page's own lines among the host's, by hash: a few, to which each line is then held.
    joined = joined.withColumn(here, F.array_intersect(F.transform(F.col(lines), _key), F.col(drop_col)))
    clean = F.col(drop_col).isNull() | (F.size(here) <= 0)
    rest = F.when(clean, F.col(lines)).otherwise(F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col(here), _key(x))))
    cut = joined.withColumn(kept, rest)
    if max_loss < 1:
        full = F.size(F.filter(lines, lambda x: ~_blank(x)))
        cut = cut.withColumn(kept, F.when(clean | (F.size(lines) - F.size(kept) <= F.lit(max_loss) * full), F.col(kept)).otherwise(F.col(lines)))
    count = lambda x: F.when(F.col(lines).isNull(), 0).otherwise(x).cast("long")
    text = F.when(F.col(drop_col).isNull() | (F.size(kept) == F.size(lines)), col(text_col)).otherwise(F.array_join(kept, "\n"))
    return cut.select(*[text.alias(c) if c.lower() == text_col.lower() else col(c) for c in names], count(F.size(lines)).alias("n_lines"), count(F.size(lines) - F.size(kept)).alias("n_dropped"))
