"""An inverted index that is stored once, grows by batches and is searched often, with bounds that tell which postings need no reading.

Postings lie in rows of some hundred (blocks), partitioned by batch and by a hash of the term. A block holds postings of one term in one cell: alike in frequency and in the chunk's
length, so its greatest frequency and least length bound what each of them adds to a score, whatever later batches make of the averages. A search
scores the chunks of a question's most promising cells, leaves out as many cells as can't by themselves lift a chunk to the k-th of these scores, and looks
their terms up for the few chunks that may still get there. The texts are never opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.text import tokens
from larkspur.operators.frames import stacked, written
from larkspur.operators.lexical import DIGITS, HELD, best_of, idf, question_terms, rank, terms_of

#: Partitions by term, chunks of a batch that share a block number (about), and questions' terms whose bounds may be broadcast.
BUCKETS, BLOCK, WANTED = 32, 4096, 20_000
#: Postings of a term with one number that aren't told apart by cell; numbers in a task that makes or scores their blocks, about; rows of lookups that may be broadcast.
RARE, NUMBERS, ASKED = 16, 8, 200_000
#: Questions, on the average, that ask for a posting where all are scored in one pass, and terms of questions that such a pass may take to the tasks.
PASSED, SHARED = 200_000, 2
#: Postings that the first look takes, for each place of the ranking; what rounding may add to a score.
SEEDS, SLACK = 8, 10.0 ** (1 - DIGITS)


@dataclass(frozen=True)
class StoredIndex:
    """blocks: (batch, bucket, term, cell, subs, sub, n, max_tf, min_len, entries); chunks: those of all batches, with n_terms."""

    blocks: DataFrame
    chunks: DataFrame
    k1: float = 1.5
    b: float = 0.75


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _sub(chunk: Column, subs: Column) -> Column:
    return F.pmod(F.xxhash64(chunk, F.lit("sub")), subs.cast("long")).cast("int")


def _by_number(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each number (the first column), which come one after the other: a task holds one number's."""
    now, held = None, []
    for b in batches:
        number = b.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), b.num_rows] if b.num_rows else [0]
        for i, j in zip(cuts, cuts[1:]):
            if number[i] != now:
                if held:
                    yield held
                now, held = number[i], []
            held.append(b.slice(i, j - i))
    if held:
        yield held


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of chunks (sub, chunk_ord, terms), in order of their numbers."""
    for held in _by_number(batches):
        yield from _blocks_of(held)


def _blocks_of(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(held).combine_chunks()
    sub, keys, terms = t.column(0)[0].as_py(), t.column(1).combine_chunks(), t.column(2).combine_chunks()
    size = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    coded = terms.flatten().dictionary_encode()
    if not len(coded):
        return
    width = len(coded.dictionary)
    code, tf = np.unique(np.repeat(np.arange(len(size)), size) * width + coded.indices.to_numpy(), return_counts=True)
    row, term = np.divmod(code, width)
    cell = np.minimum(tf, 15) * 64 + np.minimum(np.floor(2 * np.log2(size[row])), 63).astype(np.int64)
    cell = np.where(np.bincount(term, minlength=width)[term] <= RARE, -1, cell)
    place = np.empty(len(keys), np.int64)
    place[pc.sort_indices(keys).to_numpy()] = np.arange(len(keys))
    order = np.lexsort((place[row], cell, term))
    row, term, cell, tf = row[order], term[order], cell[order], tf[order].astype(np.int32)
    length = size[row].astype(np.int32)
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (cell[1:] != cell[:-1])])
    ends = np.r_[first, len(row)].astype(np.int32)
    entries = pa.StructArray.from_arrays([keys.take(pa.array(row)), pa.array(tf), pa.array(length)], names=["chunk_ord", "tf", "len"])
    made = [pa.array(np.full(len(first), sub, np.int32)), coded.dictionary.take(pa.array(term[first])), pa.array(cell[first].astype(np.int32)), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(length, first)), pa.ListArray.from_arrays(pa.array(ends), entries)]
    whole = pa.RecordBatch.from_arrays(made, names=["sub", "term", "cell", "n", "max_tf", "min_len", "entries"])
    for at in range(0, whole.num_rows, 8192):
        yield whole.slice(at, 8192)


def append(chunks: DataFrame, path: str, batch: int, *, tokenize=tokens, by: tuple[str, ...] = ()) -> None:
    """Adds a batch of chunks (chunk_ord, title, text, ...) that no other batch has. Repeated, it replaces what it wrote. Chunks may be partitioned `by` columns.

    Chunks are dealt by number, as texts, and a number's terms and blocks are made where its chunks are: no term and no posting is shuffled. So one term in every chunk makes many blocks, not a large one.
    Postings are written before chunks, and only batches with chunks are read, so a batch that was cut off counts for nothing.
    """
    subs = max(1, -(-chunks.count() // BLOCK))
    tasks = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), subs // NUMBERS)
    dealt = chunks.select(_sub(F.col("chunk_ord"), F.lit(subs)).alias("sub"), "chunk_ord", "title_terms" if "title_terms" in chunks.columns else "title", "text").repartition(tasks, "sub").sortWithinPartitions("sub")
    dealt = dealt.select("sub", "chunk_ord", terms_of(dealt, tokenize).alias("terms"))
    key = chunks.schema["chunk_ord"].dataType.simpleString()
    blocks = dealt.mapInArrow(_made, f"sub int, term string, cell int, n int, max_tf int, min_len int, entries array<struct<chunk_ord: {key}, tf: int, len: int>>")
    blocks = blocks.select(_bucket(F.col("term")).alias("bucket"), "term", "cell", F.lit(subs).cast("int").alias("subs"), "sub", "n", "max_tf", "min_len", "entries")
    blocks.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    counted = chunks.withColumn("n_terms", F.size(terms_of(chunks, tokenize)).cast("long")).drop("title_terms")
    counted.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/chunks/batch={batch}")


def read(spark: SparkSession, path: str, *, k1: float = 1.5, b: float = 0.75) -> StoredIndex:
    chunks = spark.read.parquet(f"{path}/chunks")
    whole = chunks.select("batch").distinct()
    return StoredIndex(spark.read.parquet(f"{path}/postings").join(F.broadcast(whole), "batch", "left_semi"), chunks, k1, b)


def _gain(index: StoredIndex, tf: Column, length: Column) -> Column:
    """What a posting adds to a score: grows with tf, falls with the length. Of rows with idf and avgdl."""
    norm = index.k1 * (1 - index.b + index.b * length / F.when(F.col("avgdl") == 0, F.lit(1.0)).otherwise(F.col("avgdl")))
    return F.col("idf") * tf * (index.k1 + 1) / (tf + norm)


def bounds(index: StoredIndex, questions: DataFrame, tokenize=tokens) -> DataFrame:
    """(qid, bucket, term, cell, n, idf, avgdl, ub, term_ub, all_ub, before) for each cell with postings of a question's term: how many these are, and bounds of what one of them, one of the
    term's and one of each term's adds. before: the postings of the question's cells with larger bounds. Read from the heads of blocks: no entries, no other terms' buckets.
    """
    wanted = question_terms(questions, tokenize).select("qid", "pos", "term", _bucket(F.col("term")).alias("bucket"))
    # Partitions are pruned by the other side of a join only if that has a filter: this one holds always.
    terms = wanted.select("bucket", "term").where("bucket >= 0").distinct()
    heads = index.blocks.select("bucket", "term", "cell", "n", "max_tf", "min_len").join(F.broadcast(terms) if wanted.limit(WANTED + 1).count() <= WANTED else terms, ["bucket", "term"])
    cells = heads.groupBy("bucket", "term", "cell").agg(F.sum("n").alias("n"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
    stats = index.chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.avg("n_terms"), F.lit(0.0)).alias("avgdl"))
    cells = cells.withColumn("df", F.sum("n").over(Window.partitionBy("bucket", "term"))).crossJoin(F.broadcast(stats)).withColumn("idf", idf(F.col("chunks"), F.col("df")))
    rows = wanted.join(cells, ["bucket", "term"]).withColumn("ub", _gain(index, F.col("max_tf"), F.col("min_len")))
    of_term = Window.partitionBy("qid", "term").orderBy(F.desc("ub"), "cell")
    rows = rows.withColumn("place", F.row_number().over(of_term)).withColumn("term_ub", F.first("ub").over(of_term))
    of = Window.partitionBy("qid")
    before = F.sum("n").over(of.orderBy(F.desc("ub"), "pos", "cell").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("all_ub", F.sum(F.when(F.col("place") == 1, F.col("ub"))).over(of)).withColumn("before", F.coalesce(before, F.lit(0)))
    return rows.select("qid", "bucket", "term", "cell", "n", "idf", "avgdl", "ub", "term_ub", "all_ub", "before")


def _postings(index: StoredIndex, cells: DataFrame, few: bool, *more: str) -> DataFrame:
    """(qid, term, chunk_ord, gain, ...) of every posting of these cells."""
    cells = cells.select("qid", "bucket", "term", "cell", "idf", "avgdl", *more)
    rows = index.blocks.select("bucket", "term", "cell", "entries").join(F.broadcast(cells) if few else cells, ["bucket", "term", "cell"])
    rows = rows.select("qid", "term", "idf", "avgdl", *more, F.explode("entries").alias("e"))
    return rows.select("qid", "term", F.col("e.chunk_ord").alias("chunk_ord"), _gain(index, F.col("e.tf"), F.col("e.len")).alias("gain"), *more)


def _passed(index: StoredIndex, cells: DataFrame, k: int) -> DataFrame:
    """(qid, chunk_ord, score): of each block number the k best chunks of each question, by all postings of its terms.

    Blocks of wanted terms are shuffled by number, each once, however many questions ask for it; as a number has its chunks whole, no gain leaves the task.
    """
    asked = cells.select("qid", "term", "idf", "avgdl").distinct().toArrow().combine_chunks()
    qids, owner = np.unique(asked.column("qid").to_numpy(), return_inverse=True)
    coded = pa.chunked_array(asked.column("term").chunks, pa.string()).combine_chunks().dictionary_encode()
    terms, of, width = coded.dictionary, coded.indices.to_numpy(), len(qids)
    weight = np.zeros(len(terms))
    weight[of] = asked.column("idf").to_numpy() * (index.k1 + 1)
    average = (float(asked.column("avgdl")[0].as_py()) if len(of) else 0.0) or 1.0
    questions, count = owner[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(terms))
    first, k1, b_, keep = np.cumsum(count) - count, index.k1, index.b, best_of(k, qids)

    def score(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).combine_chunks()
        keys, tf, length = (t.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "tf", "len"))
        term = np.repeat(pc.index_in(t.column("term").combine_chunks(), value_set=terms).to_numpy(), pc.list_value_length(t.column("keys").combine_chunks()).to_numpy()).astype(np.int64)
        chunks, row = np.unique(keys, return_inverse=True)
        order = np.argsort(row, kind="stable")
        row, term, tf, length = row[order], term[order], tf[order], length[order]
        gain = weight[term] * tf / (tf + k1 * (1 - b_ + b_ * length / average))
        step = max(1, min(512, HELD // max(1, width)))
        for at in range(0, len(chunks), step):
            i, j = np.searchsorted(row, [at, at + step])
            each, block = count[term[i:j]], chunks[at : at + step]
            inside = np.repeat(first[term[i:j]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            scores = np.bincount(np.repeat(row[i:j] - at, each) * width + questions[inside], np.repeat(gain[i:j], each), len(block) * width).reshape(len(block), width)
            made = keep(block, scores)
            if made is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["qid", "chunk_ord", "score"])

    def best(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pa.Table.from_batches(list(score(held)), pa.schema({"qid": pa.int64(), "chunk_ord": pa.int64(), "score": pa.float64()})).sort_by([("qid", "ascending"), ("score", "descending"), ("chunk_ord", "ascending")])
        qid = parts.column("qid").to_numpy()
        yield from parts.filter(pa.array(np.arange(len(qid)) - np.searchsorted(qid, qid) < k)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_number(batches):
            yield from best(held)

    wanted = cells.select("bucket", "term").where("bucket >= 0").distinct()
    blocks = index.blocks.select("batch", "sub", "bucket", "term", "entries").join(F.broadcast(wanted), ["bucket", "term"], "left_semi")
    numbers = index.blocks.select("batch", "subs").distinct().agg(F.coalesce(F.sum("subs"), F.lit(0))).first()[0]
    tasks = max(int(index.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), numbers // NUMBERS)
    rows = blocks.select(F.concat_ws("-", "batch", "sub").alias("number"), "term", F.col("entries.chunk_ord").alias("keys"), F.col("entries.tf").alias("tf"), F.col("entries.len").alias("len"))
    return rows.repartition(tasks, "number").sortWithinPartitions("number").mapInArrow(run, "qid long, chunk_ord long, score double")


def _looked_up(index: StoredIndex, asked: DataFrame) -> DataFrame:
    """(qid, term, cell, chunk_ord, gain) of asked (qid, chunk_ord, bucket, term, idf, avgdl), where the chunk has the term: only blocks of the chunks' numbers are opened."""
    subs = index.blocks.select("batch", "subs").distinct()
    at = asked.crossJoin(F.broadcast(subs)).withColumn("sub", _sub(F.col("chunk_ord"), F.col("subs")))
    wanted = at.select("batch", "bucket", "term", "subs", "sub").distinct()
    few = wanted.limit(ASKED + 1).count() <= ASKED
    blocks = index.blocks.select("batch", "bucket", "term", "cell", "subs", "sub", "entries")
    if not few:  # what is shuffled then are the blocks of wanted terms alone
        terms = asked.select("bucket", "term").distinct()
        blocks = blocks.join(F.broadcast(terms) if terms.limit(WANTED + 1).count() <= WANTED else terms, ["bucket", "term"], "left_semi")
    some = blocks.join(F.broadcast(wanted) if few else wanted, ["batch", "bucket", "term", "subs", "sub"])
    entries = some.select("term", "cell", F.explode("entries").alias("e")).select("term", "cell", F.col("e.chunk_ord").alias("chunk_ord"), F.col("e.tf").alias("tf"), F.col("e.len").alias("len"))
    return entries.join(F.broadcast(asked) if asked.limit(ASKED + 1).count() <= ASKED else asked, ["term", "chunk_ord"]).select("qid", "term", "cell", "chunk_ord", _gain(index, F.col("tf"), F.col("len")).alias("gain"))


def split_cells(index: StoredIndex, cells: DataFrame, k: int) -> DataFrame:
    """cells (of bounds) with least, a score that k chunks of a question have at least (0 if fewer are known), and kept, false for cells that search needn't read whole.

    least is the k-th exact score among the chunks of the cells with the largest bounds. As long as the bounds of what is left out, one of each term, sum up to less than that, a chunk
    that has nothing else can't reach it. Terms with many postings for their bound are left out first; of the one that no longer fits, the cells that do.
    """
    few = cells.limit(WANTED * 8 + 1).count() <= WANTED * 8
    first = _postings(index, cells.where(F.col("before") < SEEDS * k), few).groupBy("qid", "chunk_ord").agg(F.sum("gain").alias("score"))
    seeds = rank(first).where(F.col("rank") <= 2 * k).select("qid", "chunk_ord")
    terms = cells.groupBy("qid", "bucket", "term").agg(F.sum("n").alias("n_term"), F.max("term_ub").alias("term_ub"), F.max("idf").alias("idf"), F.max("avgdl").alias("avgdl"))
    exact = _looked_up(index, written(seeds.join(terms.drop("n_term", "term_ub"), "qid"))).groupBy("qid", "chunk_ord").agg(F.sum("gain").alias("score"))
    kth = rank(exact).where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    upto = F.sum("term_ub").over(Window.partitionBy("qid").orderBy(F.desc(F.col("n_term") / F.col("term_ub")), "term"))
    rows = cells.join(terms.select("qid", "term", upto.alias("upto")), ["qid", "term"]).join(kth, "qid", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    left_out = F.when(F.col("upto") < F.col("least") - SLACK, True).otherwise(F.col("upto") - F.col("term_ub") + F.col("ub") < F.col("least") - SLACK)
    # Behind a term that is kept in part nothing is left out: its bound counts in upto as if it were whole.
    return rows.withColumn("kept", ~left_out).drop("upto")


def search(index: StoredIndex, questions: DataFrame, k: int = 5, tokenize=tokens) -> DataFrame:
    """The k best chunks of each question (qid, query), as (qid, chunk_ord, score, rank): what lexical.search finds in the same chunks.

    Where many questions share their terms, or many chunks may still get to the ranking, all postings of these terms are read once, for all questions; else bounds tell what needn't be read.
    """
    cells = written(bounds(index, questions, tokenize))
    # A pass has its questions' terms in each task, and numbers for keys.
    passes = index.chunks.schema["chunk_ord"].dataType.simpleString() == "bigint" and questions.schema["qid"].dataType.simpleString() == "bigint" and cells.select("qid", "term").distinct().limit(PASSED + 1).count() <= PASSED
    if passes:
        n = cells.groupBy("bucket", "term", "cell").agg(F.sum("n").alias("all"), F.max("n").alias("once")).agg(F.sum("all").alias("all"), F.sum("once").alias("once")).first()
        if (n["all"] or 0) > SHARED * (n["once"] or 0):
            return rank(_passed(index, cells, k)).where(F.col("rank") <= k)
    rows = written(split_cells(index, cells, k))
    few = rows.limit(WANTED * 8 + 1).count() <= WANTED * 8
    # What a chunk may still have from the cells of a term that aren't read.
    rest = rows.where("not kept").groupBy("qid", "bucket", "term").agg(F.max("ub").alias("rest"), F.max("idf").alias("idf"), F.max("avgdl").alias("avgdl"))
    rest = rest.withColumn("all_rest", F.sum("rest").over(Window.partitionBy("qid")))
    kept = rows.where("kept").join(rest.select("qid", "term", "rest"), ["qid", "term"], "left").join(rest.select("qid", "all_rest").distinct(), "qid", "left").na.fill(0.0, ["rest", "all_rest"])
    read = _postings(index, kept, few, "rest", "all_rest", "least").groupBy("qid", "chunk_ord").agg(F.sum("gain").alias("score"), F.sum("rest").alias("met"), F.max("all_rest").alias("all_rest"), F.max("least").alias("least"))
    open_ = written(read.where(F.col("score") + F.col("all_rest") - F.col("met") >= F.col("least") - SLACK).select("qid", "chunk_ord", "score"))
    # The cells that were left out, looked up for the chunks that are left.
    asked = open_.select("qid", "chunk_ord").join(rest.select("qid", "bucket", "term", "idf", "avgdl"), "qid")
    if passes and asked.limit(ASKED + 1).count() > ASKED:
        return rank(_passed(index, cells, k)).where(F.col("rank") <= k)
    late = _looked_up(index, asked)
    late = late.join(rows.where("not kept").select("qid", "term", "cell"), ["qid", "term", "cell"]).select("qid", "chunk_ord", F.col("gain").alias("score"))
    total = stacked(open_, late).groupBy("qid", "chunk_ord").agg(F.round(F.sum("score"), DIGITS).alias("score"))
    return rank(total).where(F.col("rank") <= k)


def share_read(index: StoredIndex, questions: DataFrame, k: int = 5, tokenize=tokens) -> DataFrame:
    """(qid, n_postings, n_kept): the postings of a question's terms, and those of them in cells that search reads whole."""
    rows = split_cells(index, written(bounds(index, questions, tokenize)), k)
    return rows.groupBy("qid").agg(F.sum("n").alias("n_postings"), F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)).alias("n_kept"))
