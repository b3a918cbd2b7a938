"""BM25 as joins: question terms with postings, gains summed per question and chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import tokens
from larkspur.operators.frames import written

#: Decimals to which scores are rounded before they are ranked, so that the order of a sum decides nothing.
DIGITS = 6
#: Questions' terms that may be broadcast (a row for each term of a question, some ten bytes each), and scores that a worker holds at once.
WANTED, HELD = 200_000, 1 << 21
#: Chunks whose terms a worker turns into numbers at once.
ROWS = 512


@dataclass(frozen=True)
class LexicalIndex:
    """postings (term, chunk_ord, tf, len); stats (n, avgdl), one row; df (term, df). terms: (chunk_ord, terms), if the index is made of chunks at hand."""

    postings: DataFrame
    stats: DataFrame
    df: DataFrame
    k1: float = 1.5
    b: float = 0.75
    terms: DataFrame | None = None

    def persist(self) -> LexicalIndex:
        return LexicalIndex(self.postings.persist(), self.stats.persist(), self.df.persist(), self.k1, self.b, None if self.terms is None else self.terms.persist())


def terms_of(chunks: DataFrame, tokenize=tokens) -> Column:
    """The terms of a chunk's title and text. Chunks may bring title_terms, found once a document."""
    if "title_terms" in chunks.columns:
        return F.concat(F.coalesce("title_terms", F.array().cast("array<string>")), F.coalesce(tokenize(F.col("text")), F.array().cast("array<string>")))
    return tokenize(F.concat_ws(" ", "title", "text"))


def chunk_terms(chunks: DataFrame, tokenize=tokens) -> DataFrame:
    """(chunk_ord, terms): of title and text."""
    return chunks.select("chunk_ord", terms_of(chunks, tokenize).alias("terms"))


def term_frequencies(chunks: DataFrame, tokenize=tokens) -> DataFrame:
    """(chunk_ord, term, tf, len): a chunk is a row, so its terms are counted in it, as runs of its sorted terms, and nothing is shuffled."""
    rows = chunk_terms(chunks, tokenize).select("chunk_ord", F.size("terms").alias("len"), F.sort_array("terms").alias("terms")).where("len > 0")
    starts = F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: (i == 0) | (F.col("terms")[F.greatest(i - 1, F.lit(0))] != F.col("terms")[i]))
    rows = rows.withColumn("starts", starts).withColumn("ends", F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("len")))
    runs = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(F.col("terms")[x["starts"]].alias("term"), (x["ends"] - x["starts"]).cast("long").alias("tf")))
    # The outer form: for the other one Spark adds a filter on the array's size, and pushes it, with all that makes the array, below. No array is empty here.
    return rows.select("chunk_ord", "len", F.explode_outer(runs).alias("x")).select("chunk_ord", "len", "x.term", "x.tf")


def corpus_stats(chunks: DataFrame, tokenize=tokens) -> DataFrame:
    """One row: n, and avgdl (chunks without terms count; 0 without chunks)."""
    return chunk_terms(chunks, tokenize).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("terms")), F.lit(0.0)).alias("avgdl"))


def build_index(chunks: DataFrame, *, tokenize=tokens, k1: float = 1.5, b: float = 0.75) -> LexicalIndex:
    postings = term_frequencies(chunks, tokenize)
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return LexicalIndex(postings, corpus_stats(chunks, tokenize), df, k1, b, chunk_terms(chunks, tokenize))


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def question_terms(questions: DataFrame, tokenize=tokens) -> DataFrame:
    """(qid, pos, term): each distinct term of (qid, query), in order."""
    return questions.select("qid", F.posexplode(F.array_distinct(tokenize(F.col("query")))).alias("pos", "term"))


def gains(index: LexicalIndex, questions: DataFrame, tokenize=tokens) -> DataFrame:
    """(qid, chunk_ord, pos, term, gain) of every posting of a question's terms.

    Questions' terms meet document frequencies first, so that only postings of wanted terms are joined. Up to WANTED of them are broadcast; more are joined by a shuffle on the term.
    """
    terms = question_terms(questions, tokenize)
    few = terms.limit(WANTED + 1).count() <= WANTED
    wanted = terms.join(index.df, "term").crossJoin(F.broadcast(index.stats))
    rows = index.postings.join(F.broadcast(wanted) if few else wanted, "term")
    norm = index.k1 * (1 - index.b + index.b * F.col("len") / F.when(F.col("avgdl") == 0, F.lit(1.0)).otherwise(F.col("avgdl")))
    return rows.select("qid", "chunk_ord", "pos", "term", (idf(F.col("n"), F.col("df")) * F.col("tf") * (index.k1 + 1) / (F.col("tf") + norm)).alias("gain"))


def rank(scored: DataFrame, by: str = "qid", order: str | Column = "chunk_ord") -> DataFrame:
    """scored with rank, from 1: by score, ties by `order`."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), order)))


def score(index: LexicalIndex, questions: DataFrame, tokenize=tokens) -> DataFrame:
    """(qid, chunk_ord, score, matched): matched terms in the question's order."""
    by = gains(index, questions, tokenize).groupBy("qid", "chunk_ord")
    matched = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"])
    return by.agg(F.round(F.sum("gain"), DIGITS).alias("score"), matched.alias("matched"))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ROWS rows at most, so that what a worker makes of one is bounded."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def found_terms(column: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and places in `terms` of all tokens of a column of arrays that are among these."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ids = pc.index_in(column.flatten(), value_set=terms)
    keep = ids.is_valid().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(sizes)), sizes)[keep], pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[keep].astype(np.int64)


def _numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a column of arrays."""
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


class Scan:
    """Scores of all chunks for a set of questions, block after block. Texts are turned into terms once: a pass over them leaves each chunk's length and its terms among the questions', by number.

    Tasks add gains in a matrix of some chunks and all questions; only what `keep` makes of it leaves them.
    """

    def __init__(self, index: LexicalIndex, terms: pa.Table, qid_type: str):
        self.index, self.qid_type = index, qid_type
        self.qids, owner = np.unique(terms.column("qid").to_numpy(), return_inverse=True)
        encoded = terms.column("term").combine_chunks().dictionary_encode()
        self.terms, of = encoded.dictionary, encoded.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        self.questions, self.count = owner[order], np.bincount(of, minlength=len(self.terms))
        self.first = np.cumsum(self.count) - self.count
        self.hits = self._hits()
        self.n, self.total, self.df = self._frequencies()

    def _hits(self) -> DataFrame:
        """(chunk_ord, len, ids), a row for each chunk, written."""
        terms = self.terms

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                rows, ids = found_terms(b.column(1), terms)
                offsets = pa.array(np.searchsorted(rows, np.arange(b.num_rows + 1)).astype(np.int32))
                size = pc.fill_null(pc.list_value_length(b.column(1)), 0).cast(pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), size, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["chunk_ord", "len", "ids"])

        return written(self.index.terms.select("chunk_ord", "terms").mapInArrow(run, "chunk_ord long, len int, ids array<int>"))

    def _frequencies(self) -> tuple[int, int, np.ndarray]:
        width = max(1, len(self.terms))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total, df = 0, 0, np.zeros(width, np.int64)
            for b in sliced(batches):
                rows, ids = _numbered(b.column(1))
                df += np.bincount(np.unique(rows * width + ids) % width, minlength=width)
                n, total = n + b.num_rows, total + int(pc.sum(b.column(0)).as_py() or 0)
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[total, n, df[at]])], names=["id", "n"])

        got = self.hits.select("len", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
        by = dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
        df = np.zeros(len(self.terms))
        for k, v in by.items():
            if k >= 0:
                df[k] = v
        return by.get(-1, 0), by.get(-2, 0), df

    def run(self, keep: Callable[[np.ndarray, np.ndarray], list[np.ndarray] | None], schema: str) -> DataFrame:
        """What keep(chunk_ords, scores) makes of each block (arrays of the schema's columns, or None); scores: chunks x questions, 0 where no term meets."""
        n, df, first, count, questions, distinct = self.n, self.df, self.first, self.count, self.questions, max(1, len(self.terms))
        k1, b_, width = self.index.k1, self.index.b, len(self.qids)
        average = (self.total / n if n else 0) or 1.0
        weight = np.log(1 + (n - df + 0.5) / (df + 0.5)) * (k1 + 1)
        step = max(1, min(512, HELD // max(1, width)))
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    b = batch.slice(at, step)
                    keys, length = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
                    rows, ids = _numbered(b.column(2))
                    code, tf = np.unique(rows * distinct + ids, return_counts=True)
                    row, term = np.divmod(code, distinct)
                    gain = weight[term] * tf / (tf + k1 * (1 - b_ + b_ * length[row] / average))
                    each = count[term]
                    inside = np.repeat(first[term] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
                    scores = np.bincount(np.repeat(row, each) * width + questions[inside], np.repeat(gain, each), len(keys) * width).reshape(len(keys), width)
                    made = keep(keys, scores)
                    if made is not None and len(made[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=names)

        return self.hits.mapInArrow(run, schema)


def scan(index: LexicalIndex, questions: DataFrame, tokenize=tokens) -> Scan | None:
    """A Scan, if the index has chunks at hand and the questions WANTED terms at most, which come to the driver."""
    if index.terms is None or index.terms.schema["chunk_ord"].dataType.simpleString() != "bigint" or questions.schema["qid"].dataType.simpleString() != "bigint":
        return None
    terms = question_terms(questions, tokenize).select("qid", "term").limit(WANTED + 1).toArrow()
    return Scan(index, terms, "long") if terms.num_rows <= WANTED else None


def best_of(k: int, qids: np.ndarray) -> Callable[[np.ndarray, np.ndarray], list[np.ndarray] | None]:
    """The k best chunks of each question in a block, ties by chunk: only scores above 0 are sorted."""

    def keep(keys: np.ndarray, scores: np.ndarray) -> list[np.ndarray] | None:
        row, question = np.nonzero(scores)
        if not len(row):
            return None
        key, score = keys[row], np.round(scores[row, question], DIGITS)
        order = np.lexsort((key, -score, question))
        question = question[order]
        place = np.arange(len(question)) - np.searchsorted(question, question)
        top = order[place < k]
        return [qids[question[place < k]], key[top], score[top]]

    return keep


def _with_matched(index: LexicalIndex, hits: DataFrame, questions: DataFrame, tokenize=tokens) -> DataFrame:
    """hits with matched: the distinct terms of the question that are in the chunk, in the question's order."""
    hits = written(hits)
    few = hits.limit(WANTED + 1).count() <= WANTED
    rows = index.terms.join(F.broadcast(hits) if few else hits, "chunk_ord").join(questions.select("qid", F.array_distinct(tokenize(F.col("query"))).alias("wanted")), "qid")
    return rows.select("qid", "chunk_ord", "score", F.array_intersect("wanted", "terms").alias("matched"), "rank")


def search(index: LexicalIndex, questions: DataFrame, k: int = 5, tokenize=tokens, *, matched: bool = False) -> DataFrame:
    """The k best chunks of each question (qid, query), as (qid, chunk_ord, score, rank), with matched terms on demand. A question without known terms has none.

    Questions of up to WANTED terms are scored in matrices (Scan), and matched terms found in their hits alone; more and stored indexes are scored by joins.
    """
    s = scan(index, questions, tokenize)
    if s is not None:
        hits = rank(s.run(best_of(k, s.qids), "qid long, chunk_ord long, score double")).where(F.col("rank") <= k)
        return _with_matched(index, hits, questions, tokenize) if matched else hits
    rows = score(index, questions, tokenize)
    return rank(rows if matched else rows.drop("matched")).where(F.col("rank") <= k)


def best_ranks(index: LexicalIndex, questions: DataFrame, targets: DataFrame, tokenize=tokens) -> DataFrame:
    """(qid, rank): the best rank over all chunks of a question's targets (qid, chunk_ord), as search would give it without a k. Targets that no term meets have none.

    Chunks that beat a target are counted where they are scored; the targets and their scores come to the driver.
    """
    s = scan(index, questions, tokenize)
    if s is None:
        return targets.join(rank(score(index, questions, tokenize)), ["qid", "chunk_ord"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    wanted = targets.select("qid", "chunk_ord").distinct().toArrow()
    return count_better(s.qids, s.run, wanted)


def count_better(qids: np.ndarray, run: Callable, wanted: pa.Table) -> DataFrame:
    """The ranks of the best of each question's wanted chunks; run(keep, schema) gives blocks of (keys, scores), 0 or less where there is none."""
    column, keys = np.searchsorted(qids, wanted.column("qid").to_numpy()), wanted.column("chunk_ord").to_numpy()
    known = (column < len(qids)) & (qids[np.minimum(column, max(0, len(qids) - 1))] == wanted.column("qid").to_numpy()) if len(qids) else np.zeros(len(keys), bool)
    column, keys = column[known], keys[known]
    order = np.argsort(keys, kind="stable")
    column, keys = column[order], keys[order]

    def held(block: np.ndarray, scores: np.ndarray) -> list[np.ndarray] | None:
        by = np.argsort(block, kind="stable")
        at = np.minimum(np.searchsorted(block[by], keys), len(block) - 1)
        here = np.flatnonzero(block[by][at] == keys)
        value = scores[by[at[here]], column[here]]
        return [qids[column[here]][value > 0], keys[here][value > 0], np.round(value[value > 0], DIGITS)]

    found = run(held, "qid long, chunk_ord long, score double").toArrow()
    best: dict[int, tuple[float, int]] = {}
    for q, key, value in zip(*[found.column(i).to_pylist() for i in range(3)], strict=True):
        best[q] = max(best.get(q, (-1.0, 0)), (value, -key))
    score_of = np.array([best.get(int(q), (np.inf, 0))[0] for q in qids])
    key_of = np.array([-best.get(int(q), (0.0, 0))[1] for q in qids])

    def better(block: np.ndarray, scores: np.ndarray) -> list[np.ndarray] | None:
        rounded = np.where(scores > 0, np.round(scores, DIGITS), -1.0)
        n = ((rounded > score_of) | (rounded == score_of) & (block[:, None] < key_of)).sum(axis=0)
        some = np.flatnonzero(np.isfinite(score_of))
        return [qids[some], n[some].astype(np.int64)]

    return run(better, "qid long, n long").groupBy("qid").agg((F.sum("n") + 1).alias("rank"))
