"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside a smoothed unigram base.

Tokens are the words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) and one end for each text. The frequent words fall into HEAD classes by
frequency, of about equal shares of the text each; the others, unseen words among them, into RARE classes by a hash of their last bytes; the end is a class of its
own. A class has SLOTS slots: a class of few words deals them out one by one, others by the hash of their last bytes.
P(token | history) = P(class | features) * P(slot | class, features) * P(token | class, slot).
The first two are softmaxes. Their features are the word before, the two words before and, skipping one, the word before that, each hashed into rows
of weights (for slots, rows of the class); where they say nothing, a class or slot has its share of the tokens. The last is the multinomial of the slot, smoothed as the base is.

Training is by full steps along the gradient of the likelihood: by a weight it is how often the feature and the outcome meet, less how often the
model expects them to. Tasks add up both over their texts, the sums are merged, and all weights move at once, by the logarithm of the ratio of the two (both
smoothed by PRIOR), as in iterative scaling. Sums don't depend on how texts are dealt to tasks, so neither do the scores (but for rounding).

Counts are exact and cover all training texts. The FREQUENT most frequent words go to every worker; the rest of the vocabulary
stays a distributed table, which the rare words of the texts are joined with. Rows of weights grow with the vocabulary up to MOST_ROWS, which bounds a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.language_id import least_count
from larkspur.llm.names import col, others, quoted, unused
from larkspur.llm.storage import drop_table, write_table
from larkspur.llm.wordhash import KeyTable, mix, room, small_batches, tidy, word_runs

#: Words known to all workers (at most), and the smoothing of counts.
FREQUENT, ALPHA = 1 << 18, 0.1
#: Classes by frequency, by last bytes, and the end; slots of a class; how many last bytes tell slots apart.
HEAD, RARE, SLOTS, TAIL = 15, 6, 22, 3
END = HEAD + RARE
CLASSES = END + 1
#: Distinct words for each row of weights for classes; the least and the most rows. Slots have a share of them for each class.
WORDS_A_ROW, LEAST_ROWS, MOST_ROWS, SLOT_SHARE = 16, 1 << 12, 1 << 15, 4
#: The part of each step that is taken, and the tokens that every expectation and count of a row begins with.
RATES, PRIOR = (0.6, 0.4), 100.0
#: Weights stay within this, so exponentials neither overflow nor vanish.
LIMIT = 6.0
#: Tokens that are worked on at once, tokens for a task of a training pass, distinct words that a task holds, and rows of a block of sums.
STEP, TASK_TOKENS, HELD_WORDS, BLOCK_ROWS = 4096, 6_000_000, 1 << 20, 1024
_BEGIN, _END_KEY = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


@dataclass
class Tokens:
    """Tokens of a run of texts, those of text i from first[i] to first[i + 1], the last an end; tails: hashes of words' last bytes."""

    keys: np.ndarray
    tails: np.ndarray
    word: np.ndarray
    first: np.ndarray

    def features(self) -> list[np.ndarray]:
        """A hash of each of a token's features."""
        at = np.arange(len(self.keys))
        begin = np.repeat(self.first[:-1], np.diff(self.first))
        one = np.where(at - 1 >= begin, self.keys[np.maximum(at - 1, 0)], _BEGIN)
        two = np.where(at - 2 >= begin, self.keys[np.maximum(at - 2, 0)], _BEGIN)
        return [mix(one), mix(one * np.uint64(3) + two * np.uint64(5) + np.uint64(1)), mix(two ^ np.uint64(0x5851F42D4C957F2D))]


def read_tokens(texts: pa.Array) -> Iterator[tuple[int, int, Tokens]]:
    """(first row, rows, tokens) of a string column, about a MB at a time. Null is empty: an end alone."""
    for row, rows, hashes, tails, first in word_runs(texts, lower=True, tail=TAIL):
        at = np.arange(len(hashes)) + np.repeat(np.arange(rows), np.diff(first))
        begin = first + np.arange(rows + 1)
        keys, ends, word = np.full(begin[-1], _END_KEY), np.zeros(begin[-1], np.int64), np.zeros(begin[-1], bool)
        keys[at], ends[at], word[at] = hashes, (tails >> np.uint64(40)).astype(np.int64), True
        yield row, rows, Tokens(keys, ends, word, begin)


@dataclass
class Leaves:
    """What a class and slot is made of, and the frequent words with their leaf (class * SLOTS + slot): arrays of bounded size, which go to every worker."""

    frequent: KeyTable
    leaf: np.ndarray
    counts: np.ndarray
    tokens: np.ndarray
    words: np.ndarray

    def find(self, t: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Each token's place among the frequent words (-1: none), and its leaf."""
        at = self.frequent.find(t.keys)
        at[~t.word] = -1
        leaf = np.where(t.word, HEAD * SLOTS + t.tails % (RARE * SLOTS), END * SLOTS)
        found = at >= 0
        leaf[found] = self.leaf[at[found]]
        return at, leaf

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed shares of the classes, and of the slots of each class."""
        by = self.tokens.reshape(CLASSES, SLOTS)
        classes = by.sum(axis=1) + 1
        slots = by + 0.5
        return classes / classes.sum(), slots / slots.sum(axis=1, keepdims=True)


@dataclass
class Model:
    """vocabulary: (key, tail, n), a table, the end among its rows (tail -1); the rest is of bounded size. tokens: of training; words: distinct ones, the end included."""

    vocabulary: DataFrame
    tokens: int
    words: int
    ends: int
    leaves: Leaves
    weights: tuple[np.ndarray, np.ndarray]


def count_words(texts: DataFrame) -> DataFrame:
    """(text) to (key, tail, n), summed in each task before the shuffle. The end of texts is a row with tail -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, tails, counts, ends = KeyTable(), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.r_[table.keys[: table.n], _END_KEY].view(np.int64)), pa.array(np.r_[tails[: table.n], -1].astype(np.int32)), pa.array(np.r_[counts[: table.n], ends])], names=["key", "tail", "n"])

        for b in small_batches(batches, 2048):
            for _, rows, t in read_tokens(b.column("text")):
                keys, last = t.keys[t.word], t.tails[t.word]
                at = table.find(keys)
                new = np.flatnonzero(at < 0)
                if len(new):
                    fresh, where = np.unique(keys[new], return_index=True)
                    table.add(fresh)
                    tails, counts = room(tails, table.n), room(counts, table.n)
                    tails[table.n - len(fresh) : table.n] = last[new[where]]
                    at[new] = table.find(keys[new])
                np.add.at(counts, at, 1)
                ends += rows
                if table.n > HELD_WORDS:
                    yield found()
                    table, tails, counts, ends = KeyTable(), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if ends:
            yield found()

    counted = texts.mapInArrow(tidy(run), "key long, tail int, n long").groupBy("key", "tail").agg(F.sum("n").alias("n"))
    return counted.where("n > 0")


def deal_leaves(keys: np.ndarray, tails: np.ndarray, counts: np.ndarray, rare_tokens: np.ndarray, rare_words: np.ndarray, ends: int) -> Leaves:
    """Frequent words to classes of equal shares of their tokens, most frequent first (ties by key), and to slots. rare_*: by leaf of the RARE classes."""
    order = np.lexsort((keys, -counts))
    before = np.cumsum(counts[order]) - counts[order]
    cls = np.zeros(len(keys), np.int64)
    cls[order] = np.minimum(HEAD - 1, before * HEAD // max(1, counts.sum()))
    few = np.bincount(cls, minlength=HEAD) <= 2 * SLOTS
    slot = np.where(few[cls], (keys % np.uint64(SLOTS)).astype(np.int64), tails % SLOTS)
    leaf = cls * SLOTS + slot
    tokens = np.concatenate([np.bincount(leaf, counts, HEAD * SLOTS), rare_tokens, np.zeros(SLOTS)])
    words = np.concatenate([np.bincount(leaf, minlength=HEAD * SLOTS), rare_words, np.zeros(SLOTS)])
    tokens[END * SLOTS] = ends
    return Leaves(KeyTable(keys), leaf, counts.astype(np.float64), tokens, words)


def weight_rows(words: int) -> tuple[int, int]:
    """Rows of weights for classes, and for the slots of one class, for a vocabulary: powers of 2."""
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (max(1, words // WORDS_A_ROW) - 1).bit_length()))
    return rows, rows // SLOT_SHARE


def class_rows(features: list[np.ndarray], rows: int) -> list[np.ndarray]:
    return [(f & np.uint64(rows - 1)).astype(np.int64) for f in features]


def slot_rows(features: list[np.ndarray], classes: np.ndarray, rows: int) -> list[np.ndarray]:
    """Rows for the slots of each token's class: the class's own part of the table."""
    return [classes * rows + (f >> np.uint64(64 - rows.bit_length() + 1)).astype(np.int64) for f in features]


def _exponentials(rows: list[np.ndarray], weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        out += np.take(weights, r, axis=0)
    out += bias
    return np.exp(out, out=out)


def _add_rows(sums: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Element by element, which numpy adds faster than it finds equal rows."""
    width = sums.shape[1]
    np.add.at(sums.ravel(), (rows[:, None] * width + np.arange(width)).ravel(), values.ravel())


def _gather(texts: DataFrame, leaves: Leaves, rows: tuple[int, int], weights: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """How often rows and outcomes meet in the texts (weights None), or how often the model expects them to: for classes, and for slots.

    A task adds into two arrays of the weights' size; blocks of their rows are shuffled, merged, and come to the driver, whose share is bounded by MOST_ROWS.
    """
    context = texts.sparkSession.sparkContext
    shared = context.broadcast((leaves, None if weights is None else tuple(w.astype(np.float16) for w in weights)))
    n_class, n_slot = rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, weights = shared.value
        class_share, slot_share = (np.log(x).astype(np.float32) for x in leaves.shares())
        weights = None if weights is None else [w.astype(np.float32) for w in weights]
        classes, slots = np.zeros((n_class, CLASSES), np.float32), np.zeros((END * n_slot, SLOTS), np.float32)
        for b in small_batches(batches, 2048):
            for _, _, t in read_tokens(b.column("text")):
                features, leaf = t.features(), leaves.find(t)[1]
                for i in range(0, len(leaf), STEP):
                    some = leaf[i : i + STEP]
                    cls, inside = some // SLOTS, [f[i : i + STEP] for f in features]
                    word = np.flatnonzero(cls != END)
                    by_class, by_slot = class_rows(inside, n_class), slot_rows([f[word] for f in inside], cls[word], n_slot)
                    if weights is None:
                        for r, s in zip(by_class, by_slot, strict=True):
                            np.add.at(classes.ravel(), r * CLASSES + cls, np.float32(1))
                            np.add.at(slots.ravel(), s * SLOTS + some[word] % SLOTS, np.float32(1))
                        continue
                    for sums, w, bias, where in ((classes, weights[0], class_share, by_class), (slots, weights[1], slot_share[cls[word]], by_slot)):
                        if len(where[0]):
                            p = _exponentials(where, w, bias)
                            p /= np.einsum("ij->i", p)[:, None]
                            for r in where:
                                _add_rows(sums, r, p)
        for table, sums in enumerate((classes, slots)):
            for i in range(0, len(sums), BLOCK_ROWS):
                part = sums[i : i + BLOCK_ROWS]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([table << 24 | i // BLOCK_ROWS], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["block", "sums"])
        for b in batches:
            blocks = b.column(0).to_pylist()
            for k, block in enumerate(blocks):
                part = np.frombuffer(b.column(1)[k].as_buffer(), np.float32)
                if block == now:
                    total += part
                else:
                    if now is not None:
                        yield give()
                    now, total = block, part.astype(np.float64)
        if now is not None:
            yield give()

    schema = "block int, sums binary"
    merged = texts.mapInArrow(tidy(run), schema).repartition("block").sortWithinPartitions("block").mapInArrow(tidy(merge), schema).toArrow()
    out = np.zeros((n_class, CLASSES), np.float32), np.zeros((END * n_slot, SLOTS), np.float32)
    for block, sums in zip(merged.column(0).to_pylist(), merged.column(1), strict=True):
        table, at = out[block >> 24], (block & 0xFFFFFF) * BLOCK_ROWS
        part = np.frombuffer(sums.as_buffer(), np.float32).reshape(-1, table.shape[1])
        table[at : at + len(part)] = part
    shared.unpersist()
    return out


def step(weights: np.ndarray, met: np.ndarray, expected: np.ndarray, rate: float) -> np.ndarray:
    """All weights of a table, moved: up where the corpus has more than the model expects. As 16-bit floats, as the workers have them."""
    prior = np.float32(PRIOR / met.shape[1])
    return np.clip(weights + np.float32(rate) * np.log((met + prior) / (expected + prior)), -LIMIT, LIMIT).astype(np.float16).astype(np.float32)


def train_weights(texts: DataFrame, leaves: Leaves, rows: tuple[int, int], rates: tuple[float, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A pass over all texts that counts, and one for each step but the first: what weights of zero expect follows from the counts and the shares."""
    met = _gather(texts, leaves, rows, None)
    class_share, slot_share = (x.astype(np.float32) for x in leaves.shares())
    expected = met[0].sum(axis=1, keepdims=True) * class_share, met[1].sum(axis=1, keepdims=True) * np.repeat(slot_share[:END], rows[1], axis=0)
    weights = np.zeros_like(met[0]), np.zeros_like(met[1])
    for k, rate in enumerate(RATES if rates is None else rates):
        if k:
            expected = _gather(texts, leaves, rows, weights)
        weights = tuple(step(w, n, e, rate) for w, n, e in zip(weights, met, expected, strict=True))
    return weights


def train(df: DataFrame, text_col: str = "text") -> Model:
    """Learns from all rows, whatever their order and partitions. An empty table gives a model that knows nothing."""
    texts = df.select(col(text_col).alias("text"))
    vocabulary = write_table(count_words(texts), "vocabulary")
    words = vocabulary.where("tail >= 0")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.sum(F.when(F.col("tail") < 0, F.col("n"))), F.lit(0)).alias("ends")).first()
    # Words seen once are rare, like words that are never seen.
    least = max(2, least_count(words, FREQUENT))
    top = words.where(F.col("n") >= least).toArrow()
    rare = words.where(F.col("n") < least).groupBy(F.pmod("tail", F.lit(RARE * SLOTS)).alias("leaf")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toArrow()
    sums = [np.zeros(RARE * SLOTS) for _ in range(2)]
    for x, name in zip(sums, ("n", "v"), strict=True):
        x[rare["leaf"].to_numpy()] = rare[name].to_numpy()
    keys, tails, counts = (top[c].to_numpy() for c in ("key", "tail", "n"))
    leaves = deal_leaves(keys.view(np.uint64), tails.astype(np.int64), counts, *sums, total["ends"])
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-total["n"] // TASK_TOKENS))
    return Model(vocabulary, total["n"], total["v"], total["ends"], leaves, train_weights(texts.coalesce(tasks), leaves, weight_rows(total["v"])))


def score(df: DataFrame, model: Model, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with n_tokens, n_known, train_tokens, base_score and score added (they replace columns of these names, in any case).

    n_known: tokens that training saw. base_score: the sum of log10((c + ALPHA) / (N + ALPHA * (V + 1))) over tokens; score: the model's log10 probability of the text.
    Null text is empty: it has an end alone. Each row is scored for itself, so repeated rows stay.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = others(keep or df.columns, new)
    text, at_row, known, counted, modelled, rare, times, key, n = unused([*names, *new], "text_to_score", "row", "known", "counted", "modelled", "rare", "times", "key", "n")
    rows = df.select(*map(quoted, names), col(text_col).alias(text))
    zero = F.lit(0).cast("long")
    added = {at_row: zero, "n_tokens": zero, known: zero, counted: F.lit(0.0), modelled: F.lit(0.0), rare: F.array(zero), times: F.array(zero)}
    schema = rows.select(*map(quoted, names), *[c.alias(x) for x, c in added.items()]).schema
    columns_out = [*names, *added]
    shared = df.sparkSession.sparkContext.broadcast((model.leaves, tuple(w.astype(np.float16) for w in model.weights), model.ends))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, weights, ends = shared.value
        weights = [w.astype(np.float32) for w in weights]
        n_class, n_slot = len(weights[0]), len(weights[1]) // END
        class_share, slot_share = (np.log(x).astype(np.float32) for x in leaves.shares())
        inside, logs = np.log10(leaves.tokens + ALPHA * (leaves.words + 1)), np.log10(leaves.counts + ALPHA)
        log_end = float(np.log10(ends + ALPHA))
        place = TaskContext.get().partitionId() << 33
        for b in small_batches(batches, 2048):
            for row, n, t in read_tokens(b.column(len(names))):
                first, values, features = t.first[:-1], np.zeros(len(t.keys)), t.features()
                at, leaf = leaves.find(t)
                for i in range(0, len(leaf), STEP):
                    some = leaf[i : i + STEP]
                    cls, here = some // SLOTS, [f[i : i + STEP] for f in features]
                    word = np.flatnonzero(cls != END)
                    p = _exponentials(class_rows(here, n_class), weights[0], class_share)
                    values[i : i + STEP] = np.log10(p[np.arange(len(p)), cls] / np.einsum("ij->i", p))
                    if len(word):
                        p = _exponentials(slot_rows([f[word] for f in here], cls[word], n_slot), weights[1], slot_share[cls[word]])
                        values[i + word] += np.log10(p[np.arange(len(p)), some[word] % SLOTS] / np.einsum("ij->i", p))
                values -= np.where(t.word, inside[leaf], 0.0)
                found = at >= 0
                counts = np.where(t.word, 0.0, log_end)
                counts[found] = logs[at[found]]
                seen = found | (~t.word & (ends > 0))
                left = np.flatnonzero(t.word & ~found)
                # Distinct rare words of each text, with how often it has them.
                owner = np.searchsorted(t.first, left, "right") - 1
                order = np.lexsort((t.keys[left], owner))
                keys, owner = t.keys[left][order], owner[order]
                fresh = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]) if len(keys) else np.zeros(0, np.int64)
                ends_of = pa.array(np.searchsorted(owner[fresh], np.arange(n + 1)), pa.int32())
                sums = [np.add.reduceat(x, first) for x in (seen.astype(np.int64), counts, values)]
                columns = [pa.array(place + np.arange(n)), pa.array(np.diff(t.first)), *map(pa.array, sums)]
                columns += [pa.ListArray.from_arrays(ends_of, pa.array(keys[fresh].view(np.int64))), pa.ListArray.from_arrays(ends_of, pa.array(np.diff(np.r_[fresh, len(keys)])))]
                place += n
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(row, n) for i in range(len(names))], *columns], names=columns_out)

    scored = write_table(rows.mapInArrow(tidy(run), schema), "scored")
    pairs = scored.select(at_row, F.explode(F.arrays_zip(rare, times)).alias("x")).select(at_row, F.col(f"x.{rare}").alias(key), F.col(f"x.{times}").alias(times))
    looked = pairs.join(model.vocabulary.where("tail >= 0").select(F.col("key").alias(key), F.col("n").alias(n)), key, "left")
    by = looked.groupBy(at_row).agg(F.sum(F.col(times) * F.log10(F.coalesce(n, F.lit(0)) + F.lit(ALPHA))).alias(rare), F.sum(F.when(F.col(n).isNotNull(), F.col(times))).alias(times))
    # Ends have probability 1 in their class; words in their slot their smoothed count, whose denominator the modelled part holds.
    joined = scored.drop(rare, times).join(by, at_row, "left")
    counts = F.col(counted) + F.coalesce(rare, F.lit(0.0))
    base = counts - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + ALPHA * (model.words + 1))))
    total = F.col(modelled) + counts - F.lit(float(np.log10(model.ends + ALPHA)))
    return joined.select(*map(quoted, names), "n_tokens", (F.col(known) + F.coalesce(times, zero)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), total.alias("score"))
