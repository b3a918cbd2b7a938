"""Periodic runs: stretches of a text in which words repeat at a fixed distance, found by matching blocks.

A run of period q and length L holds q words and their copies q further on, so L - q starts. Any 2b - 1 words in a row hold a whole aligned block
of b words (one that begins at a multiple of b), so a run whose L - q is at least 2b - 1 has an aligned block that occurs again q words on.
Blocks of each power of two are keys of an automaton over integers, by which all their occurrences in the text are found in one pass; those at the distances that belong to the scale
seed an exact extension to both sides. A block of 2b words occurs again only if both its halves do, so each scale leaves few keys to the next, and
its key is the pair of its halves' numbers: keys stay short, on which the automaton spends the same time in any text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larkspur.llm.names import col, others, unused
from larkspur.llm.wordhash import SEGMENT, small_batches, text_bytes, text_runs, tidy

#: Seeds that are held at once.
SEEDS = 1 << 20


def scale_of(q: int, shortest: int) -> int:
    """The words in a block (a power of two) that a run of period q and enough words must repeat."""
    return 1 << ((max(shortest - q, q) + 1) // 2).bit_length() - 1


def _scales(n: int, shortest: int) -> Iterator[tuple[int, int, int]]:
    """(b, lo, hi): the periods lo..hi, in ascending order, and the scale of all of them."""
    q, last = 1, n // 2
    while q <= last:
        b, hi = scale_of(q, shortest), q
        while hi < last and scale_of(hi + 1, shortest) == b:
            # From `shortest` on, the scale is that of the period alone: its end is known.
            hi = min(last, 4 * b - 2) if hi >= shortest else hi + 1
        yield b, q, hi
        q = hi + 1


class _Blocks:
    """The occurrences of aligned blocks of each scale in a sequence x of small integers.

    A block's key is two integers, the numbers of its halves, whatever its length: at scale b the text is read as b / 2 sequences, one for each remainder of a place by b / 2.
    """

    def __init__(self, x: np.ndarray):
        often = np.bincount(x) > 1
        #: By scale: for each aligned block whether it occurs elsewhere; for each place the number of the block that begins there, 0 if none that does.
        self.again, self.number = {1: often[x]}, {1: np.where(often[x], x.astype(np.int64) + 1, 0)}
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def at(self, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the aligned blocks that occur elsewhere, the number of each, and all occurrences as sorted number * 2n + place."""
        if b not in self.found:
            scale = max(k for k in self.again if k <= b)
            while scale < b:
                scale *= 2
                self._match(scale)
            starts, number = np.flatnonzero(self.again[b]) * b, self.number[b]
            places = np.flatnonzero(number)
            self.found[b] = starts, number[starts], np.sort(number[places] * (2 * len(number)) + places)
        return self.found[b]

    def forget(self, b: int) -> None:
        """Drops what was found at scales below b, which no larger scale reads."""
        for held in (self.again, self.number, self.found):
            for scale in [k for k in held if k < b]:
                del held[scale]

    def _match(self, b: int) -> None:
        half, number = b // 2, self.number[b // 2]
        n, blocks = len(number), len(number) // b
        self.again[b], self.number[b] = np.zeros(blocks, bool), np.zeros(n, np.int64)
        wanted = np.flatnonzero(self.again[half][0 : 2 * blocks : 2] & self.again[half][1 : 2 * blocks : 2])
        if not len(wanted):
            return
        rows = -(-n // half) + 1  # each sequence ends in a 0, so no key crosses into the next
        text = np.zeros((rows, half), np.int64)
        text.ravel()[:n] = number
        text = np.ascontiguousarray(text.T).ravel()
        some = text > 0
        some[1:] |= some[:-1]
        kept = np.flatnonzero(some)
        keys: dict[tuple[int, int], int] = {}
        for key in zip(number[wanted * b].tolist(), number[wanted * b + half].tolist(), strict=True):
            keys.setdefault(key, len(keys) + 1)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for key, value in keys.items():
            automaton.add_word(key, value)
        automaton.make_automaton()
        ends, values = np.array(list(automaton.iter(tuple(text[kept].tolist()))), np.int64).reshape(-1, 2).T
        ends = kept[ends]
        often = np.bincount(values, minlength=len(keys) + 1) > 1
        self.number[b][(ends % rows - 1) * half + ends // rows] = np.where(often[values], values, 0)
        self.again[b][wanted] = self.number[b][wanted * b] > 0


def _first_change(x: np.ndarray, at: int, q: int) -> int:
    """The least i >= at with x[i] != x[i + q], or where x ends."""
    last, step = len(x) - q, 16
    while at < last:
        to = min(last, at + step)
        differ = x[at:to] != x[at + q : to + q]
        i = int(differ.argmax())
        if differ[i]:
            return at + i
        at, step = to, step * 4
    return last


def _last_change(x: np.ndarray, at: int, q: int) -> int:
    """The least i <= at such that x[j] == x[j + q] for all j from i to before at."""
    step = 16
    while at > 0:
        of = max(0, at - step)
        differ = (x[of:at] != x[of + q : at + q])[::-1]
        i = int(differ.argmax())
        if differ[i]:
            return at - i
        at, step = of, step * 4
    return 0


def runs_of(x: np.ndarray, *, shortest: int = 12, exponent: int = 2) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run in a sequence of integers from 0, by start, then period.

    A run has its smallest period q and at least max(shortest, exponent * q) items (exponent: 2 or more), and neither neighbour extends it with that period.
    Work and memory grow with n log n for any sequence: places within a known run of period p seed no multiple of p.
    """
    if exponent < 2:
        raise ValueError("a run repeats its period twice at least")
    n = len(x)
    if n < max(2, shortest):
        return []
    blocks = _Blocks(x)
    found: dict[tuple[int, int], int] = {}
    # The run that reaches furthest of those known around a place: its end and its period.
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)

    def seeds(b: int, lo: int, hi: int) -> None:
        starts, numbers, occurrences = blocks.at(b)
        if not len(starts):
            return
        new = ~((reach[starts] >= starts + hi + b) & (period[starts] <= b))
        starts, numbers = starts[new], numbers[new]
        base = numbers * (2 * n) + starts
        first, end = np.searchsorted(occurrences, base + lo), np.searchsorted(occurrences, base + hi, "right")
        counts = end - first
        total = int(counts.sum())
        if total > SEEDS and lo < hi:
            seeds(b, lo, (lo + hi) // 2)
            seeds(b, (lo + hi) // 2 + 1, hi)
        elif total:
            take = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(total)
            s = np.repeat(starts, counts)
            extend(b, s, occurrences[take] - np.repeat(base, counts))

    def extend(b: int, s: np.ndarray, q: np.ndarray) -> None:
        new = ~((reach[s] >= s + q + b) & (q % period[s] == 0))
        s, q = s[new], q[new]
        order = np.lexsort((s, q))
        s, q = s[order], q[order]
        cuts = np.flatnonzero(np.diff(q)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(q)], strict=True):
            while i < j:
                at, step = int(s[i]), int(q[i])
                if reach[at] >= at + step + b and step % period[at] == 0:
                    i += 1
                    continue
                start, end = _last_change(x, at, step), _first_change(x, at + b, step) + step
                if end - start >= max(shortest, exponent * step) and found.setdefault((start, end), step) == step:
                    here = reach[start:end]
                    further = here < end
                    here[further] = end
                    period[start:end][further] = step
                # Seeds of this period up to the end of the stretch lead to it again.
                i += max(1, int(np.searchsorted(s[i:j], end - step - b, "right")))

    for b, lo, hi in _scales(n, shortest):
        seeds(b, lo, hi)
        if lo >= shortest:
            blocks.forget(b)
    return sorted((start, end - start, q) for (start, end), q in found.items())


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run contains after its first period."""
    gone = np.zeros(n, bool)
    for start, length, q in runs:
        gone[start + q : start + length] = True
    return gone


def find_runs(df: DataFrame, *, text_col: str = "text", shortest: int = 12, exponent: int = 2) -> DataFrame:
    """df with n_words (long), runs (array of start, length and period in words, by start, then period; never null) and collapsed (string) added; they replace columns of these names, in any case.

    Words are runs of characters other than ASCII white space, compared as they are. runs: see runs_of. collapsed: the text's words, joined by one space, without those
    that a run contains after its first period. Null or empty text: no words, no runs, collapsed is empty. Each row is worked on by itself, so repeated rows
    give repeated results and an empty table an empty one; there is no shuffle, and a worker holds some texts of SEGMENT bytes together or one longer text.
    """
    names = others(df.columns, ["n_words", "runs", "collapsed"])
    [text] = unused([*names, "n_words", "runs", "collapsed"], "text_of")
    rows = df.select(*map(col, names), col(text_col).cast("string").alias(text))
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("runs", run_type), T.StructField("collapsed", T.StringType())]
    schema = T.StructType([*rows.schema.fields[:-1], *added])
    arrow_runs = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def one(data: bytes) -> tuple[int, list[dict], bytes]:
        words = data.split()
        known: dict[bytes, int] = {}
        x = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
        runs = runs_of(x, shortest=shortest, exponent=exponent) if len(known) < len(words) else []
        if runs:
            gone = repeated(len(words), runs).tolist()
            words = [w for w, out in zip(words, gone, strict=True) if not out]
        return len(x), [{"start": a, "length": n, "period": q} for a, n, q in runs], b" ".join(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            data, offsets = text_bytes(b.column(b.num_columns - 1))
            for row, last in text_runs(offsets, SEGMENT):
                made = [one(data[offsets[i] : offsets[i + 1]].tobytes()) for i in range(row, last)]
                kept = [b.column(i).slice(row, last - row) for i in range(b.num_columns - 1)]
                new = [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], arrow_runs), pa.array([m[2] for m in made], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *new], names=schema.fieldNames())

    return rows.mapInArrow(tidy(run), schema)
