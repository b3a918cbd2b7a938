"""Language identification: known words first, else ever shorter character n-grams.

A word (a run of letters, lower-cased) that training saw adds its log frequency in each
language. An unseen word falls back to the longest character n-grams of which training saw any:
their mean log frequency stands for the word. The language with the largest sum wins, ties go to the
first in alphabetical order; the score is its share of the posterior under equal priors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.names import col, others, quoted, unused
from larkspur.llm.storage import write_table
from larkspur.llm.wordhash import SEGMENT, KeyTable, Symbols, room, small_batches, tidy

UNDETERMINED = "und"
#: What every count begins with, and the entries that a task counts before it hands them on.
SMOOTHING, HELD_ENTRIES = 0.5, 1 << 20
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


def _pieces(text: str, most: int) -> Iterator[str]:
    """A text in parts of about `most` characters that end between words; a longer word stays whole."""
    at = 0
    while at < len(text):
        to = min(at + most, len(text))
        if to < len(text):
            cut = to
            while cut > at and text[cut - 1].isalpha():
                cut -= 1
            if cut == at:
                cut = to
                while cut < len(text) and text[cut].isalpha():
                    cut += 1
            to = cut
        yield text[at:to]
        at = to


def letter_words(texts: list[str | None], most: int = SEGMENT) -> Iterator[tuple[int, int, Symbols, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, code points, starts and ends of words, first word of each text): words are runs of letters of the lower-cased texts. A text of over `most` characters comes in parts, as the same row again and again."""
    row = 0
    while row < len(texts):
        last, size, part = row, 0, []
        while last < len(texts) and (last == row or size + len(texts[last] or "") <= most):
            part.append((texts[last] or "").lower())
            size += len(part[-1])
            last += 1
        for run in [part] if size <= most or len(part) > 1 else ([x] for x in _pieces(part[0], most)):
            offsets = np.zeros(len(run) + 1, np.int64)
            np.cumsum([len(x) for x in run], out=offsets[1:])
            points = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), np.uint32)
            s = Symbols(points, offsets)
            yield row, last - row, s, *s.runs(_is_letter()[points])
        row = last


def _grams(s: Symbols, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the words, and the word of each."""
    made = np.maximum(ends - starts - n + 1, 0)
    word = np.repeat(np.arange(len(starts)), made)
    at = np.arange(len(word)) - np.repeat(np.cumsum(made) - made, made) + starts[word]
    return s.hashes(at, at + n), word


@dataclass
class Entries:
    """Words, or n-grams of one length: entry i has the languages codes[first[i]:first[i + 1]], and gains over `base`, the log frequency of what a language lacks."""

    table: KeyTable
    first: np.ndarray
    codes: np.ndarray
    gains: np.ndarray
    base: np.ndarray


@dataclass
class LanguageModel:
    """entries[n]: n = 0 for words, else for n-grams."""

    languages: list[str]
    entries: dict[int, Entries]

    def sums(self, s: Symbols, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Per text and language, the sum over words."""
        rows, wide = len(first) - 1, len(self.languages)
        text = np.repeat(np.arange(rows), np.diff(first))
        out = np.zeros((rows, wide))

        def add(e: Entries, at: np.ndarray, of: np.ndarray, share: np.ndarray | None) -> None:
            """Entries `at` of the texts `of`, each counting for its share (none: 1)."""
            n = e.first[at + 1] - e.first[at]
            inside = np.repeat(e.first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            gains = e.gains[inside] if share is None else e.gains[inside] * np.repeat(share, n)
            out.ravel()[:] += np.bincount(np.repeat(of, n) * wide + e.codes[inside], gains, rows * wide)
            out[:] += np.bincount(of, share, rows)[:, None] * e.base

        words = self.entries[0]
        at = words.table.find(s.hashes(starts, ends))
        add(words, at[at >= 0], text[at >= 0], None)
        left = np.flatnonzero(at < 0)
        for n in sorted((n for n in self.entries if n), reverse=True):
            e = self.entries[n]
            hashes, word = _grams(s, starts[left], ends[left], n)
            at = e.table.find(hashes)
            word, at = word[at >= 0], at[at >= 0]
            seen = np.bincount(word, minlength=len(left))
            add(e, at, text[left[word]], 1 / seen[word])
            left = left[seen == 0]
        return out


def least_count(counts: DataFrame, most: int) -> int:
    """The least count n such that at most `most` rows have it or more, from a histogram of a few hundred steps."""
    total, least = 0, 1 << 62
    for r in counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect():
        total += r["rows"]
        if total > most:
            break
        least = r["least"]
    return least


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", *, max_documents: int = 40_000, max_chars: int = 1 << 27, n_max: int = 4, salt_col: str = "doc_id") -> LanguageModel:
    """Learns from a sample of the rows with text and language, drawn by a hash of salt_col: about max_documents of them and max_chars characters at most.

    These two bound the model's size and what the driver and the workers hold, whatever the size of the corpus. All words and n-grams of the sample are in the
    model, in all its languages. Null texts and languages are left out. No rows give a model that finds UNDETERMINED everywhere.
    """
    rows = df.where(col(text_col).isNotNull() & col(lang_col).isNotNull()).select(col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"), col(salt_col).cast("string").alias("salt"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    share = min(1.0, max_documents / max(1, size["n"]), max_chars / max(1, size["chars"]))
    rows = rows.where(F.pmod(F.xxhash64("salt", F.lit("language")), F.lit(1 << 62)) < int(share * (1 << 62)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], tuple[KeyTable, np.ndarray]] = {}

        def found() -> Iterator[pa.RecordBatch]:
            for (kind, lang), (table, counts) in held.items():
                n = table.n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(table.keys[:n].view(np.int64)), pa.array([lang] * n, pa.string()), pa.array(counts[:n])], names=["kind", "key", "lang", "n"])
            held.clear()

        for b in small_batches(batches, 1024):
            langs = b.column("lang").to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs])
            for row, n, s, starts, ends, first in letter_words(b.column("text").to_pylist()):
                lang = np.repeat(of[row : row + n], np.diff(first))
                for kind in range(n_max + 1):
                    hashes, word = (s.hashes(starts, ends), np.arange(len(starts))) if kind == 0 else _grams(s, starts, ends, kind)
                    for k in np.unique(lang).tolist():
                        keys, times = np.unique(hashes[lang[word] == k], return_counts=True)
                        table, counts = held.get((kind, names[k]), (KeyTable(), np.zeros(0, np.int64)))
                        at = table.find(keys)
                        new = at < 0
                        at[new] = table.n + np.arange(np.count_nonzero(new))
                        table.add(keys[new])
                        counts = room(counts, table.n)
                        counts[at] += times
                        held[kind, names[k]] = table, counts
                if sum(t.n for t, _ in held.values()) > HELD_ENTRIES:
                    yield from found()
        yield from found()

    counted = rows.select("text", "lang").mapInArrow(tidy(count), "kind int, key long, lang string, n long").groupBy("kind", "key", "lang").agg(F.sum("n").alias("n"))
    # Flat columns of numbers, and a language's number for its name: some MB on the driver, by the bounds of the sample.
    table = write_table(counted, "language-entries")
    languages = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    number = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])[F.col("lang")] if languages else F.lit(0)
    found = table.select("kind", "key", number.cast("int").alias("code"), "n").toArrow()
    kinds, keys, codes, n = (found[c].to_numpy() for c in ("kind", "key", "code", "n"))
    entries = {}
    for kind in range(n_max + 1):
        at = np.flatnonzero(kinds == kind)
        hashes, code, counts = keys[at].view(np.uint64), codes[at], n[at].astype(float)
        order = np.lexsort((code, hashes))
        hashes, code, counts = hashes[order], code[order], counts[order]
        first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
        total = np.bincount(code, counts, len(languages)) + SMOOTHING * (len(first) + 1)
        gains = np.log((counts + SMOOTHING) / SMOOTHING)
        entries[kind] = Entries(KeyTable(hashes[first]), np.r_[first, len(hashes)].astype(np.int32), code.astype(np.int32), gains, np.log(SMOOTHING / total) if languages else np.zeros(0))
    return LanguageModel(languages, entries)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", *, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all of df) with lang_pred and score added in the place of columns of these names, in any case.

    Null texts and texts without a letter: `und`, score 0. Rows are scored one by one, so repeated rows stay.
    """
    names = others(keep or df.columns, ["lang_pred", "score"])
    (text,) = unused([*names, "lang_pred", "score"], "text_to_score")
    rows = df.select(*map(quoted, names), col(text_col).alias(text))
    schema = rows.select(*map(quoted, names), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in small_batches(batches, 2048):
            sums, words = np.zeros((b.num_rows, max(1, len(m.languages)))), np.zeros(b.num_rows, np.int64)
            if m.languages:
                for row, n, s, starts, ends, first in letter_words(b.column(len(names)).to_pylist()):
                    sums[row : row + n] += m.sums(s, starts, ends, first)
                    words[row : row + n] += np.diff(first)
            found = words > 0
            p = np.exp(sums - sums.max(axis=1, keepdims=True))
            langs = [m.languages[k] if f else UNDETERMINED for k, f in zip(sums.argmax(axis=1).tolist(), found.tolist(), strict=True)]
            scores = np.where(found, 1 / p.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(langs, pa.string()), pa.array(scores)], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(tidy(score), schema)
