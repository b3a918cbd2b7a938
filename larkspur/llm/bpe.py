"""Byte-level BPE: encoding word by word with a contiguous array of ranks, and decoding.

The tokenizer file's path is a parameter. Texts are cut at single blanks between words, and before a dot or comma after a letter or digit,
where no token can cross. What lies between repeats so often that each piece is encoded once and kept, under its 64-bit hash, in
a bounded table; a run of texts is cut, looked up and put together by whole arrays. New words are merged many at a time, each in its row of
parts and ranks.
"""

from __future__ import annotations

import array
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.names import col, others, quoted, unused
from larkspur.llm.wordhash import SEGMENT, KeyTable, Symbols, small_batches, room, text_bytes, text_runs, tidy

#: Fixed value: the pattern that cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words of at most so many bytes are merged in rows, side by side; longer ones by themselves.
ROW = 40
#: A word longer than this is merged with a heap instead of scans.
LONG_WORD = 300
#: Pieces that a worker keeps (about 45 bytes each), and ids. When there are more, it starts anew.
KEPT_PIECES, KEPT_IDS = 1 << 19, 1 << 21

# A single space between two characters that aren't blank: the token before ends there and the next begins with it.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACE = np.zeros(256, bool)
_SPACE[[10, 32]] = True
#: Bytes of blanks other than space and line feed, and first bytes of longer ones.
_ODD = np.zeros(256, bool)
_ODD[[9, 11, 12, 13, 28, 29, 30, 31]] = True
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ",."]] = True
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in tokenizer files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_settings(path: str) -> dict:
    """A tokenizer file's JSON. Files with settings that this module doesn't follow are an error."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    wrong = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    wrong += ["normalizer"] if spec.get("normalizer") else []
    wrong += ["pre_tokenizer"] if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) else []
    wrong += ["decoder"] if (spec.get("decoder") or {}).get("type", "ByteLevel") != "ByteLevel" else []
    wrong += ["added_tokens"] if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")) else []
    if model.get("type", "BPE") != "BPE" or wrong:
        raise ValueError(f"{path}: not a plain byte-level BPE file: {', '.join(wrong) or model.get('type')}")
    return spec


def _wide_blanks(b: np.ndarray) -> np.ndarray:
    """Where the blanks of two and three bytes begin: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F and U+3000."""
    at = np.flatnonzero(_LEAD[b])
    if not len(at):
        return at
    one = b[np.minimum(at + 1, len(b) - 1)]
    two = b[np.minimum(at + 2, len(b) - 1)]
    first = b[at]
    found = (first == 0xC2) & ((one == 0x85) | (one == 0xA0))
    found |= (first == 0xE1) & (one == 0x9A) & (two == 0x80)
    found |= (first == 0xE2) & (one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    found |= (first == 0xE2) & (one == 0x81) & (two == 0x9F)
    found |= (first == 0xE3) & (one == 0x80) & (two == 0x80)
    return at[found]


class Encoder:
    """Texts to ids. word_ids, of a subclass, gives the ids of new words, as one array and how many each word has."""

    def __init__(self, specials: dict[str, int]):
        self.specials = specials
        self.special_bytes = [s.encode() for s in specials]
        self.cut_specials = re.compile("(" + "|".join(re.escape(t) for t in sorted(specials, key=len, reverse=True)) + ")") if specials else None
        self.pattern = regex.compile(PATTERN)
        self._forget()

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def _forget(self) -> None:
        self.table, self.starts, self.counts = KeyTable(), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.n_ids = np.zeros(1 << 10, np.uint32), 0

    def piece_words(self, piece: str) -> list[str]:
        if piece.isalpha() or piece[:1] == " " and piece[1:].isalpha():
            return [piece]
        return self.pattern.findall(piece)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces as one array, and how many each has. A special token is a piece of its own."""
        words, made = [], []
        for p in pieces:
            found = [p] if p in self.specials else self.piece_words(p)
            words += found
            made.append(len(found))
        ids, counts = self.word_ids(words)
        ends = np.cumsum(made)
        total = np.r_[0, np.cumsum(counts)]
        return ids, total[ends] - total[ends - made]

    def _keep(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, counts = self._encode_pieces(pieces)
        n = self.table.n
        self.table.add(hashes)
        self.starts, self.counts = room(self.starts, self.table.n), room(self.counts, self.table.n)
        self.starts[n : self.table.n], self.counts[n : self.table.n] = self.n_ids + np.cumsum(counts) - counts, counts
        self.ids = room(self.ids, self.n_ids + len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def _places(self, hashes: np.ndarray, piece: Callable[[int], str]) -> np.ndarray:
        places = self.table.find(hashes)
        new = np.flatnonzero(places < 0)
        if len(new):
            found, at = np.unique(hashes[new], return_index=True)
            self._keep(found, [piece(i) for i in new[at].tolist()])
            places[new] = self.table.find(hashes[new])
        return places

    def _slow_pieces(self, text: str) -> list[str]:
        """Pieces of any text, special tokens among them."""
        parts = self.cut_specials.split(text) if self.cut_specials else [text]
        return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else _CUT.split(part)) if p]

    def _run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, and where those of each begin."""
        if self.table.n > KEPT_PIECES or self.n_ids > KEPT_IDS:
            self._forget()
        rows = len(offsets) - 1
        space, begins = _SPACE[data], offsets[:-1][np.diff(offsets) > 0]
        # Texts that have other cuts than single blanks, or special tokens.
        pairs = np.flatnonzero(space[1:] & space[:-1])
        ends = offsets[1:][np.diff(offsets) > 0] - 1
        odd = np.concatenate([pairs, begins[space[begins]], ends[space[ends]], np.flatnonzero(_ODD[data]), _wide_blanks(data)])
        slow = np.zeros(rows, bool)
        slow[np.searchsorted(offsets, odd, "right") - 1] = True
        whole = data.tobytes()
        if any(s in whole for s in self.special_bytes):
            slow |= [any(s in whole[a:b] for s in self.special_bytes) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        cut = space
        cut[begins] = True
        marks = np.flatnonzero(_MARK[data])
        marks = marks[marks > 1]
        before, lead = data[marks - 1], data[marks - 2]
        # After an ASCII letter or digit, or a letter from U+00C0 to U+00FF (all but two signs).
        cut[marks[_ALNUM[before] | (lead == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)]] = True
        starts = np.flatnonzero(cut)
        stops = np.r_[starts[1:], len(data)]
        text_of = np.searchsorted(offsets, starts, "right") - 1
        if slow.any():
            fast = ~slow[text_of]
            starts, stops, text_of = starts[fast], stops[fast], text_of[fast]
        places = self._places(Symbols(data, offsets).hashes(starts, stops), lambda i: whole[starts[i] : stops[i]].decode())
        if slow.any():
            pieces, owner = [], []
            for k in np.flatnonzero(slow).tolist():
                found = self._slow_pieces(whole[offsets[k] : offsets[k + 1]].decode())
                pieces += found
                owner += [k] * len(found)
            raw = [p.encode() for p in pieces]
            at = np.r_[0, np.cumsum([len(x) for x in raw], dtype=np.int64)]
            more = self._places(Symbols(np.frombuffer(b"".join(raw), np.uint8), at).hashes(at[:-1], at[1:]), pieces.__getitem__)
            places, text_of = np.concatenate([places, more]), np.concatenate([text_of, np.array(owner, np.int64)])
            order = np.argsort(text_of, kind="stable")
            places, text_of = places[order], text_of[order]
        counts = self.counts[places]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[places] - (ends - counts), counts) + np.arange(total)]
        first = np.r_[0, ends][np.searchsorted(text_of, np.arange(rows + 1))]
        return ids, first

    def _long_piece(self, piece: str) -> np.ndarray:
        """The ids of a piece that is too long to be kept, some words at a time."""
        found, words = [], []
        for m in self.pattern.finditer(piece):
            words.append(m[0])
            if len(words) == 100_000:
                found.append(self.word_ids(words)[0])
                words = []
        return np.concatenate([*found, self.word_ids(words)[0]])

    def _long_text(self, text: str) -> np.ndarray:
        """The ids of one text, some pieces of about SEGMENT bytes at a time."""
        out = []
        for k, part in enumerate(self.cut_specials.split(text) if self.cut_specials else [text]):
            if k % 2:
                out.append(np.array([self.specials[part]], np.uint32))
                continue
            held, size = [], 0
            for piece in _CUT.split(part):
                if len(piece) > SEGMENT // 4:
                    out += [self._join(held), self._long_piece(piece)]
                    held, size = [], 0
                else:
                    held.append(piece)
                    size += len(piece)
                    if size > SEGMENT // 2:
                        out.append(self._join(held))
                        held, size = [], 0
            out.append(self._join(held))
        return np.concatenate(out)

    def _join(self, pieces: list[str]) -> np.ndarray:
        """The ids of neighbouring pieces of a text."""
        raw = "".join(pieces).encode()
        return self._run(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0] if raw else np.zeros(0, np.uint32)

    def encode_texts(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, rows, ids, where those of each text begin and the end) of a string column, null as empty, about a MB at a time."""
        data, offsets = text_bytes(texts)
        for row, last in text_runs(offsets, SEGMENT):
            part = data[offsets[row] : offsets[last]]
            if len(part) <= SEGMENT:
                yield row, last - row, *self._run(part, offsets[row : last + 1] - offsets[row])
            else:
                ids = self._long_text(part.tobytes().decode())
                yield row, 1, ids, np.array([0, len(ids)])

    def encode(self, text: str) -> np.ndarray:
        found = [ids for _, _, ids, _ in self.encode_texts(pa.array([text], pa.large_string()))]
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


class Bpe(Encoder):
    """The codec of a byte-level BPE tokenizer file (vocabulary, merges and special tokens in JSON)."""

    def __init__(self, path: str):
        spec = read_settings(path)
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        super().__init__(specials)
        chars = byte_characters()
        vocab = spec["model"]["vocab"]
        tokens = {i: bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode() for token, i in vocab.items()}
        tokens |= {i: t.encode() for t, i in specials.items()}
        self.bytes_of = [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]
        self.byte_ids = np.array([vocab[c] for c in sorted(chars, key=chars.get)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.never = len(pairs)
        codes = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(codes)
        self._codes, self._order = codes[order], order
        self._merged = np.array([vocab[a + b] for a, b in pairs] + [0], np.int64)
        left, right = np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij")
        self._first = self.ranks(left.ravel(), right.ravel()).reshape(256, 256)
        self._scalar: dict[int, int] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of parts; `never` if they don't merge."""
        if not self.never:
            return np.zeros(len(a), np.int64)
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self._codes, code), self.never - 1)
        return np.where(self._codes[at] == code, self._order[at], self.never)

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of like length at a time."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(x) for x in raw], np.int64)
        out: list[np.ndarray | None] = [None] * len(raw)
        width = np.minimum(-(-sizes // 8) * 8, ROW + 1)
        for k in np.flatnonzero((sizes > ROW) | [w in self.specials for w in words]).tolist():
            width[k] = -1
            out[k] = np.array([self.specials[words[k]]] if words[k] in self.specials else self.merge_long(raw[k]), np.uint32)
        counts = np.array([0 if x is None else len(x) for x in out], np.int64)
        blocks = []
        for w in np.unique(width[width > 0]).tolist():
            at = np.flatnonzero(width == w)
            for i in range(0, len(at), 1 << 15):
                some = at[i : i + (1 << 15)]
                parts, n = self.merge_rows(np.frombuffer(b"".join([raw[k].ljust(w, b"\0") for k in some.tolist()]), np.uint8).reshape(len(some), w), sizes[some])
                counts[some] = n
                blocks.append((some, parts, n))
        starts = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        for some, parts, n in blocks:
            inside = np.arange(parts.shape[1]) < n[:, None]
            ids[(starts[some][:, None] + np.arange(parts.shape[1]))[inside]] = parts[inside]
        for k, x in enumerate(out):
            if x is not None:
                ids[starts[k] : starts[k] + len(x)] = x
        return ids, counts

    def merge_rows(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as rows of bytes, to rows of ids and how many each has.

        A row holds the parts between a word's boundaries, another the rank of each part with the next. In each round every word that has a
        pair to merge deletes the boundary of its least rank, the first of equals, and the ranks on either side are looked up anew.
        """
        n, width = raw.shape
        columns = np.arange(width)
        out, left = np.zeros((n, width), np.int64), sizes.astype(np.int64).copy()
        parts = self.byte_ids[raw]
        ranks = np.full((n, width), self.never, np.int64)
        ranks[:, :-1] = self._first[raw[:, :-1], raw[:, 1:]]
        ranks[columns >= sizes[:, None] - 1] = self.never
        word, size = np.arange(n), left.copy()
        while len(word):
            at = ranks.argmin(axis=1)
            row = np.arange(len(word))
            least = ranks[row, at]
            go = least < self.never
            if not go.all():
                out[word[~go]], left[word[~go]] = parts[~go], size[~go]
                word, size, parts, ranks, at, least = word[go], size[go], parts[go], ranks[go], at[go], least[go]
                row = np.arange(len(word))
                if not len(word):
                    break
            parts[row, at] = self._merged[least]
            after = columns > at[:, None]
            parts = np.take_along_axis(parts, np.minimum(columns + after, width - 1), 1)
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= at[:, None]), width - 1), 1)
            size -= 1
            for here in (at - 1, at):
                known = np.flatnonzero((here >= 0) & (here + 1 < size))
                ranks[known, here[known]] = self.ranks(parts[known, here[known]], parts[known, here[known] + 1])
            none = np.flatnonzero(at + 1 >= size)
            ranks[none, at[none]] = self.never
        return out, left

    def _rank(self, a: int, b: int) -> int:
        if not self._scalar:
            self._scalar = dict(zip(self._codes.tolist(), self._order.tolist(), strict=True))
        return self._scalar.get(a << 32 | b, self.never)

    def merge_long(self, raw: bytes) -> list[int]:
        """parts holds what lies between the boundaries of one word, ranks[i] the rank of parts[i] with parts[i + 1]. Over LONG_WORD bytes a heap finds the least rank: the same ids in n log n."""
        parts = self.byte_ids[np.frombuffer(raw, np.uint8)].tolist()
        if len(parts) > LONG_WORD:
            return self._merge_by_heap(array.array("i", parts))
        never = self.never
        ranks = [self._rank(a, b) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == never:
                break
            i = ranks.index(least)
            parts[i] = int(self._merged[least])
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = self._rank(parts[i - 1], parts[i])
            if i < len(ranks):
                ranks[i] = self._rank(parts[i], parts[i + 1])
        return parts

    def _merge_by_heap(self, parts: array.array) -> list[int]:
        """A heap of rank and left part as one integer, where entries that no longer hold are skipped."""
        n, gone = len(parts), -1
        after, before = array.array("i", [*range(1, n), gone]), array.array("i", [gone, *range(n - 1)])
        heap = [r << 32 | i for i in range(n - 1) if (r := self._rank(parts[i], parts[i + 1])) < self.never]
        heapq.heapify(heap)
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << 32)
            j = after[i]
            if parts[i] == gone or j == gone or self._rank(parts[i], parts[j]) != rank:
                continue
            parts[i], parts[j] = int(self._merged[rank]), gone
            after[i] = after[j]
            if after[i] != gone:
                before[after[i]] = i
                if (r := self._rank(parts[i], parts[after[i]])) < self.never:
                    heapq.heappush(heap, r << 32 | i)
            if (h := before[i]) != gone and (r := self._rank(parts[h], parts[i])) < self.never:
                heapq.heappush(heap, r << 32 | h)
        return [p for p in parts if p != gone]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODECS: dict[str, Bpe] = {}


def codec(path: str) -> Bpe:
    """One for each file and Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Bpe(path)
    return _CODECS[path]


def encode(df: DataFrame, tokenizer: str, *, text_col: str = "text", ids: bool = True, digests: bool = False, decoded: bool = False) -> DataFrame:
    """df with `ids` (array<int>) and n_tokens added; with digests, ids_sha256 and decoded_sha256 as well; with decoded, the text that the ids decode to. Columns of these names, in any case, are replaced.

    tokenizer: the path of the file on every executor; a file with settings other than plain byte-level BPE is an error. Null text: no ids.
    Texts are encoded row by row, whole; a worker holds a bounded table of pieces (told apart by 64-bit hashes), no more. Words over LONG_WORD bytes
    are merged with a heap instead of scans of the rank array, to the same ids. The digests are of the ids as little-endian unsigned 32-bit
    integers and of the text decoded from them, in UTF-8.
    """
    new = {"ids": "array<int>"} if ids else {}
    new |= {"n_tokens": "long"} | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {}) | ({"decoded": "string"} if decoded else {})
    names = others(df.columns, new)
    (text,) = unused([*names, *new], "text_to_encode")
    rows = df.select(*map(quoted, names), col(text_col).alias(text))
    schema = rows.select(*map(quoted, names), *[F.lit(None).cast(t).alias(c) for c, t in new.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in small_batches(batches):
            for row, n, found, first in c.encode_texts(b.column(len(names))):
                columns = [b.column(i).slice(row, n) for i in range(len(names))]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found.view(np.int32))))
                columns.append(pa.array(np.diff(first), pa.int64()))
                parts = [found[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)] if digests or decoded else []
                back = [c.decode(x) for x in parts]
                if digests:
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()))
                    columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()))
                if decoded:
                    columns.append(pa.array(back, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *new])

    return rows.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, tokenizer: str, *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df with the text of ids_col added as out_col (a column of that name, in any case, is replaced); null ids give null."""
    names = others(df.columns, [out_col])
    (ids,) = unused([*names, out_col], "ids_to_decode")
    rows = df.select(*map(quoted, names), col(ids_col).alias(ids))
    schema = rows.select(*map(quoted, names), F.lit("").alias(out_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in small_batches(batches):
            found = b.column(len(names))
            texts = [None if x is None else c.decode(x.values.to_numpy(zero_copy_only=False)) for x in found]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(texts, pa.string())], names=[*names, out_col])

    return rows.mapInArrow(tidy(run), schema)
