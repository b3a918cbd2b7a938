"""Texts to the inputs of BERT-like models: words cut by a vocabulary, greedily, with padding and masks by batch."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np

#: Ideographs that stand as words of their own (fixed values: the blocks of CJK unified and compatibility ideographs that such vocabularies were made with).
IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))


def _kind(c: str) -> str:
    """drop, blank, alone (a word of its own) or part (of a longer word)."""
    code, category = ord(c), unicodedata.category(c)
    if c in "\t\n\r" or category[0] == "Z":
        return "blank"
    if c == "�" or category[0] == "C":
        return "drop"
    ascii_mark = code < 128 and not c.isalnum()
    return "alone" if ascii_mark or category[0] == "P" or any(a <= code <= b for a, b in IDEOGRAPHS) else "part"


@dataclass
class Subwords:
    """A tokenizer over a vocabulary file (one piece a line, its id is the line's number): pieces inside a word begin with ##.

    A word is its longest piece of the vocabulary, then the longest that follows, and so on; where none fits, or over `longest` characters, it is [UNK] as a whole.
    Texts are cut to `most` tokens, the marks at both ends included; of a pair, the longer text is cut. Null texts are empty.
    """

    vocabulary: str
    lower: bool = True
    most: int = 512
    longest: int = 100
    _kinds: dict[str, str] = field(default_factory=dict, repr=False)

    @cached_property
    def ids(self) -> dict[str, int]:
        with open(self.vocabulary, encoding="utf-8", newline="\n") as f:
            ids = {line.rstrip("\r\n"): i for i, line in enumerate(f)}
        if lacking := [x for x in ("[PAD]", "[UNK]", "[CLS]", "[SEP]") if x not in ids]:
            raise ValueError(f"the vocabulary lacks {', '.join(lacking)}")
        return ids

    @cached_property
    def _tries(self) -> tuple[dict, dict]:
        """Two tries of characters, for the beginnings of words and for what follows; "" holds a piece's id."""
        tries: tuple[dict, dict] = ({}, {})
        for piece, i in self.ids.items():
            inner = piece.startswith("##") and len(piece) > 2
            node = tries[inner]
            for c in piece[2:] if inner else piece:
                node = node.setdefault(c, {})
            node[""] = i
        # "##" pieces may begin a word too, spelt as they are: marks are words of their own, so no text comes to that.
        return tries

    def words(self, text: str) -> list[str]:
        text = text or ""
        if self.lower:
            # Accents go with the case, as in uncased models.
            text = "".join([c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"]).lower()
        out: list[str] = []
        for c in text:
            kind = self._kinds.get(c) or self._kinds.setdefault(c, _kind(c))
            out.append(c if kind == "part" else f" {c} " if kind == "alone" else " " if kind == "blank" else "")
        return "".join(out).split(" ")

    def cut(self, word: str) -> list[int]:
        """The ids of a word's pieces."""
        if len(word) > self.longest:
            return [self.ids["[UNK]"]]
        out, at = [], 0
        while at < len(word):
            node, found = self._tries[at > 0], None
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if "" in node:
                    found = (node[""], i + 1)
            if found is None:
                return [self.ids["[UNK]"]]
            out.append(found[0])
            at = found[1]
        return out

    def tokens(self, text: str, most: int | None = None) -> list[int]:
        """The first `most` ids of a text, or all: words after these aren't cut."""
        out: list[int] = []
        for word in self.words(text):
            if most is not None and len(out) >= most:
                break
            out += self.cut(word)
        return out[:most]

    def _batch(self, rows: list[tuple[list[int], list[int]]]) -> dict[str, np.ndarray]:
        width = max((len(ids) for ids, _ in rows), default=0)
        out = {name: np.zeros((len(rows), width), np.int64) for name in ("input_ids", "attention_mask", "token_type_ids")}
        out["input_ids"][:] = self.ids["[PAD]"]
        for k, (ids, kinds) in enumerate(rows):
            out["input_ids"][k, : len(ids)], out["attention_mask"][k, : len(ids)], out["token_type_ids"][k, : len(ids)] = ids, 1, kinds
        return out

    def texts(self, texts: list[str]) -> dict[str, np.ndarray]:
        """[CLS] text [SEP] by row, padded to the longest."""
        begin, end = self.ids["[CLS]"], self.ids["[SEP]"]
        rows = [[begin, *self.tokens(t, self.most - 2), end] for t in texts]
        return self._batch([(ids, [0] * len(ids)) for ids in rows])

    def pairs(self, pairs: list[tuple[str, str]]) -> dict[str, np.ndarray]:
        """[CLS] a [SEP] b [SEP] by row; what stands after the first [SEP] is of type 1."""
        begin, end, room = self.ids["[CLS]"], self.ids["[SEP]"], self.most - 3
        rows = []
        for pair in pairs:
            a, b = (self.tokens(t) for t in pair)
            if len(a) + len(b) > room:
                # The shorter one keeps what it has up to half the room, the longer one gets the rest; of equals the second counts as longer.
                less = min(len(a), len(b), room // 2)
                a, b = (a[: room - less], b[:less]) if len(a) > len(b) else (a[:less], b[: room - less])
            rows.append(([begin, *a, end, *b, end], [0] * (len(a) + 2) + [1] * (len(b) + 1)))
        return self._batch(rows)
