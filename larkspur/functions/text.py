"""Text columns: Unicode blanks, tokens, numbers, quotes. All but the Han tokenizer are native expressions."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that the tokenizer leaves out.
STOP_WORDS = (
    "的 了 是 在 和 与 或 而 则 也 都 被 把 对 为 其 此 该 这 那 有 个 上 中 下 内 外 等 及 以 并 但 由 于 从 到 至 者 所 之 它 他 她 我 你 "
    "可以 可能 通常 一般 因此 所以 由于 如果 虽然 但是 以及 一 二 三 不 很 会 能 要 就 还 又 使 让 多 少"
).split()
#: Headings of the sections that end an article's body.
TAIL_HEADINGS = ("参见", "参考文献", "外部連結", "外部链接", "延伸閱讀", "延伸阅读", "注釋", "注释")
BLANK = r"(?U)[\s\x{FEFF}]"


def utrim(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, rf"^(?:{BLANK})+|(?:{BLANK})+$", "")


def is_blank(c: Column) -> Column:
    return F.length(F.regexp_replace(c, rf"(?:{BLANK})+", "")) == 0


def quote_form(c: Column) -> Column:
    """The form in which quotes are compared: without any white space."""
    return F.regexp_replace(c, rf"(?:{BLANK})+", "")


def numbers(c: Column) -> Column:
    """Runs of ASCII digits with an optional decimal part; signs and separators don't belong to them."""
    return F.regexp_extract_all(c, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def without_ids(c: Column, ids: Column) -> Column:
    """The text with every literal id removed, longer ids first."""
    longest = F.array_sort(ids, lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, c, lambda text, i: F.when(F.length(i) > 0, F.replace(text, i, F.lit(""))).otherwise(text))


def contains(text: Column, part: Column) -> Column:
    """A binary substring test that is false on nulls; the empty string is in every text."""
    return F.coalesce(F.contains(text, part), F.lit(False))


def first_line(c: Column) -> Column:
    return F.trim(F.substring_index(c, "\n", 1))


def keep_term(t: Column) -> Column:
    return (t != "") & ((F.length(t) > 1) | ~t.rlike("^[a-z0-9]$")) & ~t.isin(*STOP_WORDS)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, without stop words and single ASCII letters or digits. A run of Han characters stays one token: see han_tokens."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), keep_term)


def segment(text: str, lexicon: set[str], longest: int) -> list[str]:
    """Words of a run: at each place the longest entry of the lexicon for Han characters, else one character; other runs stay whole."""
    out, i = [], 0
    while i < len(text):
        if not "\u4e00" <= text[i] <= "\u9fff":
            j = i
            while j < len(text) and not "\u4e00" <= text[j] <= "\u9fff":
                j += 1
        else:
            j = next((j for j in range(min(len(text), i + longest), i + 1, -1) if text[i:j] in lexicon), i + 1)
        out.append(text[i:j])
        i = j
    return out


def han_tokens(c: Column, lexicon: Iterable[str]) -> Column:
    """tokens(c) with runs of Han characters cut by forward maximum matching against a lexicon (a bounded list, sent to the workers)."""
    words = {w.lower() for w in lexicon}
    longest = max(map(len, words), default=1)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(runs: pd.Series) -> pd.Series:
        return runs.map(lambda r: None if r is None else [w for x in r for w in segment(x, words, longest)])

    return F.filter(cut(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), keep_term)


def term_freq(terms: Column) -> Column:
    """A map from each term to how often it occurs."""
    distinct = F.array_distinct(terms)
    return F.map_from_arrays(distinct, F.transform(distinct, lambda t: F.size(F.filter(terms, lambda x: x == t))))
