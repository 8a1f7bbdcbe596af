"""Fill-in-middle: a text is cut into units, and its prefix, middle and suffix change places.

A ``Split`` pre-tokenizer isolates every match of a pattern, so it gives a text's units with their code-point
offsets and needs no vocabulary. The number of offsets is the number of units; the offsets at the drawn ranks cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from .common import col

#: One code point, line ends too.
CODE_POINT = r"(?m)."
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that the pre-tokenizer takes at once. Units of one code point never cross a block's end.
BLOCK = 256
#: Words whose numbers of units a worker remembers, and their greatest length; beyond that number it starts again.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 48
OUT = "struct<fim_text:string,form:string,n_units:long,prefix_chars:long,middle_chars:long>"


class Cutter:
    """Units of a text by their offsets.

    Units of one code point cross neither words nor blocks, so the units of a word are split once and remembered by their
    number; where a rank falls into a word, its offsets are split again. Other patterns are matched over whole texts.
    """

    def __init__(self, pattern: str = CODE_POINT) -> None:
        self.split = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.single = pattern == CODE_POINT
        self.memory: dict[str, int] = {}

    def ends(self, part: str) -> list[int]:
        step = BLOCK if self.single else max(len(part), 1)
        return [at + end for at in range(0, len(part), step) for _, (_, end) in self.split.pre_tokenize_str(part[at : at + step])]

    def count(self, word: str) -> int:
        pieces = self.split.pre_tokenize_str
        if len(word) > REMEMBERED_CHARS:
            return sum(len(pieces(word[at : at + BLOCK])) for at in range(0, len(word), BLOCK))
        got = self.memory.get(word)
        if got is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            got = self.memory[word] = len(pieces(word))
        return got

    def cut(self, text: str, ranks: Callable[[int], tuple[int, int] | None]) -> tuple[int, list[int]]:
        """How many units the text has, and the code points at which the units of the ranks that ``ranks`` asks for (given that number) end."""
        if not self.single:
            ends = [0, *self.ends(text)] if text else [0]
            return len(ends) - 1, [ends[r] for r in ranks(len(ends) - 1) or ()]
        words, get, slow = text.split(" "), self.memory.get, self.count
        space = slow(" ")
        sizes = np.fromiter((get(w) or slow(w) for w in words), np.int64, len(words)) + space
        sizes[-1] -= space  # no space follows the last word
        upto = np.cumsum(sizes)
        n = int(upto[-1])

        def place(rank: int) -> int:
            if rank == 0:
                return 0
            k = int(np.searchsorted(upto, rank))
            before = sum(map(len, words[:k])) + k
            return before + self.ends(words[k] + " ")[rank - 1 - (int(upto[k - 1]) if k else 0)]

        return n, [place(r) for r in ranks(n) or ()]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Raise unless every output can be read back: no mark may start within another, or within itself."""
    for a in marks:
        for b in marks:
            if not a or not b or any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(0 if a is not b else 1, len(a))):
                raise ValueError(f"marks {marks} overlap")
    if len(set(marks)) < 3:
        raise ValueError(f"marks {marks} must differ")


def rearrange(text: str, draws: tuple[int, int, int, int], cutter: Cutter, marks: tuple[str, str, str], plain_from: int, spm_below: int) -> tuple[str, str, int, int | None, int | None]:
    """Output, form, units, and code points of prefix and middle. Of four draws two cut, one decides whether, one decides how."""
    p, s, m = marks
    plain = not text or p in text or s in text or m in text or draws[2] % 100 >= plain_from
    n, places = cutter.cut(text, lambda n: None if plain else tuple(sorted((draws[0] % (n + 1), draws[1] % (n + 1)))))
    if plain:
        return text, "plain", n, None, None
    a, b = places
    if draws[3] % 100 < spm_below:
        return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}", "spm", n, a, b - a
    return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}", "psm", n, a, b - a


def draws(id_: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of an id: the first groups of a hash's digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20,
    marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), pattern: str = CODE_POINT,
) -> DataFrame:
    """All columns and rows of ``df``, plus ``fim_text``, ``form``, ``n_units``, ``prefix_chars`` and ``middle_chars``, which replace columns of those names.

    A prefix ends after the smaller of two drawn numbers of units, its middle after the larger. ``plain_from`` of 100 texts
    are rearranged, ``spm_below`` of 100 of those with the suffix first. Plain texts are whole and have no parts (nulls): the
    drawn ones, empty ones, and those that hold one of ``marks`` (prefix, suffix, middle) already. A null text is an empty
    one. Draws follow the id alone: repeated rows get one result, null ids draw like an empty one, an empty table stays
    empty, and reruns agree. A ``pattern`` other than single code points is matched over whole texts; what lies between matches is a unit too.
    """
    check_marks(marks)

    @F.pandas_udf(OUT)
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        cutter = Cutter(pattern)
        for texts, *drawn in batches:
            rows = [rearrange(t or "", d, cutter, marks, plain_from, spm_below) for t, d in zip(texts, zip(*drawn, strict=True), strict=True)]
            out = pd.DataFrame(rows, columns=["fim_text", "form", "n_units", "prefix_chars", "middle_chars"])
            yield out.astype({"n_units": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    new = ("fim_text", "form", "n_units", "prefix_chars", "middle_chars")
    held = F.struct(*[col(c).alias(c) for c in df.columns if c not in new]).alias("held")
    done = df.select(held, of(col(text_col), *draws(col(id_col), seed)).alias("out"))
    kept = [F.col("held")[c].alias(c) for c in df.columns if c not in new]
    return done.select(*kept, *[F.col("out")[c].alias(c) for c in new])


def restore(fim_text: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text, rebuilt from output and form alone."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(fim_text, F.lit(len(first) + 1))
        rest = F.split_part(body, F.lit(second), F.lit(2))
        return F.split_part(body, F.lit(second), F.lit(1)), F.split_part(rest, F.lit(m), F.lit(1)), F.split_part(rest, F.lit(m), F.lit(2))

    prefix, suffix, middle = parts(p, s)
    suffix_, prefix_, middle_ = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(fim_text)
