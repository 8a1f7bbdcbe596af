"""Token counts of a unigram tokenizer without segmentations: Aho-Corasick matches feed a Viterbi of score and count.

The vocabulary and scores come from a public piece file. White space splits a text into words, each with its
leading mark, and no piece crosses words, so the best segmentation of a text is that of its words and a word's
count can be remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the tokenizer: the mark of a word's start, the penalty of an unknown character, white space.
MARK, UNKNOWN_PENALTY = "▁", 10.0
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Words whose counts a worker remembers, and their greatest length; beyond that number it starts again.
REMEMBERED, REMEMBERED_CHARS = 1_000_000, 48
NONE = float("-inf")

_split = re.compile(f"[{WHITE}]+").split
_odd_space = re.compile("[\x1c-\x1f]").search  # str.split takes these for white space too


class Vocabulary(NamedTuple):
    pieces: list[tuple[str, float]]
    unknown: int
    byte_fallback: bool


def read_vocabulary(path: str = PIECES) -> Vocabulary:
    """Pieces and scores of a public piece file, as a unigram vocabulary. The driver reads it and sends it to workers; its size is the file's."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    return Vocabulary([(p.id_to_piece(i), p.get_score(i)) for i in ids], p.unk_id(), any(p.is_byte(i) for i in ids))


class PieceCounter:
    """Counts pieces exactly as the unigram model does on words that each carry their mark."""

    def __init__(self, v: Vocabulary) -> None:
        self.matches = ahocorasick.Automaton()
        for piece, score in v.pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in v.pieces) - UNKNOWN_PENALTY
        known = {p for p, _ in v.pieces}
        self.bytes = v.byte_fallback and all(f"<0x{b:02X}>" in known for b in range(256))
        self.single = {p for p in known if len(p) == 1}
        self.memory: dict[str, int] = {}

    def segment_count(self, word: str) -> int:
        """The count of the best segmentation. Of equal scores the earliest start wins, and an unknown character comes last.

        Matches come by end, and of one end the longest first.
        """
        n = len(word)
        best, count = [0.0] + [NONE] * n, [0] * (n + 1)
        if self.single.issuperset(word):  # no unknown character
            for at, (length, score) in self.matches.iter(word):
                at += 1
                total = best[at - length] + score
                if total > best[at]:
                    best[at], count[at] = total, count[at - length] + 1
            return count[n]
        ending: dict[int, list[tuple[int, float]]] = {}
        for at, m in self.matches.iter(word):
            ending.setdefault(at + 1, []).append(m)
        odd = [False] * (n + 1)
        for end, c in enumerate(word, 1):
            for length, score in ending.get(end, ()):
                total = best[end - length] + score
                if total > best[end]:
                    best[end], count[end] = total, count[end - length] + 1
            if c not in self.single:
                total = best[end - 1] + self.unknown
                if total > best[end]:
                    best[end], odd[end] = total, True
                    count[end] = count[end - 1] + (len(c.encode("utf-8", "surrogatepass")) if self.bytes else not odd[end - 1])
        return count[n]

    def word(self, word: str) -> int:
        got = self.memory.get(word)
        if got is None:
            marked = word if word[0] == MARK else MARK + word
            got = sum(map(self.segment_count, re.findall(f"{MARK}[^{MARK}]*", marked)))
            if len(word) <= REMEMBERED_CHARS:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = got
        return got

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        parts: Iterable[str] = filter(None, _split(text)) if _odd_space(text) else text.split()
        get, slow = self.memory.get, self.word
        return sum([get(w) or slow(w) for w in parts])


#: The worker's counter, by a digest of its vocabulary. Workers outlive queries, so only the last one is held.
_counter: dict[str, PieceCounter] = {}


def _counter_of(digest: str, v: Vocabulary) -> PieceCounter:
    if digest not in _counter:
        _counter.clear()
        _counter[digest] = PieceCounter(v)
    return _counter[digest]


def count_tokens(df: DataFrame, text_col: str = "text", path: str = PIECES, out_col: str = "n_tokens") -> DataFrame:
    """All columns and rows of ``df``, plus ``out_col`` (long), which replaces a column of that name.

    Null, empty and white-space texts count zero; repeated rows count alike; an empty table stays empty.
    """
    read = read_vocabulary(path)
    digest = hashlib.sha256(repr(read).encode("utf-8", "surrogatepass")).hexdigest()
    vocabulary = df.sparkSession.sparkContext.broadcast(read)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter_of(digest, vocabulary.value)
        for texts in batches:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    return df.withColumn(out_col, of(F.col(text_col)))
