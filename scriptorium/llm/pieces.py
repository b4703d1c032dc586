"""Oversized texts to pieces under a token limit, by content-defined chunking.

A rolling hash over the last WINDOW words of the text marks landmarks, about LANDMARKS to
a piece. A piece ends at the first landmark between its least and its greatest size,
moved to the best natural boundary near it: a paragraph's end before a line's, a
sentence's, a word's. Without a landmark the best boundary with the smallest hash is
taken; inside an unbroken run, a token's end between two characters. As landmarks depend
on the words around them only, an edit alters the pieces it touches and their neighbours,
after which the cuts fall in the same places again.

A piece is a range of the text's own token ids. The next piece starts `overlap` tokens
before the last one's end (up to three more where that would split a character), so
consecutive pieces share these ids.

Defined cases: null and empty texts have no piece; a text within the limit is one piece;
whole texts are cut, however long; an overlap of half the limit or more is an error;
repeated rows are cut each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.tokens import Tokenizer
from scriptorium.llm.transducer import Encoder
from scriptorium.llm.words import mix, word_hashes

WINDOW = 8
LANDMARKS = 8
#: Boundaries from worst to best.
LEVELS = ["token", "mark", "word", "sentence", "line", "paragraph", "end"]
_BREAK = r"(?:\r\n|\n|\r| | |\x85)"
_PARAGRAPH = re.compile(r"[^\S\r\n]*" + _BREAK + r"[^\S\r\n]*" + _BREAK)
_LINE = re.compile(r"[^\S\r\n]*" + _BREAK)
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?=\s)|(?<=[。！？])[」』）]*(?![。！？])")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Limit:
    limit_id: int
    max_tokens: int
    overlap: int

    def __post_init__(self) -> None:
        if not 0 <= self.overlap * 2 < self.max_tokens:
            raise ValueError("the overlap must be less than half the limit")


class Cutter:
    """Cuts texts with one encoder."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        tokens = encoder.transducer.tokens
        self.tokens = tokens
        self.inside = {i for i, t in tokens.items() if 0x80 <= t[0] <= 0xBF}  # begins within a character

    def _boundaries(self, text: str, words: list[str], ends: np.ndarray) -> np.ndarray:
        """The level of the boundary after each word of the pattern.

        Cuts fall before white space, never within it, so that a piece has the same
        tokens when it is encoded alone.
        """
        space = np.fromiter((w[0].isspace() for w in words), bool, len(words))
        level = np.fromiter((not w.isspace() for w in words), np.int8, len(words))
        level[:-1] += level[:-1] * space[1:]
        for rank, found, side in ((3, _SENTENCE, 1), (4, _LINE, 0), (5, _PARAGRAPH, 0)):
            places = np.fromiter((m.end() if side else m.start() for m in found.finditer(text)), np.int64)
            if len(places):
                at = np.searchsorted(ends, places, side="right") - 1
                at = at[(at >= 0) & (level[at] > 0)]
                level[at] = np.maximum(level[at], rank)
        return level

    def cut(self, text: str, limit: Limit) -> list[tuple]:
        """(start_token, n_tokens, start_char, end_char, cut_at) of each piece."""
        encoder = self.encoder
        words = encoder.pattern.findall(text)
        lists = [encoder.piece(w) for w in words]
        total = sum(map(len, lists))
        if not total:
            return []
        if total <= limit.max_tokens:
            return [(0, total, 0, len(text), "end")]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = [i for x in lists for i in x]
        ends_t = np.cumsum(lengths)
        ends_c = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        level = self._boundaries(text, words, ends_c)
        hashes = word_hashes(words)
        rolled = np.zeros_like(hashes)
        factor = np.uint64(1)
        for back in range(min(WINDOW, len(words))):
            rolled[back:] += hashes[: len(hashes) - back] * factor
            factor = np.uint64(int(factor) * int(_MULTIPLIER) & 0xFFFFFFFFFFFFFFFF)
        rolled = mix(rolled)
        spacing = max(1.0, limit.max_tokens / LANDMARKS * len(words) / total)
        landmark = rolled < np.uint64(int(2**64 / (spacing + 1)))

        def char_at(token: int) -> int:
            w = int(np.searchsorted(ends_t, token, side="right"))
            if w == len(words):
                return len(text)
            first = int(ends_t[w] - lengths[w])
            start = int(ends_c[w] - len(words[w]))
            return start + len(b"".join(self.tokens[i] for i in ids[first:token]).decode("utf-8", "ignore"))

        out, start = [], 0
        done = 0
        while True:
            if total - start <= limit.max_tokens:
                out.append((start, total - start, char_at(start), len(text), "end"))
                return out
            top = start + limit.max_tokens
            low = max(done + 1, start + limit.max_tokens // 2)
            a, b = np.searchsorted(ends_t, low, side="left"), np.searchsorted(ends_t, top, side="right")
            if a < b:
                at = self._pick(a, b, ends_t, level, rolled, landmark, limit.max_tokens // LANDMARKS)
                end, kind = int(ends_t[at]), LEVELS[level[at]]
            else:
                end, kind = top, LEVELS[0]
                while ids[end] in self.inside and end > done + 1:
                    end -= 1
            out.append((start, end - start, char_at(start), char_at(end), kind))
            done, start = end, end - limit.overlap
            while start > 0 and ids[start] in self.inside:
                start -= 1

    @staticmethod
    def _pick(a, b, ends_t, level, rolled, landmark, reach) -> int:
        """The boundary of [a, b) to cut at."""
        marks = np.flatnonzero(landmark[a:b])
        if len(marks):
            mark = a + int(marks[0])
            near = np.arange(a, b)
            close = near[np.abs(ends_t[near] - ends_t[mark]) <= reach]
            near = close if level[close].max() >= 2 else near
            best = near[level[near] == level[near].max()]
            return int(best[np.argmin(np.abs(ends_t[best] - ends_t[mark]))])
        near = np.arange(a, b)
        best = near[level[near] == level[near].max()]
        return int(best[np.argmin(rolled[best])])


_SCHEMA = "limit_id int, piece_no int, n_pieces int, start_token int, n_tokens int, start_char int, end_char int, cut_at string, piece string"


def pieces(df: DataFrame, id_col: str, text_col: str, limits: list[Limit], tokenizer: Tokenizer) -> DataFrame:
    """One row per piece of each text and limit; rows are cut where they lie, without a shuffle."""
    names = ["id", *(part.split()[0] for part in _SCHEMA.split(", "))]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Cutter(tokenizer.encoder())
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                for limit in limits:
                    found = cutter.cut(text, limit)
                    for n, (first, size, begin, end, kind) in enumerate(found):
                        rows.append((key, limit.limit_id, n, len(found), first, size, begin, end, kind, text[begin:end]))
            yield pd.DataFrame(rows, columns=names)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return source.mapInPandas(cut, f"id {df.schema[id_col].dataType.simpleString()}, {_SCHEMA}")
