"""Token counts of a sentence-piece vocabulary, word by word.

In the published vocabulary no piece holds a space behind another character except runs of spaces alone, so nothing merges over
the border before a space that follows a word. A text is cut there, each part is counted once per worker (the cache is
bounded) and the counts are added up; ``tests/llm/test_packing.py`` compares them with whole texts.

Defined results: null and empty texts count 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.llm.bpe import CACHE_BYTES, CACHE_MOST, local_file

_CUTS = re.compile(r" (?=[^ ])(?<=[^ ] )").split


class PieceCounter:
    """Counts tokens with one vocabulary; falls back to whole texts where a piece could cross a border."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.apart = all("▁" not in p.lstrip("▁") for p in texts)
        self.words = _Words(self.whole)

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.apart:
            return self.whole(text)
        first, *rest = _CUTS(text)
        return self.whole(first) + sum(map(self.words.__getitem__, rest))


class _Words(dict):
    """Remembers the count of a short part; the model puts the space in front by itself."""

    def __init__(self, count: Callable[[str], int]) -> None:
        super().__init__()
        self.count = count

    def __missing__(self, part: str) -> int:
        n = self.count(part)
        if len(part) <= CACHE_BYTES:
            if len(self) >= CACHE_MOST:
                self.clear()
            self[part] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """One counter per worker and vocabulary."""
    return PieceCounter(local_file(path))


def count_column(text: Column, path: str) -> Column:
    """The number of tokens of a text column."""

    @F.pandas_udf("long")
    def sizes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for series in texts:
            yield series.map(count, na_action=None).astype("int64")

    return sizes(text)
