"""Byte-level BPE encoding with a segment tree over adjacent pair ranks.

Each pretoken starts as its bytes. A segment tree holds, at leaf i, the rank of the pair that starts at the living part i (or
infinity) and at each inner node the lesser child, the left one on ties; the root is thus the leftmost lowest-rank merge. A
merge rewrites three leaves and their paths, so a pretoken of n bytes costs O(n log n) however long it is. The loop ends when
the root is infinite. Distinct words are encoded once per worker (the cache is bounded).

Defined results: null and empty texts get an empty list; the string of a special token is ordinary text; any text is encoded
whole; equal texts get equal ids.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TOKENIZER_FOLDER = "/opt/tokenizers"
#: Pretokens of byte-level BPE as published with the vocabulary.
PRETOKEN_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text is cut at single spaces between other characters: no pretoken reaches across one, each begins with it.
_CUTS = re.compile(r" (?=\S)(?<=\S )").split
NEVER = 1 << 60
CACHE_MOST = 400_000
CACHE_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a .tiktoken vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTree:
    """Segment tree of pair ranks over the parts of one pretoken."""

    def __init__(self, ranks: list[int]) -> None:
        self.size = 1
        while self.size < max(1, len(ranks)):
            self.size *= 2
        self.tree = [NEVER] * self.size + ranks + [NEVER] * (self.size - len(ranks))
        for node in range(self.size - 1, 0, -1):
            self.tree[node] = min(self.tree[2 * node], self.tree[2 * node + 1])

    def update(self, leaf: int, rank: int) -> None:
        tree = self.tree
        node = leaf + self.size
        if tree[node] == rank:
            return
        tree[node] = rank
        node >>= 1
        while node:
            least = tree[2 * node] if tree[2 * node] <= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == least:
                return
            tree[node] = least
            node >>= 1

    def leftmost_least(self) -> int:
        """Leaf of the leftmost pair of lowest rank, or -1 if no pair merges."""
        tree = self.tree
        least = tree[1]
        if least == NEVER:
            return -1
        node = 1
        while node < self.size:
            node *= 2
            if tree[node] != least:
                node += 1
        return node - self.size


class Encoder:
    """Encodes texts with one byte-level vocabulary."""

    def __init__(self, path: str) -> None:
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(PRETOKEN_PATTERN).findall
        self.words = _Words(self.whole)
        self.sizes = _Words(lambda part: len(self.whole(part)))

    def pretoken(self, piece: bytes) -> list[int]:
        """Ids of one pretoken."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        ends = list(range(1, n + 1))  # end of the part that starts at i, while i lives
        before = list(range(-1, n - 1))
        tree = PairTree([ranks.get(piece[i : i + 2], NEVER) for i in range(n - 1)])
        while (i := tree.leftmost_least()) >= 0:
            j = ends[i]
            ends[i] = stop = ends[j]
            if j < n - 1:
                tree.update(j, NEVER)
            if stop < n:
                before[stop] = i
                tree.update(i, ranks.get(piece[i : ends[stop]], NEVER))
            else:
                tree.update(i, NEVER)
            p = before[i]
            if p >= 0:
                tree.update(p, ranks.get(piece[p:stop], NEVER))
        out = []
        i = 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def whole(self, text: str) -> list[int]:
        """Ids of any text, pretoken by pretoken."""
        return [i for pretoken in self.split(text) for i in self.pretoken(pretoken.encode("utf-8"))]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        first, *rest = _CUTS(text)
        return list(chain(self.whole(first), *map(self.words.__getitem__, rest)))

    def count(self, text: str | None) -> int:
        """The number of ids, without putting them together."""
        if not text:
            return 0
        first, *rest = _CUTS(text)
        return len(self.whole(first)) + sum(map(self.sizes.__getitem__, rest))


class _Words(dict):
    """Remembers what is made of a short part with a space before it."""

    def __init__(self, make: Callable) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, part: str):
        made = self.make(" " + part)
        if len(part) <= CACHE_BYTES:
            if len(self) >= CACHE_MOST:
                self.clear()
            self[part] = made
        return made


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file to the executors, so that only the driver needs the folder; returns the path."""
    shipped = spark.sparkContext.__dict__.setdefault("_caseloom_files", set())
    if path not in shipped:
        spark.sparkContext.addFile(path)
        shipped.add(path)
    return path


def local_file(path: str) -> str:
    """The shipped copy of a file on this worker, or the path itself where nothing was shipped."""
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(local_file(path))


def vocabulary_path(name: str, folder: str = TOKENIZER_FOLDER) -> str:
    return f"{folder}/{name}.tiktoken"


def encode_column(text: Column, path: str) -> Column:
    """The ids of a text column."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path).encode
        for series in texts:
            yield series.map(encode, na_action=None)

    return ids(text)


def count_column(text: Column, path: str) -> Column:
    """The number of ids of a text column, without moving the ids out of the worker."""

    @F.pandas_udf("long")
    def sizes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = encoder(path).count
        for series in texts:
            yield series.map(count, na_action=None).astype("int64")

    return sizes(text)
