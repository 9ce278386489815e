"""Several values packed in one field: dictionary-guided segmentation.

A multi-pattern automaton (Aho-Corasick) over the known values finds every place where a known value stands as a whole item,
that is between delimiters or quotes. Dynamic programming over the text then picks the best cover: a known value is one item
whatever delimiters it contains, quoted stretches stay whole, and what is left is cut at delimiters. The Python part runs on
distinct texts of an Arrow batch only.

Delimiters are ``| ; ~ + , /``, tab and line breaks. ``/`` and ``,`` and ``+`` may be part of a value; inside *unknown* text a
slash between two characters belongs to the value and any other slash is a delimiter, as are a comma and a plus always.

Defined results: null, empty or blank text has no items; empty places are not counted; an unclosed quote is an ordinary
character; equal items repeat; text of any length is segmented whole, in time linear in its length times the longest value.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import ship_package, spread

HARD = "|;~\t\n\r"
ITEM_SCHEMA = "array<string>"
_BREAKS = set(HARD + ",/+")
_SPACE = re.compile(r"\s+")
_QUOTES = "\"'"


def fold(text: str) -> str:
    """Case and spacing do not count in comparing items; a colon path is compared without spaces around its colons."""
    return _SPACE.sub(" ", re.sub(r"\s*:\s*", ":", text)).strip().upper()


class Segmenter:
    """Splits one text into its items, given the known values."""

    def __init__(self, known: Iterable[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for value in known:
            if value and fold(value):
                self.automaton.add_word(fold(value), len(fold(value)))
        self.filled = len(self.automaton) > 0
        if self.filled:
            self.automaton.make_automaton()
        self.cache: dict[str, list[str]] = {}

    def items(self, text: str | None) -> list[str]:
        """The items of ``text`` as written, in order."""
        if text is None:
            return []
        found = self.cache.get(text)
        if found is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            found = self.cache[text] = self._segment(text)
        return found

    @staticmethod
    def _folded(text: str) -> tuple[str, list[int], list[int]]:
        """The text in compared form, and for each of its characters the first and the end position in the original."""
        out: list[str] = []
        first: list[int] = []
        end: list[int] = []
        n = len(text)
        i = 0
        while i < n:
            ch = text[i]
            if ch.isspace():
                j = i
                while j < n and text[j].isspace():
                    j += 1
                hard = any(c in "\t\n\r" for c in text[i:j])
                near_colon = (j < n and text[j] == ":") or (i > 0 and text[i - 1] == ":")
                if hard or not near_colon:
                    out.append("\n" if hard else " ")
                    first.append(i)
                    end.append(j)
                i = j
                continue
            up = ch.upper()
            for c in up if len(up) == 1 else ch:
                out.append(c)
                first.append(i)
                end.append(i + 1)
            i += 1
        return "".join(out), first, end

    def _segment(self, text: str) -> list[str]:
        if not text.strip():
            return []
        flat, first, end = self._folded(text)
        n = len(flat)
        # spans (start -> [(stop, score)]) that are taken whole: known values and quoted stretches
        spans: dict[int, list[tuple[int, int]]] = {}
        if self.filled:
            for last, size in self.automaton.iter(flat):
                start = last + 1 - size
                if self._starts_item(flat, start) and self._ends_item(flat, last + 1):
                    spans.setdefault(start, []).append((last + 1, size * 4))
        for q in _QUOTES:
            i = flat.find(q)
            while i >= 0:
                stop = self._quoted(flat, i, q)
                if stop and self._starts_item(flat, i) and self._ends_item(flat, stop):
                    spans.setdefault(i, []).append((stop, (stop - i) * 4 + 2))
                    i = flat.find(q, stop)
                else:
                    i = flat.find(q, i + 1)
        # best[i]: score of the cover of flat[:i]; loose characters score nothing, whole values score by their length
        best = [0] * (n + 1)
        via = [-1] * (n + 1)
        pending: dict[int, list[tuple[int, int]]] = {}
        for i in range(n):
            if i and best[i] < best[i - 1]:
                best[i], via[i] = best[i - 1], -1
            for stop, score in spans.get(i, ()):
                pending.setdefault(stop, []).append((best[i] + score, i))
            nxt = best[i]
            best[i + 1], via[i + 1] = nxt, -1
            for score, start in pending.get(i + 1, ()):
                if score > best[i + 1] or (score == best[i + 1] and via[i + 1] < start):
                    best[i + 1], via[i + 1] = score, start
        whole: list[tuple[int, int]] = []
        i = n
        while i > 0:
            if via[i] >= 0:
                whole.append((via[i], i))
                i = via[i]
            else:
                i -= 1
        items: list[str] = []
        at = 0
        for start, stop in [*reversed(whole), (n, n)]:
            items += self._loose(text, flat, first, end, at, start)
            if stop > start:
                items.append(self._written(text[first[start] : end[stop - 1]]))
            at = stop
        return [x for x in items if x]

    @staticmethod
    def _starts_item(flat: str, i: int) -> bool:
        while i > 0 and flat[i - 1] == " ":
            i -= 1
        return i == 0 or flat[i - 1] in _BREAKS

    @staticmethod
    def _ends_item(flat: str, i: int) -> bool:
        while i < len(flat) and flat[i] == " ":
            i += 1
        return i == len(flat) or flat[i] in _BREAKS

    @staticmethod
    def _quoted(flat: str, i: int, q: str) -> int:
        """End of the quoted stretch that opens at i (after its closing quote), or 0; a doubled quote is part of it."""
        j = i + 1
        while (j := flat.find(q, j)) >= 0:
            if flat[j + 1 : j + 2] == q:
                j += 2
                continue
            return j + 1
        return 0

    @staticmethod
    def _loose(text: str, flat: str, first: list[int], end: list[int], a: int, b: int) -> list[str]:
        """Unknown text flat[a:b], cut at delimiters; a slash between two characters belongs to the value."""
        parts: list[str] = []
        begin = a
        for i in range(a, b):
            c = flat[i]
            cut = c in HARD or c in ",+" or (c == "/" and (i == a or i == b - 1 or flat[i - 1] in " \n/" or flat[i + 1] in " \n/"))
            if cut:
                if i > begin:
                    parts.append(text[first[begin] : end[i - 1]])
                begin = i + 1
        if b > begin:
            parts.append(text[first[begin] : end[b - 1]])
        return [Segmenter._written(p) for p in parts]

    @staticmethod
    def _written(part: str) -> str:
        """Without outer white space and quoting; a quote doubled inside quoting is one quote."""
        part = part.strip()
        if len(part) >= 2 and part[0] in _QUOTES and part[-1] == part[0]:
            part = part[1:-1].replace(part[0] * 2, part[0]).strip()
        return part


_SEGMENTERS: dict[tuple[str, ...], Segmenter] = {}


def segmenter(known: tuple[str, ...]) -> Segmenter:
    """One automaton per Python worker and dictionary."""
    if known not in _SEGMENTERS:
        _SEGMENTERS[known] = Segmenter(known)
    return _SEGMENTERS[known]


def items_udf(known: list[str]):
    """Column function from a text to its items. ``known`` is a dictionary of checked size (``known_values``), sent to each worker once."""
    shared = SparkSession.active().sparkContext.broadcast(tuple(sorted(set(known))))

    @F.pandas_udf(ITEM_SCHEMA)
    def split_items(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = segmenter(shared.value).items
        for series in texts:
            yield series.map(lambda t: split(t) if t is not None else [])

    return split_items.asNondeterministic()  # else a filter on the items is pushed below and splits every text again


def known_values(labels: DataFrame, columns: list[str], most: int = 1_000_000) -> list[str]:
    """The dictionary as a Python list; its size is checked, for it travels to every worker."""
    values = labels.select(F.explode(F.array(*columns)).alias("v")).filter("v IS NOT NULL").distinct().limit(most + 1).collect()
    if len(values) > most:
        raise ValueError(f"the dictionary has more than {most} values")
    return sorted(r["v"] for r in values)


def packed_items(df: DataFrame, key: str, field: str, known: list[str], least: int = 1) -> DataFrame:
    """Rows (rec_key, pos_no, item_text) for each distinct (key, text) with at least ``least`` items."""
    ship_package(df.sparkSession)
    texts = df.select(F.col(key).cast("string").alias("rec_key"), F.col(field).alias("_text")).filter(F.col("_text").isNotNull())
    split = spread(texts).withColumn("_items", items_udf(known)("_text")).filter(F.size("_items") >= least)
    rows = split.select("rec_key", F.posexplode("_items").alias("pos", "item_text"))
    return rows.select("rec_key", (F.col("pos") + 1).cast("int").alias("pos_no"), "item_text").distinct()
