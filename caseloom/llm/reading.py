"""Reading level by harmonic propagation over the document-word graph.

Documents and words are the two sides of a bipartite graph; an edge weighs the word's count in the document times its inverse
document frequency. Graded documents are clamped to their grade; every other document takes the weighted mean of its words and
every word the weighted mean of its documents, over and over, until no word moves by more than a small amount. Every word is a
node of its own. A word of one document links nothing and is left out; the most frequent words live in vectors that go to every
task and whose sums come back through the driver (their number is a parameter, so is their size); all other words stay in a
table keyed by the word, whose values reach the blocks of documents by joins. Which way a word goes does not change its value.

Texts are read and cut into words once: the graph is a table of blocks, each with its documents' words in order as one array of
numbers and a dictionary of its words, so that a round is array arithmetic over blocks. Documents' values never leave the executors.

Read-out: the difficulty is the document's converged value, the weighted mean of its words. A document belongs to the band that
prevails in it, so the same mean is also taken over a running window of words, each window falls into a band, and the band that
holds most words wins (a document half plain and half demanding would look middle by its mean alone). The two cuts between bands
are those that tell windows of graded documents apart best, class by class, from histograms over all graded documents.

Defined results: only documents of the language with at least ``least_words`` words between white space are rated; null text is
not; doubled labels count once and contradicting ones go by majority, ties to the middle of the scale; labels of absent
documents are ignored; without any graded document, or without letters, a document is ``middle``; rows with equal keys are rated
each. If the change is still above the limit after ROUNDS_MOST rounds, a warning with the change is logged.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import materialize, ship_package, spread

BANDS = ("plain", "middle", "demanding")
GRADE = {"plain": 0.0, "middle": 0.5, "demanding": 1.0}
HEAD = 1 << 18  # words whose values are kept in vectors; all others are exact as well, by joins
WINDOW = 12  # words on either side
BINS = 2000
ROUNDS_MOST, CHANGE_LEAST = 200, 0.002
BLOCK_WORDS = 50_000
_WORD = re.compile(r"[^\W\d_]+")
_LOG = logging.getLogger(__name__)

RAW_SCHEMA = "block long, docs array<long>, ends array<int>, nodes array<int>, grades array<double>, words array<string>, df array<int>"
GRAPH_SCHEMA = "block long, docs array<long>, ends array<int>, nodes array<int>, grades array<double>, tail array<string>, tail_idf array<double>"


def graded(labels: DataFrame, key: str, band: str) -> DataFrame:
    """One grade per document: the majority of its distinct labels' counts, ties to the value nearest the middle."""
    grade = F.create_map(*[F.lit(x) for kv in GRADE.items() for x in kv])
    counted = labels.filter(F.col(key).isNotNull() & F.col(band).isin(*BANDS)).groupBy(key, band).agg(F.count(F.lit(1)).alias("n"))
    valued = counted.withColumn("grade", F.element_at(grade, F.col(band)))
    return valued.groupBy(key).agg(F.max_by("grade", F.struct("n", -F.abs(F.col("grade") - 0.5), "grade")).alias("grade"))


def word_blocks(docs: DataFrame, least_words: int) -> DataFrame:
    """RAW_SCHEMA: the documents (doc, text, grade) to rate in blocks with dictionaries and the documents of each word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = TaskContext.get().partitionId() << 33
        known: dict[str, int] = {}
        docs, ends, nodes, grades, df = [], [], [], [], Counter()

        def flush() -> pd.DataFrame:
            row = (block, docs, ends, nodes, grades, list(known), [df[i] for i in range(len(known))])
            return pd.DataFrame([row], columns=[c.split()[0] for c in RAW_SCHEMA.split(", ")])

        for batch in batches:
            for doc, body, grade in zip(batch["doc"], batch["text"], batch["grade"]):
                if len(body.split(None, least_words)) < least_words:
                    continue
                ids = [known.setdefault(w, len(known)) for w in _WORD.findall(body.lower())]
                df.update(set(ids))
                nodes += ids
                docs.append(doc)
                ends.append(len(nodes))
                grades.append(grade)
                if len(nodes) >= BLOCK_WORDS:
                    yield flush()
                    block += 1
                    known, docs, ends, nodes, grades, df = {}, [], [], [], [], Counter()
        if docs:
            yield flush()

    return docs.select("doc", "text", "grade").mapInPandas(run, RAW_SCHEMA)


@dataclass
class Graph:
    """Blocks (GRAPH_SCHEMA), inverse document frequencies of the head, and whether words stand outside it.

    A node below the head's size is a head word, that size itself a word of one document, and above it a word of ``tail``.
    """

    blocks: DataFrame
    idf: np.ndarray
    has_tail: bool
    documents: int


def build_graph(raw: DataFrame, head_most: int = HEAD) -> Graph:
    """Numbers the words of all blocks alike."""
    spark = raw.sparkSession
    frequency = raw.select(F.explode(F.arrays_zip("words", "df")).alias("e")).groupBy(F.col("e.words").alias("word")).agg(F.sum("e.df").alias("df")).filter("df > 1")
    frequency = materialize(frequency, "reading-words")
    documents = raw.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0))).first()[0]
    head = frequency.orderBy(F.col("df").desc(), "word").limit(head_most).toPandas()  # at most head_most rows
    idf = np.log(documents / head["df"].to_numpy(dtype=float)) if len(head) else np.empty(0)
    number = spark.sparkContext.broadcast({w: i for i, w in enumerate(head["word"])})
    beside = frequency.join(F.broadcast(spark.createDataFrame(head[["word"]], "word string")), "word", "left_anti") if len(head) == head_most else None
    has_tail = beside is not None and not beside.isEmpty()
    if has_tail:
        local = raw.select("block", F.explode("words").alias("word")).join(beside.select("word", F.log(F.lit(float(documents)) / F.col("df")).alias("idf")), "word")
        raw = raw.join(local.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("word", "idf"))).alias("tail")), "block", "left")
    else:
        raw = raw.withColumn("tail", F.array().cast("array<struct<word: string, idf: double>>"))
    n_head = len(head)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = number.value
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                tail = [] if r.tail is None else [(t["word"], t["idf"]) for t in r.tail]
                beyond = {w: n_head + 1 + k for k, (w, _) in enumerate(tail)}
                to_global = np.array([known.get(w, beyond.get(w, n_head)) for w in r.words], dtype=np.int32)
                nodes = to_global[np.asarray(r.nodes, dtype=np.int64)] if len(r.nodes) else np.empty(0, dtype=np.int32)
                rows.append((r.block, r.docs, r.ends, nodes, r.grades, [w for w, _ in tail], [x for _, x in tail]))
            yield pd.DataFrame(rows, columns=["block", "docs", "ends", "nodes", "grades", "tail", "tail_idf"])

    blocks = materialize(raw.select("block", "docs", "ends", "nodes", "grades", "words", "tail").mapInPandas(run, GRAPH_SCHEMA), "reading-graph")
    return Graph(blocks, idf, has_tail, documents)


class _Block:
    """One block's arrays with the current values: edge weights and word values by place."""

    def __init__(self, r, value: np.ndarray, idf: np.ndarray) -> None:
        tail = [] if r.tail_value is None else r.tail_value
        self.value = np.concatenate((value, [np.nan], np.asarray(tail, dtype=float), np.full(len(r.tail_idf) - len(tail), np.nan)))
        self.idf = np.concatenate((idf, [0.0], np.asarray(r.tail_idf, dtype=float)))
        self.nodes = np.asarray(r.nodes, dtype=np.int64)
        self.ends = np.asarray(r.ends, dtype=np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)
        self.grades = np.asarray(r.grades, dtype=float)
        at = self.value[self.nodes]
        known = ~np.isnan(at)
        self.weight = self.idf[self.nodes] * known
        self.pull = self.weight * np.where(known, at, 0.0)

    def document_values(self) -> np.ndarray:
        """The weighted mean of each document's words; NaN without a known one."""
        n = len(self.ends)
        mass = np.bincount(self.owner, self.weight, n)
        return np.where(mass > 0, np.bincount(self.owner, self.pull, n) / np.maximum(mass, 1e-12), np.nan)

    def word_sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Numerator and denominator of every node's mean over this block's documents, graded ones clamped."""
        score = np.where(np.isnan(self.grades), self.document_values(), self.grades)[self.owner]
        edge = self.idf[self.nodes] * ~np.isnan(score)
        n = len(self.value)
        return np.bincount(self.nodes, edge * np.nan_to_num(score), n), np.bincount(self.nodes, edge, n)

    def windows(self) -> np.ndarray:
        """The difficulty of the window around each word, within its document."""
        top, under = np.concatenate(([0.0], np.cumsum(self.pull))), np.concatenate(([0.0], np.cumsum(self.weight)))
        place = np.arange(len(self.nodes))
        low, high = np.maximum(self.starts[self.owner], place - WINDOW), np.minimum(self.ends[self.owner], place + WINDOW + 1)
        mass = under[high] - under[low]
        return np.where(mass > 1e-9, (top[high] - top[low]) / np.maximum(mass, 1e-9), 0.5)


def _with_tail(graph: Graph, tail: DataFrame | None) -> DataFrame:
    """Blocks with the current values of their words outside the head."""
    if tail is None:
        return graph.blocks.withColumn("tail_value", F.lit(None).cast("array<double>"))
    words = graph.blocks.filter(F.size("tail") > 0).select("block", F.posexplode("tail").alias("t", "word")).join(tail, "word", "left")
    values = words.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("t", F.coalesce("value", F.lit(float("nan"))).alias("value")))).alias("v"))
    return graph.blocks.join(values.select("block", F.col("v.value").alias("tail_value")), "block", "left")


def propagate(graph: Graph) -> tuple[np.ndarray, DataFrame | None, int, float]:
    """(head values, values of other words, rounds, last change); NaN: never reached."""
    context = graph.blocks.sparkSession.sparkContext
    n_head = len(graph.idf)
    value, tail = np.full(n_head, np.nan), None
    moved = 0.0
    for turn in range(1, ROUNDS_MOST + 1):
        state = context.broadcast((value, graph.idf))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g, idf = state.value
            top, under = np.zeros(n_head), np.zeros(n_head)
            for batch in batches:
                for r in batch.itertuples(index=False):
                    a, b = _Block(r, g, idf).word_sums()
                    top += a[:n_head]
                    under += b[:n_head]
                    if len(r.tail):
                        yield pd.DataFrame({"node": -1, "word": list(r.tail), "top": a[n_head + 1 :], "under": b[n_head + 1 :]})
            present = np.flatnonzero(under > 0)
            yield pd.DataFrame({"node": present, "word": None, "top": top[present], "under": under[present]})

        sums = _with_tail(graph, tail).mapInPandas(run, "node int, word string, top double, under double")
        if graph.has_tail:
            sums = materialize(sums, "reading-sums")
        table = sums.filter("node >= 0").groupBy("node").agg(F.sum("top").alias("top"), F.sum("under").alias("under")).toPandas()  # at most HEAD rows
        fresh = np.full(n_head, np.nan)
        fresh[table["node"].to_numpy(dtype=np.int64)] = table["top"].to_numpy(dtype=float) / table["under"].to_numpy(dtype=float)
        moved = float(np.abs(np.nan_to_num(fresh, nan=-1.0) - np.nan_to_num(value, nan=-1.0)).max(initial=0.0))
        value = fresh
        if graph.has_tail:
            after = materialize(sums.filter("word IS NOT NULL").groupBy("word").agg(F.sum("top").alias("top"), F.sum("under").alias("under")).filter("under > 0").select("word", (F.col("top") / F.col("under")).alias("value")), "reading-tail")
            before = after.select("word", F.lit(-1.0).alias("old")) if tail is None else tail.withColumnRenamed("value", "old")
            change = after.join(before, "word", "left").agg(F.max(F.abs(F.col("value") - F.coalesce("old", F.lit(-1.0))))).first()[0]
            moved, tail = max(moved, change or 0.0), after
        state.unpersist()
        if moved < CHANGE_LEAST:
            return value, tail, turn, moved
    _LOG.warning("reading levels: the largest change is still %.4f after %d rounds", moved, ROUNDS_MOST)
    return value, tail, ROUNDS_MOST, moved


def best_cut(lower: np.ndarray, upper: np.ndarray) -> float:
    """The bin edge that separates two histograms best, both classes weighing alike; the middle of ties."""
    if not lower.sum() or not upper.sum():
        return 0.5
    gain = np.cumsum(lower) / lower.sum() - np.cumsum(upper) / upper.sum()
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[len(best) // 2] + 1) / BINS)


def band_cuts(blocks: DataFrame, state) -> tuple[float, float] | None:
    """The cuts between plain, middle and demanding windows of graded documents; null without a graded word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(BANDS), BINS), dtype=np.int64)
        for batch in batches:
            for r in batch.itertuples(index=False):
                block = _Block(r, *state.value)
                grade = block.grades[block.owner]
                at = np.minimum((block.windows() * BINS).astype(np.int64), BINS - 1)
                marked = ~np.isnan(grade)
                np.add.at(total, ((grade[marked] * 2).astype(np.int64), at[marked]), 1)
        grade, bins = np.nonzero(total)
        yield pd.DataFrame({"grade": grade, "bin": bins, "n": total[grade, bins]})

    shapes = blocks.filter(F.exists("grades", lambda g: g.isNotNull())).mapInPandas(run, "grade int, bin int, n long").groupBy("grade", "bin").agg(F.sum("n").alias("n")).toPandas()
    if shapes.empty:
        return None
    dense = np.zeros((len(BANDS), BINS))
    dense[shapes["grade"].to_numpy(dtype=int), shapes["bin"].to_numpy(dtype=int)] = shapes["n"].to_numpy(dtype=float)
    return best_cut(dense[0], dense[1]), best_cut(dense[1], dense[2])


def reading_levels(df: DataFrame, key: str, text: str, language: str, wanted: str, labels: DataFrame, label_key: str, band: str, least_words: int = 50, head_most: int = HEAD) -> DataFrame:
    """(key, difficulty, band) of every document to rate."""
    spark = df.sparkSession
    ship_package(spark)
    docs = spread(df.filter((F.col(language) == wanted) & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")))
    grades = graded(labels, label_key, band).select(F.col(label_key).cast("long").alias("doc"), "grade")
    raw = materialize(word_blocks(docs.join(grades, "doc", "left"), least_words), "reading-blocks")
    graph = build_graph(raw, head_most)
    value, tail, _, _ = propagate(graph)
    state = spark.sparkContext.broadcast((value, graph.idf))
    blocks = _with_tail(graph, tail)
    cuts = band_cuts(blocks, state)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        order = np.array([1, 0, 2])  # ties go to the middle, then to plain
        for batch in batches:
            for r in batch.itertuples(index=False):
                block = _Block(r, *state.value)
                n = len(block.ends)
                if cuts is None:
                    yield pd.DataFrame({"doc": r.docs, "difficulty": np.full(n, 0.5), "band": BANDS[1]})
                    continue
                shares = np.bincount(block.owner * 3 + np.searchsorted(cuts, block.windows(), side="right"), minlength=3 * n).reshape(n, 3)
                best = order[np.argmax(shares[:, order], axis=1)]
                yield pd.DataFrame({"doc": r.docs, "difficulty": np.nan_to_num(block.document_values(), nan=0.5), "band": np.array(BANDS)[best]})

    return blocks.mapInPandas(rate, "doc long, difficulty double, band string").withColumnRenamed("doc", key)
