"""Documents x terms in packed blocks: counted, weighed and multiplied an Arrow batch at a time.

A block is a row with the keys of some documents and, as bytes, the start of each document, the term numbers and the counts
(or weights, eight bytes each). Documents without a term of the vocabulary are in no block. Null terms are no terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import materialize

FLUSH = 200_000  # distinct terms that a task holds before it passes its counts on
STEPS = 25  # updates of a document's topic weights for a given factor
GATHERED = 16_384  # cells of one gathered product, so that it stays in the cache


def _cells(lists: pa.ListArray, pairs: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(row, term code, terms by code) of every occurrence in a batch; with ``pairs`` neighbours are terms also."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    if coded.null_count:
        row, codes = row[codes >= 0], codes[codes >= 0]
    if pairs and len(codes) > 1:
        beside = row[:-1] == row[1:]
        both, place = np.unique(codes[:-1][beside] * len(names) + codes[1:][beside], return_inverse=True)
        row, codes = np.concatenate([row, row[:-1][beside]]), np.concatenate([codes, place + len(names)])
        left, right = np.divmod(both, len(names))
        names = names + [f"{names[x]} {names[y]}" for x, y in zip(left.tolist(), right.tolist())]
    return row, codes, names


def _counted(row: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) without repeats, in order."""
    cells, tf = np.unique(row * max(n, 1) + codes, return_counts=True)
    return (*np.divmod(cells, max(n, 1)), tf)


def term_counts(docs: DataFrame, pairs: bool = False) -> DataFrame:
    """(term, df, cf) over the documents with ``fitted``; the row without a term has their number of source rows as df.

    ``docs``: fitted, source_rows and terms (an array), a row per document.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[int]] = {None: [0, 0]}

        def flushed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], names=["term", "df", "cf"])
            held.clear()
            held[None] = [0, 0]
            return out

        for batch in batches:
            batch = batch.filter(batch["fitted"])
            held[None][0] += sum(batch["source_rows"].to_pylist())
            row, codes, names = _cells(batch["terms"], pairs)
            _, code, tf = _counted(row, codes, len(names))
            df, cf = np.bincount(code, minlength=len(names)).tolist(), np.bincount(code, weights=tf, minlength=len(names)).astype(np.int64).tolist()
            for name, d, c in zip(names, df, cf):
                if known := held.get(name):
                    known[0] += d
                    known[1] += c
                elif d:
                    held[name] = [d, c]
            if len(held) > FLUSH:
                yield flushed()
        yield flushed()

    parts = docs.select("fitted", "source_rows", "terms").mapInArrow(count, "term string, df long, cf long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def long_counts(docs: DataFrame, key: str, pairs: bool = False) -> DataFrame:
    """(key, term, tf), a row per document and term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, codes, names = _cells(batch["terms"], pairs)
            row, code, tf = _counted(row, codes, len(names))
            yield pa.record_batch([batch[key].take(pa.array(row)), pa.array(names, pa.string()).take(pa.array(code)), pa.array(tf.astype(np.int64))], names=[key, "term", "tf"])

    return docs.select(key, "terms").mapInArrow(count, f"{key} {dict(docs.dtypes)[key]}, term string, tf long")


def _block(keys: pa.Array, fitted: bool, size: np.ndarray, idx: np.ndarray, values: np.ndarray, terms: int) -> pa.RecordBatch:
    ptr = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    cells = [pa.array([x.tobytes()], pa.binary()) for x in (ptr, idx.astype(np.uint16 if terms <= 1 << 16 else np.int32), values)]
    return pa.record_batch([pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([fitted]), *cells], names=["keys", "fitted", "ptr", "idx", "val"])


@dataclass
class TermMatrix:
    """Blocks (keys, fitted, ptr, idx, val) over a sorted vocabulary; counts become weights by ``idf``."""

    blocks: DataFrame
    key: str
    kind: str
    vocabulary: list[str]
    idf: np.ndarray | None = None
    sublinear: bool = True

    def read(self, ptr: bytes, idx: bytes, val: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _read(ptr, idx, val, self.idf, self.sublinear, len(self.vocabulary))

    def _map(self, use, schema: str, columns: list[str]) -> DataFrame:
        """``use(batch of blocks, reader, terms)`` gives a record batch of ``schema``."""
        context = self.blocks.sparkSession.sparkContext
        shared, sublinear = context.broadcast((self.idf, self.vocabulary)), self.sublinear

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, vocabulary = shared.value
            yield from use(batches, lambda *cells: _read(*cells, idf, sublinear, len(vocabulary)), pa.array(vocabulary, pa.string()))

        return self.blocks.select(*columns).mapInArrow(run, schema)

    def weights(self) -> DataFrame:
        """(key, term, weight), a row per document and term."""
        key = self.key

        def use(batches, read, terms):
            for batch in batches:
                for keys, *cells in zip(batch["keys"], *(batch[c].to_pylist() for c in ("ptr", "idx", "val"))):
                    ptr, idx, val = read(*cells)
                    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
                    yield pa.record_batch([keys.values.take(pa.array(doc)), terms.take(pa.array(idx)), pa.array(val)], names=[key, "term", "weight"])

        return self._map(use, f"{key} {self.kind}, term string, weight double", ["keys", "ptr", "idx", "val"])

    def select(self, *columns: str) -> DataFrame:
        return self.weights().select(*columns)

    def totals(self) -> DataFrame:
        """(term, docs, total): documents with the term and the sum of its weights."""

        def use(batches, read, terms):
            docs, total = np.zeros(len(terms), np.int64), np.zeros(len(terms))
            for batch in batches:
                for cells in zip(*(batch[c].to_pylist() for c in ("ptr", "idx", "val"))):
                    _, idx, val = read(*cells)
                    docs += np.bincount(idx, minlength=len(terms))
                    total += np.bincount(idx, weights=val, minlength=len(terms))
            seen = np.flatnonzero(docs)
            yield pa.record_batch([terms.take(pa.array(seen)), pa.array(docs[seen]), pa.array(total[seen])], names=["term", "docs", "total"])

        parts = self._map(use, "term string, docs long, total double", ["ptr", "idx", "val"])
        return parts.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total"))


def _read(ptr: bytes, idx: bytes, val: bytes, idf: np.ndarray | None, sublinear: bool, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document starts, term numbers, weights) of a block; without ``idf`` the stored values are the weights."""
    ptr, idx = np.frombuffer(ptr, np.int64), np.frombuffer(idx, np.uint16 if terms <= 1 << 16 else np.int32)
    if idf is None:
        return ptr, idx, np.frombuffer(val, np.float64)
    tf = np.frombuffer(val, np.int32)
    w = (np.log(tf) + 1 if sublinear else tf.astype(float)) * idf[idx]
    return ptr, idx, w / np.repeat(np.sqrt(np.add.reduceat(w * w, ptr[:-1])), np.diff(ptr))


def pack_counts(docs: DataFrame, key: str, vocabulary: list[str], idf: np.ndarray, sublinear: bool = True, pairs: bool = False) -> TermMatrix:
    """The matrix of ``docs`` (key, fitted, terms), a row per document."""
    numbers = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})
    kind, m = dict(docs.dtypes)[key], len(vocabulary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbers.value
        for batch in batches:
            for fitted in (True, False):
                part = batch.filter(batch["fitted"] if fitted else pa.compute.invert(batch["fitted"]))
                row, codes, names = _cells(part["terms"], pairs)
                idx = np.fromiter((number.get(n, -1) for n in names), np.int64, len(names))[codes]
                row, idx, tf = _counted(row[idx >= 0], idx[idx >= 0], m)
                if len(row):
                    present, size = np.unique(row, return_counts=True)
                    yield _block(part[key].take(pa.array(present)), fitted, size, idx, tf.astype(np.int32), m)

    blocks = docs.select(key, "fitted", "terms").mapInArrow(pack, f"keys array<{kind}>, fitted boolean, ptr binary, idx binary, val binary")
    return TermMatrix(materialize(blocks, "term-blocks"), key, kind, vocabulary, idf, sublinear)


def pack_weights(rows: DataFrame, key: str, vocabulary: list[str]) -> TermMatrix:
    """The matrix of (key, fitted, idx, val), a row per document with its term numbers in order and their weights."""
    kind, m = dict(rows.dtypes)[key], len(vocabulary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fitted in (True, False):
                part = batch.filter(batch["fitted"] if fitted else pa.compute.invert(batch["fitted"]))
                if part.num_rows:
                    size, idx, val = (part["idx"].value_lengths(), part["idx"].flatten(), part["val"].flatten())
                    yield _block(part[key], fitted, *(x.to_numpy(zero_copy_only=False) for x in (size, idx, val)), m)

    blocks = rows.select(key, "fitted", "idx", "val").mapInArrow(pack, f"keys array<{kind}>, fitted boolean, ptr binary, idx binary, val binary")
    return TermMatrix(materialize(blocks, "term-blocks"), key, kind, vocabulary)


# --- products ---


def product(ptr: np.ndarray, idx: np.ndarray, val: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Sparse rows times ``dense``; rows of about equal length are gathered and multiplied together."""
    size = np.diff(ptr)
    out, order = np.zeros((len(size), dense.shape[1])), np.argsort(size, kind="stable")
    ordered, at = size[order], int(np.count_nonzero(size == 0))
    while at < len(order):
        end = int(np.searchsorted(ordered, ordered[at] + ordered[at] // 4, "right"))
        width = int(ordered[end - 1])
        cols, step = np.arange(width), max(1, GATHERED // width)
        for i in range(at, end, step):
            rows = order[i : min(i + step, end)]
            place = ptr[rows][:, None] + cols
            beyond = cols >= size[rows][:, None]
            place[beyond] = 0
            v = val[place]
            v[beyond] = 0.0
            out[rows] = np.matmul(v[:, None, :], dense[idx[place]])[:, 0]
        at = end
    return out


def solve(top: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Topic weights of documents by multiplicative updates; ``top``: documents times the factor."""
    out = np.full(top.shape, 0.1)
    for i in range(0, len(out), 512):
        w, t = out[i : i + 512], top[i : i + 512]
        d = np.empty_like(w)
        for _ in range(STEPS):
            np.matmul(w, gram, out=d)
            np.maximum(d, 1e-12, out=d)
            np.divide(t, d, out=d)
            np.multiply(w, d, out=w)
    return out


def factor_sums(matrix: TermMatrix, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(topics x topics, topics x terms) sums over the fitted documents; tasks are added up in the cluster, range by range."""
    context = matrix.blocks.sparkSession.sparkContext
    shared = context.broadcast((factor, matrix.idf))
    sublinear, (k, m), cores = matrix.sublinear, factor.shape, context.defaultParallelism
    edges = np.linspace(0, m, min(m, 4 * cores) + 1).astype(int)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, idf = shared.value
        across, gram = np.ascontiguousarray(h.T), h @ h.T
        a, b = np.zeros((k, k)), np.zeros((m, k))
        for batch in batches:
            for cells in zip(*(batch[c].to_pylist() for c in ("ptr", "idx", "val"))):
                ptr, idx, val = _read(*cells, idf, sublinear, m)
                w = solve(product(ptr, idx, val, across), gram)
                a += w.T @ w
                order = np.argsort(idx, kind="stable")
                terms, start = np.unique(idx[order], return_index=True)
                doc = np.repeat(np.arange(len(w)), np.diff(ptr))[order]
                b[terms] += product(np.append(start, len(idx)), doc, val[order], w)
        yield from (_part(-1, a), *(_part(i, b[edges[i] : edges[i + 1]]) for i in range(len(edges) - 1)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells in zip(batch["part"].to_pylist(), batch["cells"].to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(cells)
        yield from (_part(part, x) for part, x in total.items())

    schema = "part int, cells binary"
    parts = matrix.blocks.filter("fitted").select("ptr", "idx", "val").coalesce(cores).mapInArrow(sums, schema)
    found = {r["part"]: np.frombuffer(r["cells"]) for r in parts.repartition(cores, "part").mapInArrow(add, schema).collect()}
    shared.destroy()
    return found[-1].reshape(k, k), np.concatenate([found[i].reshape(-1, k) for i in range(len(edges) - 1)]).T


def _part(part: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int32()), pa.array([cells.tobytes()], pa.binary())], names=["part", "cells"])


def topic_weights(matrix: TermMatrix, factor: np.ndarray) -> DataFrame:
    """(key, topic_weights) of every document."""
    shared = matrix.blocks.sparkSession.sparkContext.broadcast((factor, matrix.idf))
    key, sublinear, m = matrix.key, matrix.sublinear, len(matrix.vocabulary)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, idf = shared.value
        across, gram = np.ascontiguousarray(h.T), h @ h.T
        for batch in batches:
            for keys, *cells in zip(batch["keys"], *(batch[c].to_pylist() for c in ("ptr", "idx", "val"))):
                w = solve(product(*_read(*cells, idf, sublinear, m), across), gram)
                ends = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
                yield pa.record_batch([keys.values, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=[key, "topic_weights"])

    return matrix.blocks.select("keys", "ptr", "idx", "val").mapInArrow(assign, f"{key} {matrix.kind}, topic_weights array<double>")
