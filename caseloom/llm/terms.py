"""Frequency of every distinct term: a range-partitioned external sort of (term, record) pairs with run-length scanning.

Run generation: each input task turns its records into (term, record) pairs, sorts a bounded buffer of them and scans it,
emitting one run (term, occurrences, records) per term of the buffer. A record lies in one buffer only, so the record counts
of runs add up exactly; a term that stands in a third of all rows costs one row per buffer instead of one per record. Merge:
runs are range-partitioned by term, sorted inside partitions and scanned once more. No hash table of the vocabulary exists
anywhere, so memory stays bounded for any number of distinct terms.

A term is a longest run of two or more Unicode letters and numbers in the lower-cased text.

Defined results: null texts are not records for the share; blank texts are records without terms; repeated rows count each
time; the text is taken whole, whatever its length (a text with more pairs than the buffer gets a buffer of its own); an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.session import default_parallelism, materialize, ship_package, spread

NOT_TERM = r"[^\p{L}\p{N}]+"
BUFFER_PAIRS = 2_000_000  # pairs sorted at once in a task; about 100 MB with the terms
RUN_SCHEMA = "term string, occurrences long, records long"


def sorted_run(term_codes: np.ndarray, records: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts (term code, record) pairs and scans the runs: codes present, occurrences and distinct records of each."""
    pairs = np.sort(term_codes.astype(np.int64) << np.int64(32) | records.astype(np.int64))
    codes = pairs >> np.int64(32)
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    new_pair = np.concatenate(([True], pairs[1:] != pairs[:-1]))
    return codes[starts], np.diff(np.append(starts, len(pairs))), np.add.reduceat(new_pair.astype(np.int64), starts)


def _emit(texts: pa.ChunkedArray | pa.Array) -> pa.RecordBatch:
    """The runs of one buffer of lower-cased texts, plus one row with a null term that carries the number of records."""
    records_here = len(texts) - texts.null_count
    tokens = pc.split_pattern_regex(texts.drop_null(), NOT_TERM)
    if isinstance(tokens, pa.ChunkedArray):
        tokens = tokens.combine_chunks()
    terms = pc.list_flatten(tokens)
    owners = pc.list_parent_indices(tokens)
    keep = pc.greater_equal(pc.utf8_length(terms), 2)
    terms, owners = terms.filter(keep), owners.filter(keep)
    coded = terms.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    vocabulary = coded.dictionary
    order = np.asarray(pc.sort_indices(vocabulary))  # codes in term order, so that the run leaves sorted
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    if len(coded):
        codes, occurrences, records = sorted_run(rank[coded.indices.to_numpy(zero_copy_only=False)], owners.to_numpy(zero_copy_only=False), len(order))
        names = vocabulary.take(pa.array(order[codes]))
    else:
        occurrences = records = np.empty(0, dtype=np.int64)
        names = pa.array([], pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([names.cast(pa.string()), pa.array([None], pa.string())]), pa.array(np.append(occurrences, 0)), pa.array(np.append(records, records_here))], names=["term", "occurrences", "records"]
    )


def generate_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: buffers texts until about BUFFER_PAIRS pairs are held (six bytes a pair), then emits their sorted run."""
    held: list[pa.Array] = []
    size = 0
    for batch in batches:
        column = batch.column(0)
        at = 0
        while at < len(column):
            room = max(1, min(len(column) - at, 1 + int((6 * BUFFER_PAIRS - size) / max(1, column.nbytes / len(column)))))
            piece = column.slice(at, room)
            held.append(piece)
            size += piece.nbytes
            at += room
            if size >= 6 * BUFFER_PAIRS:
                yield _emit(pa.chunked_array(held))
                held, size = [], 0
    if held:
        yield _emit(pa.chunked_array(held))


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow over runs sorted by term: a run-length scan that adds up neighbours, carrying one term across batches."""
    carry: tuple[str, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column(0)
        occurrences, records = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        change = pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        starts = np.flatnonzero(np.concatenate(([True], change)))
        names = terms.take(pa.array(starts)).to_pylist()
        occ, rec = np.add.reduceat(occurrences, starts), np.add.reduceat(records, starts)
        if carry is not None:
            if carry[0] == names[0]:
                occ[0] += carry[1]
                rec[0] += carry[2]
            else:
                names, occ, rec = [carry[0], *names], np.insert(occ, 0, carry[1]), np.insert(rec, 0, carry[2])
        carry = (names[-1], int(occ[-1]), int(rec[-1]))
        if len(names) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(names[:-1], pa.string()), pa.array(occ[:-1]), pa.array(rec[:-1])], names=["term", "occurrences", "records"])
    if carry is not None:
        yield pa.RecordBatch.from_arrays([pa.array([carry[0]], pa.string()), pa.array([carry[1]], pa.int64()), pa.array([carry[2]], pa.int64())], names=["term", "occurrences", "records"])


def term_frequencies(df: DataFrame, text: str) -> tuple[DataFrame, int]:
    """(term, occurrences, records) for every distinct term, and the number of records (texts that are not null)."""
    ship_package(df.sparkSession)
    runs = materialize(spread(df.select(F.lower(F.col(text)).alias("text"))).mapInArrow(generate_runs, RUN_SCHEMA), "term-runs")
    total = runs.filter("term IS NULL").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    ordered = runs.filter("term IS NOT NULL").repartitionByRange(default_parallelism(df.sparkSession), "term").sortWithinPartitions("term")
    return ordered.mapInArrow(merge_runs, RUN_SCHEMA), total


def mark_terms(terms: DataFrame, total: int, rare_most: int = 2, common_share: tuple[int, int] = (1, 5)) -> DataFrame:
    """Adds ``verdict``: rare (in at most ``rare_most`` records), common (in more than the share of all records), or usual."""
    part, whole = common_share
    verdict = F.when(F.col("records") <= rare_most, "rare").when(F.col("records") * whole > F.lit(total * part), "common").otherwise("usual")
    return terms.withColumn("verdict", verdict)
