"""Parquet footers and dictionary pages, read on the executors.

For every column chunk (file x row group x column) this yields what can be known without decoding data pages: exact null
count, exact extrema, whether the load column is constant in the row group, and, where *every* data page of the chunk is
dictionary encoded, the complete list of distinct values (the dictionary page). Only page headers and the dictionary page are
read; data page bodies are skipped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq

DATA_PAGE, DICTIONARY_PAGE, DATA_PAGE_V2 = 0, 2, 3
DICTIONARY_ENCODINGS = (2, 8)  # PLAIN_DICTIONARY, RLE_DICTIONARY
HEADER_BYTES = 16 * 1024

CHUNK_SCHEMA = (
    "file string, row_group int, field string, load_value string, n_values long, null_count long, "
    "min_value string, max_value string, all_dictionary boolean, distinct_values array<string>"
)


class _Compact:
    """Reader of the Thrift compact protocol, as far as page headers use it."""

    def __init__(self, data: bytes) -> None:
        self.data, self.pos = data, 0

    def byte(self) -> int:
        self.pos += 1
        return self.data[self.pos - 1]

    def varint(self) -> int:
        shift = value = 0
        while True:
            b = self.byte()
            value |= (b & 0x7F) << shift
            if not b & 0x80:
                return value
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int) -> object:
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            return self.byte()
        if kind in (4, 5, 6):
            return self.zigzag()
        if kind == 7:
            self.pos += 8
            return struct.unpack("<d", self.data[self.pos - 8 : self.pos])[0]
        if kind == 8:
            size = self.varint()
            self.pos += size
            return self.data[self.pos - size : self.pos]
        if kind in (9, 10):
            head = self.byte()
            size = head >> 4
            if size == 15:
                size = self.varint()
            return [self.value(head & 0x0F) for _ in range(size)]
        if kind == 12:
            return self.struct()
        raise ValueError(f"unexpected thrift type {kind}")

    def struct(self) -> dict[int, object]:
        fields: dict[int, object] = {}
        number = 0
        while head := self.byte():
            delta = head >> 4
            number = number + delta if delta else self.zigzag()
            fields[number] = self.value(head & 0x0F)
        return fields


def _decode_plain_strings(body: bytes, count: int) -> list[str]:
    values, pos = [], 0
    for _ in range(count):
        (size,) = struct.unpack_from("<I", body, pos)
        values.append(body[pos + 4 : pos + 4 + size].decode("utf-8", "replace"))
        pos += 4 + size
    return values


def chunk_dictionary(handle: pa.NativeFile, chunk: pq.ColumnChunkMetaData) -> list[str] | None:
    """All distinct values of a string column chunk, or None unless every data page uses the dictionary."""
    if chunk.physical_type != "BYTE_ARRAY" or not chunk.has_dictionary_page:
        return None
    start = chunk.dictionary_page_offset or chunk.data_page_offset
    end = start + chunk.total_compressed_size
    values: list[str] | None = None
    while start < end:
        handle.seek(start)
        head = handle.read(min(HEADER_BYTES, end - start))
        reader = _Compact(head)
        try:
            page = reader.struct()
        except IndexError:
            return None  # a header longer than the window (large page statistics): unknown, so the chunk is scanned
        size = page[3]
        if page[1] == DICTIONARY_PAGE:
            handle.seek(start + reader.pos)
            body = handle.read(size)
            if chunk.compression != "UNCOMPRESSED":
                body = pa.Codec(chunk.compression.lower()).decompress(body, page[2]).to_pybytes()
            values = _decode_plain_strings(body, page[7][1])
        elif page[1] == DATA_PAGE and page[5][2] not in DICTIONARY_ENCODINGS:
            return None
        elif page[1] == DATA_PAGE_V2 and page[8][4] not in DICTIONARY_ENCODINGS:
            return None
        start += reader.pos + size
    return values


def open_parquet(path: str) -> tuple[pa.NativeFile, pq.FileMetaData]:
    """The file's handle and footer, from any filesystem that Arrow knows."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:/") and not path.startswith("file://"):
            path = "file://" + path[len("file:") :]
        fs, inner = pafs.FileSystem.from_uri(path)
    else:
        fs, inner = pafs.LocalFileSystem(), path
    handle = fs.open_input_file(inner)
    return handle, pq.read_metadata(handle)


def read_chunks(fields: list[str], load_field: str):
    """A mapInPandas function from file paths to one row per (row group, field); see CHUNK_SCHEMA."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["file"]:
                rows = []
                handle, meta = open_parquet(path)
                names = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    load = None
                    if load_field in names:
                        chunk = group.column(names[load_field])
                        stats = chunk.statistics
                        if stats is not None and stats.has_min_max and stats.has_null_count and stats.null_count == 0 and stats.min == stats.max:
                            load = str(stats.min)
                    for field in fields:
                        if field not in names:
                            rows.append((path, g, field, load, group.num_rows, group.num_rows, None, None, True, []))
                            continue
                        chunk = group.column(names[field])
                        stats = chunk.statistics
                        nulls = int(stats.null_count) if stats is not None and stats.has_null_count else None
                        low, high = (str(stats.min), str(stats.max)) if stats is not None and stats.has_min_max else (None, None)
                        values = chunk_dictionary(handle, chunk)
                        rows.append((path, g, field, load, chunk.num_values, nulls, low, high, values is not None, values or []))
                handle.close()
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")]).astype({"null_count": "Int64", "n_values": "int64"})

    return run
