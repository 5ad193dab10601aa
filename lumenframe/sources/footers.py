"""Parquet footers and dictionary pages, read on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame

from lumenframe.session import spread, written

FOOTER_SCHEMA = "file string, row_group int, column string, rows long, nulls long, lo double, hi double, exact boolean, present boolean"

#: Fixed values of the Parquet format: the types as they stand in a compact Thrift struct, the field
#: numbers of a page header (for each kind of data page, that of its encoding), the encodings that
#: mean a dictionary, and the element types of PLAIN dictionaries.
THRIFT_STOP, THRIFT_TRUE, THRIFT_FALSE, THRIFT_BYTE, THRIFT_BINARY, THRIFT_LIST, THRIFT_STRUCT = 0, 1, 2, 3, 8, 9, 12
PAGE_SIZE_FIELD, DICTIONARY_HEADER_FIELD, COUNT_FIELD = 3, 7, 1
DATA_PAGE_ENCODING = {5: 2, 8: 4}
DICTIONARY_ENCODINGS = (2, 8)
PLAIN_TYPES = {"DOUBLE": "<f8", "FLOAT": "<f4", "INT64": "<i8", "INT32": "<i4"}


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def _struct(buf: bytes, at: int) -> tuple[dict, int]:
    """The integer and struct fields of a compact Thrift struct, by field number."""
    out, field = {}, 0
    while True:
        head = buf[at]
        at += 1
        kind, step = head & 0x0F, head >> 4
        if kind == THRIFT_STOP:
            return out, at
        if step:
            field += step
        else:
            raw, at = _varint(buf, at)
            field = (raw >> 1) ^ -(raw & 1)
        if kind in (THRIFT_TRUE, THRIFT_FALSE):
            out[field] = kind == THRIFT_TRUE
        elif kind == THRIFT_BYTE:
            out[field], at = buf[at], at + 1
        elif kind == THRIFT_BINARY:
            size, at = _varint(buf, at)
            at += size
        elif kind == THRIFT_STRUCT:
            out[field], at = _struct(buf, at)
        elif kind == THRIFT_LIST:
            raise ValueError("no list is expected in a page header")
        else:
            raw, at = _varint(buf, at)
            out[field] = (raw >> 1) ^ -(raw & 1)


def dictionary_values(raw: pa.NativeFile, chunk: pq.ColumnChunkMetaData) -> np.ndarray | list[str] | None:
    """The numbers or texts in a chunk's dictionary page, or None if there is none or it holds neither."""
    kind = PLAIN_TYPES.get(chunk.physical_type)
    if (kind is None and chunk.physical_type != "BYTE_ARRAY") or not chunk.has_dictionary_page:
        return None
    start = chunk.dictionary_page_offset
    size = chunk.data_page_offset - start
    raw.seek(start)
    buf = raw.read(size)
    header, body = _struct(buf, 0)
    packed = buf[body : body + header[PAGE_SIZE_FIELD]]
    count = header[DICTIONARY_HEADER_FIELD][COUNT_FIELD]
    if chunk.compression != "UNCOMPRESSED":
        packed = pa.Codec(chunk.compression.lower()).decompress(packed, header[2], asbytes=True)
    if kind is not None:
        return np.frombuffer(packed, kind, count)
    out, at = [], 0
    for _ in range(count):  # a text is its length in four bytes, then its bytes
        n = int.from_bytes(packed[at : at + 4], "little")
        out.append(packed[at + 4 : at + 4 + n].decode("utf-8", "replace"))
        at += 4 + n
    return out


def _header(raw: pa.NativeFile, at: int) -> tuple[dict, int]:
    """The page header at an offset, and the offset of what follows it."""
    size = 512
    while True:
        raw.seek(at)
        buf = raw.read(size)
        try:
            got, used = _struct(buf, 0)
            return got, at + used
        except IndexError:
            if len(buf) < size:
                raise
            size *= 8


def dictionary_only(raw: pa.NativeFile, chunk: pq.ColumnChunkMetaData) -> bool:
    """True if every data page of the chunk refers to its dictionary.

    The list of encodings in a footer does not tell (the dictionary page itself is PLAIN), so the
    headers of the pages are read; their bodies are skipped.
    """
    if not chunk.has_dictionary_page or not any(e.endswith("DICTIONARY") for e in chunk.encodings):
        return False
    at, end = chunk.data_page_offset, chunk.dictionary_page_offset + chunk.total_compressed_size
    while at < end:
        header, body = _header(raw, at)
        for field, encoding in DATA_PAGE_ENCODING.items():
            if field in header and header[field].get(encoding) not in DICTIONARY_ENCODINGS:
                return False
        at = body + header[PAGE_SIZE_FIELD]
    return True


def _number(x) -> float | None:
    return float(x) if isinstance(x, (int, float)) and x == x else None


def parquet_files(df: DataFrame, columns: list[str]) -> list[str]:
    """Parquet files whose rows are those of ``df``: its own if it is a bare scan of some, otherwise
    ``columns`` are written to the shared folder first (so no filter or column of ``df`` is passed over)."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        relation = plan.relation()
        if "Parquet" in relation.fileFormat().getClass().getSimpleName() and relation.partitionSchema().isEmpty():
            return df.inputFiles()
    return written(df.select(*[f"`{c}`" for c in columns])).inputFiles()


def read_footers(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (file, row group, column) of the Parquet files that hold ``df``.

    ``exact``: the footer states the number of nulls, and extrema if there are other values; ``lo`` and
    ``hi`` are those of numbers and truth values. A column that a file lacks is all NULL there
    (``present`` is false). Only footers are read; files are spread over the tasks.
    """
    files = parquet_files(df, columns)
    wanted = list(columns)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uri in batch["file"]:
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as raw:
                    meta = pq.ParquetFile(raw).metadata
                names = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for name in wanted:
                        if name not in names:
                            rows.append((uri, g, name, group.num_rows, group.num_rows, None, None, True, False))
                            continue
                        st = group.column(names[name]).statistics
                        exact = bool(st and st.has_null_count and (st.has_min_max or st.null_count == group.num_rows))
                        lo, hi = (st.min, st.max) if st and st.has_min_max else (None, None)
                        rows.append((uri, g, name, group.num_rows, st.null_count if exact else None, _number(lo), _number(hi), exact, True))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOOTER_SCHEMA.split(", ")])

    spark = df.sparkSession
    n = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    return spark.createDataFrame([(f,) for f in files], "file string").repartition(n).mapInPandas(kernel, FOOTER_SCHEMA)


def by_file(feet: DataFrame) -> DataFrame:
    """The rows of ``read_footers`` gathered as ``file, facts``, spread over the tasks."""
    from pyspark.sql import functions as F

    facts = F.collect_list(F.struct("row_group", "column", "rows", "nulls", "lo", "hi", "exact", "present")).alias("facts")
    return spread(feet, "file").groupBy("file").agg(facts)


class Chunks:
    """The column chunks of one file, opened when something of it is asked for."""

    def __init__(self, uri: str):
        self.uri, self.file = uri, None

    def dictionary(self, row_group: int, column: str) -> np.ndarray | list[str] | None:
        """The distinct values of a chunk all of whose data pages refer to its dictionary, else None."""
        if self.file is None:
            fs, path = pafs.FileSystem.from_uri(self.uri)
            self.raw = fs.open_input_file(path)
            self.file = pq.ParquetFile(self.raw)
            meta = self.file.metadata
            self.at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        chunk = self.file.metadata.row_group(row_group).column(self.at[column])
        return dictionary_values(self.raw, chunk) if dictionary_only(self.raw, chunk) else None

    def close(self) -> None:
        if self.file is not None:
            self.raw.close()
