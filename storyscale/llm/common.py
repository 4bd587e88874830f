"""Shared helpers of the training-data operators: inputs, shared folders and files, batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyscale.sources.package import ship
from storyscale.sources.shared import delete, work_dir

__all__ = ["delete", "work_dir"]

#: White space of the word definition ``[^\x20\x09-\x0D]+``, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a batch of rows for a Python worker, where the session has Spark's default.
BATCH = "8m"


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package on its Python workers' path, wherever the driver was started, and batches by size.

    Rows differ in length by powers of ten, so batches are bounded by bytes; a longer row is a batch of its own.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return ship(spark)


def checkpointed(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a shared folder, closely packed, and read again: cuts its lineage, survives lost executors."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path


def write_file(uri: str, parts: list) -> None:
    """Write a file in one step: a task that is run again writes the same file over."""
    fs, path = _place(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as f:
        for p in parts:
            f.write(memoryview(np.ascontiguousarray(p)).cast("B") if isinstance(p, np.ndarray) and p.size else b"" if isinstance(p, np.ndarray) else p)
    fs.move(tmp, path)


def read_file(uri: str) -> bytes:
    fs, path = _place(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def _mapped(path: str, dtype: str) -> np.ndarray:
    """A local file as an array; a plain view, whose slices cost less than a memmap's."""
    return np.memmap(path, dtype=dtype, mode="r").view(np.ndarray) if os.path.getsize(path) else np.empty(0, dtype)


@lru_cache(maxsize=4096)
def map_array(uri: str, dtype: str) -> np.ndarray:
    """A file of the shared folder as a memory-mapped array.

    A folder that is a mounted file system is mapped in place; from any other store the file is
    copied once for each worker process and unlinked when mapped, so that nothing stays behind.
    """
    fs, path = _place(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return _mapped(path, dtype)
    with tempfile.NamedTemporaryFile() as f, fs.open_input_stream(path) as g:
        while block := g.read(1 << 22):
            f.write(block)
        f.flush()
        return _mapped(f.name, dtype)


def rows_of(batch: pa.RecordBatch, column: str | int = "text") -> pa.Array:
    """A text column of a batch with nulls as empty texts."""
    a = batch.column(column)
    return a.fill_null("") if a.null_count else a


def text_bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them, without a copy."""
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
