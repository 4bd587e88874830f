"""Order without a single task: consecutive numbers over a whole table, and ordered folds of groups.

Numbers: rows are dealt out by ranges of their order and numbered in each part; a part's offset is the
number of rows before it, from one count a part. Folds: a group's rows pass in order through a small
state, so no group is collected. Where the state of two neighbouring stretches follows from the
states of each, a group also spreads over many tasks, whatever share of the rows it holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from storyscale.sources.package import ship
from storyscale.sources.shared import stored, work_dir

_PLACE = (1 << 33) - 1  # the lower bits of monotonically_increasing_id: a row's place in its task


def numbered(df: DataFrame, order: list[str | Column], name: str = "place", start: int = 1) -> DataFrame:
    """``df`` with consecutive long numbers in the given order, which must be total for the same numbers each time.

    Rows that are equal in ``order`` are numbered by one task.
    """
    spark = df.sparkSession
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(_PLACE)})
    rows = stored(rows, work_dir(spark, "numbered"))
    counts = sorted(tuple(r) for r in rows.groupBy("__part").count().collect())  # a row for each part
    before = accumulate((n for _, n in counts), initial=start)
    offsets = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before)], "__part int, __before long")
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


class Fold(Protocol):
    """A group's state: takes its rows in order, batch by batch, and gives the values of its output columns."""

    def add(self, rows: pa.RecordBatch) -> None: ...

    def result(self) -> tuple: ...


def _runs(b: pa.RecordBatch, keys: int) -> Iterator[tuple[tuple, int, int]]:
    """(key, first row, end) of the stretches of one key."""
    rows = list(zip(*(b.column(i).to_pylist() for i in range(keys))))
    i = 0
    for j in range(1, len(rows) + 1):
        if j == len(rows) or rows[j] != rows[i]:
            yield rows[i], i, j
            i = j


def _fold_sorted(rows: DataFrame, keys: list[str], new: Callable[[], Fold], made: str) -> DataFrame:
    """keys and ``made`` of each stretch of one key in the tasks' rows."""
    schema = T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL(made).fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for b in batches:
            done = []
            for key, i, j in _runs(b, len(keys)):
                if fold is None or key != now:
                    if fold is not None:
                        done.append((*now, *fold.result()))
                    now, fold = key, new()
                fold.add(b.slice(i, j - i))
            if done:
                yield _batch(done, arrow)
        if fold is not None:
            yield _batch([(*now, *fold.result())], arrow)

    return rows.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def folded(df: DataFrame, keys: list[str], order: list[str], new: Callable[[], Fold], made: str) -> DataFrame:
    """keys and the columns ``made`` (as DDL) of each group, its rows folded in order by one task, in a stream.

    The fold sees all columns of ``df``, keys first. A null key is a key like any other.
    """
    ship(df.sparkSession)
    rest = [c for c in df.columns if c not in keys]
    rows = df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    return _fold_sorted(rows, keys, new, made)


# -- digests of joined texts ----------------------------------------------------------------------

_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials over two elements modulo CRC-32's, highest power in the lowest bit."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_joined(a: int, b: int, size: int) -> int:
    """CRC-32 of two byte strings behind each other, from theirs and the second's length in bytes."""
    power, square = 1 << 31, 1 << 23  # 1 and x ** 8: the step over a byte
    while size:
        if size & 1:
            power = _times(power, square)
        square = _times(square, square)
        size >>= 1
    return _times(power, a) ^ b


class _Digest:
    """Rows, characters, bytes and CRC-32 of the texts in the last column, joined."""

    def __init__(self, gap: str) -> None:
        self.gap, self.n, self.chars, self.bytes, self.crc = gap, 0, 0, 0, 0

    def add(self, rows: pa.RecordBatch) -> None:
        texts = rows.column(rows.num_columns - 1).fill_null("").to_pylist()
        whole = self.gap.join(["", *texts] if self.n else texts)
        data = whole.encode()
        self.n, self.chars, self.bytes, self.crc = self.n + len(texts), self.chars + len(whole), self.bytes + len(data), zlib.crc32(data, self.crc)

    def result(self) -> tuple:
        return self.n, self.chars, self.bytes, self.crc


class _Combined:
    """The digest of stretches behind each other."""

    def __init__(self, gap: str) -> None:
        self.gap, self.state = gap, None

    def add(self, rows: pa.RecordBatch) -> None:
        names = ("n", "chars", "bytes", "crc32")
        gap = self.gap.encode()
        for n, chars, size, crc in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in names)):
            if self.state is None:
                self.state = (n, chars, size, crc)
            else:
                a = self.state
                self.state = (a[0] + n, a[1] + len(self.gap) + chars, a[2] + len(gap) + size, crc_joined(zlib.crc32(gap, a[3]), crc, size))

    def result(self) -> tuple:
        return self.state


DIGEST = "n long, chars long, bytes long, crc32 long"


def joined_digest(df: DataFrame, keys: list[str], order: list[str], text: Column, gap: str) -> DataFrame:
    """keys with the rows, characters, bytes and CRC-32 of each group's texts in order (a null one empty), joined by ``gap``.

    The rows of a group spread over tasks by ranges of (keys, order), which must tell rows apart for the
    same digest each time; the joined text stands nowhere. Keys must not be named like the digest's columns.
    """
    ship(df.sparkSession)
    rows = df.select(*keys, *[F.col(o).alias(f"__order{i}") for i, o in enumerate(order)], text.alias("__text"))
    by = [*keys, *[f"__order{i}" for i in range(len(order))]]
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id()).select("__part", *keys, "__text")
    parts = _fold_sorted(rows, ["__part", *keys], lambda: _Digest(gap), DIGEST)  # a row for each group and each part that it has
    return folded(parts, keys, ["__part"], lambda: _Combined(gap), DIGEST)


class Joined:
    """The joined texts of the last column themselves, and the first values, by the column before it, of others."""

    def __init__(self, gap: str, firsts: int) -> None:
        self.gap, self.firsts, self.texts, self.first = gap, firsts, [], None

    def add(self, rows: pa.RecordBatch) -> None:
        n = rows.num_columns
        self.texts.extend(rows.column(n - 1).fill_null("").to_pylist())
        at = rows.column(n - 2).to_pylist()
        i = min(range(len(at)), key=lambda k: (at[k] is None, at[k] if at[k] is not None else 0))
        new = (at[i] is None, at[i], *(rows.column(n - 2 - self.firsts + k)[i].as_py() for k in range(self.firsts)))
        if self.first is None or (new[0], new[1] or 0) < (self.first[0], self.first[1] or 0):
            self.first = new

    def result(self) -> tuple:
        return (len(self.texts), *self.first[2:], self.gap.join(self.texts))
