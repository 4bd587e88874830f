"""Quoted CSV read by many tasks, whatever its cells hold.

Spark splits plain text files at line ends, which a quoted cell may hold. Whether a split begins
inside such a cell follows from the number of quotes before it: a first pass tells for each split
whether its number of quotes is odd, and a prefix over the splits, a few bytes each, tells where
each begins. A second pass cuts the lines into records; the pieces of a record that runs over a
split's end are put together by the split that it opens in.

Cells are quoted as RFC 4180 has it: a cell with a quote, delimiter or line end stands in quotes, a
quote in it is doubled; a quote inside an unquoted cell isn't allowed. Lines end in LF or CR LF; line
ends in cells stay as they are. Blank lines between records are left out. Without a quote at the
file's end the last record runs to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyscale.sources.package import ship
from storyscale.sources.shared import stored, work_dir

#: Room of a file in the order of rows, in bytes; a file is smaller, and there are at most 2 ** 23.
FILE = 1 << 40


class Splits(NamedTuple):
    """Arrays over the splits of all files, by ``key``."""

    key: np.ndarray
    inside: np.ndarray  #: whether it begins in a quoted cell
    owner: np.ndarray  #: the place of the split that opened that cell's record, in the files' order
    place: np.ndarray  #: its own place
    base: np.ndarray  #: where it begins: of a file's first split a multiple of FILE


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
    return lines.select(F.xxhash64(*place).alias("split"), *place, "value")


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.count_substring(lines, '"'), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one split."""
    cut = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    yield from ((i, j) for i, j in zip(cut, cut[1:]) if i < j)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """split, whether it has an odd number of quotes, and whether a line ends behind an odd number (so that a cell that is open at its start ends in it)."""
    now, odd, closes = None, 0, False
    names = ["split", "odd", "closes"]
    for b in batches:
        keys, quotes = b.column(0).to_numpy(), _quotes(b.column(1))
        for i, j in _parts(keys):
            if now is not None and keys[i] != now:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bool(odd)]), pa.array([closes])], names)
            if keys[i] != now:
                now, odd, closes = int(keys[i]), 0, False
            so_far = (odd + np.cumsum(quotes[i:j])) & 1
            odd, closes = int(so_far[-1]), closes or bool(so_far.any())
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([bool(odd)]), pa.array([closes])], names)


def _splits(lines: DataFrame) -> Splits:
    """What the second pass must know of each split; on the driver, which lists the splits anyway."""
    where = lines.groupBy("split").agg(F.first("path").alias("path"), F.first("start").alias("start"))
    told = lines.select("split", "value").mapInArrow(_count, "split long, odd boolean, closes boolean")
    t = told.join(where, "split").select("path", "start", "split", "odd", "closes").toArrow()  # a row for each split
    t = t.sort_by([("path", "ascending"), ("start", "ascending")])
    n = t.num_rows
    split, start, odd, closes = (t[c].to_numpy() for c in ("split", "start", "odd", "closes"))
    if len(np.unique(split)) < n:
        raise ValueError("two splits have one key")
    path = t["path"].combine_chunks().dictionary_encode().indices.to_numpy() if n else np.zeros(0, np.int64)
    inside, owner = np.zeros(n, bool), np.arange(n)
    for k in range(1, n):
        if path[k] == path[k - 1]:
            inside[k] = inside[k - 1] ^ odd[k - 1]
            owner[k] = owner[k - 1] if inside[k - 1] and not closes[k - 1] else k - 1
    by = np.argsort(split)
    return Splits(split[by], inside[by], owner[by], by, (path.astype(np.int64) * FILE + start)[by])


class _Cutter:
    """Cuts the lines of one task's splits to rows (ord, owner, record); owner is null of a whole record."""

    def __init__(self, splits: Splits, header: bool) -> None:
        self.splits, self.header = splits, header
        self.key, self.open, self.rows = None, [], []

    def enter(self, key: int) -> None:
        self.leave()
        k = int(np.searchsorted(self.splits.key, key))
        self.key, self.odd, self.line = key, int(self.splits.inside[k]), int(self.splits.base[k])
        self.place = int(self.splits.place[k])
        self.head = self.header and self.line % FILE == 0
        self.began, self.owner = self.line, int(self.splits.owner[k]) if self.odd else None

    def leave(self) -> None:
        """The record that is open at the split's end goes on in the next."""
        if self.open:
            self.put(self.began, self.place if self.owner is None else self.owner, self.open)
            self.open = []

    def put(self, at: int, owner: int | None, lines: list[str]) -> None:
        text = "\n".join(lines)
        if owner is None and text in ("", "\r"):
            return
        if self.head and owner in (None, self.place):
            self.head = False
            if owner is None:
                return
            raise ValueError("a header must lie in the first split of its file")
        self.rows.append((at, owner, text))

    def add(self, lines: list[str], quotes: np.ndarray) -> None:
        after = ((self.odd + np.cumsum(quotes)) & 1).tolist()
        for text, odd in zip(lines, after):
            if not self.open and self.owner is None:
                self.began = self.line
            if odd:
                self.open.append(text)
            else:
                self.put(self.began, self.owner, [*self.open, text] if self.open else [text])
                self.open, self.owner = [], None
            self.line += 1
        self.odd = after[-1]


def _cut(splits: Splits, header: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _Cutter(splits, header)
        for b in batches:
            keys, quotes = b.column(0).to_numpy(), _quotes(b.column(1))
            lines = pc.fill_null(b.column(1), "").to_pylist()
            for i, j in _parts(keys):
                if int(keys[i]) != c.key:
                    c.enter(int(keys[i]))
                c.add(lines[i:j], quotes[i:j])
            yield _made(c)
        if c.key is not None:
            c.leave()
            yield _made(c)

    return run


def _made(c: _Cutter) -> pa.RecordBatch:
    rows, c.rows = c.rows, []
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["row_ord", "owner", "record"])


def records(spark: SparkSession, path: str | list[str], header: bool = True) -> DataFrame:
    """row_ord and the text of each record of CSV files, in the order of paths and places; ``header``: without the first of each file."""
    lines = _lines(ship(spark), path)
    cut = lines.select("split", "value").mapInArrow(_cut(_splits(lines), header), "row_ord long, owner long, record string")
    cut = stored(cut, work_dir(spark, "csv"))  # read twice below
    piece = F.struct("row_ord", "record")
    joined = cut.where("owner IS NOT NULL").groupBy("owner").agg(F.array_sort(F.collect_list(piece)).alias("p"))  # the pieces of one record
    joined = joined.select(F.col("p")[0]["row_ord"].alias("row_ord"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    out = cut.where("owner IS NULL").select("row_ord", "record").unionByName(joined)
    return out.withColumn("record", F.when(F.endswith("record", F.lit("\r")), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record")))


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The cells of CSV files with a header as text, '' where one is empty or missing, and row_ord; cells beyond the header are left out."""
    names = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").columns
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    cells = F.from_csv("record", schema, {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    rows = records(spark, path).select("row_ord", cells.alias("cells"))
    return rows.select(*[F.coalesce(F.col(f"cells.c{i}"), F.lit("")).alias(n) for i, n in enumerate(names)], "row_ord")
