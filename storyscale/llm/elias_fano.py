"""Token ids in files with Elias-Fano coded document boundaries.

Documents lie in ascending id order over a row of files. A file holds the concatenated ids, and in
Elias-Fano code its document boundaries and its document ids (above the first one): of each value
the lower bits in a packed array, the upper bits in unary in a bit vector of about two bits a
document, with samples of the positions of its ones. ``select`` finds one value from a sample and a
few words, ``selects`` a run of neighbours, so no table of 64-bit offsets or ids is kept or read.

The files are written into the shared folder, each in one step under a name of its own, so a task
that is run again writes the same file. Null ids come first; rows of one id, or of none, that are
more than a file holds are spread over several. Within a file they lie in the order of their token
ids. Ids are whole numbers of up to 64 bits, also negative; text ids must be cast first, which
write() asks for. A null text is empty and holds the end id alone; very long texts are encoded as
batches of their own; further columns are not read, whatever their names; an empty table gives no
file and no row.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyscale.llm.common import _place, map_array, work_dir
from storyscale.llm.tokenizing import batches_of, encoder, vocabulary

#: The end id of each document.
END = 2
#: Documents for a file, and files at most; above them files grow.
DOCS_PER_FILE = 8192
FILES = 65_536
MAGIC = b"TOKIDS02"
#: Magic, bytes an id, low bits of boundaries and document ids; documents, ids, null ids, first document id; words of low and high and samples of both.
_HEADER = struct.Struct("<8sBBBxxxxxQQQq6Q")
SAMPLE = 256


class EliasFano(NamedTuple):
    """A non-decreasing sequence of n values."""

    n: int
    width: int  #: low bits of each value
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray  #: position of every SAMPLE-th one of high

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        width = max(0, int(values[-1]) // max(n, 1)).bit_length() - 1 if n else 0
        width = max(width, 0)
        low = values & np.uint64((1 << width) - 1)
        bits = ((low[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, width, _words(bits), _words(high), ones[::SAMPLE].astype(np.uint64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        x = self.low[word] >> shift
        nxt = self.low[np.minimum(word + 1, len(self.low) - 1)]
        x = np.where(shift + np.uint64(self.width) > np.uint64(64), x | (nxt << ((np.uint64(64) - shift) & np.uint64(63))), x)
        return (x & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def select(self, i: int) -> int:
        """Value i: from the nearest sample on, whole words are passed by their counts of ones."""
        k = i // SAMPLE
        at = int(self.samples[k])
        need = i - k * SAMPLE
        word = at >> 6
        bits = int(self.high[word]) >> (at & 63) << (at & 63)
        while (ones := bits.bit_count()) <= need:
            need -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(need):
            bits &= bits - 1
        position = (word << 6) + (bits & -bits).bit_length() - 1
        return (position - i << self.width) | int(self._low(np.array([i]))[0])

    def selects(self, first: int, last: int) -> np.ndarray:
        """Values first to last (exclusive): only the words between the samples around them are read."""
        if first >= last:
            return np.zeros(0, np.int64)
        k, end = first // SAMPLE, -(-last // SAMPLE)
        a = int(self.samples[k]) >> 6
        b = (int(self.samples[end]) >> 6) + 1 if end < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(np.ascontiguousarray(self.high[a:b]).view(np.uint8), bitorder="little")) + (a << 6)
        skip = int(np.searchsorted(ones, int(self.samples[k]))) + first - k * SAMPLE
        i = np.arange(first, last)
        return (ones[skip : skip + last - first] - i << self.width) | self._low(i)

    @property
    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.low, self.high, self.samples


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, bitorder="little")
    return np.frombuffer(packed.tobytes() + bytes(-len(packed) % 8), np.uint64)


class Reader:
    """A file of the format, memory-mapped."""

    def __init__(self, path: str):
        data = map_array(path, "u1")
        magic, size, width, id_width, n, total, self.nulls, self.first_id, *words = _HEADER.unpack(data[-_HEADER.size :].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{path} isn't a file of token ids")
        self.n, self.total = n, total
        parts, end = [], len(data) - _HEADER.size
        for count in reversed(words):
            parts.insert(0, data[end - 8 * count : end].view(np.uint64) if count else np.zeros(0, np.uint64))
            end -= 8 * count
        self.bounds = EliasFano(n + 1, width, *parts[:3])
        self.above = EliasFano(n - self.nulls, id_width, *parts[3:])  #: document ids that aren't null, less the first
        self.ids = data[: total * size].view(f"<u{size}")

    def doc_ids(self, first: int, last: int) -> pa.Array:
        """Document ids first to last (exclusive); the null ones come first."""
        nulls = min(max(self.nulls - first, 0), last - first)
        ids = self.above.selects(first + nulls - self.nulls, last - self.nulls) + self.first_id  # 64-bit, wrapping
        return pa.array(np.concatenate([np.zeros(nulls, np.int64), ids]), pa.int64(), mask=np.arange(last - first) < nulls)

    def document(self, i: int) -> np.ndarray:
        """The ids of document i, found by two selects."""
        return self.ids[self.bounds.select(i) : self.bounds.select(i + 1)]


def _write(path: str, docs: Iterator[tuple[int | None, bytes]], size: int) -> tuple[int, int]:
    """Write documents in order: ids as they come, then what tells where they lie."""
    fs, place = _place(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    tmp = f"{place}.{uuid.uuid4().hex}.tmp"
    bounds, doc_ids, nulls = [0], [], 0
    with fs.open_output_stream(tmp) as f:
        for doc_id, ids in docs:
            f.write(ids)
            bounds.append(bounds[-1] + len(ids) // size)
            if doc_id is None:
                nulls += 1
            else:
                doc_ids.append(doc_id)
        f.write(bytes(-bounds[-1] * size % 8))
        first = doc_ids[0] if doc_ids else 0
        ends, above = EliasFano.build(np.array(bounds)), EliasFano.build(np.array([i - first for i in doc_ids], np.uint64))
        parts = [*ends.parts, *above.parts]
        for part in parts:
            f.write(part.tobytes())
        f.write(_HEADER.pack(MAGIC, size, ends.width, above.width, nulls + len(doc_ids), bounds[-1], nulls, first, *map(len, parts)))
    fs.move(tmp, place)
    return nulls + len(doc_ids), bounds[-1]


def write(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json") -> list[tuple[int, int, int]]:
    """Write the token files; returns (file, documents, ids) of each, in order.

    Files take ranges of ids between quantiles of the id column, which a pass over that column
    alone gives; an id that is k quantiles is spread over the k files that end with it, null ids
    over files of their own in front. Texts are encoded once, before the shuffle, to ids of two bytes.
    """
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    enc = encoder(vocabulary(tokenizer), "word", "<u2")
    size = 2 if max(enc.tokenizer.get_vocab_size(with_added_tokens=True), END + 1) <= 1 << 16 else 4
    rows, named = df.select(F.count(F.lit(1)), F.count(id_col)).first()
    if not rows:
        return []
    per = max(DOCS_PER_FILE, -(-rows // FILES))
    of_null, of_ids = -(-(rows - named) // per), -(-named // per)
    files = of_null + of_ids
    bounds: list[int] = []
    if of_ids > 1:
        bounds = sorted(df.select(F.percentile_approx(F.col(id_col).cast("long"), [k / of_ids for k in range(1, of_ids)], F.lit(max(10_000, 10 * of_ids)))).first()[0])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary(tokenizer), "word", f"<u{size}")
        end = np.array([END], f"<u{size}").tobytes()
        edges = np.array(bounds, np.int64)
        met: Counter = Counter()  # rows of one text and one id that is spread: alike, so which of them goes where is the same whatever their order
        for b in batches:
            texts = b.column(1).fill_null("").to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            null, ids = b.column(0).is_null().to_numpy(zero_copy_only=False), b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            left = np.searchsorted(edges, ids, "left")
            file = np.where(null, 0, left + of_null)
            over = np.where(null, of_null, np.searchsorted(edges, ids, "right") - left)
            for t in np.flatnonzero(over > 1).tolist():
                mark = zlib.crc32(texts[t].encode())
                key = (None if null[t] else int(ids[t]), mark, len(texts[t]))
                file[t] += (mark + met[key]) % over[t]
                met[key] += 1
            for i, j in batches_of(lengths):
                ids = [x + end for x in enc.encode(texts[i:j])]
                yield pa.RecordBatch.from_arrays([pa.array(file[i:j], pa.int32()), b.column(0)[i:j], pa.array(ids, pa.binary())], ["file", "id", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int | None, bytes]]:
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        made, stream = [], rows()
        row = next(stream, None)
        while row is not None:
            file = row[0]

            def of_file() -> Iterator[tuple[int | None, bytes]]:
                nonlocal row
                while row is not None and row[0] == file:
                    yield row[1], row[2]
                    row = next(stream, None)

            made.append((file, *_write(f"{path}/{file:06d}.tok", of_file(), size)))
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int64()) for k in range(3)], ["file", "docs", "ids"])

    encoded = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "file int, id long, ids binary")
    dealt = encoded.repartitionById(files, F.col("file")).sortWithinPartitions("file", "id", "ids")
    return sorted(tuple(r) for r in dealt.mapInArrow(store, "file long, docs long, ids long").collect())  # a row for each file


def read(spark: SparkSession, path: str, files: list[tuple[int, int, int]], id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of each document, from the files: start counts the ids of all documents before it."""
    rows, base = [], 0
    for file, _, n in files:
        rows.append((f"{path}/{file:06d}.tok", base))
        base += n

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = Reader(name)
                for i in range(0, r.n, 512):
                    j = min(i + 512, r.n)
                    bounds = r.bounds.selects(i, j + 1)  # of these documents alone
                    ids = [r.ids[x:y].astype("<u4").tobytes() for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
                    yield pa.RecordBatch.from_arrays([r.doc_ids(i, j), pa.array(first + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(ids, pa.binary())], ["id", "start", "n_tokens", "ids"])

    listed = spark.createDataFrame(rows, "name string, first long")
    if rows:
        listed = listed.repartition(len(rows))
    return listed.mapInArrow(load, f"{id_col} long, start long, n_tokens long, ids binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``df`` to a new folder of the shared place and read it back."""
    path = work_dir(df.sparkSession, "tokens")
    return read(df.sparkSession, path, write(df, path, id_col, text_col), id_col)
