"""Order-preserving packing of token ids to sequences, by dynamic programming.

Each partition of the input is a run of documents in stored order; nothing is shuffled. Its
documents, each ended by END, form one line of tokens that is cut to windows of at most LENGTH.
Cuts may stand behind a document (free), a sentence (penalty SENTENCE) or, where neither comes for
GAP tokens, inside a sentence (penalty INSIDE). f(j), the least padding and penalties with a cut at
j, is

    f(j) = penalty(j) + LENGTH - at(j) + min { f(i) + at(i) : at(j) - LENGTH <= at(i) < at(j) }

where a monotone queue gives the minimum in constant time. The line is worked on in blocks of BLOCK
tokens, which may lie within one long document; the last window of a block is opened again for the
next one, so blocks leave no padding. Only the last window
of a partition may stay short: its tokens go to sequences of powers of two, which need no padding.

A null text is empty and gives the end token alone, repeated rows are packed one by one, an empty
table gives no rows; of equal costs the longest window is taken; further columns are not read,
whatever their names. Sequence ids hold the partition in their upper bits: a task that is run again
gives the same ids.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.llm.tokenizing import batches_of, encoder, vocabulary

LENGTH = 1024
END = 0
SENTENCE = 2
INSIDE = 10
GAP = 16
#: Tokens of the line that are planned together.
BLOCK = 1 << 18


def windows(at: list[int], penalty: list[int], length: int) -> list[int]:
    """Cuts of least cost: at[0] is the start and at[-1] the end, no step is above ``length``.

    Returns the indexes of the chosen cuts, without the start.
    """
    n = len(at)
    f, back = [0.0] * n, [0] * n
    value = [0.0] * n  # f(i) + at(i)
    value[0] = at[0]
    queue: deque[int] = deque([0])
    for j in range(1, n):
        x = at[j]
        while at[queue[0]] < x - length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        v = f[j] = penalty[j] + length - x + value[i]
        v += x
        value[j] = v
        while queue and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def cut_points(line: np.ndarray, ends: np.ndarray, stops: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Possible cuts of a line of tokens and their penalties.

    ends: places behind the documents; stops: for each token id whether it closes a sentence.
    """
    n = len(line)
    costs = np.full(n + 1, -1, np.int16)  # -1: no cut
    costs[1:][stops[line]] = SENTENCE
    costs[ends] = 0
    costs[[0, n]] = 0
    at = np.flatnonzero(costs >= 0)
    gap = min(GAP, length)
    steps = (np.diff(at) - 1) // gap
    first = np.repeat(at[:-1], steps)
    costs[first + gap * (np.arange(len(first)) - np.repeat(np.cumsum(steps) - steps, steps) + 1)] = INSIDE
    at = np.flatnonzero(costs >= 0)
    return at.tolist(), costs[at].tolist()


def powers(n: int, length: int) -> list[int]:
    """``n`` tokens as sizes of sequences that need no padding."""
    out = []
    while n:
        step = min(length, 1 << (n.bit_length() - 1))
        out.append(step)
        n -= step
    return out


class _Line:
    """Documents that wait for their cuts, and what is known of them."""

    def __init__(self, length: int, stops: np.ndarray, first_sequence: int):
        self.length, self.stops, self.sequence = length, stops, first_sequence
        self.docs: list[list] = []  # id, its ids, where the waiting part starts
        self.size = 0

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append([doc_id, np.frombuffer(ids, np.uint32), 0])
        self.size += len(ids) // 4

    def cut(self, last: bool) -> Iterator[list[tuple]]:
        """Pieces of the windows that are settled, a block of the line at a time; what is left waits unless the line ends here."""
        block = max(BLOCK, 4 * self.length)
        while self.size >= block or last and self.size:
            rest = last and self.size <= block
            parts, ends, n = [], [], 0
            for _, ids, start in self.docs:
                parts.append(ids[start : start + block - n])
                n += len(parts[-1])
                if start + len(parts[-1]) == len(ids):
                    ends.append(n)
                if n == block:
                    break
            at, penalty = cut_points(np.concatenate(parts), np.array(ends, int), self.stops, self.length)
            cuts = [0, *(at[i] for i in windows(at, penalty, self.length))]
            if rest:
                a = cuts[-2]
                cuts[-1:] = (a + np.cumsum(powers(n - a, self.length))).tolist()
            else:
                cuts.pop()
            yield self._settle(cuts)

    def _settle(self, cuts: list[int]) -> list[tuple]:
        out, k = [], 0
        for a, b in zip(cuts, cuts[1:]):
            offset, left = 0, b - a
            while left:
                doc_id, ids, start = self.docs[k]
                n = min(left, len(ids) - start)
                out.append((doc_id, start, n, ids[start : start + n].tobytes(), len(ids), self.sequence, offset))
                offset += n
                left -= n
                self.docs[k][2] = start + n
                if start + n == len(ids):
                    k += 1
            self.sequence += 1
        del self.docs[:k]
        self.size -= cuts[-1] - cuts[0]
        return out


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", length: int = LENGTH) -> DataFrame:
    """Pieces of the documents: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary(tokenizer), "byte", "<u4")
        stops = np.zeros(enc.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        stops[[i for s in (".", "!", "?", "\n") for i in enc.ids(s)[-1:]]] = True
        end = np.array([END], "<u4").tobytes()
        line = _Line(length, stops, TaskContext.get().partitionId() << 40)
        id_type = None

        def out(pieces: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*pieces))
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            id_type = b.column(0).type
            ids, texts = b.column(0).to_pylist(), b.column(1).fill_null("").to_pylist()
            for i, j in batches_of(np.fromiter(map(len, texts), np.int64, len(texts))):
                for doc_id, x in zip(ids[i:j], enc.encode(texts[i:j])):
                    line.add(doc_id, x + end)
                    yield from map(out, line.cut(False))
        yield from map(out, line.cut(True))

    return df.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
