"""Interpolated modified Kneser-Ney model of order 3, counted in Spark, scored from mapped files.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case and one end token a text; a text's
first tokens follow two start symbols. Counting steps, each reading shuffled blocks of keys that were
counted before the shuffle:

A. words: 64-bit word hashes, in buckets of the hash's upper bits. Each bucket becomes a sorted
   array of hashes and one of counts; a word's rank over all buckets is its number from here on, in
   four bytes, or in eight where there are more words than four bytes can tell.
B. triples (u, v, w), in buckets that are ranges of their lexicographic order, cut at quantiles of a
   sample: however frequent a word or pair is, its followers spread over buckets. A bucket becomes
   sorted arrays: its u, their v, their w, and counts. Which (v, w) follow how many different u goes on to
C. pairs (v, w), in such ranges too, as sorted arrays of v and w with these numbers.
D. words again: of each v the sum of these numbers over its followers and how many followers have
   one, two and more; of each w the number of its different v.

The highest order is discounted by counts, the lower ones by numbers of different histories. What a
history (u, v) keeps for lower orders is computed from its followers' counts when it is looked up,
and stored only for histories of many followers and those that span buckets.

All arrays lie in the shared folder; workers map them into memory and look words and runs up by
binary search, sorted, block by block. No array passes through the driver, which sees a few numbers
for each bucket and SAMPLE triples for each to cut ranges by.

A null text is empty (the end token alone), repeated rows count each time, an empty table gives no
rows, a null id counts as the empty text for ``held_out``; of a very long text nothing is cut off,
only its tokens are read in blocks of about _SLICE bytes of texts. Ties have no part in the results.
Columns beside id and text are not read. Without training rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.llm.common import checkpointed, crc_mod, map_array, rows_of, slices, text_bytes, work_dir, write_file
from storyscale.llm.words import words

#: Additive constant of the base score.
ADD = 0.1
END = np.uint64(1)  #: stands for the end token among word hashes
_SLICE = 1 << 21  #: bytes of text whose words are found together
_BLOCK = 3 << 18  #: tokens that are looked up together
_GATHER = 1 << 22  #: tokens that are counted before they are shuffled
_MANY = 255  #: counts from here on lie in a list of their own
_OFTEN = 16  #: lookups in a sorted range from which it is searched alone
_LARGE = 64  #: followers of a history beyond which its sums are stored
SAMPLE = 64  #: triples for each bucket that are sampled to cut ranges by
PARTITION = 1 << 24  #: tokens from which there are more ranges than the session's shuffle partitions ask for, each a third of it
_U = np.uint64

Discounts = tuple[float, float, float]
Edge = tuple[int, ...]


class Model(NamedTuple):
    """Where the arrays lie, and the numbers that go with them."""

    path: str
    bases: tuple[int, ...]  #: rank of the first word of each word bucket, and the number of words
    tokens: int
    texts: int
    wide: bool = False  #: numbers of words have eight bytes
    edges: tuple[tuple[Edge, ...], tuple[Edge, ...]] = ((), ())  #: first triple, first pair of each bucket but the first
    filled: tuple[frozenset[int], frozenset[int]] = (frozenset(), frozenset())  #: buckets that have rows
    pairs: int = 0  #: different pairs
    discounts: tuple[Discounts, Discounts, Discounts] = ((0.75,) * 3,) * 3  #: of words, pairs and triples
    low_back_off: float = 1.0
    split: dict[Edge, tuple[int, ...]] = {}  #: sums of the histories at a bucket's ends

    @property
    def words(self) -> int:
        """The number of words, which also stands for the start of a text."""
        return self.bases[-1]

    @property
    def shift(self) -> int:
        return 64 - (len(self.bases) - 2).bit_length()

    @property
    def kind(self) -> str:
        return "<u8" if self.wide else "<u4"


def _changes(cols: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows of columns differ from the row before; the first does."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    return np.flatnonzero(new)


def _parts(key: np.ndarray, bits: list[int]) -> Iterator[np.ndarray]:
    """The columns of so many bits each that numbers are put together from."""
    for i, n in enumerate(bits):
        yield (key >> _U(sum(bits[i + 1 :]))) & _U((1 << n) - 1)


def _distinct(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers of so many bits in order, a row of each, and for each row its place among them."""
    n = len(key)
    low = n.bit_length()
    drop = max(bits + low - 64, 0)
    both = key.astype(_U)
    both >>= _U(drop)
    both <<= _U(low)
    both |= np.arange(n, dtype=_U)
    both.sort()  # costs far less than a sort of places
    order = (both & _U((1 << low) - 1)).view(np.int64)
    key = key[order].view(_U) if drop else both >> _U(low)
    del both  # blocks may be large
    if drop and np.any(key[1:] < key[:-1]):  # numbers that differ in the lowest bits alone
        again = np.argsort(key)
        order, key = order[again], key[again]
    first = _changes([key])
    key, row = key[first], order[first]
    at = np.empty(n, np.int64)
    at[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    return key, row, at


def _summed(cols: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns in lexicographic order with the sums of their counts (rows of an array; none: one each); empties the list."""
    if not len(cols[0]):
        return cols, np.zeros(0, np.int64) if counts is None else counts
    rows, kinds, lows = len(cols[0]), [c.dtype for c in cols], [c.min() for c in cols]
    bits = [int(c.max() - low).bit_length() for c, low in zip(cols, lows)]
    if sum(bits) > 64:
        order = np.lexsort((*cols[:1:-1], (cols[0].astype(_U) << _U(32)) | cols[1]) if cols[0].itemsize == 4 else cols[::-1])
        for i, c in enumerate(cols):
            cols[i] = c[order]
        first = _changes(cols)
        distinct = [c[first] for c in cols]
    else:  # a row is one number, whose sort costs far less
        key = (cols[0] - lows[0]).astype(_U)
        for c, low, n in zip(cols[1:], lows[1:], bits[1:]):
            key <<= _U(n)
            key |= (c - low).astype(_U)
        cols.clear()
        if counts is None:
            key.sort()
        else:
            order = np.argsort(key)
            key = key[order]
        first = _changes([key])
        distinct = [x.astype(kind) + low for x, kind, low in zip(_parts(key[first], bits), kinds, lows)]
    return distinct, np.diff(np.append(first, rows)) if counts is None else np.add.reduceat(counts[order], first, axis=0)


def _span(cols: list[np.ndarray], edge: Edge) -> tuple[int, int]:
    """Bounds of the sorted rows of columns that equal the edge."""
    lo, hi = 0, len(cols[0])
    for c, x in zip(cols, edge):
        x = c.dtype.type(x)
        lo, hi = lo + int(np.searchsorted(c[lo:hi], x)), lo + int(np.searchsorted(c[lo:hi], x, "right"))
    return lo, hi


def _cut(cols: list[np.ndarray], edges: tuple[Edge, ...]) -> list[int]:
    """Bounds of the ranges that the edges cut sorted rows of columns into."""
    out = [0]
    for edge in edges:
        out.append(_span(cols, edge)[0])
    return [*out, len(cols[0])]


def _pack(a: np.ndarray) -> bytes:
    """An array's length in bytes and its bytes plane by plane, compressed: the upper planes have long runs and few values."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b""
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Tokens of many texts: hashes with the end tokens, the first token of each text, and (batch, first row, last row) of the texts."""
    hs, starts, rows, n = [], [], [], 0
    for b in batches:
        buf, offsets = text_bytes(rows_of(b, column))
        for i, j in slices(offsets, _SLICE):
            w = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hs.append(np.insert(w.hash, w.first[1:], END))
            starts.append(n + w.first[:-1] + np.arange(j - i))
            rows.append((b, i, j))
            n += len(hs[-1])
            if n >= _BLOCK:
                yield np.concatenate(hs), np.concatenate(starts), rows
                hs, starts, rows, n = [], [], [], 0
    if n:
        yield np.concatenate(hs), np.concatenate(starts), rows


_SHUFFLED = "bucket int, keys array<binary>, counts binary"


def _told(bucket: int, kind: int, cols: list[np.ndarray], counts: np.ndarray) -> dict:
    """A row of keys and their counts (rows of an array) for a bucket."""
    wide = np.ascontiguousarray(counts.reshape(len(counts), -1).T.astype(np.uint32))
    return {"bucket": bucket, "kind": kind, "keys": [_pack(c) for c in cols], "counts": _pack(wide.ravel()), "seen": None}


def _counts(data: bytes, wide: int) -> np.ndarray:
    return _unpack(data, "<u4").reshape(wide, -1).T.astype(np.int64)


def _gathered(blocks: Iterator[tuple], count: Callable[[np.ndarray, np.ndarray], tuple], cut: Callable[[list[np.ndarray]], list[int]]) -> Iterator[pa.RecordBatch]:
    """What ``count`` makes of the tokens of many texts, as a row for each bucket; ``cut`` gives the buckets' bounds among sorted rows."""
    hs, starts, n = [], [], 0
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.list_(pa.binary())), ("counts", pa.binary())])

    def out() -> pa.RecordBatch:
        h, s = np.concatenate(hs), np.concatenate(starts)
        hs.clear()  # before the sort, which needs as much again
        cols, c = count(h, s)
        bounds = cut(cols)
        rows = [_told(b, 0, [x[i:j] for x in cols], c[i:j]) for b, (i, j) in enumerate(zip(bounds, bounds[1:])) if i < j]
        return pa.RecordBatch.from_pylist(rows, schema)

    for h, s, _ in blocks:
        hs.append(h)
        starts.append(s + n)
        n += len(h)
        if n >= _GATHER:
            yield out()
            starts, n = [], 0
    if n:
        yield out()


def _merged(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """The buckets of a partition (one, as they are dealt), each with its rows and counts."""
    parts: dict[int, list] = {}
    for b in batches:
        for bucket, k, c in zip(*(b.column(x).to_pylist() for x in ("bucket", "keys", "counts"))):
            parts.setdefault(bucket, []).append(([_unpack(x, kind) for x in k], _counts(c, 1)[:, 0]))
    for bucket in sorted(parts):
        ks, cs = zip(*parts.pop(bucket))
        yield bucket, *_summed([np.concatenate(x) for x in zip(*ks)], np.concatenate(cs))


def _rows(made: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(made, schema)


# -- lookups -------------------------------------------------------------------------------------


def _ranks(model: Model, keys: np.ndarray) -> np.ndarray:
    """Ranks of distinct word hashes in order; -1 of unknown ones."""
    out = np.full(len(keys), -1, np.int64)
    at = (keys >> _U(model.shift)).astype(np.int64) if model.shift < 64 else np.zeros(len(keys), np.int64)
    cuts = np.searchsorted(at, np.arange(len(model.bases)))
    for b in np.unique(at).tolist():
        have = map_array(f"{model.path}/words/{b:06d}.key", "<u8") if model.bases[b + 1] > model.bases[b] else ()
        if len(have):
            part = keys[cuts[b] : cuts[b + 1]]
            i = np.minimum(np.searchsorted(have, part), len(have) - 1)
            out[cuts[b] : cuts[b + 1]] = np.where(have[i] == part, i + model.bases[b], -1)
    return out


def _of_ranks(model: Model, ranks: np.ndarray, kinds: dict[str, str]) -> list[np.ndarray]:
    """Arrays of words, at ranks in order; the rank ``model.words`` stands for the start of a text."""
    outs = [np.zeros(len(ranks), np.float64 if d == "<f8" else np.int64) for d in kinds.values()]
    bounds = [*model.bases, model.words + 1]
    cuts = np.searchsorted(ranks, bounds)
    for b in range(len(bounds) - 1):
        if cuts[b] < cuts[b + 1]:
            i = ranks[cuts[b] : cuts[b + 1]] - bounds[b]
            for out, (kind, dtype) in zip(outs, kinds.items()):
                out[cuts[b] : cuts[b + 1]] = map_array(f"{model.path}/words/{b:06d}.{kind}", dtype)[i]
    return outs


def _within(have: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each x in the sorted range of ``have`` of its group, and whether it is there.

    A group's x, sorted, begin at ``first``, which also has their number; ``lo`` and ``hi`` bound its range.
    """
    rows = np.diff(first)
    place, end = np.repeat(lo, rows), np.repeat(hi, rows)
    if not len(have):
        return place, np.zeros(len(place), bool)
    often = (rows >= _OFTEN) & (hi > lo)
    for i, j, a, b in zip(*(c[often].tolist() for c in (first[:-1], first[1:], lo, hi))):
        place[i:j] += have[a:b].searchsorted(x[i:j])
    at = np.flatnonzero((end > place) & np.repeat(~often, rows))
    base, left, want = place[at], (end - place)[at], x[at]
    while len(at):  # most ranges are short, so few rows stay
        half = (left + 1) >> 1
        base += np.where(have[base + (half - 1)] < want, half, 0)
        left -= half
        more = left > 0
        if np.count_nonzero(more) * 2 < len(at):
            place[at] = base
            at, base, left, want = at[more], base[more], left[more], want[more]
    return place, (place < end) & (have[np.minimum(place, len(have) - 1)] == x)


def _write_starts(name: str, starts: np.ndarray) -> None:
    """Ascending numbers as two bytes each above every 256th; where that is too little, as eight."""
    base = starts[::256]
    above = starts - np.repeat(base, 256)[: len(starts)]
    narrow = above.max(initial=0) < 1 << 16
    write_file(f"{name}b", [base.astype("<u8") if narrow else base[:0]])
    write_file(f"{name}s", [above.astype("<u2") if narrow else starts.astype("<u8")])


def _starts(name: str, at: np.ndarray) -> np.ndarray:
    base = map_array(f"{name}b", "<u8")
    if len(base):
        return base[at >> 8].astype(np.int64) + map_array(f"{name}s", "<u2")[at]
    return map_array(f"{name}s", "<u8")[at].astype(np.int64)


def _store(place: str, cols: list[np.ndarray], c: np.ndarray) -> np.ndarray:
    """Write sorted rows as levels of arrays, each but the last with the starts of its parts in the next; starts of the last level's parts."""
    starts = np.arange(len(c))
    for level in range(len(cols) - 1, -1, -1):
        first = _changes(cols[: level + 1])
        write_file(f"{place}.{level}", [cols[level][first]])
        if level < len(cols) - 1:
            _write_starts(f"{place}.{level}", np.append(np.searchsorted(starts, first), len(starts)))
            if level == len(cols) - 2:
                last = first
        starts = first
    write_file(f"{place}.count", [np.minimum(c, _MANY).astype(np.uint8)])
    many = np.flatnonzero(c >= _MANY)
    write_file(f"{place}.many", [np.stack([many, c[many]]).astype("<u8")])
    return last


def _places(model: Model, place: str, cols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of distinct rows of two columns, in order, in the second level, and whether they are there."""
    first = _changes(cols[:1])
    x, have = cols[0][first], map_array(f"{place}.0", model.kind)
    lo = np.searchsorted(have, x)
    found = have[np.minimum(lo, len(have) - 1)] == x if len(have) else np.zeros(len(x), bool)
    at = np.where(found, lo, 0)
    lo, hi = (np.where(found, _starts(f"{place}.0", at + i), 0) for i in (0, 1))
    return _within(map_array(f"{place}.1", model.kind), lo, hi, cols[1], np.append(first, len(cols[1])))


def _counts_at(place: str, i: np.ndarray) -> np.ndarray:
    """Counts at places of the last level."""
    c = map_array(f"{place}.count", "u1")[i].astype(np.int64)
    many = np.flatnonzero(c == _MANY)
    if len(many):
        more = map_array(f"{place}.many", "<u8").reshape(2, -1)
        c[many] = more[1][np.searchsorted(more[0], i[many].astype(_U))]
    return c


def _pair_counts(model: Model, cols: list[np.ndarray]) -> np.ndarray:
    """Numbers of distinct pairs in order; 0 of unknown ones."""
    out = np.zeros(len(cols[0]), np.int64)
    bounds = _cut(cols, model.edges[1])
    for b in sorted(model.filled[1]):
        if bounds[b] < bounds[b + 1]:
            part = slice(bounds[b], bounds[b + 1])
            place = f"{model.path}/pairs/{b:06d}"
            i, there = _places(model, place, [c[part] for c in cols])
            out[part] = np.where(there, _counts_at(place, np.where(there, i, 0)), 0)
    return out


def _sums(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each run of counts the sum, and how many are one, two and more."""
    return np.stack([np.add.reduceat(x, first, dtype=np.int64) for x in (c, c == 1, c == 2, c > 2)])


def _followed(model: Model, pairs: list[np.ndarray], words_: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_sums`` of the followers of distinct pairs in order, and the counts of some words behind them; 0 of unknown ones.

    The words behind a pair, sorted, begin at ``first``, which also has their number.
    """
    sums, out = np.zeros((4, len(pairs[0])), np.int64), np.zeros(len(words_), np.int64)
    spans = [_span(pairs, e[:2]) for e in model.edges[0]]  # pairs that lie in two buckets are looked up in both
    cuts = [int(first[i]) + _span([words_[first[i] : first[j]]], e[2:])[0] for (i, j), e in zip(spans, model.edges[0])]
    froms, tos = [0, *(i for i, _ in spans)], [*(j for _, j in spans), len(pairs[0])]
    bounds = [0, *cuts, len(words_)]
    for b in sorted(model.filled[0]):
        i, j = froms[b], tos[b]
        if i == j:
            continue
        place = f"{model.path}/triples/{b:06d}"
        at, there = _places(model, place, [c[i:j] for c in pairs])
        at = np.where(there, at, 0)
        lo, hi = (np.where(there, _starts(f"{place}.1", at + k), 0) for k in (0, 1))
        large = np.flatnonzero(hi - lo > _LARGE)
        if len(large):
            stored = map_array(f"{place}.large", "<u8").reshape(5, -1)
            sums[:, i + large] = stored[1:, np.searchsorted(stored[0], at[large].astype(_U))]
        small = np.flatnonzero(there & (hi - lo <= _LARGE))
        if len(small):
            n = (hi - lo)[small]
            begin = np.cumsum(n) - n
            sums[:, i + small] = _sums(_counts_at(place, np.arange(n.sum()) + np.repeat(lo[small] - begin, n)), begin)
        part = slice(bounds[b], bounds[b + 1])
        of = np.clip(first[i : j + 1], part.start, part.stop) - part.start
        found, there = _within(map_array(f"{place}.2", model.kind), lo, hi, words_[part], of)
        out[part] = np.where(there, _counts_at(place, np.where(there, found, 0)), 0)
    for k, s in model.split.items():
        i, j = _span(pairs, k)
        sums[:, i:j] = np.array(s)[:, None]
    return sums, out


def _discounted(c: np.ndarray, d: Discounts) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


def _discounts(n: list[int]) -> Discounts:
    """Modified Kneser-Ney discounts from the numbers of keys counted once to four times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return tuple(min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.0), k + 1.0) if n[k] and n[0] else 0.75 for k in range(3))


# -- training ------------------------------------------------------------------------------------


def train(df: DataFrame, text_col: str = "text", path: str | None = None, wide: bool = False) -> Model:
    """Count the texts of ``df`` and write the model's arrays to a new folder of the shared place (``wide``: eight bytes a word at any size)."""
    spark = df.sparkSession
    path = path or work_dir(spark, "lm")
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_words = 1 << min(max(wanted - 1, 1).bit_length(), 16)
    texts = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shift = 64 - (n_words - 1).bit_length()

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.arange(1, n_words, dtype=_U) << _U(shift)
        return _gathered(_blocks(batches), lambda h, _: _summed([h]), lambda k: [0, *np.searchsorted(k[0], upper).tolist(), len(k[0])])

    schema_a = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), ("tokens", pa.int64()), ("ends", pa.int64())])

    def store_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = []
        for b, (k,), c in _merged(batches, "<u8"):
            write_file(f"{path}/words/{b:06d}.key", [k])
            write_file(f"{path}/words/{b:06d}.count", [c.astype("<u8")])
            end = c[k == END]
            made.append({"bucket": b, "n": len(k), "tokens": int(c.sum()), "ends": int(end[0]) if len(end) else 0})
        yield _rows(made, schema_a)

    stored = texts.mapInArrow(count_words, _SHUFFLED).repartitionById(n_words, F.col("bucket")).mapInArrow(store_words, "bucket long, n long, tokens long, ends long").collect()
    by = {r["bucket"]: r for r in stored}  # a row for each bucket
    bases = (0, *np.cumsum([by[b]["n"] if b in by else 0 for b in range(n_words)]).tolist())
    tokens, ends = sum(r["tokens"] for r in stored), sum(r["ends"] for r in stored)
    model = Model(path, bases, tokens, ends, wide or bases[-1] >= (1 << 32) - 1)
    if not tokens:
        return model
    wanted = max(wanted, -(-tokens // PARTITION))  # a task merges a range in memory
    model = model._replace(edges=_edges(texts, model, wanted))

    def count_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _gathered(_blocks(batches), lambda h, starts: _counted_triples(model, h, starts), lambda cols: _cut(cols, model.edges[0]))

    told = "bucket int, kind int, keys array<binary>, counts binary, seen array<long>"
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.list_(pa.binary())), ("counts", pa.binary()), ("seen", pa.list_(pa.int64()))])

    def numbers(order: int, b: int, c: np.ndarray, more: list[int]) -> dict:
        return {"bucket": 0, "kind": -order, "keys": None, "counts": None, "seen": [b, len(c), *(int((c == i).sum()) for i in range(1, 5)), *more]}

    def store_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, cols, c in _merged(batches, model.kind):
            place = f"{path}/triples/{b:06d}"
            first = _store(place, cols, c)
            sums = _sums(c, first)
            large = np.flatnonzero(np.diff(np.append(first, len(c))) > _LARGE)
            write_file(f"{place}.large", [np.concatenate([large[None], sums[:, large]]).astype("<u8")])
            ends = [int(x) for i in sorted({0, len(first) - 1}) for x in (cols[0][first[i]], cols[1][first[i]], *sums[:, i])]
            pairs, n = _summed(cols[1:])
            bounds = _cut(pairs, model.edges[1])
            yield _rows([numbers(3, b, c, ends)] + [_told(to, 1, [x[i:j] for x in pairs], n[i:j]) for to, (i, j) in enumerate(zip(bounds, bounds[1:])) if i < j], schema)

    def store_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            mine = np.array(batch.column(1).to_pylist()) == 1
            if not mine.all():
                yield batch.filter(pa.array(~mine))
            parts.append(batch.filter(pa.array(mine)))
        for b, cols, n in _merged(iter(parts), model.kind):
            first = _store(f"{path}/pairs/{b:06d}", cols, n)
            histories = _summed(cols[1:])
            made = [numbers(2, b, n, [])]
            for kind, ((words_,), counts) in enumerate((([cols[0][first]], _sums(n, first).T), histories)):
                bounds = np.searchsorted(words_, np.array([*bases, model.words + 1]).astype(words_.dtype))
                made += [_told(to, 2 + kind, [words_[i:j]], counts[i:j]) for to, (i, j) in enumerate(zip(bounds, bounds[1:])) if i < j]
            yield _rows(made, schema)

    counted = texts.mapInArrow(count_triples, _SHUFFLED).repartitionById(len(model.edges[0]) + 1, F.col("bucket")).mapInArrow(store_triples, told)
    tallied = counted.repartitionById(len(model.edges[1]) + 1, F.col("bucket")).mapInArrow(store_pairs, told)
    # the tallies are a small part of the pairs; written once, they serve the reads below
    tallied = checkpointed(tallied, f"{path}/tallies")
    seen = [(r["kind"], r["seen"]) for r in tallied.where("kind < 0").select("kind", "seen").collect()]  # a row or two for each bucket
    of = lambda order, i: sum(x[i] for k, x in seen if k == -order)
    split: dict[Edge, np.ndarray] = {}
    for k, x in seen:
        for e in (x[6:12], x[12:18]) if k == -3 else ():
            if e:
                split[tuple(e[:2])] = split.get(tuple(e[:2]), 0) + np.array(e[2:])
    high, mid = (_discounts([of(order, i) for i in range(2, 6)]) for order in (3, 2))
    model = model._replace(pairs=of(2, 1), filled=tuple(frozenset(x[0] for k, x in seen if k == -order) for order in (3, 2)), split={k: tuple(x.tolist()) for k, x in split.items()})

    def store_tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [*bases, model.words + 1]
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for b, kind, (k,), c in zip(*(x.to_pylist() for x in batch.columns)):
                if b not in sums:
                    sums[b] = [np.zeros((bounds[b + 1] - bounds[b], w), np.int64) for w in (4, 1)]
                sums[b][kind - 2][_unpack(k, model.kind).astype(np.int64) - bounds[b]] += _counts(c, (4, 1)[kind - 2])
        made = []
        for b, (followers, histories) in sums.items():
            total, h = followers[:, 0], histories[:, 0]
            write_file(f"{path}/words/{b:06d}.total", [total.astype("<u8")])
            write_file(f"{path}/words/{b:06d}.back", [((followers[:, 1:] @ np.array(mid)) / np.maximum(total, 1)).astype("<f8")])
            write_file(f"{path}/words/{b:06d}.histories", [h.astype("<u8")])
            made.append({"seen": [*(int((h == i).sum()) for i in range(1, 5)), int((h > 2).sum())]})
        yield _rows(made, pa.schema([("seen", pa.list_(pa.int64()))]))

    low = tallied.where("kind >= 2").select("bucket", "kind", "keys", "counts").repartitionById(n_words + 1, F.col("bucket")).mapInArrow(store_tallies, "seen array<long>").collect()  # a row for each bucket
    m = [sum(r["seen"][i] for r in low) for i in range(5)]
    dl = _discounts(m[:4])
    return model._replace(discounts=(dl, mid, high), low_back_off=(dl[0] * m[0] + dl[1] * m[1] + dl[2] * m[4]) / max(model.pairs, 1))


def _edges(texts: DataFrame, model: Model, wanted: int) -> tuple[tuple[Edge, ...], tuple[Edge, ...]]:
    """Where the ranges of triples and of pairs are cut: quantiles of about SAMPLE triples for each range."""
    share, thin = SAMPLE * 3 * wanted / model.tokens, 16
    if share * thin < 1:  # enough in some of the texts
        texts, share = texts.where(F.crc32(F.col("text").cast("binary")) % thin == 0), share * thin
    step = max(int(1 / min(share, 1)), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, starts, _ in _blocks(batches):
            cols = [c[int(h[0]) % step :: step].astype(np.int64) for c in _triples(model, h, starts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["u", "v", "w"])

    t = texts.mapInArrow(run, "u long, v long, w long").toArrow()  # about SAMPLE rows for each range
    rows = sorted(zip(*(t.column(i).to_pylist() for i in range(3))))
    cuts = lambda x, n: tuple(sorted({x[len(x) * k // n] for k in range(1, n)})) if x else ()
    return cuts(rows, 3 * wanted), cuts(sorted(r[1:] for r in rows), 2 * wanted)


def _numbered(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes' ranks (-1: unknown), and the distinct hash of each token; both in the order of hashes."""
    distinct, _, at = _distinct(h, 64)
    return _ranks(model, distinct), at


def _before(x: np.ndarray, starts: np.ndarray, start: int) -> np.ndarray:
    """What stands before each token."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = start
    return out


def _triples(model: Model, h: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Each token behind the two before it, as numbers of words."""
    known, at = _numbered(model, h)
    w = known[at]
    v = _before(w, starts, model.words)
    return [x.astype(model.kind) for x in (_before(v, starts, model.words), v, w)]


def _counted_triples(model: Model, h: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct triples of the model's words in order and their counts."""
    known, w = _numbered(model, h)
    start, bits = len(known), len(known).bit_length()
    if 3 * bits > 64:
        return _summed(_triples(model, h, starts))
    v = _before(w, starts, start)
    key = _before(v, starts, start).view(_U)  # numbered within the block, a triple is one number
    for x in (v, w):
        key <<= _U(bits)
        key |= x.view(_U)
    del v, w, x
    key.sort()
    first, ranks = _changes([key]), np.append(known, model.words).astype(model.kind)
    key, c = key[first], np.diff(first, append=len(key))
    del first
    return [ranks[x.view(np.int64)] for x in _parts(key, [bits] * 3)], c


# -- scoring -------------------------------------------------------------------------------------


def _score(model: Model, h: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of each text of a block."""
    n_tokens = np.diff(np.append(starts, len(h)))
    vocabulary = model.words + 1
    known, at = _numbered(model, h)
    have = np.flatnonzero(known >= 0)
    c, histories = (np.zeros(len(known), np.int64) for _ in range(2))
    kinds = {"histories": "<u8", "total": "<u8", "back": "<f8"}
    # the block's known words are numbered in their order, with the start of a text behind them
    start, ranks = len(have), np.append(known[have], model.words)
    total, back = np.zeros(start + 1, np.int64), np.zeros(start + 1)
    if model.tokens:
        _, total[start:], back[start:] = _of_ranks(model, ranks[start:], kinds)
    if start:
        c[have], histories[have], total[:start], back[:start] = _of_ranks(model, known[have], {"count": "<u8", **kinds})
    word = _discounted(histories, model.discounts[0]) / max(model.pairs, 1) + model.low_back_off / vocabulary
    p = word[at]
    if model.tokens:
        number, ranks, bits = np.full(len(known), -1), ranks.astype(model.kind), start.bit_length()
        number[have] = np.arange(start)
        w = number[at]
        v = _before(w, starts, start)
        both, odd = np.flatnonzero((v >= 0) & (w >= 0)), np.flatnonzero((v >= 0) & (w < 0))
        p[odd] = _interpolated(p[odd], 0, total[v[odd]], back[v[odd]], model.discounts[1])
        pairs, _, place = _distinct(v[both] << bits | w[both], 2 * bits)
        first, last = (x.astype(np.int64) for x in _parts(pairs, [bits, bits]))
        # a text's first token stands behind two starts, the pair after all others
        cols = [np.append(ranks[x], ranks[start]) for x in (first, last)]
        p[both] = _interpolated(word[have][last], _pair_counts(model, cols)[:-1], total[first], back[first], model.discounts[1])[place]
        pair = np.full(len(h), -1)
        pair[both] = place
        pair, bits2 = _before(pair, starts, len(pairs)), len(pairs).bit_length()
        three, odd = np.flatnonzero((pair >= 0) & (w >= 0)), np.flatnonzero((pair >= 0) & (w < 0))
        triples, row, place = _distinct(pair[three] << bits | w[three], bits2 + bits)
        of, last = (x.astype(np.int64) for x in _parts(triples, [bits2, bits]))
        (total, *few), counts = _followed(model, cols, ranks[last], np.searchsorted(of, np.arange(len(pairs) + 2)))
        back = sum(d * n for d, n in zip(model.discounts[2], few)) / np.maximum(total, 1)
        p[odd] = _interpolated(p[odd], 0, total[pair[odd]], back[pair[odd]], model.discounts[2])
        p[three] = _interpolated(p[three[row]], counts, total[of], back[of], model.discounts[2])[place]
    base_of = lambda c: np.log10((c + ADD) / (model.tokens + ADD * vocabulary))
    sums_of = lambda x: np.add.reduceat(x, starts)
    return [n_tokens, sums_of((c > 0)[at].astype(np.int64)), sums_of(base_of(c)[at]), sums_of(np.log10(p))]


def _interpolated(low: np.ndarray, counts: np.ndarray | int, total: np.ndarray, back: np.ndarray, d: Discounts) -> np.ndarray:
    """Probabilities of words counted so often behind histories of ``total`` followers, which leave ``back`` to the lower order ``low``."""
    return np.where(total > 0, back * low + _discounted(counts, d) / np.maximum(total, 1), low)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each row; scores are log10 probabilities."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, starts, rows in _blocks(batches):
            ids = pa.concat_arrays([b.column(0)[i:j] for b, i, j in rows])
            n, known, base, own = _score(model, h, starts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(own), pa.array(10 ** (-own / n))], names)

    return df.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 10) == 0
