"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Words are runs of letters and digits in lower case, shingles five words (fewer words: all of them).
Each benchmark item has the SimHash of its shingles. Each text's windows of an item's length get
theirs too; a window that shares no shingle with the benchmark is at similarity 0 and is passed
over. Fingerprints are cut to RADIUS + 1 blocks: an item within RADIUS differing bits has an equal
block, so looking the blocks up finds all of them. A candidate counts if the exact similarity of
the two bags of shingles, sum of least over sum of greatest counts, is SIMILARITY or more.

The benchmark is worked on in blocks of at most BLOCK bytes, the only data sent to all workers;
each block passes over all texts. Texts are worked on in their own rows, without a shuffle.

A null text is empty and has no match; an item without words matches nothing; repeated items match
each; repeated rows get equal matches; of equally similar windows the first counts. Long texts are
looked up by pieces of bounded windows and candidates. An empty table gives no rows, an empty
benchmark no matches. Input columns pass through, whatever their names; ``matches`` replaces one of
that name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from storyscale.llm.common import rows_of, slices, text_bytes
from storyscale.llm.words import ALNUM, shingle_hashes, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCK = 32 << 20
_SLICE = 1 << 21
_WINDOWS = 1 << 15
_CANDIDATES = 1 << 20
_EDGES = np.linspace(0, 64, RADIUS + 2).astype(int)
MATCHES = "array<struct<item_id:{},similarity:double,distance:int,start_word:int,n_words:int>>"


class Index(NamedTuple):
    """Items by number: id, words, fingerprint, bag of shingles; shingles and fingerprint blocks lead to them."""

    ids: list
    length: np.ndarray
    prints: np.ndarray
    bags: list[Counter]
    shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  #: by shingle size: sorted hashes, length of an item that has it; a table of their lower bits
    blocks: tuple[np.ndarray, np.ndarray]  #: sorted keys of (length, block, value), item of each


def fingerprints(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHashes from how many of n shingles set each of the 64 bits."""
    return np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _block_keys(prints: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A key of each block of each fingerprint, of windows of the same length."""
    cols = []
    for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])):
        value = (prints >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        cols.append((length.astype(np.uint64) << np.uint64(16)) | np.uint64(k << 8) | value)
    return np.stack(cols, axis=1)


def _lower(a: pa.Array) -> pa.Array:
    return pc.utf8_lower(a)


def build(items: list[tuple]) -> Index:
    """Index of (item id, text) pairs."""
    ids, length, prints, bags, by = [], [], [], [], {}
    for item_id, text in items:
        buf, offsets = text_bytes(_lower(pa.array([text or ""], pa.string())))
        h = words(buf, offsets, ALNUM).hash
        if not len(h):
            continue
        k = min(SHINGLE, len(h))
        sh = shingle_hashes(h, k)
        n = len(ids)
        ids.append(item_id)
        length.append(len(h))
        bags.append(Counter(sh.tolist()))
        prints.append(fingerprints(_bits(sh).sum(axis=0, dtype=np.int64)[None], np.array([len(sh)]))[0])
        by.setdefault(k, set()).update((x, len(h)) for x in bags[-1])
    shingles = {}
    for k, have in by.items():
        pairs = sorted(have)
        hashes = np.array([x for x, _ in pairs], np.uint64)
        table = np.zeros(1 << 20, bool)
        table[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        shingles[k] = (hashes, np.array([n for _, n in pairs], np.int64), table)
    prints, length = np.array(prints, np.uint64), np.array(length, np.int64)
    keys = _block_keys(prints, length) if len(ids) else np.zeros((0, RADIUS + 1), np.uint64)
    order = np.argsort(keys.ravel(), kind="stable")
    return Index(ids, length, prints, bags, shingles, (keys.ravel()[order], np.repeat(np.arange(len(ids)), RADIUS + 1)[order]))


def _runs(a: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a[first:last] of many ranges end to end, and the range of each element."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return a[at], of


def _matches(h: np.ndarray, hits: dict[int, np.ndarray], index: Index) -> list[tuple[int, float, int, int, int]]:
    """Best match of each item in a text of word hashes h; hits: by shingle size, places whose shingle is in the benchmark."""
    best: dict[int, tuple[float, int, int, int]] = {}
    for k, places in hits.items():
        sh = shingle_hashes(h, k)
        hashes, lengths, _ = index.shingles[k]
        mark, which = np.unique(sh[places], return_inverse=True)
        of_items, of = _runs(lengths, np.searchsorted(hashes, mark, "left"), np.searchsorted(hashes, mark, "right"))  # no more than the index holds
        for n in np.unique(of_items).tolist():
            size = min(n, len(h))  # a shorter text is one window
            has = np.zeros(len(mark), bool)
            has[of[of_items == n]] = True
            mine = places[has[which]]
            cover = np.zeros(len(h) - size + 2, np.int32)  # windows that hold a place: from place - size + k to place
            np.add.at(cover, np.maximum(mine - size + k, 0), 1)
            np.add.at(cover, np.minimum(mine, len(h) - size) + 1, -1)
            starts = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
            for i in range(0, len(starts), _WINDOWS):
                _probe(sh, starts[i : i + _WINDOWS], n, size, k, index, best)
    return [(item, *m) for item, m in sorted(best.items())]


def _probe(sh: np.ndarray, starts: np.ndarray, n: int, size: int, k: int, index: Index, best: dict) -> None:
    """Look the windows at ``starts`` up and verify what their blocks find."""
    per = size - k + 1
    lo, hi = starts[0], starts[-1] + per
    if hi - lo > 4 * _WINDOWS:  # far apart: two halves
        half = len(starts) // 2
        if half:
            _probe(sh, starts[:half], n, size, k, index, best)
            _probe(sh, starts[half:], n, size, k, index, best)
            return
    total = np.zeros((hi - lo + 1, 64), np.int32)
    np.cumsum(_bits(sh[lo:hi]), axis=0, out=total[1:])
    prints = fingerprints(total[starts - lo + per] - total[starts - lo], np.full(len(starts), per))
    keys = _block_keys(prints, np.full(len(starts), n)).ravel()
    have, owner = index.blocks
    first, last = np.searchsorted(have, keys, "left"), np.searchsorted(have, keys, "right")
    found = np.cumsum((last - first).reshape(-1, RADIUS + 1).sum(axis=1))
    a = 0
    while a < len(starts):  # windows whose blocks lead to about _CANDIDATES items, or one window
        b = max(a + 1, int(np.searchsorted(found, (found[a - 1] if a else 0) + _CANDIDATES, "right")))
        span = slice(a * (RADIUS + 1), b * (RADIUS + 1))
        items, of = _runs(owner, first[span], last[span])
        window = of // (RADIUS + 1) + a
        distance = np.bitwise_count(prints[window] ^ index.prints[items])
        near = np.flatnonzero(distance <= RADIUS)
        pairs, at = np.unique(window[near] * len(index.ids) + items[near], return_index=True)
        for pair, d in zip(pairs.tolist(), distance[near[at]].tolist()):
            w, i = divmod(pair, len(index.ids))
            mine, bag = Counter(sh[starts[w] : starts[w] + per].tolist()), index.bags[i]
            both = sum((mine & bag).values())
            similarity = both / (per + sum(bag.values()) - both)
            if similarity >= SIMILARITY and (i not in best or similarity > best[i][0]):
                best[i] = (similarity, d, int(starts[w]), size)
        a = b


def _find(buf: np.ndarray, offsets: np.ndarray, index: Index) -> dict[int, list]:
    """Matches of each text that has some."""
    w = words(buf, offsets, ALNUM)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    found: dict[int, dict[int, np.ndarray]] = {}
    for k, (hashes, _, table) in index.shingles.items():
        sh = shingle_hashes(w.hash, k)
        at = np.flatnonzero(table[(sh & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = at[text[at] == text[at + k - 1]]
        at = at[hashes[np.minimum(np.searchsorted(hashes, sh[at]), len(hashes) - 1)] == sh[at]]
        for t in np.unique(text[at]).tolist():
            found.setdefault(t, {})[k] = at[text[at] == t] - w.first[t]
    return {t: m for t, hits in found.items() if (m := _matches(w.hash[w.first[t] : w.first[t + 1]], hits, index))}


def matches(df: DataFrame, benchmark: DataFrame, text_col: str = "text", carry: list[str] | None = None, item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Columns ``carry`` of ``df`` (default: all) with ``matches``: the best one of each matched item."""
    carried = [c for c in (df.columns if carry is None else carry) if c != "matches"]
    item_type = benchmark.schema[item_col].dataType
    kind = T.StructType.fromDDL(f"matches {MATCHES.format(item_type.simpleString())}")["matches"].dataType
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(item_text_col) + F.lit(16)), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block))
    read = carried if text_col in carried else [*carried, text_col]
    out, made = df.select(*read), []
    for i in range(n_blocks):
        part = benchmark.where(F.pmod(F.xxhash64(item_col, item_text_col), F.lit(n_blocks)) == i)
        items = [tuple(r) for r in part.select(item_col, item_text_col).collect()]  # at most about BLOCK bytes
        items.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1] or ""))
        index = build(items)
        made.append(f"__matches{i}")
        out = out.mapInArrow(_pass(index, out.columns, read.index(text_col), made[-1], to_arrow_type(item_type)), T.StructType([*out.schema.fields, T.StructField(made[-1], kind)]))
    return out.select(*carried, (F.concat(*made) if made[1:] else F.col(made[0])).alias("matches"))


def _pass(index: Index, columns: list[str], text_at: int, name: str, item: pa.DataType):
    fields = ("item_id", "similarity", "distance", "start_word", "n_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_bytes(_lower(rows_of(b, text_at)))
            got: list[list] = [[] for _ in range(b.num_rows)]
            for i, j in slices(offsets, _SLICE):
                for t, found in _find(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], index).items():
                    got[i + t] = [dict(zip(fields, (index.ids[m[0]], *m[1:]))) for m in found]
            kind = pa.struct([("item_id", item), ("similarity", pa.float64()), ("distance", pa.int32()), ("start_word", pa.int32()), ("n_words", pa.int32())])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.list_(kind))], [*columns, name])

    return run
