"""Periodic runs of words in each text, and the texts without their repetitions.

A run is a stretch of consecutive words with smallest period q (words q apart are the same) and at
least LEAST words and TIMES periods, which no neighbouring word extends. Runs are found as Stoye and
Gusfield do: in the suffix tree of a text's words, two occurrences of an inner node's word string
that stand its length apart, below different children, are a branching tandem repeat. Each node
tests the leaves of all its children but the largest, forwards and backwards, which makes
O(n log n) tests in all. A branching repeat is then rotated to the left as far as its words agree;
repeats that reach the same maximal stretch are merged, the shortest period wins.

The trees of many texts are built together, as arrays: suffixes are sorted by prefix doubling, the
ranks of all doublings stay and give any two places' common words by binary descent, and nodes
are the intervals of the sorted suffixes. A run makes two different places share at least
min(max(LEAST, TIMES * q) - q) words (16 for the defaults), so a text without such a pair has no
run and gets no tree.

Each row stands alone: no shuffle, and a task that runs again gives the same rows. Words are
``[^\\x20\\x09-\\x0D]+``, case-sensitive. A null, empty or wordless text has no words, no runs and an
empty text; very long texts are taken whole, with about 200 bytes of memory a word, or more where
they repeat long passages (four for each doubling of the longest); repeated rows give the same;
runs are in order of start, then period, so there are no ties; an empty table gives no rows.
Columns named like an output column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyscale.llm.common import SPACE, rows_of, slices, text_bytes
from storyscale.llm.words import U, mix

LEAST, TIMES = 24, 3
#: Bytes of texts whose trees are built together; leaves tested together.
_SLICE = 1 << 21
_LEAVES = 1 << 20


class Runs(NamedTuple):
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class Children(NamedTuple):
    """Children of inner nodes but the largest of each: their interval of sorted suffixes, the node's, and its depth in words."""

    low: np.ndarray
    high: np.ndarray
    node_low: np.ndarray
    node_high: np.ndarray
    depth: np.ndarray


def _groups(first: np.ndarray) -> np.ndarray:
    """Where the group of each place begins, by the flags of groups' first places."""
    return np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))


def _changes(x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def doublings(s: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ... the rank of each place among the strings of 2 ** k symbols from it; in the last, no two places share one.

    Each text in ``s`` must end in a symbol that occurs nowhere else.
    """
    order = np.argsort(s, kind="stable")
    first = _changes(s[order])
    rank = np.empty(len(s), np.int32)
    rank[order] = _groups(first)
    out, size = [rank], 1
    alone = first & np.append(first[1:], True)
    at = order[~alone]
    while len(at):
        key = rank[at].astype(np.int64) * len(s) + rank[at + size]  # a string shared by two places holds no end
        by = np.argsort(key)
        at, key = at[by], key[by]
        old = rank[at]
        new = _changes(key)
        rank = rank.copy()
        rank[at] = old + (_groups(new) - _groups(_changes(old))).astype(np.int32)
        out.append(rank)
        at = at[~(new & np.append(new[1:], True))]
        size *= 2
    return out


def shared_words(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols agree from the places a and b on (``back``: up to them)."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 2, -1, -1):
        i, j = (a - n - (1 << k), b - n - (1 << k)) if back else (a + n, b + n)
        if back:
            inside = (i >= 0) & (j >= 0)
            same = inside & (ranks[k][np.maximum(i, 0)] == ranks[k][np.maximum(j, 0)])
        else:
            same = ranks[k][i] == ranks[k][j]
        n += same.astype(np.int64) << k
    return n


def _minima(v: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ... the least of the 2 ** k values up to each place; 0 where there are fewer."""
    out, size = [v], 1
    while True:
        wide = np.zeros_like(v)
        wide[size:] = np.minimum(out[-1][size:], out[-1][:-size])
        if not wide.any():
            return out
        out.append(wide)
        size *= 2


def inner_nodes(common: np.ndarray) -> Children:
    """Children of the suffix tree's inner nodes but each node's largest; ``common``: symbols shared by each sorted suffix and the one before."""
    split = np.flatnonzero(common)
    depth = common[split]
    least = _minima(common)
    before, low, high = split - 1, split - 1, split.copy()  # the last place of a lesser or equal value, of a lesser one; the node's end
    for k in range(len(least) - 1, -1, -1):
        size = 1 << k
        before = before - size * (least[k][before] > depth)
        low = low - size * (least[k][low] >= depth)
        to = high + size
        high = high + size * ((to < len(common)) & (least[k][np.minimum(to, len(common) - 1)] >= depth))
    order = np.lexsort((split, high, low))
    split, depth, before, low, high = (x[order] for x in (split, depth, before, low, high))
    first = _changes(low) | _changes(high)
    last = np.append(first[1:], True) if len(first) else first
    node = np.cumsum(first) - 1
    # a child ends before each split, and one more behind the node's last split
    begin = np.concatenate([before, split[last]])
    end = np.concatenate([split - 1, high[last]])
    of = np.concatenate([node, node[last]])
    parent = np.concatenate([np.arange(len(split)), np.flatnonzero(last)])
    by = np.lexsort((begin - end, of))
    keep = by[~_changes(of[by])]
    p = parent[keep]
    return Children(begin[keep], end[keep], low[p], high[p], depth[p])


def branching_repeats(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of all branching tandem repeats: two equal strings side by side, not followed by the symbol that would go on with them."""
    rank = ranks[-1]
    n = len(rank)
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    common = np.zeros(n, np.int32)
    common[1:] = shared_words(ranks, suffix[:-1], suffix[1:])
    c = inner_nodes(common)
    found = [np.zeros(0, np.int64)]
    for i, j in slices(np.concatenate([[0], np.cumsum(c.high - c.low + 1)]), _LEAVES):
        part = Children(*(x[i:j] for x in c))
        size = part.high - part.low + 1
        child = np.repeat(np.arange(j - i), size)
        leaf = suffix[np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size) + part.low[child]]
        depth = part.depth[child].astype(np.int64)
        for other, first in ((leaf + depth, leaf), (leaf - depth, leaf - depth)):
            r = rank[np.clip(other, 0, n - 1)]
            hit = (other >= 0) & (other < n) & (r >= part.node_low[child]) & (r <= part.node_high[child]) & ((r < part.low[child]) | (r > part.high[child]))
            found.append(first[hit] * n + depth[hit])
    key = np.unique(np.concatenate(found))
    return key // n, key % n


def runs_of(s: np.ndarray, least: int = LEAST, times: int = TIMES) -> Runs:
    """All runs in ``s``, in order of start and period; each text must end in a symbol that occurs nowhere else."""
    if not len(s):
        return Runs(*[np.zeros(0, np.int64)] * 3)
    ranks = doublings(s)
    at, period = branching_repeats(ranks)
    start = at - shared_words(ranks, at, at + period, back=True)  # rotated to the left
    end = at + 2 * period
    long = end - start >= np.maximum(least, times * period)
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))  # repeats of several periods' length reach the same stretch
    start, end, period = start[by], end[by], period[by]
    keep = _changes(start) | _changes(end)
    return Runs(start[keep], (end - start)[keep], period[keep])


def _may_have(codes: np.ndarray, text: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """Whether two places of a text have the same ``size`` words behind them, by their hashes; may err towards yes."""
    out = np.zeros(n_texts, bool)
    n = len(codes) - size + 1
    if n <= 0:
        return out
    with np.errstate(over="ignore"):
        h = mix(codes.astype(U) + U(1))
        have = np.zeros(n, U)
        for i in range(size):
            have = mix(have * U(0x2545F4914F6CDD1D) + h[i : i + n])
    whole = text[:n] == text[size - 1 :]
    bits = max(n_texts - 1, 1).bit_length()
    key = np.sort(((have >> U(bits)) << U(bits) | text[:n].astype(U))[whole])
    out[(key[1:][key[1:] == key[:-1]] & U((1 << bits) - 1)).astype(np.int64)] = True
    return out


def shortest_shared(least: int, times: int) -> int:
    """Words that two places of any run have in common behind them."""
    return max(min(max(least, times * q) - q for q in range(1, least + 1)), 1)


def scan(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, list[Runs], list[bytes]]:
    """How many words, the runs and the text without repetitions of each text."""
    words = [t.split() for t in texts]  # at the same bytes as the word definition
    n = np.fromiter(map(len, words), np.int64, len(words))
    known: dict[bytes, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, int(n.sum()))
    text = np.repeat(np.arange(len(n)), n)
    some = np.flatnonzero(_may_have(codes, text, len(n), shortest_shared(least, times)))
    none = Runs(*[np.zeros(0, np.int64)] * 3)
    runs, left = [none] * len(n), [b" ".join(ws) for ws in words]
    # the texts that may have runs, each with an end of its own
    first = np.concatenate([[0], np.cumsum(n)])
    begin = np.concatenate([[0], np.cumsum(n[some] + 1)])
    s = np.empty(begin[-1], np.int64)
    for k, t in enumerate(some):
        s[begin[k] : begin[k + 1] - 1] = codes[first[t] : first[t + 1]] + k * len(known)  # words of different texts differ
        s[begin[k + 1] - 1] = -1 - k
    found = runs_of(s, least, times)
    of = np.searchsorted(begin, found.start, "right") - 1
    for k in np.unique(of):
        i, j = np.searchsorted(of, [k, k + 1])
        mine = Runs(found.start[i:j] - begin[k], found.length[i:j], found.period[i:j])
        t = int(some[k])
        edge = np.zeros(n[t] + 1, np.int64)
        np.add.at(edge, mine.start + mine.period, 1)
        np.add.at(edge, mine.start + mine.length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        runs[t], left[t] = mine, b" ".join(words[t][i] for i in np.flatnonzero(~gone).tolist())
    return n, runs, left


def find(df: DataFrame, least: int = LEAST, times: int = TIMES, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``df`` (default: all) with n_words, runs and collapsed.

    runs: start (word number from 0), length and period in words of each run. collapsed: the words,
    joined by one space, that lie in no run behind its first period.
    """
    own = T.StructType.fromDDL("n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    carried = [c for c in (df.columns if carry is None else carry) if c not in own.names]
    schema = T.StructType([*[df.schema[c] for c in carried], *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = rows_of(b, b.num_columns - 1)
            _, offsets = text_bytes(texts)
            for i, j in slices(offsets, _SLICE):
                n, runs, left = scan(texts[i:j].cast(pa.large_binary()).to_pylist(), least, times)
                ends = np.concatenate([[0], np.cumsum([len(r.start) for r in runs])]).astype(np.int32)
                fields = [pa.array(np.concatenate(x)) for x in zip(*runs)]
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, list(Runs._fields)))
                kept = pa.array(left, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[c[i:j] for c in b.columns[: len(carried)]], pa.array(n), listed, kept], schema.names)

    read = df.select(*carried, F.col(text_col).cast("string"))
    return read.toDF(*map(str, range(len(read.columns)))).mapInArrow(run, schema)  # numbered, so that no name clashes


def made_periodic(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the end of every tenth text, by its id's hash h, made a repetition: word i >= a becomes word a + (i - a) % p.

    g = h // 10, a = g % n and p = 1 + (n - a) // (3 + g % 8), of n words; the words are joined by one space.
    Its own columns __words, __n, __a and __p must not be taken.
    """
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    out = df.withColumn("__words", F.when(h % 10 == 0, F.filter(F.split(F.coalesce(text_col, F.lit("")), SPACE + "+"), lambda w: w != "")))
    g, n = F.floor(h / 10), F.size("__words")
    out = out.withColumns({"__n": n, "__a": F.when(n > 0, (g % n).cast("int"))})
    out = out.withColumn("__p", (1 + F.floor((F.col("__n") - F.col("__a")) / (3 + g % 8))).cast("int"))
    turn = F.slice("__words", F.col("__a") + 1, F.col("__p"))
    times = F.ceil((F.col("__n") - F.col("__a")) / F.col("__p")).cast("int")
    words = F.slice(F.concat(F.slice("__words", F.lit(1), F.col("__a")), F.flatten(F.array_repeat(turn, times))), F.lit(1), F.col("__n"))
    return out.withColumn(text_col, F.when(F.col("__n") > 0, F.array_join(words, " ")).otherwise(F.col(text_col))).drop("__words", "__n", "__a", "__p")


def foremost(runs: Column) -> Column:
    """The run of the greatest length / period; of equal ones the first, then of the shortest period. Null of none.

    Fractions are compared exactly, by products.
    """

    def better(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)  # in order of start and period
