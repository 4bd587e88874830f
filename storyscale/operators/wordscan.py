"""Distinct words of stories with frequency, patterns and stage: one Arrow pass over the stories' bytes.

A story's row stands alone, so the pass needs no shuffle and works on streams. Words are runs of
letters in the bytes of a whole batch; each distinct word of the batch is classified once, column by
column, and (row, word) pairs are counted by one sort. Memory is a small multiple of a batch, which
Spark bounds by rows and bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from storyscale.functions import lexicon as L

_BIT = {p: 1 << i for i, p in enumerate(L.PATTERNS)} | {"irregular": 1 << len(L.PATTERNS)}
_LETTER = np.zeros(256, np.uint8)
_LETTER[65:91] = _LETTER[97:123] = np.arange(97, 123)
_QUOTE = "’".encode()

#: What ``scan`` returns.
SCAN = "struct<total int, words array<struct<word string, freq int, mask int, stage int>>, tally array<struct<mask int, stage int, freq int, words int>>>"


def _holds(words: pa.Array, regex: str) -> np.ndarray:
    return pc.match_substring_regex(words, regex).to_numpy(zero_copy_only=False)


def _among(words: pa.Array, listed: list[str]) -> np.ndarray:
    return pc.is_in(words, pa.array(listed)).to_numpy(zero_copy_only=False)


def masks(words: pa.Array) -> np.ndarray:
    """Pattern bits of normalised words, as ``patterns.mask`` gives them."""
    either = "|".join
    n = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    groups = pc.count_substring_regex(words, "[aeiouy]+").to_numpy(zero_copy_only=False)
    syllables = np.maximum(groups - _holds(words, "(^|[^ly])e$") + _holds(words, "(^|[^aeiouy])le$"), 1)
    ow = _holds(words, "ow") & ~_among(words, L.OW_LONG_O)
    spelled = {
        "digraph": _holds(words, either(L.DIGRAPHS)),
        "blend": _holds(words, f"^({either(L.INITIAL_BLENDS)})|({either(L.FINAL_BLENDS)})$"),
        "final_e": (n >= 4) & _holds(words, "[aeiou][^aeiou]e$") & ~_among(words, L.FINAL_E_EXCEPTIONS),
        "vowel_team": _holds(words, either(L.VOWEL_TEAMS)),
        "r_controlled": _holds(words, either(L.R_CONTROLLED)),
        "l_controlled": _holds(words, either(L.L_CONTROLLED)),
        "diphthong": _holds(words, either(d for d in L.DIPHTHONGS if d != "ow")) | ow,
    }
    bits = sum(_BIT[p] * on.astype(np.int32) for p, on in spelled.items())
    bits = np.where(_among(words, L.IRREGULAR_WORDS), _BIT["irregular"], bits)
    return bits + _BIT["multisyllabic"] * ((n > 3) & (syllables >= 2))


def _stages() -> list[int]:
    """Highest stage of each possible mask; 0 of an irregular word of one syllable."""
    of = lambda m: max((L.STAGES[p] for p in L.PATTERNS if m & _BIT[p]), default=0)
    return [L.STAGES["short_vowel"], *map(of, range(1, 2 * _BIT["irregular"]))]


_STAGE = np.array(_stages(), np.int32)


def _bytes(stories: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all stories (null: none) and the offsets of their rows."""
    wide = stories.fill_null("").cast(pa.large_binary())
    _, off, data = wide.buffers()
    offsets = np.frombuffer(off, np.int64)[wide.offset : wide.offset + len(wide) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def _tails(raw: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which runs of letters follow another behind an apostrophe; in a chain of several every second one does."""
    gap = start[1:] - end[:-1]
    near = np.flatnonzero(((gap == 1) | (gap == len(_QUOTE))) & (row[1:] == row[:-1]))
    at = end[near]
    linked = near[np.where(gap[near] == 1, raw[at] == ord("'"), np.all([raw[np.minimum(at + i, len(raw) - 1)] == b for i, b in enumerate(_QUOTE)], axis=0))] + 1
    first = np.ones(len(linked), bool)
    first[1:] = linked[1:] != linked[:-1] + 1
    place = np.arange(len(linked))
    return linked[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Normalised words of all rows in order, and the row of each."""
    low = _LETTER[raw]
    inside = low != 0
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (cut[:-1] | np.concatenate([[True], ~inside[:-1]])))
    end = np.flatnonzero(inside & (cut[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    tail = _tails(raw, start, end, row) if len(start) else start
    if len(tail):  # what stands behind the apostrophe goes, and the n of n't with it
        head = tail - 1
        short = (end[tail] - start[tail] == 1) & (low[start[tail]] == ord("t")) & (low[end[head] - 1] == ord("n")) & (end[head] - start[head] >= 2)
        gone = np.zeros(len(raw) + 1, np.int32)
        np.add.at(gone, start[tail], 1)
        np.add.at(gone, end[tail], -1)
        inside &= np.cumsum(gone)[:-1] == 0
        end[head[short]] -= 1
        inside[end[head[short]]] = False
        start, end, row = (np.delete(x, tail) for x in (start, end, row))
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=ends[1:])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(low[inside])), row


def _lists(lengths: np.ndarray, **fields: pa.Array) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def scan(stories: pa.Array) -> pa.Array:
    """All words of each story (null: none): how many, the distinct ones in order, and their sums by mask."""
    rows = len(stories)
    found, row = _words(*_bytes(stories))
    coded = found.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    vocabulary = coded.dictionary.take(pa.array(order)).cast(pa.string())
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    size = max(len(order), 1)
    keys, freq = np.unique(row * size + rank[coded.indices.to_numpy()], return_counts=True)
    at, word = keys // size, keys % size
    mask, freq = masks(vocabulary)[word].astype(np.int32), freq.astype(np.int32)
    words = _lists(np.bincount(at, minlength=rows), word=vocabulary.take(pa.array(word)), freq=pa.array(freq), mask=pa.array(mask), stage=pa.array(_STAGE[mask]))
    sums = np.bincount(at * len(_STAGE) + mask, freq, rows * len(_STAGE)).astype(np.int32)
    n = np.bincount(at * len(_STAGE) + mask, minlength=rows * len(_STAGE)).astype(np.int32)
    some = np.flatnonzero(n)
    by = (some % len(_STAGE)).astype(np.int32)
    tally = _lists(np.bincount(some // len(_STAGE), minlength=rows), mask=pa.array(by), stage=pa.array(_STAGE[by]), freq=pa.array(sums[some]), words=pa.array(n[some]))
    total = pa.array(np.bincount(row, minlength=rows).astype(np.int32))
    return pa.StructArray.from_arrays([total, words, tally], ["total", "words", "tally"])
