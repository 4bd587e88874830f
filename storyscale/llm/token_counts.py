"""Edit-aware token counts: a segment tree of pre-tokens for each document.

The leaves of a document's tree are runs of up to LEAF chunks, a chunk being what lies between two
places where the tokenizer always cuts; every node knows the characters and tokens below it. An
edit descends to the leaf of its place, takes the chunks it touches and those whose cut could look
at the changed characters, encodes these anew, and goes on to the right only until its cuts meet
the old ones again. Then the sums on the leaves' paths to the root are renewed; all other leaves
are neither read nor encoded.

A cut lies between a character that is surely no white space and plain white space, or between a
letter or digit and a comma or the like: the tokenizer cuts there whatever stands around, so a cut
depends on the characters beside it alone, in texts with unusual white space or special names too.
What holds no such place (one very long word) is one chunk. A leaf that inserts have made long is
dealt out to several.

Trees are kept: with ``trees`` the edited text comes with its chunks' characters and tokens, and a
later batch of edits that is given them starts there instead of encoding the text.

A null text is empty, a null or empty list of edits changes nothing, places beyond the text are
moved to its end, and the edits of a list apply one after another. Repeated rows count alike; very
long texts are worked on in batches of their own; a kept tree that doesn't fit its text is made
anew; further columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyscale.llm.tokenizing import Encoder, batches_of, encoder, vocabulary

LEAF = 64
EDITS = "array<struct<start:int,end:int,replacement:string>>"
#: A kept tree: characters and tokens of each chunk.
TREE = "struct<chars:array<int>,tokens:array<int>>"


class Tree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, enc: Encoder, chars: list[int] | None = None, tokens: list[int] | None = None):
        self.enc = enc
        self.encoded = 0  #: characters encoded by edits
        if chars is None or tokens is None or len(chars) != len(tokens) or sum(chars) != len(text):
            self._build(text)
        else:
            ends = np.cumsum([0, *chars]).tolist()
            self._layout([text[a:b] for a, b in zip(ends, ends[1:])], list(tokens))

    def _build(self, text: str) -> None:
        chunks = self.enc.sure(text)
        self._layout(chunks, self.enc.counts(chunks))

    def _layout(self, chunks: list[str], counts: list[int]) -> None:
        self.leaves = [(chunks[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(chunks), LEAF)] or [([], [])]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (c, n) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, c)), sum(n)
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def kept(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the chunks: what a later tree of this text starts from."""
        return [len(c) for chunks, _ in self.leaves for c in chunks], [n for _, counts in self.leaves for n in counts]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(c for chunks, _ in self.leaves for c in chunks)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before it."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if before + self.chars[node] <= place and before + self.chars[node] < self.chars[1]:
                before += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), before

    def _renew(self, leaf: int) -> None:
        chunks, counts = self.leaves[leaf]
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(map(len, chunks)), sum(counts)
        while node := node // 2:
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace characters start to end."""
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        leaf, at = self._leaf_at(max(start - 2, 0))
        chunks = self.leaves[leaf][0]
        first = 0
        while first < len(chunks) - 1 and at + len(chunks[first]) < start - 1:
            at += len(chunks[first])
            first += 1
        # taken: old chunks from here on, and where each ends in the old text
        walk = self._from(leaf, first)
        taken, ends, old = [], {}, at
        context = 2
        while True:
            wanted = context
            while wanted:
                chunk = next(walk, None)
                if chunk is None:
                    break
                taken.append(chunk)
                old += len(chunk[2])
                ends[old] = len(taken)
                wanted -= old > end
            ended = wanted > 0
            was = "".join(c for _, _, c in taken)
            now = was[: start - at] + replacement + was[end - at :]
            if not self.enc.local and (self.enc.special(now) or self.enc.special(was)):
                self._rebuild(start, end, replacement)
                return
            new = self.enc.sure(now)
            if ended:
                break
            # meet: the first cut right of the edit that is an old one too, with two characters behind it in sight
            place, moved = at, len(replacement) - (end - start)
            for k, c in enumerate(new):
                place += len(c)
                if place - moved >= end and place - moved in ends and place - moved <= old - 2:
                    taken, new = taken[: ends[place - moved]], new[: k + 1]
                    break
            else:
                context *= 2
                continue
            break
        self.encoded += sum(map(len, new))
        counts = self.enc.counts(new)
        if not taken:
            spans = {leaf: (first, first)}
        else:
            spans = {}
            for n, i, _ in taken:
                a, b = spans.get(n, (i, i))
                spans[n] = (min(a, i), max(b, i + 1))
        for k, (n, (a, b)) in enumerate(sorted(spans.items())):
            c, m = self.leaves[n]
            self.leaves[n] = (c[:a] + (new if k == 0 else []) + c[b:], m[:a] + (counts if k == 0 else []) + m[b:])
            self._renew(n)
        if any(len(self.leaves[n][0]) > 8 * LEAF for n in spans):
            self._layout([c for chunks, _ in self.leaves for c in chunks], [n for _, counts in self.leaves for n in counts])

    def _from(self, leaf: int, first: int) -> Iterator[tuple[int, int, str]]:
        for n in range(leaf, len(self.leaves)):
            chunks = self.leaves[n][0]
            for i in range(first if n == leaf else 0, len(chunks)):
                yield n, i, chunks[i]

    def _rebuild(self, start: int, end: int, replacement: str) -> None:
        """The way of special names that reach beyond their chunk: a new tree."""
        text = self.text()
        text = text[:start] + replacement + text[end:]
        self.encoded += len(text)
        self._build(text)


def count(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", tokenizer: str = "byte_bpe_50k.json", tree_col: str | None = None, trees: bool = False) -> DataFrame:
    """(id, n_chars, n_tokens, n_edits, edited_chars, edited_tokens, encoded_chars) of each row.

    n_*: of the text as it is; edited_*: after the edits; encoded_chars: characters that the edits
    had encoded anew. ``trees`` adds edited_text and tree, ``tree_col`` names a column of trees to
    start from.
    """
    names = ["n_chars", "n_tokens", "n_edits", "edited_chars", "edited_tokens", "encoded_chars"]
    kept = [T.StructField("edited_text", T.StringType()), *T.StructType.fromDDL(f"tree {TREE}").fields] if trees else []
    schema = T.StructType([df.schema[id_col], *[T.StructField(n, T.LongType()) for n in names], *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary(tokenizer), "byte", "<u4")
        for b in batches:
            texts = b.column(1).fill_null("").to_pylist()
            edits, starts = b.column(2).to_pylist(), b.column(3)
            for i, j in batches_of(np.fromiter(map(len, texts), np.int64, len(texts))):
                enc.refresh()
                out, after = [], []
                for text, steps, start in zip(texts[i:j], edits[i:j], starts[i:j].to_pylist()):
                    tree = Tree(text, enc, *((start["chars"], start["tokens"]) if start else ()))
                    row = [tree.length, tree.total, len(steps or ())]
                    for e in steps or ():
                        if e:
                            tree.edit(e["start"] or 0, e["end"] or 0, e["replacement"] or "")
                    out.append((*row, tree.length, tree.total, tree.encoded))
                    if trees:
                        after.append((tree.text(), dict(zip(("chars", "tokens"), tree.kept()))))
                cols = [b.column(0)[i:j], *[pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))]]
                if trees:
                    counts = pa.list_(pa.int32())
                    cols += [pa.array([t for t, _ in after], pa.string()), pa.array([t for _, t in after], pa.struct([("chars", counts), ("tokens", counts)]))]
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    tree = F.col(tree_col) if tree_col else F.lit(None)
    return df.select(id_col, F.col(text_col).cast("string").alias("__text"), F.col(edits_col).cast(EDITS).alias("__edits"), tree.cast(TREE).alias("__tree")).mapInArrow(run, schema)


#: What the scripted edits put in.
REPLACEMENTS = ("", " revised", "é", "\n\n", "'s", " 2024", "...", "un")


def scripted_edits(id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> Column:
    """n edits at places of the text that follow from the id: what the registered query applies."""
    length = F.coalesce(F.length(text_col), F.lit(0)) + 1
    draw = lambda k, what: F.crc32(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"{k}:{what}")).cast("binary"))
    steps = []
    for k in range(n):
        start = (draw(k, "start") % length).cast("int")
        text = F.get(F.array(*map(F.lit, REPLACEMENTS)), (draw(k, "text") % len(REPLACEMENTS)).cast("int"))
        steps.append(F.struct(start.alias("start"), (start + (draw(k, "size") % 13).cast("int")).alias("end"), text.alias("replacement")))
    return F.array(*steps)
