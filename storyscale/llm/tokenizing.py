"""Token ids of many texts with a public tokenizer file of the tokenizers library.

A pre-token (what the tokenizer's pattern cuts a text to) has the same ids in each text, so a worker
asks the library's BPE model once for each distinct one and keeps its ids as bytes; the ids of a
text are the joined bytes of its pre-tokens. Texts of Latin letters, digits and signs are cut by
the pattern here, spelled out for these characters. Texts with any other character, unusual white
space or a special token's name are cut only at plain white space, where the tokenizer always cuts
too, and these chunks (or, where white space itself counts and is unusual, the text) go to the
library as they are. A worker remembers up to twice PIECES pieces: the newer half, and of the older ones those not
met since.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: Pre-tokens and chunks that a worker remembers, and the longest of them.
PIECES = 500_000
LONGEST = 100

#: Letters and numbers below U+0250; the rest of that range is signs, controls and white space.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
#: White space beside blank, tab and line ends, controls that some take for it, and a letter whose lower case is two characters.
_SPACES = "\x0b\x0c\x1c-\x1f\x85\xa0  -​    　"
_UNUSUAL = re.compile(f"[{_SPACES}]")
_NOT_PLAIN = re.compile(f"[{_SPACES}İɐ-\U0010ffff]")
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_PIECE = {
    "byte": f"{_CONTRACTIONS}| ?[{_L}]+| ?[{_N}]+| ?[^ \t\n\r{_L}{_N}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+",
    "word": f"{_CONTRACTIONS}|[{_L}]+|[{_N}]|[^ \t\n\r{_L}{_N}]+",
}
#: Where the byte tokenizer cuts whatever lies around: behind what is surely no white space and before plain white
#: space, and behind an ASCII or CJK letter or ASCII digit and before a comma, a semicolon or the like.
_SURE = re.compile(f"(?<=[^ \t\n\r{_SPACES}])(?=[ \t\n\r])|(?<=[A-Za-z0-9\u3041-\u3096\u30a1-\u30fa\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7a3])(?=[,;\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])")
_CHUNK = {"byte": r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+", "word": r"[^ \t\n\r]+"}


def vocabulary(name: str) -> str:
    """Where a tokenizer file lies on this machine: a path as given, or a public file by its name."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class _Memory(dict):
    """Ids of pieces as bytes, made by ``make`` where they are not known."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.pop(piece, None)
        if out is None:
            out = self.make(piece)
        if len(piece) <= LONGEST:
            self[piece] = out
        return out

    def bound(self):
        """Lookup of a piece; a full memory becomes the older one."""
        if len(self) > PIECES:
            self.older = dict(self)
            self.clear()
        return self.__getitem__


class Encoder:
    """kind: "byte" for byte-level BPE, "word" for BPE with word ends that drops white space and case."""

    def __init__(self, path: str, kind: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.code = kind, {2: "H", 4: "I"}[np.dtype(dtype).itemsize]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # special names stand for themselves wherever they are, within one chunk of sure()
        self.local = not any(t.lstrip or t.rstrip or t.single_word or _SURE.search(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cut, self.cut_ascii = re.compile(_PIECE[kind]).findall, re.compile(_PIECE[kind].replace(_L, "A-Za-z").replace(_N, "0-9")).findall
        self.chunk = re.compile(_CHUNK[kind]).findall
        letters, model, code = _byte_letters(), self.tokenizer.model, self.code
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # each piece is asked for once, so its own memory is in vain
        tokenize = model.tokenize
        blank = chr(letters[32])

        def of_piece(p: str) -> bytes:
            if not p.isascii() or not p.isprintable() or p[-1] == " ":
                p = p.encode().decode("latin-1").translate(letters)
            elif p[0] == " ":
                p = blank + p[1:]
            return array(code, [t.id for t in tokenize(p)]).tobytes()

        self.pieces, self.chunks = _Memory(of_piece), _Memory(self._chunk)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def whole(self, text: str) -> bool:
        """Whether white space or special names in a text make its cuts unlike those at plain white space."""
        return self.special(text) or bool(_UNUSUAL.search(text))

    def special(self, text: str) -> bool:
        """Whether a text holds the name of a special token."""
        return "<|" in text and any(s in text for s in self.specials)

    def sure(self, text: str) -> list[str]:
        """A text for byte-level BPE in chunks that are encoded one by one whatever stands beside them."""
        if not text:
            return []
        return [text] if not self.local and self.special(text) else _SURE.split(text)

    def refresh(self) -> None:
        """Keep the memories within their bounds."""
        self.pieces.bound()
        self.chunks.bound()

    def counts(self, chunks: list[str]) -> list[int]:
        """Ids of each chunk. A plain chunk's ids are those of its pre-tokens."""
        get, size = self.chunks.__getitem__, array(self.code).itemsize
        return [len(x) // size for x in map(get, chunks)]

    def _chunk(self, chunk: str) -> bytes:
        if self.whole(chunk) or _NOT_PLAIN.search(chunk):
            return array(self.code, self.ids(chunk)).tobytes()
        return b"".join(map(self.pieces.__getitem__, self.cut(chunk.lower() if self.kind == "word" else chunk)))

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian integers."""
        piece, chunk, out = self.pieces.bound(), self.chunks.bound(), []
        for t in texts:
            special = self.special(t)
            if not special and not _NOT_PLAIN.search(t):
                if self.kind == "word":
                    t = t.lower()
                out.append(b"".join(map(piece, self.cut_ascii(t) if t.isascii() else self.cut(t))))
            elif self.kind == "byte" and self.whole(t):
                out.append(array(self.code, self.ids(t)).tobytes())
            else:
                out.append(b"".join(map(chunk, self.chunk(t))))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, kind: str, dtype: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path, kind, dtype)


def batches_of(sizes: np.ndarray, most: int = 1 << 21) -> Iterable[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``most``."""
    ends = np.cumsum(sizes)
    i = 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j
