"""Toxicity by multiple-instance learning: sentences scored, combined by noisy-or, learned from document labels.

A sentence ends at ``.``, ``!``, ``?`` or a line end and has a logistic score over the words it
holds and their stems (first STEM bytes), which tell inflected and compound words too; a document is
toxic unless each of its sentences is not: P = 1 - prod(1 - s). The likelihood of the document
labels trains the weights. The fit takes a bounded sample: POSITIVES and
NEGATIVES labelled rows, those with the smallest hash of the id, of texts up to LONGEST bytes. All
texts are scored whole, on arrays over their bytes, and the offending sentences are located.

Labels, language, source and id are no inputs of a score. Several labels of one id count as toxic
if one of them does; null labels are left out. A null text is empty and scores lowest with other
wordless texts; repeated rows score alike, and of differing texts of one id the fit takes always the
same one; an empty table gives no rows; very long texts are scored whole, in blocks. Columns named
like an output column give way to it. Without labelled rows of
both kinds the model has no words and every score is the share of toxic labels (0 if none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyscale.llm.common import crc_mod, rows_of, slices, text_bytes
from storyscale.llm.words import ALNUM, words

POSITIVES, NEGATIVES = 1000, 3000
LONGEST = 1 << 20
#: Chosen with TELLING by the least log loss of a fourfold cross-validation within training rows; held-out rows had no part in it.
STEM = 4
#: Words kept: the most telling ones of toxic texts, of a likelihood ratio (G squared) of at least TELLING, which chance reaches for about one word in 2,000.
TELLING = 12.0
WORDS = 4096
THRESHOLD = 0.7
OFFENDING = 0.5
_SLICE = 1 << 21
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


class Model(NamedTuple):
    hashes: np.ndarray  #: sorted word hashes
    weights: np.ndarray
    bias: float
    scale: float = 1.0  #: the document's log odds are scaled and shifted to probabilities
    shift: float = 0.0


def _folded(buf: np.ndarray) -> np.ndarray:
    """Bytes with the capitals of Latin-1 in lower case: two bytes each, the second moves by 32."""
    buf = buf.copy()
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    at = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
    buf[at] += 32
    return buf


def _sentences(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and stems, the sentence of each, the text of each sentence and the first byte of each sentence.

    A sentence has at least one word.
    """
    w = words(_folded(buf), offsets, ALNUM, STEM)
    if not len(w.start):
        z = np.zeros(0, np.int64)
        return w.hash, z, z, z
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
    mark = np.cumsum(_STOP[buf])[w.start] + text
    new = np.concatenate(([True], mark[1:] != mark[:-1]))
    first, sentence = np.flatnonzero(new), np.cumsum(new) - 1
    stem = np.flatnonzero(w.prefix)
    return np.concatenate([w.hash, w.prefix[stem]]), np.concatenate([sentence, sentence[stem]]), text[first], w.start[first]


def _log_odds(words_at: np.ndarray, feature: np.ndarray, sentence: np.ndarray, n: int, m: Model) -> np.ndarray:
    """Log odds of each sentence; a word counts once in a sentence."""
    pairs = np.unique(sentence[words_at] * len(m.weights) + feature) if len(words_at) else np.zeros(0, np.int64)
    return m.bias + np.bincount(pairs // max(len(m.weights), 1), m.weights[pairs % max(len(m.weights), 1)], n)


def _features(h: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that the model knows, and which they are."""
    if not len(known) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i = np.minimum(np.searchsorted(known, h), len(known) - 1)
    at = np.flatnonzero(known[i] == h)
    return at, i[at]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _noisy_or(z: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Log odds of the texts: sum over sentences of -log(1 - s) is -log(1 - P)."""
    safe = np.bincount(text, _softplus(z), n)
    return np.log(np.maximum(np.expm1(np.minimum(safe, 500)), 1e-12))


def _sample(df: DataFrame, labels: DataFrame, id_col: str, label_col: str, text_col: str) -> list:
    """The training rows: (label, word hashes of each sentence once, their sentences)."""
    marked = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    rows = df.where(F.octet_length(text_col) <= LONGEST).select(id_col).distinct()  # ids alone: no text is shuffled
    marked = marked.join(rows, id_col, "left_semi")
    order = [F.xxhash64(F.col(id_col)), F.col(id_col)]
    chosen = marked.where("__label > 0").orderBy(*order).limit(POSITIVES).union(marked.where("__label <= 0").orderBy(*order).limit(NEGATIVES)).collect()  # at most POSITIVES + NEGATIVES ids
    if not chosen:
        return []
    label = {r[0]: int(r[1] > 0) for r in chosen}

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array([i for i, x in enumerate(b.column(0).to_pylist()) if x in label], pa.int64())
            if not len(at):
                continue
            ids = b.column(0).take(at)
            texts = b.column(1).take(at)
            out = []
            for x in range(len(texts)):
                h, s, _, _ = _sentences(*text_bytes(texts[x : x + 1]))
                order = np.lexsort((h, s))
                h, s = h[order], s[order]
                keep = np.concatenate(([True], (h[1:] != h[:-1]) | (s[1:] != s[:-1]))) if len(h) else np.zeros(0, bool)
                out.append((h[keep].tobytes(), s[keep].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["id", "h", "s"])

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.where(F.octet_length(text_col) <= LONGEST).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    got = texts.mapInArrow(gather, f"id {kind}, h binary, s binary").groupBy("id").agg(F.min(F.struct("h", "s")).alias("t")).select("id", "t.*").collect()  # the sampled rows alone; of differing texts of an id always the same one
    got.sort(key=lambda r: str(r["id"]))
    return [(label[r["id"]], np.frombuffer(r["h"], np.uint64), np.frombuffer(r["s"], np.uint32).astype(np.int64)) for r in got]


def loss(w: np.ndarray, b: float, word: np.ndarray, sent: np.ndarray, text: np.ndarray, y: np.ndarray, weight: np.ndarray, n_sent: int) -> tuple[float, np.ndarray, float]:
    """Weighted negative log likelihood of the labels ``y`` and its gradient by the words' weights and the bias.

    ``word`` and ``sent``: a word in a sentence, each pair once; ``text``: the text of each sentence.
    """
    odds = b + np.bincount(sent, w[word], n_sent)
    s = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    safe = np.bincount(text, _softplus(odds), len(y))  # -log(1 - P)
    clean = np.exp(-safe)
    toxic = np.maximum(1 - clean, 1e-9)
    pull = weight * np.where(y > 0, -clean / toxic, 1.0)
    g = pull[text] * s
    return float((weight * np.where(y > 0, -np.log(toxic), safe)).sum()), np.bincount(word, g[sent], len(w)), float(g.sum())


def fit(sample: list, shares: tuple[float, float], rounds: int = 120, telling: float | None = None) -> Model:
    """Maximum likelihood of the labels by AdaGrad, then a scale and shift of the log odds.

    shares: of clean and toxic among all labels, to which the sample's classes are weighted back.
    """
    y = np.array([x[0] for x in sample], float)
    if not len(y) or y.min() == y.max():
        p = min(max(shares[1], 1e-6), 1 - 1e-6) if len(y) else 1e-6
        return Model(np.zeros(0, np.uint64), np.zeros(0), -30.0, 0.0, math.log(p / (1 - p)))
    n = len(y)
    sizes = np.array([x[2].max() + 1 if len(x[2]) else 0 for x in sample])
    base = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(n), sizes)
    # in how many texts of either kind each word is: text by text, so that no table of all occurrences is made
    vocabulary = np.zeros(0, np.uint64)
    for i in range(0, n, 256):
        vocabulary = np.union1d(vocabulary, np.concatenate([x[1] for x in sample[i : i + 256]]))
    df, pos = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for label, h, _ in sample:
        at = np.searchsorted(vocabulary, np.unique(h))
        df[at] += 1
        pos[at] += label
    p1, p0 = (pos + 0.5) / (y.sum() + 1), (df - pos + 0.5) / (n - y.sum() + 1)
    g2 = _likelihood_ratio(pos, df, y.sum(), n) * (p1 > p0)
    kept = np.sort(np.argsort(-g2, kind="stable")[: min(WORDS, max(int((g2 >= (TELLING if telling is None else telling)).sum()), 1))])
    sent, word = [], []
    for (_, h, s), first in zip(sample, base):
        at, which = _features(h, vocabulary[kept])
        sent.append(s[at] + first)
        word.append(which)
    sent, word = np.concatenate(sent), np.concatenate(word)
    w, b = np.clip(np.log(p1[kept] / p0[kept]), 0, 3), -5.0
    gw, gb = np.full(len(w), 1e-6), 1e-6
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    n_sent = int(sizes.sum())
    for _ in range(rounds):
        _, dw, db = loss(w, b, word, sent, text, y, weight, n_sent)
        dw += 1e-6 * w
        gw += dw * dw
        gb += db * db
        w = np.maximum(w - 0.3 * dw / np.sqrt(gw), 0)  # a sentence offends by what it holds
        b -= 0.3 * db / math.sqrt(gb)
    model = Model(vocabulary[kept], w, float(b))
    odds = _noisy_or(b + np.bincount(sent, w[word], n_sent), text, n)
    weight = np.where(y > 0, shares[1] / y.sum(), shares[0] / (n - y.sum()))
    return model._replace(**_calibrated(odds, y, weight))


def _likelihood_ratio(pos: np.ndarray, df: np.ndarray, n_pos: float, n: int) -> np.ndarray:
    """G squared of each word: how far its share of toxic texts is from that of all texts."""
    out = np.zeros(len(df))
    for seen, size in ((pos, n_pos), (df - pos, n - n_pos)):
        for have, share in ((seen, df / n), (size - seen, 1 - df / n)):
            out += 2 * have * np.log(np.maximum(have, 1e-300) / np.maximum(size * share, 1e-300))
    return out


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, float]:
    """Scale and shift of the log odds by Newton steps on the weighted likelihood, with a weak pull to 1 and 0."""
    x = np.clip(x, -12, 12)
    a = np.array([1.0, 0.0])
    ridge = 1e-3
    for _ in range(50):
        q = 1 / (1 + np.exp(-(a[0] * x + a[1])))
        g = np.array([((q - y) * weight * x).sum(), ((q - y) * weight).sum()]) + ridge * (a - [1.0, 0.0])
        v = q * (1 - q) * weight
        hess = np.array([[(v * x * x).sum() + ridge, (v * x).sum()], [(v * x).sum(), v.sum() + ridge]])
        step = np.linalg.solve(hess, g)
        a -= np.clip(step, -1, 1)
    return {"scale": float(max(a[0], 0.05)), "shift": float(a[1])}


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of the sampled rows of ``df`` that ``labels`` marks and that aren't held out."""
    counts = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col(label_col) > 0).cast("int")), F.lit(0)).alias("t")).first()
    share = counts["t"] / max(counts["n"], 1)
    return fit(_sample(df, labels, id_col, label_col, text_col), (1 - share, share))


def score(df: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``df`` (default: all) with score, predicted, n_sentences and offending.

    offending: (start, score) of each sentence of score OFFENDING or more, start in bytes.
    """
    own = T.StructType.fromDDL("score double, predicted int, n_sentences long, offending array<struct<start:int,score:double>>")
    carried = [c for c in (df.columns if carry is None else carry) if c not in own.names]
    schema = T.StructType([*[df.schema[c] for c in carried], *own.fields])
    read = carried if text_col in carried else [*carried, text_col]
    text_at = read.index(text_col)
    item = pa.struct([("start", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offsets = text_bytes(rows_of(b, text_at))
            odds, count, bad = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for i, j in slices(offsets, _SLICE):
                h, sent, text, first = _sentences(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                z = _log_odds(*_features(h, model.hashes), sent, len(text), model)
                odds[i:j] = _noisy_or(z, text, j - i)
                count[i:j] = np.bincount(text, minlength=j - i)
                for k in np.flatnonzero(z >= math.log(OFFENDING / (1 - OFFENDING))).tolist():
                    at = i + int(text[k])
                    bad[at].append({"start": int(first[k] + offsets[i] - offsets[at]), "score": 1 / (1 + math.exp(-z[k]))})
            p = 1 / (1 + np.exp(-np.clip(model.scale * np.clip(odds, -12, 12) + model.shift, -500, 500)))
            new = [pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(count), pa.array(bad, pa.list_(item))]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], *new], schema.names)

    return df.select(*read).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 3) == 1
