"""Token counts, packing and token files against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyscale.llm import elias_fano, packing, token_counts
from storyscale.llm.tokenizing import Encoder, encoder, vocabulary


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


ALPHABET = list("ab cdÉéñ'sİΣςßﬁª²½٣७…—́  \t\n\r\x0b\x1c\x85​😀中文<|>endoftxt 0129.,!?'\"") + ["'s", "<|endoftext|>", " <|startoftext|>", "'ll", "  ", "\n\n"]


@pytest.mark.parametrize(("kind", "name"), [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_encoder_equals_library(library, docs, kind, name):
    r = random.Random(5)
    texts = [x["text"] for x in docs.limit(100).collect()] + ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(4000)]
    got = Encoder(vocabulary(name), kind, "<u4").encode(texts)
    want = [np.array(e.ids, "<u4").tobytes() for e in library[name].encode_batch(texts, add_special_tokens=False)]
    assert got == want


def ids_of(tokenizer, df, end):
    return [(r["doc_id"], np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, end], "<u4")) for r in df.collect()]


def test_packing(docs, awkward, library):
    df = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    out = packing.pack(df).collect()
    by_seq, lengths = {}, {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for s, pieces in by_seq.items():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == np.cumsum([0, *[r["length"] for r in pieces]])[:-1].tolist()
        lengths[s] = sum(r["length"] for r in pieces)
    assert max(lengths.values()) <= 1024
    pad = sum(0 if n & (n - 1) == 0 else 1024 - n for n in lengths.values())
    assert pad <= 0.01 * sum(lengths.values())
    # each id of each row in one piece: compare the bags of whole documents, put together by their pieces in sequence order
    want = sorted((str(i), x.tobytes()) for i, x in ids_of(library["byte_bpe_50k.json"], df, 0))
    got, open_ = [], {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        k = str(r["doc_id"])
        have = open_.pop(k, b"")
        assert len(have) == 4 * r["start"] and len(r["ids"]) == 4 * r["length"]
        have += r["ids"]
        if len(have) == 4 * r["doc_tokens"]:
            got.append((k, have))
        else:
            open_[k] = have
    assert not open_ and sorted(got) == want


def test_packing_windows_are_optimal():
    r = random.Random(2)
    for _ in range(200):
        at = sorted({0, *(r.randrange(1, 60) for _ in range(12)), 60})
        at = [0] + [x for x in at if x > 0]
        if max(b - a for a, b in zip(at, at[1:])) > 20:
            continue
        pen = [0] + [r.choice([0, 2, 5]) for _ in at[1:]]
        best = [0.0] + [1e9] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + 20 - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= 20)
        cuts = [0, *packing.windows(at, pen, 20)]
        assert cuts[-1] == len(at) - 1
        assert sum(20 - (at[b] - at[a]) + pen[b] for a, b in zip(cuts, cuts[1:])) == best[-1]


def test_packing_blocks_lie_within_documents(monkeypatch):
    """A line of long and short documents in small blocks: nothing lost or planned beyond a block, at most a window more of padding for each."""
    r = random.Random(4)
    docs = {i: np.array([r.randrange(1, 1000) for _ in range(20_000 if i == 30 else r.choice([1, 7, 90, 300]))] + [0], np.uint32) for i in range(60)}
    seen, plan, padding = [], packing.windows, []
    monkeypatch.setattr(packing, "windows", lambda at, *a: seen.append(at[-1]) or plan(at, *a))
    for block in (1 << 18, 512):
        monkeypatch.setattr(packing, "BLOCK", block)
        seen.clear()
        line, pieces = packing._Line(64, np.arange(1000) % 9 == 0, 0), []
        for i, ids in docs.items():
            line.add(i, ids.tobytes())
            pieces += [p for made in line.cut(False) for p in made]
        pieces += [p for made in line.cut(True) for p in made]
        got, lengths = {}, Counter()
        for i, start, _, ids, whole, seq, offset in pieces:
            assert start == len(got.get(i, b"")) // 4 and offset == lengths[seq] and whole == len(docs[i])
            got[i] = got.get(i, b"") + ids
            lengths[seq] += len(ids) // 4
        assert got == {i: x.tobytes() for i, x in docs.items()} and max(lengths.values()) <= 64 and max(seen) <= block
        padding.append(sum(64 - n for n in lengths.values() if n & (n - 1)))
    assert padding[1] <= padding[0] + 64 * len(seen), padding


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing).count() == 0
    assert packing.powers(700, 1024) == [512, 128, 32, 16, 8, 4]


def test_elias_fano_code():
    r = random.Random(1)
    for _ in range(60):
        values = np.cumsum([r.choice([0, 1, 3, 500, 70_000]) for _ in range(r.randrange(1, 900))])
        ef = elias_fano.EliasFano.build(values)
        assert ef.selects(0, len(values)).tolist() == values.tolist()
        a, b = sorted((r.randrange(len(values) + 1), r.randrange(len(values) + 1)))
        assert ef.selects(a, b).tolist() == values[a:b].tolist()
        assert all(ef.select(i) == values[i] for i in r.sample(range(len(values)), min(50, len(values))))
        bits = 64 * (len(ef.low) + len(ef.high) + len(ef.samples))
        assert bits <= len(values) * (3 + max(1, int(values[-1]) // len(values)).bit_length()) + 256


def test_token_files(spark, docs, awkward, library, monkeypatch):
    monkeypatch.setattr(elias_fano, "DOCS_PER_FILE", 40)
    df = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text"))
    out = elias_fano.round_trip(df).withColumn("crc", F.crc32("ids")).collect()
    want = [((-1 if i is None else i), x.astype("<u2").tobytes(), x) for i, x in ids_of(library["word_bpe_49k.json"], df, 2)]
    want.sort(key=lambda w: w[:2])
    start, rows = 0, []
    for i, _, x in want:
        rows.append((i, start, len(x), zlib.crc32(x.tobytes())))
        start += len(x)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["crc"]) for r in out)
    assert got == sorted(rows)


def test_token_files_of_nothing(nothing):
    assert elias_fano.round_trip(nothing).count() == 0


def test_token_files_of_hot_ids(spark, library, monkeypatch):
    """Rows of one id and of none, alike or not, are spread over files and keep the order of ids."""
    monkeypatch.setattr(elias_fano, "DOCS_PER_FILE", 50)
    rows = [(7, "one text")] * 400 + [(7, f"text {i}") for i in range(300)] + [(None, None)] * 250 + [(i, f"word {i}") for i in range(-2, 300)] + [(2**63 - 1, "last"), (-(2**63), "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    path = elias_fano.work_dir(spark, "hot")
    made = elias_fano.write(df, path)
    assert sum(n for _, n, _ in made) == len(rows) and max(n for _, n, _ in made) < 200
    got = sorted(elias_fano.read(spark, path, made).withColumn("crc", F.crc32("ids")).collect(), key=lambda r: r["start"])
    order = [-(2**64) if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    encode = lambda t: zlib.crc32(np.array([*library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((str(r["doc_id"]), r["crc"]) for r in got) == sorted((str(i), encode(t)) for i, t in rows)
    with pytest.raises(TypeError):
        elias_fano.write(df.withColumn("doc_id", F.col("doc_id").cast("string")), path)


def test_edits_equal_encoding_anew():
    enc = encoder(vocabulary("byte_bpe_50k.json"), "byte", "<u4")
    r = random.Random(9)
    parts = list("ab c's  \n.,1é") + ["\xa0", "<|endoftext|>", "中"]
    for case in range(400):
        text = "".join(r.choice(parts[:14] if case % 4 else parts) for _ in range(r.randrange(600)))
        tree = token_counts.Tree(text, enc)
        for _ in range(5):
            a = r.randrange(len(text) + 2)
            b, new = a + r.choice([0, 1, 5, 100]), r.choice(["", " new", "é", "\n\n", "'s", " ", "\t", "\xa0" if case % 9 == 0 else "x", "|>"])
            tree.edit(a, b, new)
            a = min(a, len(text))
            text = text[:a] + new + text[max(min(b, len(text)), a) :]
            assert (tree.text(), tree.length, tree.total) == (text, len(text), len(enc.ids(text)))
            if r.random() < 0.3:
                tree = token_counts.Tree(text, enc, *tree.kept())


def test_sure_chunks_are_encoded_alone():
    enc = encoder(vocabulary("byte_bpe_50k.json"), "byte", "<u4")
    r = random.Random(11)
    for _ in range(6000):
        text = "".join(r.choice([*ALPHABET, "，", "。", ";", "か", "한"]) for _ in range(r.randrange(40)))
        chunks = enc.sure(text)
        assert "".join(chunks) == text and sum(enc.counts(chunks)) == len(enc.ids(text)), text


@pytest.mark.parametrize("text", ["some words of a long text. " * 5000, "odd\xa0space, words of a text " * 5000, "这是一个很长的中文文本，没有空格。" * 6000, "words <|endoftext|> and more " * 4000, "a,b;12,x" * 12_000])
def test_edits_encode_little(text):
    enc = encoder(vocabulary("byte_bpe_50k.json"), "byte", "<u4")
    tree = token_counts.Tree(text, enc)
    tree.edit(60_000, 60_005, "other")
    text = text[:60_000] + "other" + text[60_005:]
    assert tree.encoded < 200 and tree.total == sum(enc.counts(enc.sure(text)))


def test_leaves_stay_short():
    enc = encoder(vocabulary("byte_bpe_50k.json"), "byte", "<u4")
    tree = token_counts.Tree("a few words", enc)
    tree.edit(5, 5, " more words" * 5000)
    assert max(len(c) for c, _ in tree.leaves) <= 8 * token_counts.LEAF and tree.total == len(enc.ids(tree.text()))


def test_second_batch_starts_from_kept_trees(docs, awkward, monkeypatch):
    df = docs.select("doc_id", "text").limit(60).unionByName(awkward.select("doc_id", "text")).withColumn("edits", token_counts.scripted_edits())
    first = token_counts.count(df, trees=True)
    later = first.withColumn("edits", token_counts.scripted_edits(text_col="edited_text"))
    pick = ["doc_id", "n_tokens", "edited_tokens", "edited_text", "tree"]
    rows = lambda d: sorted(map(str, d.select(*pick[:4]).collect()))
    assert rows(token_counts.count(later, text_col="edited_text", tree_col="tree", trees=True)) == rows(token_counts.count(later, text_col="edited_text", trees=True))
    # a tree that is given is taken as it is: no text is encoded for it
    fake = later.withColumn("tree", F.struct(F.array(F.length("edited_text")).alias("chars"), F.array(F.lit(12_345)).alias("tokens"))).withColumn("edits", F.lit(None))
    assert {r["n_tokens"] for r in token_counts.count(fake, text_col="edited_text", tree_col="tree").collect()} == {12_345}


def test_counts_query(docs, awkward, nothing, library):
    df = docs.select("doc_id", "text").unionByName(awkward.select("doc_id", "text")).withColumn("edits", token_counts.scripted_edits())
    rows = {(r["doc_id"], r["text"]): r["edits"] for r in df.collect()}
    tok = library["byte_bpe_50k.json"]
    want = []
    for (i, text), edits in rows.items():
        text = text or ""
        n = (len(text), len(tok.encode(text, add_special_tokens=False).ids), len(edits))
        for e in edits:
            a = min(e["start"], len(text))
            text = text[:a] + e["replacement"] + text[max(a, min(e["end"], len(text))) :]
        want.append((str(i), *n, len(text), len(tok.encode(text, add_special_tokens=False).ids)))
    got = {(str(r["doc_id"]), r["n_chars"], r["n_tokens"], r["n_edits"], r["edited_chars"], r["edited_tokens"]) for r in token_counts.count(df).collect()}
    assert got == set(want)
    assert token_counts.count(nothing.withColumn("edits", F.lit(None))).count() == 0
