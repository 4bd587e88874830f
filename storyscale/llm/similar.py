"""Links between texts whose sets of five-word shingles are similar, exactly, by prefixes.

Words as in ``words``; a text of fewer words is one shingle, a text without words links to none.
Two sets link if their Jaccard similarity is at least SIMILAR. Any distance of fingerprints would
lose some of these pairs, so no fingerprint takes part:

1. All sets are ordered alike: shingles by hash, and behind them those that many sets hold, by
   how many. Of a set with n shingles the first n - ceil(SIMILAR n) + 1 are its prefix; the prefixes
   of two similar sets share a shingle. Exact for any order; this one keeps common shingles out of
   prefixes, so that few unlike sets meet.
2. Sets meet in buckets of prefix shingles. Up to GROUP sets at a shingle give pairs. More of them
   stay together as one group, whose sets are held one after the other against those that aren't
   linked yet: near copies of one text need one pass, never all pairs.
3. Only sets that met another are written to the shared folder; workers map them into memory and
   verify pairs and groups by the sets themselves.

Copies count once: a set is known by a 64-bit hash of its shingles, so repeated rows and ties add
nothing. A null text is empty and, like any text without words, links to none; an empty table gives
no links; very long texts are taken whole, their sets sliced. Columns other than those named are not
read.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.llm.common import checkpointed, map_array, rows_of, slices, text_bytes, write_file
from storyscale.llm.words import mix, shingle_hashes, words

SHINGLE = 5
SIMILAR = (4, 5)  #: the least similarity as a fraction
GROUP = 32
_FREQUENT = 64  #: sets that hold a shingle, from which it counts as common
_COMMON = 1 << 20  #: common shingles at most
_LOCAL = 4  #: sets of one block
_SLICE = 1 << 18  #: small, as workers that wait keep their memory
_GATHER = 1 << 19
_KEY = 5  #: bytes of a key that are shuffled
_U = np.uint64


def sets_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingles of each text in order of their hashes."""
    buf, offsets = text_bytes(texts)
    for i, j in slices(offsets, _SLICE):
        w = words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        s = shingle_hashes(w.hash, SHINGLE)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            h = np.sort(s[a : b - SHINGLE + 1]) if b - a >= SHINGLE else shingle_hashes(w.hash[a:b], b - a) if b > a else s[:0]
            yield h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def name_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    if not len(shingles):
        return 0
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=_U) + _U(len(shingles))], _U)).view(np.int64)[0])


def names(texts: pa.Array) -> list[pa.Array]:
    """Name and size of the set of each text."""
    made = [(name_of(s), len(s)) for s in sets_of(texts)]
    return [pa.array([x for x, _ in made], pa.int64()), pa.array([n for _, n in made], pa.int64())]


def _common(rows: DataFrame, path: str) -> str:
    """A file of the shingles that many sets hold, in order, and of how many hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0

        def out() -> pa.RecordBatch:
            k, c = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k[c >= _LOCAL].view(np.int64)), pa.array(c[c >= _LOCAL])], ["k", "n"])

        for b in batches:
            for s in sets_of(rows_of(b, 0)):
                waiting.append(s)
                n += len(s)
                if n >= _GATHER:
                    yield out()
                    waiting, n = [], 0
        if n:
            yield out()

    counted = rows.select("text").mapInArrow(released(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    t = counted.where(F.col("n") >= _FREQUENT).orderBy(F.desc("n"), "k").limit(_COMMON).toArrow()  # bounded
    k, c = t.column("k").to_numpy().view(_U), t.column("n").to_numpy().astype("<u8")
    order = np.argsort(k)
    write_file(f"{path}/common", [np.stack([k[order], c[order]])])
    return f"{path}/common"


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles of a set of which every similar set's prefix holds one."""
    n = len(shingles)
    most = n - -(-SIMILAR[0] * n // SIMILAR[1]) + 1
    if len(common) and n:
        i = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        last = common[i] == shingles
        if last.any():
            shingles = np.concatenate([shingles[~last], shingles[last][np.argsort(counts[i[last]], kind="stable")]])
    return shingles[:most] if n else shingles


def size_code(n: np.ndarray) -> np.ndarray:
    """Sizes as rounded logarithms to base 1.05; of similar sets they differ by log 1.25 / log 1.05 < 5, rounded by 5 at most."""
    return np.minimum(np.log(n) / np.log(1.05), 255).astype(np.uint8)


def _met(rows: DataFrame, common: str, n_buckets: int) -> DataFrame:
    """(a, b, sets): pairs of sets that share a prefix shingle, and larger groups of them (bytes of names in order)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = map_array(common, "<u8").reshape(2, -1)
        ks, names, sizes, n = [], [], [], 0

        def out() -> pa.RecordBatch:
            m = mix(np.concatenate(ks))
            at = (m % _U(n_buckets)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            at, m = at[order], m[order]
            w = np.repeat(np.array(names, np.int64), [len(k) for k in ks])[order]
            z = np.repeat(size_code(np.array(sizes)), [len(k) for k in ks])[order]
            m = np.ascontiguousarray((m >> _U(24)).view(np.uint8).reshape(-1, 8)[:, :_KEY])  # equal parts of unlike keys only cost a verification
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            ends = np.append(first[1:], len(at))
            cut = lambda a: pa.array([a[i:j].tobytes() for i, j in zip(first, ends)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(at[first]), cut(m), cut(w), cut(z)], ["bucket", "keys", "names", "sizes"])

        for b in batches:
            for s in sets_of(rows_of(b, 0)):
                if len(s):
                    ks.append(prefix(s, *have))
                    names.append(name_of(s))
                    sizes.append(len(s))
                    n += len(ks[-1])
                    if n >= _GATHER // 2:
                        yield out()
                        ks, names, sizes, n = [], [], [], 0
        if n:
            yield out()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for bucket, k, w, z in zip(*(x.to_pylist() for x in batch.columns)):
                parts.setdefault(bucket, []).append((np.pad(np.frombuffer(k, "u1").reshape(-1, _KEY), ((0, 0), (0, 8 - _KEY))).view("<u8")[:, 0], np.frombuffer(w, "<i8"), np.frombuffer(z, "u1")))
        for bucket in sorted(parts):
            k, w, z = (np.concatenate(x) for x in zip(*parts.pop(bucket)))
            order = np.lexsort((w, k))
            k, w, z = k[order], w[order], z[order].astype(np.int64)
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])))
            k, w, z = k[new], w[new], z[new]
            first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            size = np.diff(np.append(first, len(k)))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in range(2, GROUP + 1):
                i, j = np.triu_indices(g, 1)
                at = first[size == g][:, None]
                a, b = (at + i).ravel(), (at + j).ravel()
                near = np.abs(z[a] - z[b]) <= 5  # of similar sets; verified by their sizes later
                left.append(w[a[near]])
                right.append(w[b[near]])
            pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], axis=1), axis=0)
            groups = list({w[i : i + g].tobytes() for i, g in zip(first[size > GROUP], size[size > GROUP])})
            none = np.zeros(len(groups), bool)
            a = pa.concat_arrays([pa.array(pairs[:, 0]), pa.array(none.astype(np.int64), mask=~none)])
            b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.array(none.astype(np.int64), mask=~none)])
            yield pa.RecordBatch.from_arrays([a, b, pa.array([None] * len(pairs) + sorted(groups), pa.binary())], ["a", "b", "sets"])

    dealt = rows.select("text").mapInArrow(released(keys), "bucket int, keys binary, names binary, sizes binary").repartitionById(n_buckets, F.col("bucket"))
    return dealt.mapInArrow(released(meet), "a long, b long, sets binary").distinct()


def _stored(rows: DataFrame, wanted: DataFrame, path: str, n_buckets: int) -> DataFrame:
    """(name, fp, file, start, n): where the wanted sets lie in the shared folder."""

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for b in batches:
            for bucket, name in zip(*(x.to_pylist() for x in b.columns)):
                parts.setdefault(bucket, []).append(name)
        for bucket, names in parts.items():
            write_file(f"{path}/wanted/{bucket:06d}", [np.unique(np.array(names, "<i8"))])
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32())], ["bucket"])

    dealt = wanted.select(F.pmod("name", F.lit(n_buckets)).cast("int").alias("bucket"), "name").repartitionById(n_buckets, F.col("bucket"))
    filled = {r["bucket"] for r in dealt.mapInArrow(note, "bucket int").collect()}  # a number for each bucket

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for b in batches:
            names = b.column(1).to_numpy()
            at, want = names % n_buckets, np.zeros(len(names), bool)
            for bucket in np.unique(at).tolist():
                if bucket in filled:
                    mine = at == bucket
                    want[mine] = np.isin(names[mine], map_array(f"{path}/wanted/{bucket:06d}", "<i8"))
            if not want.any():
                continue
            chosen = b.filter(pa.array(want))
            sets = list(sets_of(rows_of(chosen, 0)))
            file, k = f"{task:06d}-{k:06d}", k + 1
            write_file(f"{path}/sets/{file}", sets)
            n = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([chosen.column(1), chosen.column(2), pa.array([file] * len(n)), pa.array(np.cumsum(n) - n), pa.array(n)], ["name", "fp", "file", "start", "n"])

    placed = rows.select("text", "__set", "fp").where("__n > 0").mapInArrow(released(store), "name long, fp long, file string, start long, n long")
    one = F.min(F.struct("fp", "file", "start", "n")).alias("s")
    return checkpointed(placed.groupBy("name").agg(one).select("name", "s.*"), f"{path}/index")


def released(made: Callable) -> Callable:
    """``made`` over batches, which at its end lets go of mapped files and free memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from made(batches)
        map_array.cache_clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
        if trim:
            trim(0)

    return run


def _set(path: str, s: dict) -> np.ndarray:
    return map_array(f"{path}/sets/{s['file']}", "<u8")[s["start"] : s["start"] + s["n"]]


def _near(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the sets are similar to the one."""
    n = np.array([len(o) for o in others])
    every = np.concatenate(others)
    i = np.minimum(np.searchsorted(one, every), len(one) - 1)
    both = np.add.reduceat((one[i] == every).astype(np.int64), np.cumsum(n) - n)
    return SIMILAR[1] * both >= SIMILAR[0] * (n + len(one) - both)


def group_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Similar sets of a group as (later, earlier) that span its components."""
    n, root, out = np.array([len(s) for s in sets]), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        at = i + 1 + np.flatnonzero((root[i + 1 :] != root[i]) & (SIMILAR[1] * np.minimum(n[i + 1 :], n[i]) >= SIMILAR[0] * np.maximum(n[i + 1 :], n[i])))
        for k in np.split(at, np.flatnonzero(np.diff(np.cumsum(n[at]) // _GATHER)) + 1):
            if len(k):
                for j in k[_near(sets[i], [sets[x] for x in k])].tolist():
                    out.append((j, i))
                    root[root == root[j]] = root[i]
    return out


def links(rows: DataFrame, path: str) -> DataFrame:
    """(u, v): fingerprints of similar texts, spanning each component; ``rows`` has text, fp, __set and __n.

    The result reads files of the shared folder ``path``; store it before they are deleted.
    """
    spark = rows.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = checkpointed(_met(rows, _common(rows, path), n_buckets), f"{path}/met")
    pairs, groups = met.where("sets is null").select("a", "b"), met.where("sets is not null").select("sets")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                names = np.frombuffer(x, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), name_of(names.view(_U)))), pa.array(names)], ["g", "name"])

    named_groups = groups.mapInArrow(released(members), "g long, name long")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).unionByName(named_groups.select("name")).distinct()
    index = _stored(rows, wanted, path, n_buckets)
    where = F.struct("name", "fp", "file", "start", "n")
    one, two = index.select(F.col("name").alias("a"), where.alias("x")), index.select(F.col("name").alias("b"), where.alias("y"))

    def verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(x["fp"], y["fp"]) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if _near(_set(path, x), [_set(path, y)])[0]]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

    def verify_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in b.column(0).to_pylist():
                found = [(group[i]["fp"], group[j]["fp"]) for i, j in group_links([_set(path, s) for s in group])]
                yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

    out = pairs.join(one, "a").join(two, "b").select("x", "y").mapInArrow(released(verify_pairs), "u long, v long")
    grouped = named_groups.join(index, "name").groupBy("g").agg(F.collect_list(where).alias("s")).select("s")
    out = out.unionByName(grouped.mapInArrow(released(verify_groups), "u long, v long"))
    # texts of one set may differ in their fingerprints
    least = rows.where("__n > 0").groupBy("__set").agg(F.min("fp").alias("v"), F.max("fp").alias("most")).where("v != most").select("__set", "v")
    same = rows.select("__set", F.col("fp").alias("u")).join(least, "__set").select("u", "v")
    return out.unionByName(same).where("u != v").distinct()
