"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints: words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, runs of three words (repeats
included, fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is set if over half
the hashes have it. Texts without words have fingerprint zero and link like any other.

Linking within RADIUS differing bits works on distinct fingerprints, so copies cost nothing more:

1. Bits are grouped to parts by their correlation over all fingerprints. Correlated bits stand
   together, so their part tells little and the other parts tell much.
2. If the thresholds t_i of m parts sum to RADIUS - m + 1, two fingerprints within RADIUS differ by
   at most t_i bits in some part i (t_i = -1: the part is not probed). Dynamic programming
   allocates unequal thresholds at the least cost: keys probed plus candidates, estimated from the
   counted sizes of the parts' buckets.
3. Fingerprints meet in buckets (part, value); each also probes the values within t_i. Buckets
   verify their candidates and give a spanning forest of the links, never all pairs.
4. A bucket above BUCKET members is not worked on in one place. Its members are spread over all
   points half the radius away; two of them within the radius share such a point, all that share
   a point are within the radius, and a point has few members. This way is exact at any size.
5. Components come from alternating large-star and small-star steps, written to the shared folder.

A null text is empty, repeated rows get equal results, an empty table gives no rows; null ids take
part and get the component of their text. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyscale.llm import similar
from storyscale.llm.common import checkpointed, delete, rows_of, work_dir

BITS = 64
RADIUS = 2
BUCKET = 1024
#: Numbers of parts that are compared.
PARTS = (2, 3)
SEED = 42
SHINGLE = 3
_CHUNK = 1 << 15


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each run of SHINGLE words of a UTF-8 text."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    n = max(1, len(words) - SHINGLE + 1)
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits of many hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text_col: str = "text", carry: list[str] | None = None, with_sets: bool = False) -> DataFrame:
    """Columns ``carry`` of ``df`` (default: all) with fp, the fingerprint as a signed long, and if asked for __set and __n, name and size of the set of ``similar``."""
    carried = [c for c in (df.columns if carry is None else carry) if c != "fp"]
    read = carried if text_col in carried else [*carried, text_col]
    text_at, more = read.index(text_col), ["__set", "__n"] if with_sets else []
    names = [*carried, "fp", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = rows_of(b, text_at).cast(pa.binary())
            fps = np.fromiter((fingerprint(shingle_hashes(t.as_py())) for t in texts), np.uint64, b.num_rows)
            sets = similar.names(rows_of(b, text_at)) if with_sets else []
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], pa.array(fps.view(np.int64)), *sets], names)

    schema = T.StructType([*[df.schema[c] for c in carried], *[T.StructField(c, T.LongType()) for c in ["fp", *more]]])
    return df.select(*read).mapInArrow(similar.released(run) if with_sets else run, schema)


# -- parts and thresholds ------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def co_occurrence(fps: DataFrame) -> np.ndarray:
    """How often each two bits are both set; the diagonal has the counts of the bits, [64, 64] of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            for i in range(0, len(x), _CHUNK):
                bits = np.ones((len(x[i : i + _CHUNK]), BITS + 1), np.float32)
                bits[:, :BITS] = np.unpackbits(x[i : i + _CHUNK], axis=1, bitorder="little")
                total += bits.T @ bits
        at = np.arange(BITS + 1)
        i, j = np.meshgrid(at, at, indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 65 * 65 rows
    out = np.zeros((BITS + 1, BITS + 1))
    for r in rows:
        out[r["i"], r["j"]] = r["n"]
    return out


def group_bits(both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of near equal size, each grown by the bit of the strongest correlation with it."""
    n = max(both[BITS, BITS], 1.0)
    p = both.diagonal()[:BITS] / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both[:BITS, :BITS] / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = set(range(BITS)), []
    for k in range(m):
        size = -(-len(free) // (m - k))
        part = [max(free, key=lambda b: (corr[b, sorted(free)].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            b = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(b)
            free.remove(b)
        parts.append(sorted(part))
    return parts


def _mask(part: list[int]) -> int:
    return sum(1 << b for b in part)


def flips(part: list[int], most: int) -> list[int]:
    """Masks of up to ``most`` bits of a part."""
    return [sum(1 << b for b in c) for k in range(most + 1) for c in combinations(part, k)]


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of the least summed cost whose sum is ``total``: dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for done, (c, ts) in best.items():
            for t, more in cost.items():
                if done + t not in nxt or c + more < nxt[done + t][0]:
                    nxt[done + t] = (c + more, [*ts, t])
        best = nxt
    return best[total]


def plan(fps: DataFrame, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """The parts with their thresholds; parts that are not probed are left out."""
    both = co_occurrence(fps)
    n = both[BITS, BITS]
    p = both.diagonal()[:BITS] / max(n, 1.0)
    choices = [(m, i, part) for m in PARTS for i, part in enumerate(group_bits(both, m))]
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(part)))).alias("v")) for k, (_, _, part) in enumerate(choices)])
    sizes = fps.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    # a bucket above BUCKET costs what its spread members cost
    pairs = F.when(F.col("n") <= BUCKET, F.col("n") * (F.col("n") - 1.0) / 2).otherwise(F.col("n") * float(_ball(radius // 2)))
    counted = {r["k"]: r["pairs"] for r in sizes.groupBy(F.col("key.k").alias("k")).agg(F.sum(pairs).alias("pairs")).collect()}
    best = None
    for m in PARTS:
        costs = []
        for k, (mm, _, part) in enumerate(choices):
            if mm != m:
                continue
            near = np.zeros(radius + 1)  # chances, by bit statistics, to differ by d bits relative to none
            near[0] = 1
            for b in part:
                q = min(2 * p[b] * (1 - p[b]), 0.5)
                odds = q / (1 - q)
                near[1:] = near[1:] + near[:-1] * odds
            cost = {-1: 0.0}
            for t in range(radius + 1):
                probes = sum(comb(len(part), d) for d in range(t + 1))
                cost[t] = n * probes + counted.get(k, 0.0) * near[: t + 1].sum()
            costs.append(cost)
        c, ts = allocate(costs, radius - m + 1)
        if best is None or c < best[0]:
            best = (c, [(part, t) for (mm, _, part), t in zip([x for x in choices if x[0] == m], ts, strict=True) if t >= 0])
    return best[1]


def _ball(r: int) -> int:
    return sum(comb(BITS, d) for d in range(r + 1))


# -- links and components ------------------------------------------------------------------------


def forest(own: np.ndarray, probes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a bucket as (fingerprint, smallest of its component); probes are held against own."""
    fps = np.unique(np.concatenate([own, probes]))
    if len(fps) < 2:
        return []
    own = np.unique(own)
    at, root = np.searchsorted(fps, own), np.arange(len(fps))
    near = np.bitwise_count((fps[:, None] ^ own[None, :]).view(np.uint64)) <= radius
    rows, cols = np.nonzero(near)
    cols = at[cols]
    while True:  # smallest neighbour, then jumps to the root of the root
        was = root.copy()
        np.minimum.at(root, rows, was[cols])
        np.minimum.at(root, cols, was[rows])
        root = root[root]
        if (root == was).all():
            break
    out = np.flatnonzero(root != np.arange(len(fps)))
    return [(int(fps[i]), int(fps[root[i]])) for i in out]


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links within the radius between distinct fingerprints that span each component."""
    if radius % 2:
        raise ValueError("the radius must be even: large buckets meet half way")
    keys = []
    for i, (part, t) in enumerate(plan(fps, radius)):
        value = F.col("fp").bitwiseAND(F.lit(_signed(_mask(part))))
        for flip in flips(part, t):
            keys.append(F.struct(F.lit(i).alias("part"), value.bitwiseXOR(F.lit(_signed(flip))).alias("value"), F.lit(flip == 0).alias("own")))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.part", "k.value", "k.own")
    sizes = keyed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own").drop("any_own")
    met = checkpointed(keyed.join(sizes, ["part", "value"]), work_dir(fps.sparkSession, "simhash-met"))
    small = met.where(F.col("n") <= bucket).groupBy("part", "value").agg(
        F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("own"), F.collect_list(F.when(~F.col("own"), F.col("fp"))).alias("probes")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for own, probes in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found += forest(np.array(own, np.int64), np.array(probes, np.int64), radius)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["u", "v"])

    out = small.select("own", "probes").mapInArrow(verify, "u long, v long")
    points = F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(f))) for f in flips(list(range(BITS)), radius // 2)])
    spread = met.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(points).alias("point"))
    centres = spread.groupBy("point").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    half_way = spread.join(centres, "point").where("fp != v").select(F.col("fp").alias("u"), "v")
    return out.unionByName(half_way).distinct()


def _least(edges: DataFrame, condition: Column | None = None) -> DataFrame:
    """Each edge in both directions with the smallest of u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if condition is not None:
        both = both.where(condition)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(u, v): each node that is not the smallest of its component, and that smallest node."""
    spark, k = edges.sparkSession, 0
    root = work_dir(spark, "components")
    edges = checkpointed(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{root}/{k}")
    if edges.isEmpty():
        return edges
    while True:
        k += 1
        large = _least(edges).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = _least(large, F.col("v") < F.col("u"))
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        nxt = checkpointed(stars, f"{root}/{k}")
        # done when every node points to one node that points nowhere
        nodes = nxt.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        if nodes.where("n > 1").isEmpty() and nxt.join(nodes, F.col("v") == F.col("node"), "left_semi").isEmpty():
            return nxt
        edges = nxt


def _roots(docs: DataFrame, radius: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, first, root) of each distinct fingerprint: its smallest id and the smallest fingerprint that links, with ``more``, reach."""
    fps = checkpointed(docs.groupBy("fp").agg(F.min("id").alias("first")), work_dir(docs.sparkSession, "simhash-fps"))
    edges = links(fps.select("fp"), radius)
    member = components(edges if more is None else edges.unionByName(more))
    return fps.join(member.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id): for each row its fingerprint and the smallest id that links reach."""
    docs = checkpointed(fingerprints(df, text_col, [id_col]).withColumnRenamed(id_col, "id"), work_dir(df.sparkSession, "simhash-docs"))
    placed = _roots(docs, radius)
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(ids, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, similar_texts: bool = False) -> DataFrame:
    """``df`` with one row of each group: the one of the smallest id; of rows repeated with their id any one.

    With ``similar_texts``, links between texts of similar shingle sets (see ``similar``) join groups too.
    All columns come back with their values, whatever their names.
    """
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    kept = _one_of_each(df.toDF(*names.values()), names[id_col], names[text_col], radius, similar_texts)
    return kept.toDF(*df.columns)


def _one_of_each(df: DataFrame, id_col: str, text_col: str, radius: int, similar_texts: bool) -> DataFrame:
    spark = df.sparkSession
    docs = checkpointed(fingerprints(df, text_col, with_sets=similar_texts), work_dir(spark, "simhash-rows"))
    more = None
    if similar_texts:
        scratch = work_dir(spark, "similar")
        found = similar.links(docs.select(F.col(text_col).alias("text"), "fp", "__set", "__n"), scratch)
        more = checkpointed(found, work_dir(spark, "similar-links"))
        delete(spark, scratch)
    placed = _roots(docs.select(F.col(id_col).alias("id"), "fp"), radius, more)
    chosen = placed.groupBy("root").agg(F.min(F.struct(F.col("first").isNull(), "first", "fp")).alias("c")).select(F.col("c.first").alias("__id"), F.col("c.fp").alias("__fp"))
    same = docs[id_col].eqNullSafe(F.col("__id")) & (docs["fp"] == F.col("__fp"))
    kept = docs.join(chosen, same, "left_semi")
    repeated = docs.groupBy(id_col, "fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col(id_col).alias("__id"), F.col("fp").alias("__fp"))
    repeated = checkpointed(repeated, work_dir(spark, "simhash-repeated"))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("fp") == F.col("__fp"))
    out = kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates([id_col, "fp"])) if not repeated.isEmpty() else kept
    return out.select(df.columns)


def hexed(fp: Column) -> Column:
    """16 lowercase hexadecimal digits of a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
