"""Exact search of the k best inner products, by distributed histogram selection.

Every query's kth best score is located in a few passes. A pass scores all candidates against all
queries, counts the scores of each query in BINS equal bins of its range, adds the counts up over the
tasks, and narrows the range to the bin that holds the kth score; bins are powers of two wide, so
the passes needed follow from the range of scores (two for unit vectors). When a bin is a single
score, a last pass filters: what scores better is in, and of the rows that tie at the kth score those
of the smallest ids.

A batch passes on only its bins down to its own kth score: the kth of all is no worse, so the sums of
the bins above it stay whole. Of ties it passes on as many as are missing. So no task holds more than
a batch of candidates and a block of queries, whatever scores tie or vector repeats, and a query's
rows number at most k for each batch. Queries and their ranges lie in the shared folder, in files of
BLOCK queries, which tasks read one after another; nothing of the data passes through the driver but
two norms.

Scores are whole numbers: each component counts as floor(1024 * x). They are exact (float products
while all sums stay below 2 ** 53, Python's integers beyond) and held to the range of a long. Vectors
that are null or hold null or non-finite components take no part, nor do rows without id; an empty
vector scores 0; of vectors of different lengths the missing components count as 0. A query's
candidates are the rows of other ids; rows that repeat a query's id are queries of their own, ranked
apart; an empty table gives no rows. Very long vectors are taken whole. Other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyscale.llm.common import _place, checkpointed, work_dir

K = 10
SCALE = 1024
BITS = 11
BINS = 1 << BITS
#: Queries of a file, and of those scored together.
BLOCK, TOGETHER = 1024, 128
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def takes_part(vec: Column) -> Column:
    """Whether a vector has finite components alone."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))), F.lit(False))


def _norm(vec: Column) -> Column:
    whole = lambda x: F.pow(F.least(F.abs(F.lit(float(SCALE)) * x) + F.lit(1.0), F.lit(1e140)), F.lit(2.0))
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + whole(x)))


class Block(NamedTuple):
    q: np.ndarray  #: number of each query
    query_id: np.ndarray
    vec: np.ndarray
    low: np.ndarray  #: where its range begins
    need: np.ndarray  #: how many scores are missing, in its range and from its top


def matrix(lists: pa.Array) -> np.ndarray:
    """The vectors of a list column as whole numbers in floats; shorter ones are filled up with zeros."""
    n = len(lists)
    size = lists.value_lengths().to_numpy(zero_copy_only=False) if n else np.zeros(0, np.int64)
    flat = np.floor(np.clip(lists.flatten().to_numpy(zero_copy_only=False), -1e290, 1e290) * SCALE)
    wide = int(size.max(initial=0))
    if len(flat) == n * wide:
        return flat.reshape(n, wide)
    out = np.zeros((n, wide))
    out[np.arange(wide) < size[:, None]] = flat
    return out


def scores(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """Inner products of all rows of a with all rows of b, as longs; ``small``: no sum reaches 2 ** 53."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if small:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    out = np.dot(whole(a), whole(b).T) if d and len(a) and len(b) else np.zeros((len(a), len(b)), object)
    return np.clip(out, _LEAST, _MOST).astype(np.int64)


@lru_cache(maxsize=4)
def _read(uri: str) -> Block:
    fs, path = _place(uri)
    t = pq.read_table(path, filesystem=fs)
    column = lambda c: t[c].to_numpy()
    return Block(column("q"), column("query_id"), matrix(t["vec"].combine_chunks()), column("low"), column("need"))


def _blocks(folder: str) -> Iterator[Block]:
    """The blocks of the queries stored in a folder."""
    fs, path = _place(folder)
    for f in sorted(f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith("part-")):
        b = _read(f if isinstance(fs, pafs.LocalFileSystem) else folder.rstrip("/") + "/" + f.rsplit("/", 1)[-1])
        for i in range(0, len(b.q), TOGETHER):
            yield Block(*(x[i : i + TOGETHER] for x in b))


def _each_block(folder: str, small: bool, names: list[str], work: Callable[[Block, np.ndarray, np.ndarray, np.ndarray], tuple]):
    """A pass over batches of (id, vector): what ``work`` makes of each block, the ids, the scores and which of them count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vec = b.column(0).to_numpy(), matrix(b.column(1))
            for block in _blocks(folder):
                cols = work(block, ids, scores(block.vec, vec, small), block.query_id[:, None] != ids)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return run


def _counted(shift: int, size: int):
    """Scores in each of ``size`` bins of each query's range, down to the bin that holds the batch's own last missing score."""

    def work(block: Block, ids: np.ndarray, s: np.ndarray, counts: np.ndarray) -> tuple:
        bins = (s.view(np.uint64) - block.low.view(np.uint64)[:, None]) >> np.uint64(shift)
        row, col = np.nonzero(counts & (s >= block.low[:, None]) & (bins < size))
        n = np.bincount(row * size + bins[row, col].astype(np.int64), minlength=len(s) * size).reshape(len(s), size)
        better = np.cumsum(n[:, ::-1], axis=1)[:, ::-1] - n
        q, at = np.nonzero((n > 0) & (better < block.need[:, None]))
        return block.q[q], block.need[q], at, n[q, at]

    return work


def _chosen(block: Block, ids: np.ndarray, s: np.ndarray, counts: np.ndarray) -> tuple:
    """What scores above ``low``, and of the ties at it the smallest ids, as many as are missing."""
    q, at = np.nonzero(counts & (s > block.low[:, None]))
    rows, cols = [q], [at]
    tie = counts & (s == block.low[:, None])
    for i in np.flatnonzero(tie.any(axis=1) & (block.need > 0)).tolist():
        c = np.flatnonzero(tie[i])
        c = c[np.argsort(ids[c], kind="stable")[: block.need[i]]]
        rows.append(np.full(len(c), i))
        cols.append(c)
    q, at = np.concatenate(rows), np.concatenate(cols)
    return block.q[q], block.query_id[q], ids[at], s[q, at]


def _put(state: DataFrame, blocks: int, path: str) -> DataFrame:
    state.repartition(blocks, "q").write.option("maxRecordsPerFile", BLOCK).parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def search(df: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score of the k best rows of ``df`` for each row that ``queries`` marks."""
    spark = df.sparkSession
    rows = df.where(F.col(id_col).isNotNull() & takes_part(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    asked = rows.where("asks").select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "vec")
    asked = checkpointed(asked, work_dir(spark, "topk-queries"))
    peak = lambda d: d.agg(F.coalesce(F.max(_norm(F.col("vec"))), F.lit(0.0)).alias("m"), F.count(F.lit(1)).alias("n")).first()
    of_queries = peak(asked)
    bound = math.ceil(of_queries["m"] * peak(rows)["m"] * (1 + 1e-9)) + 1  # no score is beyond
    small, reach = bound < 1 << 53, min(bound, _MOST)
    shift = max((2 * reach + 1).bit_length() - BITS, 0)
    blocks = max(1, -(-of_queries["n"] // BLOCK))
    candidates = rows.select("id", "vec")
    root, turn, size = work_dir(spark, "topk"), 0, BINS
    state = _put(asked.withColumns({"low": F.lit(-reach).cast("long"), "need": F.lit(k).cast("long")}), blocks, f"{root}/{turn}")
    while True:
        run = _each_block(f"{root}/{turn}", small, ["q", "need", "bin", "n"], _counted(shift, size))
        n = candidates.mapInArrow(run, "q long, need long, bin long, n long").groupBy("q", "need", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q").orderBy(F.desc("bin"))  # BINS rows of a query at most
        n = n.withColumn("reached", F.sum("n").over(down))
        holds = F.col("reached") >= F.col("need")  # a query with fewer candidates goes down to the end of its range
        found = n.groupBy("q").agg(F.coalesce(F.max(F.when(holds, F.col("bin"))), F.lit(0)).alias("bin"), F.coalesce(F.max(F.when(~holds, F.col("reached"))), F.lit(0)).alias("better"), F.max(F.when(~holds & (F.col("bin") == 0), F.col("n"))).alias("lowest"))
        wide = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,0)")  # noqa: E731  the range of a long is wider than a long
        low = (wide("low") + wide("bin") * F.lit(1 << shift).cast("decimal(20,0)")).cast("long")
        taken = F.coalesce(F.col("better") - F.coalesce("lowest", F.lit(0)), F.lit(0))
        state = state.join(found, "q", "left").select("q", "query_id", "vec", low.alias("low"), (F.col("need") - taken).alias("need"))
        turn += 1
        state = _put(state, blocks, f"{root}/{turn}")
        if shift == 0:
            break
        size = 1 << min(shift, BITS)  # what the found bin holds, and no more
        shift = max(shift - BITS, 0)
    run = _each_block(f"{root}/{turn}", small, ["q", "query_id", "id", "score"], _chosen)
    best = candidates.mapInArrow(run, "q long, query_id long, id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")  # at most k rows of each batch
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


#: The registered query in DuckDB.
SEARCH_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS f FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.f, c.f) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
