"""A log of judge responses, written by a Python data source with a commit protocol.

The log is a folder. ``plans/<plan>`` holds what one run asks about, told once, before the first
request: keys, their turn, and its chunk of a few turns. The texts stay out of it: they are dealt to
the tasks once, each behind its turn, and read in a stream. Each chunk's responses are one Parquet file of ``replies``, named by plan and chunk and moved there in one step as soon as
the chunk is through. A task that runs again finds the files of its chunks and asks about the others
alone; a run that breaks off leaves what it has, and the next one's plan holds only keys without a
response. So a key is asked about again only if its chunk was not through: once more for each time
that a run dies. The driver commits a plan by a list of its files in ``commits``, from the messages of
its tasks; aborting deletes nothing, since responses cost.

Requests run in as many tasks as asked for, one at a time in each; a task has a stretch of the turns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from storyscale.operators import ordered
from storyscale.sources.package import ship
from storyscale.sources.shared import hadoop, stored

#: Rows whose responses are one file.
CHUNK = 64
#: Tasks that ask at once.
TASKS = 4

#: Bytes of texts that a task hands to Python at once.
BATCH = 8 << 20

Ask = Callable[[list[dict]], str]
#: Messages of a turn, from the plan's row and the rows behind it.
Read = Callable[[Row, Iterator[Row]], list[dict]]


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _uri(spark: SparkSession, path: str) -> str:
    """The whole address of a path on the session's file system."""
    fs, at = hadoop(spark, path)
    uri = fs.makeQualified(at).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


@dataclass
class Done(WriterCommitMessage):
    files: list[str]
    asked: int


class ReplyWriter(DataSourceWriter):
    """Asks about the turns of one task, chunk by chunk. Without ``read`` each row is a turn and has its messages."""

    def __init__(self, log: str, plan: str, keys: tuple[str, ...], ask: Ask, read: Read | None = None) -> None:
        self.log, self.plan, self.keys, self.ask, self.read = log, plan, keys, ask, read

    def _turns(self, rows: Iterator[Row]) -> Iterator[tuple[Row, Iterator[Row]]]:
        """The plan's row of each turn and the rows behind it; rows that no turn of the plan has are passed over."""
        if self.read is None:
            yield from ((r, iter([r])) for r in rows)
            return
        for _, turn in groupby(rows, itemgetter("turn")):
            head = next(turn)
            if head["number"] is not None:
                yield head, turn

    def _there(self, name: str) -> bool:
        fs, path = _place(f"{self.log}/replies/{name}")
        return fs.get_file_info(path).type == pafs.FileType.File

    def _put(self, name: str, rows: list[tuple]) -> None:
        fs, folder = _place(f"{self.log}/replies")
        table = pa.table([pa.array(c, pa.string()) for c in zip(*rows)], names=[*self.keys, "response"])
        tmp = f"{folder}/_{name}.{uuid.uuid4().hex}"
        pq.write_table(table, tmp, filesystem=fs)
        fs.move(tmp, f"{folder}/{name}")

    def write(self, rows: Iterator[Row]) -> Done:
        done, asked, chunk, there, out = [], 0, None, False, []

        def finish() -> None:
            if out:
                self._put(done[-1], out)
                out.clear()

        read = self.read or whole
        for head, turn in self._turns(rows):
            if head["chunk"] != chunk:
                finish()
                chunk = head["chunk"]
                done.append(f"{self.plan}-{chunk:010d}.parquet")
                there = self._there(done[-1])
            if not there:
                out.append((*(head[k] for k in self.keys), self.ask(read(head, turn))))
                asked += 1
        finish()
        return Done(done, asked)

    def commit(self, messages: list[Done | None]) -> None:
        fs, folder = _place(f"{self.log}/commits")
        told = {"files": sorted(f for m in messages if m for f in m.files), "asked": sum(m.asked for m in messages if m)}
        with fs.open_output_stream(f"{folder}/{self.plan}.json") as f:
            f.write(json.dumps(told).encode())

    def abort(self, messages: list[Done | None]) -> None:
        """What is answered stays, for the next run."""


def _source(writer: ReplyWriter) -> type[DataSource]:
    class JudgeLog(DataSource):
        @classmethod
        def name(cls) -> str:
            return "judge_log"

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
            return writer

    return JudgeLog


def _ready(spark: SparkSession, log: str) -> str:
    log = _uri(spark, log)
    for part in ("replies", "plans", "commits"):
        fs, at = hadoop(spark, f"{log}/{part}")
        fs.mkdirs(at)
    return log


def replies(spark: SparkSession, log: str, keys: tuple[str, ...]) -> DataFrame:
    """keys and response of all that the log holds; of several responses for a key one."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in (*keys, "response")])
    return spark.read.schema(schema).parquet(f"{_ready(spark, log)}/replies").groupBy(*keys).agg(F.min("response").alias("response"))


def same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    """Whether rows have one key; null is a value like others."""
    out = F.lit(True)
    for k in keys:
        out &= a[k].eqNullSafe(b[k])
    return out


@contextmanager
def _batches(spark: SparkSession) -> Iterator[None]:
    """Batches of BATCH bytes for a writer, which makes Python objects of a whole batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def whole(head: Row, rows: Iterator[Row]) -> list[dict]:
    """The messages of the first row."""
    for r in rows:
        return [m.asDict() for m in r["messages"]]
    raise RuntimeError("a row of the plan is gone: the rows differ each time that they are read")


def with_turn(df: DataFrame, keys: tuple[str, ...], order: list[str], *others: str | Column) -> DataFrame:
    """keys as text, turn (by ``order``, then keys) and other columns of ``df``."""
    named = [F.col(k).cast("string").alias(k) for k in keys]
    return df.select(*named, F.struct(*order, *named).alias("turn"), *others)


def fill(spark: SparkSession, df: DataFrame, log: str, keys: tuple[str, ...], ask: Ask, order: list[str], limit: int | None = None, tasks: int = TASKS, chunk: int = CHUNK) -> DataFrame:
    """``replies`` after asking about the keys of ``df`` that the log lacks, ``limit`` of them at most, in ``order``.

    ``df`` has a column messages; of rows of one key the first in order is asked about.
    """
    rows = with_turn(df, keys, order, "messages")
    turns = rows.groupBy(*keys).agg(F.min("turn").alias("turn"))
    return fill_turns(spark, turns, rows.drop(*keys), log, keys, ask, whole, [], limit, tasks, chunk)


def fill_turns(
    spark: SparkSession, turns: DataFrame, rows: DataFrame, log: str, keys: tuple[str, ...], ask: Ask, read: Read, within: list[str | Column], limit: int | None = None, tasks: int = TASKS, chunk: int = CHUNK
) -> DataFrame:
    """``replies`` after asking about the ``turns`` (keys, turn and more) whose keys the log lacks, ``limit`` of them at most.

    ``rows`` (turn and more) hold the texts: those of a turn pass behind it, in the order ``within``, through
    ``read``. They move once, to the task of their turn, and are never whole in a row, a plan or an aggregate.
    """
    ship(spark)
    root = _ready(spark, log)
    have = replies(spark, log, keys).select(*keys)
    left = turns.join(have.hint("merge"), same(turns, have, keys), "left_anti")
    if limit is not None:
        left = left.orderBy("turn").limit(limit)
    plan = uuid.uuid4().hex
    told = ordered.numbered(left, ["turn"], "number", 0).withColumn("chunk", F.expr(f"number div {chunk}"))
    told = stored(told, f"{root}/plans/{plan}")
    if n := told.count():
        each = chunk * -(-n // (chunk * tasks))  # turns of a task, in whole chunks
        starts = told.agg(F.sort_array(F.collect_list(F.when(F.col("number") % each == 0, F.col("turn")))).alias("starts"), F.max("turn").alias("last"))  # a turn for each task
        both = told.unionByName(rows, allowMissingColumns=True).crossJoin(F.broadcast(starts)).where("turn <= last")
        task = F.greatest(F.size(F.filter("starts", lambda s: s <= F.col("turn"))) - 1, F.lit(0))
        mine = both.withColumn("task", task).drop("starts", "last").repartitionById(tasks, F.col("task")).sortWithinPartitions("turn", F.col("number").isNull(), *within)
        spark.dataSource.register(_source(ReplyWriter(root, plan, keys, ask, read)))
        with _batches(spark):
            mine.drop("task").write.format("judge_log").mode("append").save()
    return replies(spark, log, keys)
