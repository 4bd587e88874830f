"""Files in and out: CSV with multi-line cells, JSON prompts, Parquet, single-file exports, schema checks."""

from __future__ import annotations

import csv
import io
import json
import textwrap
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyscale.sources import csvscan
from storyscale.sources.shared import delete, hadoop, work_dir

OUTPUT_COLUMNS = ("model", "prompt_id", "generation_id", "seed", "target_phonics", "prompt", "story")


def require_columns(df: DataFrame, names: tuple[str, ...], what: str = "input") -> DataFrame:
    """``df``, or an error that names what it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """``df``, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def require_files(spark: SparkSession, *paths: str) -> None:
    """Raise naming the first path that doesn't exist, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            raise FileNotFoundError(p)


def read_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = (), empty: bool = False) -> DataFrame:
    """All cells as text, empty ones as '', in the order of ``row_ord``; a byte order mark is dropped.

    Cells may hold line ends and doubled quotes; a large file is read by many tasks all the same (see ``csvscan``).
    """
    require_files(spark, path)
    df = csvscan.read(spark, path)
    require_columns(df, columns, path)
    return df if empty else require_rows(df, path)


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Generated stories from CSV or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return require_columns(df if "row_ord" in df.columns else df.withColumn("row_ord", F.monotonically_increasing_id()), OUTPUT_COLUMNS, path)
    return read_csv(spark, path, OUTPUT_COLUMNS)


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """prompt_id and target_phonics of a JSON array of objects."""
    return require_columns(spark.read.json(path, multiLine=True), ("prompt_id", "target_phonics"), path)


def _named(df: DataFrame, columns: list[str] | None, strict: bool) -> list[str]:
    extra = [c for c in df.columns if columns is not None and c not in columns]
    if strict and extra:
        raise ValueError(f"columns that the file lacks: {', '.join(extra)}")
    return [c for c in columns or df.columns if c in df.columns]


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """A folder of CSV parts, each with a header; of columns not listed none."""
    plain = {"quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*_named(df, columns, strict=False)).write.mode("overwrite").options(**plain).csv(path, header=True)


def _number(x: Column) -> Column:
    """A double in the digits that the JVM tells it by, with an exponent only below 0.0001 and from 1e16 on."""
    digits = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", ".0")
    other = F.regexp_replace(x.cast("string"), r"\.0E", "E")
    for pattern, to in ((r"E(\d)$", "e+0$1"), (r"E(\d+)$", "e+$1"), (r"E-(\d)$", "e-0$1"), ("E-", "e-"), ("Infinity", "inf"), ("NaN", "nan")):
        other = F.regexp_replace(other, pattern, to)
    return F.when((x == 0) | F.abs(x).between(1e-4, 9.9e15), digits).otherwise(other)


def _cell(df: DataFrame, name: str, alone: bool) -> Column:
    """A value as a CSV cell, in quotes where it must be."""
    x, kind = F.col(f"`{name}`"), df.schema[name].dataType.simpleString()
    if kind == "boolean":
        x = F.when(x, "True").when(~x, "False")
    elif kind in ("double", "float"):
        x = _number(x.cast("double"))
    elif kind.startswith(("array", "map", "struct", "variant")):
        x = F.to_json(x)
    x = F.coalesce(x.cast("string"), F.lit(""))
    needed = F.regexp_like(x, F.lit('[,"\r\n]')) | (x == "" if alone else F.lit(False))
    return F.when(needed, F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def _joined(df: DataFrame, path: str, end: str, head: str = "", last: str = "", between: bool = False) -> None:
    """The lines of a one-column frame in order as one file: written in parts by all tasks, whose bytes the file systems put together.

    ``end`` stands behind each line, or with ``between`` only between lines; ``head`` before the first and ``last`` behind all.
    """
    spark = df.sparkSession
    folder = work_dir(spark, "export")
    df.write.mode("overwrite").option("lineSep", end).text(folder)
    jvm = spark.sparkContext._jvm
    fs, at = hadoop(spark, folder)
    parts = sorted((f.getPath().toString(), f.getLen()) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    to, target = hadoop(spark, path)
    _, new = hadoop(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = to.create(new, True)
    out.write(bytearray(head.encode()))
    gap = bytearray(end.encode())
    spare, first = len(gap) if between else 0, True
    for part, size in parts:
        if size > spare:
            if between and not first:
                out.write(gap)
            source = fs.open(jvm.org.apache.hadoop.fs.Path(part))
            jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, size - spare)
            source.close()
            first = False
        fs.delete(jvm.org.apache.hadoop.fs.Path(part), False)  # so that the lines are hardly stored twice
    out.write(bytearray(last.encode()))
    out.close()
    to.delete(target, False)
    if not to.rename(new, target):
        raise OSError(f"cannot write {path}")
    delete(spark, folder)


def export_csv(df: DataFrame, path: str, columns: list[str] | None = None, bom: bool = False, strict: bool = False) -> None:
    """One CSV file of the rows in their order (sort them first), lines ending in CR LF.

    Tasks write the lines and only bytes are joined, so the rows never come to the driver. Columns that
    aren't listed are left out, or with ``strict`` an error.
    """
    names = _named(df, columns, strict)
    head = io.StringIO()
    csv.writer(head).writerow(names)
    lines = df.select(F.concat_ws(",", *[_cell(df, n, len(names) == 1) for n in names]).alias("value"))
    _joined(lines, path, "\r\n", ("\ufeff" if bom else "") + head.getvalue())


def export_json(df: DataFrame, path: str) -> None:
    """One indented JSON array of the rows in their order, written as ``export_csv`` writes its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [textwrap.indent(json.dumps(r, indent=2, ensure_ascii=False, default=str), "  ") for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["value"])

    some = not df.isEmpty()
    _joined(df.mapInArrow(run, "value string"), path, ",\n", "[\n" if some else "[", "\n]" if some else "]", between=True)


def load_env(path: str, environ: dict[str, str]) -> None:
    """KEY=VALUE lines into ``environ``; what is set already stays."""
    file = Path(path)
    if not file.exists():
        return
    for line in file.read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and key.strip() and not key.startswith("#"):
            environ.setdefault(key.strip(), value.strip().strip("'\""))
