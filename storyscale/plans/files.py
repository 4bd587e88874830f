"""Registered queries of files: documents written to CSV and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.operators import ordered
from storyscale.plans.query import query
from storyscale.sources import csvscan, io
from storyscale.sources.shared import spread, work_dir
from storyscale.sources.tables import read


def _digest(df: DataFrame, *more: str) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"), *more)


@query("SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS chars, md5(text) AS text_md5 FROM documents")
def csv_scan(spark, sf_dir):
    """The documents through a folder of CSV files, whose cells hold line ends and quotes, and the parallel scan."""
    folder = work_dir(spark, "csv-scan")
    io.write_csv(spread(read(spark, sf_dir, "documents")), folder, ["doc_id", "lang", "text"])
    return _digest(csvscan.read(spark, folder))


@query("SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS chars, md5(text) AS text_md5, row_number() OVER (ORDER BY lang, length(text), doc_id) AS place FROM documents")
def csv_sorted_export(spark, sf_dir):
    """The documents sorted into one CSV file, read by many tasks; place is the row's number in the file."""
    path = f"{work_dir(spark, 'csv-export')}/documents.csv"
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    io.export_csv(docs.orderBy("lang", F.length("text"), "doc_id"), path)
    rows = csvscan.read(spark, path)
    return ordered.numbered(_digest(rows, "row_ord"), ["row_ord"], "place").drop("row_ord")  # numbered without texts
