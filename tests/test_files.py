"""Files by many tasks: the CSV scan against Python's reader and Spark's, ordered exports, numbers and folds."""

import csv
import io as stdio
import json
import random
import zlib

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyscale.operators import judge, ordered
from storyscale.sources import csvscan, io
from storyscale.sources.tables import stories, values


@pytest.fixture
def small_splits(spark):
    """Files of a few kilobytes are cut into many splits."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def cell(r):
    return r.choice(["", 'q"uo"te', "\n".join(f"line {i}" for i in range(r.randrange(5))), 'x\n"",\n' * r.choice([1, 900]), " lead, trail ", "crlf\r\nin a cell", f"plain é{r.random()}", "\n\n", '"'])


@pytest.mark.parametrize(("end", "bom"), [("\n", False), ("\r\n", True)])
def test_scan_equals_reader(spark, tmp_path, small_splits, end, bom):
    r = random.Random(3)
    rows = [[cell(r) for _ in range(4)] for _ in range(200)]
    path = tmp_path / "a.csv"
    with path.open("w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(["a", "b b", "row", "d,e"])
        out.writerows(rows)
    got = csvscan.read(spark, str(path))
    assert got.columns == ["a", "b b", "row", "d,e", "row_ord"]
    assert csvscan._lines(spark, str(path)).rdd.getNumPartitions() > 10
    assert [list(x)[:4] for x in got.orderBy("row_ord").collect()] == rows


def test_scan_of_documents_equals_spark(spark, sf, tmp_path, small_splits):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").orderBy("doc_id")
    path = str(tmp_path / "documents.csv")
    io.export_csv(docs, path)
    whole = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').fillna("")
    rows = csvscan.read(spark, path)
    assert [tuple(x)[:3] for x in rows.orderBy("row_ord").collect()] == [tuple(x) for x in whole.collect()]
    assert csvscan._lines(spark, path).rdd.getNumPartitions() > 50


def test_scan_of_odd_files(spark, tmp_path):
    for name, text, want in (
        ("empty", "a,b\n", []),
        ("no_end", "a,b\n1,2", [("1", "2")]),
        ("blank", "a,b\n\n1,2\n\r\n\n3,4\n", [("1", "2"), ("3", "4")]),
        ("short", 'a,b\n1\n"x\n\n",y,z\n', [("1", ""), ("x\n\n", "y")]),
        ("open", 'a,b\n1,"2\n3', [("1", "2\n3")]),
    ):
        path = tmp_path / f"{name}.csv"
        path.write_text(text, newline="")
        assert [tuple(r)[:2] for r in csvscan.read(spark, str(path)).orderBy("row_ord").collect()] == want, name
    with pytest.raises(ValueError, match="no rows"):
        io.read_csv(spark, str(tmp_path / "empty.csv"))
    assert io.read_csv(spark, str(tmp_path / "empty.csv"), empty=True).count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_csv(spark, str(tmp_path / "none.csv"))


def test_sorted_export_without_rows_on_the_driver(spark, tmp_path, monkeypatch):
    n = 1_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.lit("x,"), F.col("id")).alias("t"))
    for name in ("collect", "toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(DataFrame, name, None)
    io.export_csv(df.orderBy("k"), str(tmp_path / "s.csv"))
    with (tmp_path / "s.csv").open(newline="") as f:
        got = list(csv.reader(f))
    assert got[0] == ["k", "t"] and [int(k) for k, _ in got[1:]] == list(range(n))


def test_export_writes_as_the_csv_module(spark, tmp_path):
    doubles = [0.5, 1.0, -0.25, 0.0001, 0.0005, 1e-05, 1.5e-07, 1e16, 1e22, 123456.7891, float("nan"), float("inf"), None, 0.1 + 0.2]
    rows = [(i, x, i % 2 == 0, ["", "a\nb", 'q"', ",", " x ", None][i % 6]) for i, x in enumerate(doubles)]
    df = spark.createDataFrame(rows, "i int, x double, b boolean, t string")
    io.export_csv(df.orderBy("i"), str(tmp_path / "a.csv"), ["t", "x", "b", "i"], bom=True)
    want = stdio.StringIO()
    out = csv.writer(want)
    out.writerow(["t", "x", "b", "i"])
    out.writerows([["" if v is None else v for v in (t, x, b, i)] for i, x, b, t in rows])
    assert (tmp_path / "a.csv").read_bytes().decode("utf-8-sig") == want.getvalue()
    with pytest.raises(ValueError, match="b"):
        io.export_csv(df, str(tmp_path / "b.csv"), ["i", "x", "t"], strict=True)
    assert not (tmp_path / "b.csv").exists()
    io.export_json(df.select("i", "t").orderBy("i"), str(tmp_path / "a.json"))
    assert (tmp_path / "a.json").read_text() == json.dumps([{"i": i, "t": t} for i, _, _, t in rows], indent=2)
    io.export_json(df.limit(0), str(tmp_path / "e.json"))
    assert (tmp_path / "e.json").read_text() == "[]"


def test_write_csv_keeps_blanks(spark, tmp_path):
    df = values(spark, "a b", [(" x ", "y\nz"), ("", 'q"')])
    io.write_csv(df, str(tmp_path / "out"), ["b", "a"])
    got = csvscan.read(spark, str(tmp_path / "out"))
    assert got.columns[:2] == ["b", "a"] and sorted(tuple(r)[:2] for r in got.collect()) == [('q"', ""), ("y\nz", " x ")]


def test_numbers_need_no_single_task(spark):
    df = spark.range(5000).select(((F.col("id") * 7) % 5000).alias("k"), F.lit("same").alias("t")).repartition(6)
    out = ordered.numbered(df, ["t", F.desc("k")])
    assert all(r["place"] == 5000 - r["k"] for r in out.collect())
    assert "Window" not in out._jdf.queryExecution().toString()
    assert ordered.numbered(df.limit(0), ["k"]).count() == 0


def test_digests_spread_a_group(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "a", "a", None]), i, r.choice(["x", "é" * 5, None, "", "long " * 30])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i int, t string").repartition(5)
    got = {x["k"]: tuple(x)[1:] for x in ordered.joined_digest(df, ["k"], ["i"], F.col("t"), "-|-").collect()}
    for k in ("a", "b", None):
        mine = [t or "" for kk, _, t in rows if kk == k]
        w = "-|-".join(mine)
        assert got[k] == (len(mine), len(w), len(w.encode()), zlib.crc32(w.encode()))
    plan = ordered.joined_digest(df, ["k"], ["i"], F.col("t"), "")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "rangepartitioning" in plan


def test_joined_messages_span_batches(spark, sf):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = stories(spark, sf)
        got = {(r["model"], r["prompt_id"]): r["messages"][1]["content"] for r in judge.consistency_messages(df).collect()}
        assert "collect_list" not in judge.consistency_messages(df)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = {}
    for r in df.collect():
        groups.setdefault((r["model"], r["prompt_id"]), []).append(r)
    for k, rows in groups.items():
        first = min(rows, key=lambda r: r["row_ord"])
        parts = [f"[generation_id={r['generation_id']}]\n{r['story']}" for r in sorted(rows, key=lambda r: (r["generation_id"], r["row_ord"]))]
        assert judge.GAP.join(parts) in got[k] and got[k].startswith(f"Target phonics: {first['target_phonics']}\n")
