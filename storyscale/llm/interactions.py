"""Audit of filter interactions: what each filter removes at each step of every order of the filters.

Each document's failures are told once and stored without its text. The replay then is relational:
every document meets each of the orders (120 for five filters, broadcast), each pair explodes to the
order's steps, the first step whose filter the document fails is where it goes, and conditional sums
by part, order and step tell what is kept, removed, redundant, failed by this filter alone, and lost
of the labelled rows. Spark combines the sums in each task, so a task passes on at most as many rows
as there are parts, orders and steps, whatever a part holds. All is DataFrame functions.

A null text is empty, a null part the empty string. A copy is a row whose text some row of a smaller
id has; rows of one id and text are no copies of each other, and a row without id is none and makes
none. Several labels of an id count as good (toxic) if one of them is. Very long texts are taken
whole; repeated rows count each; there are no ties; an empty table gives no rows. Other columns of
the input are not looked at, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyscale.llm.common import SPACE, checkpointed, work_dir

#: Rows broadcast at most, so that filters can't be too many for all their orders.
MOST_ORDERS = 5040


def failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that look at one text alone: whether ``text`` of ``words`` fails each."""
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": F.regexp_like(text, F.lit("[#$%&*|]")),
    }


#: The filter that a copy fails.
COPY = "E"


def mask(fails: list[Column]) -> Column:
    """One bit for each filter, the first one lowest."""
    out = F.lit(0)
    for i, f in enumerate(fails):
        out = out.bitwiseOR(F.when(f, F.lit(1 << i)).otherwise(F.lit(0)))
    return out


def flagged(df: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str]:
    """(part, mask, good, toxic) of each row, and the filters' letters in the order of the mask's bits."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("words", F.filter(F.split("text", SPACE + "+"), lambda w: w != ""))
    single = failures(F.col("text"), F.col("words"))
    rows = docs.select("id", "part", mask(list(single.values())).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = checkpointed(rows, work_dir(spark, "interactions-rows"))
    # stored, so that the joins read plain exchanges, which Spark splits where one digest or id has many rows
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("digest", "first")
    first = checkpointed(first, work_dir(spark, "interactions-copies"))
    told = labels.groupBy(F.col(id_col).alias("id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    told = checkpointed(told.where("good OR toxic"), work_dir(spark, "interactions-labels"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    # both sides grow with the table, so neither is broadcast, however well its file is packed
    out = rows.join(first.hint("merge"), "digest", "left").join(told.hint("merge"), "id", "left")
    bit = F.when(copy, F.lit(1 << len(single))).otherwise(F.lit(0))
    out = out.select("part", F.col("mask").bitwiseOR(bit).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return out, "".join(single) + COPY


def all_orders(rows: DataFrame, letters: str) -> DataFrame:
    """(order_no, filter_order, steps) of every order: steps are (step, its filter's bit)."""
    made = [(k, "".join(o), [(i + 1, 1 << letters.index(x)) for i, x in enumerate(o)]) for k, o in enumerate(permutations(letters))]
    if len(made) > MOST_ORDERS:
        raise ValueError(f"{len(letters)} filters have {len(made)} orders; at most {MOST_ORDERS} are replayed")
    return rows.sparkSession.createDataFrame(made, "order_no int, filter_order string, steps array<struct<step:int,bit:int>>")


def replay(rows: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order and step of (part, mask, good, toxic) rows: see the module."""
    orders = all_orders(rows, letters)
    met = rows.crossJoin(F.broadcast(orders.select("order_no", "steps")))  # orders: 120 rows for five filters, MOST_ORDERS at most
    fails = [F.col("mask").bitwiseAND(F.col("steps")[i]["bit"]) != 0 for i in range(len(letters))]
    first = F.lit(len(letters) + 1)
    for i in reversed(range(len(letters))):
        first = F.when(fails[i], F.lit(i + 1)).otherwise(first)
    steps = met.withColumn("first", first).select("part", "order_no", "mask", "good", "toxic", "first", F.inline("steps"))
    here, mine = F.col("first") == F.col("step"), F.col("mask").bitwiseAND(F.col("bit")) != 0
    counts = steps.groupBy("part", "order_no", "step", "bit").agg(
        F.count_if(F.col("first") > F.col("step")).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(mine & (F.col("first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("mask") == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    total = F.sum("removed").over(Window.partitionBy("part", "bit"))  # a row for each order
    named = counts.withColumn("shapley", total).join(F.broadcast(orders.select("order_no", "filter_order")), "order_no")
    return named.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(df: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, filter_order, step and the counts of each part, order and step."""
    return replay(*flagged(df, labels, part_col, id_col, text_col))


_LETTERS = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate("ABCDE"))
#: The same in DuckDB, straight from the definition.
AUDIT_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  CASE WHEN len(words) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN w.doc_id > first THEN 16 ELSE 0 END AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x(letter, bit) AS (VALUES {_LETTERS}),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a JOIN x b ON b.bit <> a.bit JOIN x c ON c.bit NOT IN (a.bit, b.bit) JOIN x d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN x e ON e.bit NOT IN (a.bit, b.bit, c.bit, d.bit)),
p AS (SELECT f.*, filter_order, bits, coalesce(list_position(list_transform(bits, lambda z: (mask & z) <> 0), true), 6) AS first FROM f CROSS JOIN o),
s AS (SELECT *, unnest([1, 2, 3, 4, 5]) AS step, unnest(bits) AS bit FROM p),
g AS (SELECT part, filter_order, step, bit, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
  count(*) FILTER ((mask & bit) <> 0 AND first < step) AS redundant, count(*) FILTER (mask = bit) AS unique_fails,
  count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""
