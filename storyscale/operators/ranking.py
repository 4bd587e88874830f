"""Several rankings of one table, with their counts, in one scan and one shuffle.

Each task keeps the first k rows of each ranking and counts what it ranks and what it reads; only
these few rows are shuffled and ranked again. So neither a ranking nor its count needs a pass of its
own, and no task sees more than k rows of a ranking from each other task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from storyscale.sources.package import ship

#: Order columns of every ranking: numbers, then texts, then a whole number.
NUMBERS, TEXTS = 4, 3


class Ranking(NamedTuple):
    """The first k rows for which ``when`` holds, by ascending numbers, then texts, then ``last``."""

    name: str
    when: Column
    numbers: list[Column]
    texts: list[Column]
    last: Column
    k: int


_ORDER = [*[f"__n{i}" for i in range(NUMBERS)], *[f"__t{i}" for i in range(TEXTS)], "__last"]


def _entry(i: int, r: Ranking) -> Column:
    numbers = [F.lit(0.0) + F.coalesce(c.cast("double"), F.lit(0.0)) for c in r.numbers] + [F.lit(0.0)] * (NUMBERS - len(r.numbers))
    texts = [F.coalesce(c.cast("string"), F.lit("")) for c in r.texts] + [F.lit("")] * (TEXTS - len(r.texts))
    values = [*numbers, *texts, F.coalesce(r.last.cast("long"), F.lit(0).cast("long"))]
    return F.when(r.when, F.struct(F.lit(i).alias("__ranking"), *[v.alias(n) for v, n in zip(values, _ORDER)]))


def _first(t: pa.Table, k: int) -> pa.Table:
    return t.take(pc.sort_indices(t, sort_keys=[(n, "ascending") for n in _ORDER])[:k])


def ranked(df: DataFrame, rankings: list[Ranking]) -> DataFrame:
    """Rows of ``df`` that a ranking has among its first, with ranking (its name), rank, n (how many rows it ranks) and of (how many rows there are)."""
    ship(df.sparkSession)
    own = T.StructType.fromDDL("__ranking int, __n long, __of long, " + ", ".join(f"{n} {'double' if n[2] == 'n' else 'string' if n[2] == 't' else 'long'}" for n in _ORDER))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema], *own.fields])
    arrow, limits = to_arrow_schema(schema), [r.k for r in rankings]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table | None] = [None] * len(limits)
        counts, rows = np.zeros(len(limits), np.int64), 0
        for b in batches:
            rows += b.num_rows
            lists = b.column(b.num_columns - 1)
            entry, row = lists.flatten(), pc.list_parent_indices(lists)
            which = pc.struct_field(entry, "__ranking").to_numpy(zero_copy_only=False)
            for i in np.unique(which).tolist():
                at = pa.array(np.flatnonzero(which == i))
                counts[i] += len(at)
                order = {n: pc.struct_field(entry, n).take(at) for n in _ORDER}
                place = pc.sort_indices(pa.table(order), sort_keys=[(n, "ascending") for n in _ORDER])[: limits[i]]
                mine = [c.take(row.take(at).take(place)) for c in b.columns[:-1]]
                t = pa.table([*mine, *[order[n].take(place) for n in _ORDER]], names=[*b.schema.names[:-1], *_ORDER])
                kept[i] = _first(pa.concat_tables([kept[i], t]) if kept[i] else t, limits[i])
        for i, t in enumerate(kept):
            n = 0 if t is None else t.num_rows
            for size, total, of, part in ((1, int(counts[i]), rows, None), (n, 0, 0, t)):
                if size:
                    told = {"__ranking": [i] * size, "__n": [total] * size, "__of": [of] * size}
                    cols = [pa.array(told[f.name], f.type) if f.name in told else pa.nulls(size, f.type) if part is None else part[f.name].combine_chunks().cast(f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    entries = F.array_compact(F.array(*[_entry(i, r) for i, r in enumerate(rankings)]))
    made = df.select(*df.columns, entries.alias("__in")).mapInArrow(run, schema)
    mine = Window.partitionBy("__ranking")
    by = mine.orderBy(F.col("__last").isNull(), *_ORDER)  # what counts alone comes last
    out = made.select(*made.columns, F.sum("__n").over(mine).alias("n"), F.sum("__of").over(mine).alias("of"), F.row_number().over(by).alias("rank"))
    listed = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.k).alias("k")) for r in rankings])
    out = out.where(F.col("__last").isNotNull()).withColumn("__r", F.get(listed, F.col("__ranking"))).where(F.col("rank") <= F.col("__r.k"))
    return out.select(*df.columns, F.col("__r.name").alias("ranking"), "rank", "n", "of")
