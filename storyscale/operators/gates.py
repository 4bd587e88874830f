"""Checks of input rows that are measured by the job that reads them anyway, so that no check is a scan of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Failing rows that a message names.
NAMED = 5


class Gate:
    """Counts the rows of a frame that fail a test and keeps a few, while any job runs over the frame."""

    def __init__(self, what: str, fails: Column, named: list[str | Column], order: str = "row_ord") -> None:
        self.what, self.seen = what, Observation()
        row = F.struct(F.col(order), F.struct(*named).alias("named"))
        # the first failing row of each remainder of the order: a bounded state, unlike a list of all
        firsts = [F.min(F.when(fails & (F.pmod(F.col(order), F.lit(NAMED)) == i), row)).alias(f"first{i}") for i in range(NAMED)]
        self.metrics = [F.count_if(F.coalesce(fails, F.lit(False))).alias("failed"), F.count(F.lit(1)).alias("rows"), *firsts]

    def watch(self, df: DataFrame) -> DataFrame:
        """``df``, watched: the counts are there when a job has run over all of it."""
        return df.observe(self.seen, *self.metrics)

    def check(self) -> int:
        """How many rows were seen; an error that names the first ones that failed, if any did."""
        got = self.seen.get
        if got["failed"]:
            found = sorted((f for f in (got[f"first{i}"] for i in range(NAMED)) if f is not None), key=lambda f: f[0])
            raise ValueError(f"{self.what} in {got['failed']} of {got['rows']} rows, among them {[tuple(f['named']) for f in found]}")
        return got["rows"]
