"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree. At every node each child holds an exponential race time
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name, and the smallest
time wins, so a child is taken in proportion to its weight. Weight that is added later is a race
of its own, keyed by the new shard, beside the unchanged race of the old weight: at each level
above the new shard its ancestor's time is the smaller of the two. A row therefore moves only if
the added race beats the time its old path won with, and then it moves into the new shard; rows
of subtrees whose weights stay as they were keep their places. The law is ``key``: the key and
the number of shards decide.

Null keys count as the empty key, equal keys share a shard, repeated rows have slots of their own,
an empty table gives no rows, a null text has size 1, very long texts are hashed in their rows.
Input columns named like an output column give way to it; further columns are kept, whatever their
names.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyscale.llm.common import checkpointed, work_dir

#: Places of the input that are numbered together: at most this many rows of one shard in a window.
CHUNK = 16_384


class Added(NamedTuple):
    """A shard added to a rack after the tree was laid out."""

    region: int
    rack: int
    weight: float


class Tree(NamedTuple):
    """weights[region][rack][shard]; added: later shards in order of their arrival."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]
    added: tuple[Added, ...] = ()

    @property
    def shards(self) -> int:
        return sum(len(r) for g in self.weights for r in g) + len(self.added)

    def grow(self, region: int, rack: int, weight: float = 1.0) -> Tree:
        return self._replace(added=(*self.added, Added(region, rack, weight)))


#: Production layout: 2 regions of 2 racks of 4 equal shards.
SIXTEEN = Tree((((1.0,) * 4,) * 2,) * 2)


def _race(key: Column, name: str, weight: float) -> Column:
    """Time of a child; infinite for a child without weight."""
    if weight <= 0:
        return F.lit(float("inf"))
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11)
    return -F.log((h.cast("double") + 0.5) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _first(children: list[tuple[Column, Column]]) -> Column:
    """What the child of the smallest time (first) leads to (second); ties go to the earlier child."""
    if len(children) == 1:
        return children[0][1]
    best, out = children[0]
    for time, leads in children[1:]:
        out = F.when(time < best, leads).otherwise(out)
        best = F.least(best, time)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard number of a key; the added shards have the last numbers."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    n = 0
    regions = []
    for g, racks in enumerate(tree.weights):
        options = []
        for r, shards in enumerate(racks):
            leaves = [(_race(key, f"shard {g}/{r}/{s}", w), F.lit(n + s)) for s, w in enumerate(shards)]
            n += len(shards)
            options.append((_race(key, f"rack {g}/{r}", sum(shards)), _first(leaves)))
        regions.append((_race(key, f"region {g}", sum(map(sum, racks))), _first(options)))
    # the descent over the old weights, then the added races: one that beats its whole region's time and all other regions' times leads straight down to the added shard
    best = F.least(*[t for t, _ in regions]) if len(regions) > 1 else regions[0][0]
    out = _first(regions)
    for i, a in enumerate(tree.added):
        time = _race(key, f"added {i} {a.region}/{a.rack}", a.weight)
        out = F.when(time < best, F.lit(n + i)).otherwise(out)
        best = F.least(best, time)
    return out.cast("int")


def shard(df: DataFrame, tree: Tree = SIXTEEN, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """Columns ``carry`` of ``df`` (default: all) with size, text_crc32, law, shard, slot and grown_shard.

    Slots count gaplessly from 0 in each shard. The placed rows are stored once in the shared
    folder with their places in the input, so that what follows sees the same places however often
    a task is run again. Running sums over the counts of each (shard, ``chunk`` places) give the
    chunks' first slots, and rows are numbered within their chunk. A chunk is a run of places, not
    of keys, so no task numbers more than ``chunk`` rows at a time, whatever a key repeats.
    """
    spark = df.sparkSession
    grown = grown or tree.grow(0, 0)
    key = F.col(id_col)
    made = {
        "size": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1,
        "text_crc32": F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")),
        "law": F.lit("key"),
        "shard": shard_of(key, tree),
        "grown_shard": shard_of(key, grown),
        "__place": F.monotonically_increasing_id(),
    }
    kept = [c for c in (df.columns if carry is None else carry) if c not in made and c != "slot"]
    placed = checkpointed(df.select(*kept, *[c.alias(n) for n, c in made.items()]), work_dir(spark, "shards"))
    placed = placed.withColumn("__chunk", F.expr(f"__place div {chunk}"))
    counts = placed.groupBy("shard", "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = Window.partitionBy("shard", "__chunk").orderBy("__place")
    numbered = placed.withColumn("__row", F.row_number().over(own) - 1)
    return numbered.join(bases, ["shard", "__chunk"]).select(*kept, *[n for n in made if n != "__place"], (F.col("__base") + F.col("__row")).alias("slot"))
