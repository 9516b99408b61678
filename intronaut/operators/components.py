"""Connected components of a link table, by alternating star contraction.

The links never leave the executors. Each partition first replaces its links by
a spanning forest, then every round points nodes at the smallest neighbour they
see (large star, small star) until nothing changes; rounds grow with the
logarithm of the longest path. Once at most ``FEW`` links are left, one task of
that bounded size ends the work. Degrees are reduced by aggregates with map-side
combine and joins that Spark may split, so a hub costs no more than its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intronaut.scratch import materialize

LINKS = "u long, v long"
#: Links that a single task may finish.
FEW = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's links as (node, smallest node of its tree)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def flush() -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        out = pa.record_batch([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["u", "v"])
        parent.clear()
        return out

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:  # bounded memory: what was joined so far goes out as links again
            yield flush()
    yield flush()


def forest(links: DataFrame) -> DataFrame:
    """The links (u, v) of each partition reduced to trees; components stay as they are."""
    return links.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_forest, LINKS)


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v): component is the smallest node reachable.

    Loops and repeated links are ignored, rows with a null end as well; a node without links has no row.
    """
    now = materialize(forest(links.where("u is not null and v is not null and u <> v")), "forest")
    before = None
    while True:
        if now.limit(few + 1).count() <= few:
            now = materialize(forest(now.coalesce(1)), "trees")
            break
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        # large star: neighbours above a node move to the smallest neighbour of it
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        # small star: a node and its neighbours below it move to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(forest(down.union(small.select("u", F.col("m").alias("v")))).distinct(), "stars")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
