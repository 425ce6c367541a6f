"""Connected components of links between documents, by alternating star contraction.

Links are first contracted inside partitions, so that dense groups shrink to
trees.  Up to ``ONE_TASK`` trees' links (some megabytes) are then contracted in
one task.  More take rounds of a few joins and sums over a table that is
written to the shared folder; the result is the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

ONE_TASK = 200_000


def _forest(batches):
    parent: dict[int, int] = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, r) for x in list(parent) if (r := root(x)) != x]
    for lo in range(0, len(rows), 50_000):
        part = np.array(rows[lo : lo + 50_000], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], names=["u", "v"])


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links u > v.  Large star: to each larger neighbour of a node goes the least of the node and its neighbours; small star: to each smaller neighbour and the node itself."""
    if larger:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _labels(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(links: DataFrame, contract: bool = True, one_task: int = ONE_TASK) -> DataFrame:
    """a, b -> node, component: the least id that is reachable from a node; only nodes with links to others appear."""
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v")
    if contract:
        now = now.mapInArrow(_forest, "u long, v long")
    now = stored(now.distinct(), "links")
    if now.count() <= one_task:
        return _labels(stored(now.coalesce(1).mapInArrow(_forest, "u long, v long"), "stars"))
    mark = None
    while True:
        now = stored(_star(_star(now, True), False), "stars")
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(new) == mark:
            return _labels(now)
        mark = tuple(new)
