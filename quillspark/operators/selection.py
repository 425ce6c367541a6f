"""Exact selection of the first rows of an order, of all rows or of each group, without sorting: DataFrame -> DataFrame.

An order is a list of double keys (``ascending``, ``real``, ``hashed``).  As a radix select does, each
pass counts the rows of every group in equal slices of the range that still holds its last chosen row, keeps
the slice with that row, and goes on inside of it, key by key, until a slice is taken as a whole or
holds few rows, which are ranked.  A pass scans the keys and shuffles partial counts only; what a group has
reached is a row of a small table, so neither groups nor rows go through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored

#: Slices of a range in one pass.
SLICES = 1024

#: A slice of no more rows than this is ranked in one task; larger ones are cut again.
FEW = 50_000


def ascending(c: Column) -> list[Column]:
    """Keys of whole numbers, nulls first; halves, as a double holds 53 bits only."""
    v = c.cast("long")
    return [F.coalesce(F.shiftright(v, 32).cast("double"), F.lit(-(2.0**40))), F.coalesce(v.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double"), F.lit(0.0))]


def real(c: Column, descending: bool = False) -> list[Column]:
    """Keys of doubles: nulls below all, NaN above all; descending turns that round."""
    v, sign = c.cast("double"), -1.0 if descending else 1.0
    kind = F.when(v.isNull(), -2.0).when(F.isnan(v), 2.0).when(v == float("inf"), 1.0).when(v == float("-inf"), -1.0).otherwise(0.0)
    return [kind * sign, F.when(kind == 0, v).otherwise(0.0) * sign]


def hashed(digest: Column) -> list[Column]:
    """Keys of an md5 in hexadecimal."""
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") for i in range(4)]


def _reached(found: DataFrame) -> DataFrame:
    """State of each group from the slice that holds its last chosen row: count, mins, maxs of all keys, need, at (the key being narrowed, from 1)."""
    whole = F.col("count") <= F.col("need")
    differs = F.array_position(F.zip_with("mins", "maxs", lambda a, b: a < b), True)
    upto = F.concat(F.slice("mins", F.lit(1), F.col("at") - 1), F.array(F.element_at("maxs", F.col("at"))))
    state = found.withColumn("_next", differs.cast("int")).withColumns({"ties": ~whole & (F.col("_next") == 0), "top": F.when(whole, upto).otherwise(F.col("mins"))})
    return state.select("_g", "need", "mins", "maxs", F.col("_next").alias("at"), "top", "ties", (whole | F.col("ties")).alias("done"), (F.col("count") <= FEW).alias("few"))


def mark_first(rows: DataFrame, order: list[Column], need: int | Column | Callable[[DataFrame], Column], group: list[str] | None = None, name: str = "chosen", keep_keys: bool = False) -> DataFrame:
    """``name``: whether a row is among the first ``need`` of its group (of all rows without ``group``), exactly.

    ``need`` is a number, a column over ``_g`` (the group's values) and ``count`` (its size), or a function that
    makes one from the table of these.  Groups no larger than that are taken whole, with 0 or less nothing is; null is a
    group.  Rows that no key tells apart are ordered by all their columns.  With ``keep_keys`` the keys are kept on the
    executors' disks between passes (for rows that are dear to compute); lost ones are computed again.
    An empty table stays empty.
    """
    from .relational import ranked

    g = F.struct(*group).alias("_g") if group else F.struct(F.lit(0).alias("all")).alias("_g")
    n = len(order)
    keys = rows.select(g, F.array(*order).alias("_k"))
    if keep_keys:
        keys = keys.persist(StorageLevel.DISK_ONLY)
    ends = [F.count("*").alias("count"), *(F.array(*(f(F.col("_k")[i]) for i in range(n))).alias(c) for f, c in ((F.min, "mins"), (F.max, "maxs")))]
    sizes = stored(keys.groupBy("_g").agg(*ends), "sizes")
    needed = need(sizes) if callable(need) else need if isinstance(need, Column) else F.lit(need)
    state = _reached(sizes.withColumns({"need": needed.cast("long"), "at": F.lit(1)}).where("need > 0"))
    finished = [state.where("done")]
    while True:
        few, many = state.where("not done and few"), state.where("not done and not few")
        k, lo, hi = (F.element_at(c, F.col("at")) for c in ("_k", "mins", "maxs"))
        same = F.slice("_k", F.lit(1), F.col("at") - 1) == F.slice("mins", F.lit(1), F.col("at") - 1)
        inside = lambda open_: keys.join(open_.select("_g", "need", "at", "mins", "maxs"), "_g").where(same & k.between(lo, hi))  # noqa: E731, B023
        n_few, n_many = state.agg(F.count_if(F.expr("not done and few")), F.count_if(F.expr("not done and not few"))).first()
        if n_few:
            w = Window.partitionBy("_g").orderBy("_k")
            places = inside(few).withColumns({"_row": F.row_number().over(w), "_rank": F.rank().over(w), "_equal": F.count("*").over(Window.partitionBy("_g", "_k"))})
            last = places.where("_row = need").withColumn("need", F.col("need") - F.col("_rank") + 1)
            done = last.select("_g", F.col("need").cast("long").alias("need"), "mins", "maxs", F.lit(0).alias("at"), F.col("_k").alias("top"), (F.col("_equal") > F.col("need")).alias("ties"), F.lit(True).alias("done"), F.lit(True).alias("few"))
            finished.append(stored(done, "reached"))
        if not n_many:
            break
        # Halves, so that no difference overflows; numbers too small for that fall to either end.
        width = hi / 2 - lo / 2
        part = F.when(width > 0, F.least(F.floor((k / 2 - lo / 2) / width * SLICES), F.lit(SLICES - 1))).otherwise(F.when(k > lo, SLICES - 1).otherwise(0))
        parts = inside(many).withColumn("_part", part).groupBy("_g", "need", "at", "_part").agg(*ends)
        upto = F.sum("count").over(Window.partitionBy("_g").orderBy("_part"))
        hit = parts.withColumn("_upto", upto).where("_upto >= need and _upto - count < need").withColumn("need", F.col("need") - F.col("_upto") + F.col("count"))
        state = stored(_reached(hit), "reached")
        finished.append(state.where("done"))
    if keep_keys:
        keys.unpersist()
    marks = reduce(DataFrame.union, finished).select("_g", F.col("need").alias("_need"), F.col("top").alias("_top"), F.col("ties").alias("_ties"))
    out = rows.select("*", g, F.array(*order).alias("_k")).join(marks, "_g", "left")
    below = F.when(F.col("_ties"), F.col("_k") < F.col("_top")).otherwise(F.slice("_k", F.lit(1), F.size("_top")) <= F.col("_top"))
    marked = out.withColumn(name, F.coalesce(F.col("_top").isNotNull() & below, F.lit(False)))
    shown = [*(c for c in rows.columns if c != name), name]
    if marks.where("_ties").isEmpty():
        return marked.select(*shown)
    tied = F.coalesce(F.col("_ties") & (F.col("_k") == F.col("_top")), F.lit(False))
    by_all = [F.col(f"`{f.name}`") for f in rows.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    equal = ranked(marked.where(tied).withColumnRenamed("_g", "_of"), "_of", *by_all, name="_rank").withColumn(name, F.col("_rank") <= F.col("_need"))
    return marked.where(~tied).select(*shown).unionByName(equal.select(*shown))
