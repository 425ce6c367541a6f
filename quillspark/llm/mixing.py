"""Mixing sources to target weights by weighted fair queueing.

Every source gets a target (its share of a total budget, water-filled against
a cap of ``max_epochs`` times its size).  The documents of a source are put in
a seeded shuffle, and a document's copy of epoch e has the virtual finish time
(words of its source up to and including it, epochs counted) / target.  All copies
of all sources are range-sorted by that time, their words are summed up along the
order, and the stream is truncated where the total budget is used up; the copy
that crosses it is taken in part.  So sources share the budget as their targets do,
but for the copies around the cut.

All steps are DataFrame operations.  The running sum over a source is split by
leading digits of the shuffle key, so a source that holds a third of all rows
is dealt over up to 4096 groups; only one sum for each (source, group) is ever
ordered in one place.  The sum along the global order is one number for each range
partition, then a running sum inside the one partition that holds the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

WORD_RE = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: int) -> DataFrame:
    """source, source_size -> + target.  One row per source; null is a source of its own and comes last."""
    n = len(weights)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_i", (F.row_number().over(by_name) - 1) % n)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_i") + 1).cast("int"))
    ranked = ranked.withColumn("_w", weight.cast("long")).withColumn("_cap", F.col("source_size") * max_epochs)
    # Sources fill up in order of cap / weight.  The level is that of the first source which the rest of the budget doesn't fill; later ones give lower levels.
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    filled = (
        ranked.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_w").over(after))
        .withColumn("_level", F.when(F.col("_cap") > F.col("_level") * F.col("_w"), F.col("_level")))
        .withColumn("_level", F.max("_level").over(everything))
    )
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w"))
    return filled.select("source", "source_size", F.coalesce(target, F.col("_cap").cast("double")).alias("target"))


PRIVATE = "quill__"


def shuffle_key(seed: str = "mix") -> Column:
    """Of id and text, so that rows of one id (or none) are dealt as well."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: str = "mix", digits: int = 3, known: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, source, text, ... -> the same rows + size, source_size, target, begin, taken, cut.

    ``begin``: words of the source before this document in its shuffle.
    ``taken``: words that the mix takes of it, repeats counted; at most ``max_epochs`` times its size.
    ``cut``: the copy at which the budget is used up (finish, nulls, source, begin, epoch, words taken of it).

    Null or empty text: size 0, taken 0.  Null source: a source of its own, the
    last one.  Repeated rows count as often as they come.  An empty table gives an empty result.  Other columns
    are kept; those named like an added one, or beginning with quill__, are replaced.  ``known``: columns that hold the
    words and the shuffle key of a row already.
    """
    added = ("size", "source_size", "target", "begin", "taken", "cut")
    keep = [c for c in docs.columns if c.lower() not in added and not c.lower().startswith(PRIVATE)]
    n, key = (n_words(F.col("text")), shuffle_key(seed)) if known is None else map(F.col, known)
    sized = docs.select(*keep, n.alias("size"), key.alias("quill__key")).withColumns({"quill__group": F.substring("quill__key", 1, digits), "quill__name": F.coalesce("source", F.lit("")), "quill__null": F.col("source").isNull()})
    # Sums and join share the columns that rows are dealt by, so that they cross the network once.
    dealt = ["quill__name", "quill__null", "quill__group"]
    groups = sized.groupBy("source", *dealt).agg(F.sum("size").alias("_n"))
    earlier = Window.partitionBy("quill__name", "quill__null").orderBy("quill__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    goal = targets(groups.groupBy("source").agg(F.sum("_n").alias("source_size")), weights, share, max_epochs)
    groups = groups.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    groups = groups.select(*dealt, F.col("_before").alias("quill__before"), "source_size", "target")
    inside = Window.partitionBy(*dealt).orderBy("quill__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = (
        sized.withColumn("quill__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(groups, dealt)
        .withColumn("begin", F.col("quill__before") + F.col("quill__inside"))
        .select(*keep, "size", "source_size", "target", "begin")
    )
    queue = copies(out.select("source", "size", "source_size", "target", "begin"), max_epochs)
    out = out.crossJoin(F.broadcast(cut(queue, goal, share)))  # one row
    words = [_words(F.lit(e)) for e in range(max_epochs)]
    return out.select(*keep, "size", "source_size", "target", "begin", sum(words[1:], words[0]).cast("long").alias("taken"), "cut")


def _finish(epoch: Column) -> Column:
    return (F.col("source_size") * epoch + F.col("begin") + F.col("size")) / F.col("target")


def _place(epoch: Column) -> list[Column]:
    """What the stream is ordered by."""
    return [_finish(epoch), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("begin"), epoch]


def _words(epoch: Column) -> Column:
    """Words that the mix takes of a copy: all before the cut, a part at it, none behind."""
    names = ("finish", "nameless", "name", "begin", "epoch")
    here = F.struct(*(c.alias(n) for c, n in zip(_place(epoch), names, strict=True)))
    there = F.struct(*(F.col(f"cut.{n}").alias(n) for n in names))
    return F.when((F.col("size") == 0) | (here > there), 0).when(here == there, F.col("cut.words")).otherwise(F.col("size"))


def copies(mixed: DataFrame, max_epochs: int) -> DataFrame:
    """One row for each copy that has words, with its place in the stream."""
    rows = mixed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    finish, nameless, name, begin, epoch = _place(F.col("epoch"))
    return rows.select(finish.alias("finish"), nameless.alias("nameless"), name.alias("name"), begin.alias("begin"), epoch.alias("epoch"), "size")


def cut(queue: DataFrame, goal: DataFrame, share: float) -> DataFrame:
    """One row, ``cut``: the copy of the range-sorted queue at which the budget is used up, and its words before that; null if there is no copy."""
    order = ["finish", "nameless", "name", "begin", "epoch"]
    ranged = queue.repartitionByRange(shuffle_partitions(queue.sparkSession), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    # Written, as both uses must see the same ranges.
    ranged = stored(ranged, "queue")
    budget = goal.agg(F.floor(F.sum("source_size") * F.lit(float(share))).alias("budget"))
    sums = ranged.groupBy("part").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range partition.  The cut lies in the last one that the budget reaches.
    reached = sums.withColumn("before", before).crossJoin(F.broadcast(budget)).where("before < budget").orderBy(F.desc("part")).limit(1).select("part", "before", "budget")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    row = ranged.join(F.broadcast(reached), "part").withColumn("done", F.col("before") + inside).where("done < budget").withColumn("words", F.least("size", F.col("budget") - F.col("done")))
    return row.agg(F.max(F.struct(*order, "words")).alias("cut"))


def stream(mixed: DataFrame, max_epochs: int = 2, ordered: bool = True) -> DataFrame:
    """One row for each copy in the mix (epoch, words, virtual finish time); ``ordered``: range-sorted by that time, as a trainer reads them."""
    rows = mixed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    rows = rows.withColumn("words", _words(F.col("epoch")).cast("long")).withColumn("finish", _finish(F.col("epoch"))).where("words > 0").drop("cut")
    return rows.orderBy("finish", F.col("source").isNull(), "source", "begin", "epoch") if ordered else rows


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("n"), shuffle_key().alias("k")), "mix-sizes")
    return mix(sizes, known=("n", "k")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 AS i FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CASE i WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 2 AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM w
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((max(CASE WHEN cap > lev * w THEN lev END) OVER ()) * w, cap::DOUBLE)) AS target FROM l
), c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b, row_number() OVER () AS r
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT r, size, sum(size) OVER (ORDER BY (source_size * e + b + size)::DOUBLE / target, source IS NULL, source, b, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS done
  FROM c, (VALUES (0), (1)) v(e) WHERE size > 0
), p AS (
  SELECT r, sum(greatest(0, least(size, floor((SELECT sum(size) FROM d)::DOUBLE * 1.5)::BIGINT - done))) AS n FROM q GROUP BY r
)
SELECT doc_id, size, source_size, target, coalesce(p.n, 0)::BIGINT AS taken FROM c LEFT JOIN p USING (r)
"""
