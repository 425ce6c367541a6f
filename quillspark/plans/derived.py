"""Relations over the given tables, by arithmetic and md5 that any SQL engine repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..lexicons import DIMENSIONS
from ..operators import relational as rel

ARMS = ["base", "method", "generic", "random"]
OPS = ["discrimination", "force", "constraint"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def responses(spark: SparkSession, d: str) -> DataFrame:
    q = F.expr("doc_id div 4")
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    return table(spark, d, "documents").select(q.alias("query_id"), pick(ARMS, F.col("doc_id") % 4).alias("arm"), pick(OPS, q % 3).alias("target_op"), F.col("text").alias("response"), F.col("doc_id").alias("seq"), "n_chars", "lang", "source")


def _points(n_chars, query_id, ix):
    return [(1 + (F.floor(n_chars / (i + 1)) + query_id * (i + 2) + ix * i) % 5).cast("double") for i in range(5)]


def _scores(points):
    return F.map_from_arrays(F.array(*map(F.lit, DIMENSIONS)), F.array(*points))


def _sum(points):
    """``scoring.score_sum`` of the points' map, without the map: filters on a winner are pushed below it, and would build it for each score."""
    return reduce(lambda x, y: x + y, (F.coalesce(p, F.lit(0.0)) for p in points))


def judgments(spark: SparkSession, d: str, shift: int = 0, baseline: str = "base") -> DataFrame:
    """Judgments of each arm against the baseline; ``shift`` gives another judge."""
    r = responses(spark, d).drop("response")
    a, b = (_points(F.col(f"{x}_n_chars") + shift, F.col("query_id"), F.col(f"{x}_seq") % 4) for x in "ab")
    j = rel.pair_arms(r, baseline).withColumns({"scores_a": _scores(a), "scores_b": _scores(b)})
    winner = F.when(_sum(a) > _sum(b), F.col("a_arm")).when(_sum(b) > _sum(a), F.col("b_arm")).otherwise("TIE")
    return j.select("query_id", F.col("a_arm").alias("config_a"), F.col("b_arm").alias("config_b"), winner.alias("winner"), "scores_a", "scores_b", F.col("b_target_op").alias("target_op"), F.col("b_lang").alias("model"), F.col("b_seq").alias("seq"))


def all_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Judgments with the base on either side, and those of method against generic."""
    j, even = judgments(spark, d), F.col("seq") % 2 == 0
    swapped = {a: F.when(even, F.col(b)).otherwise(F.col(a)) for x, y in (("config_a", "config_b"), ("scores_a", "scores_b")) for a, b in ((x, y), (y, x))}
    return j.select(*(swapped.get(c, F.col(c)).alias(c) for c in j.columns)).unionByName(judgments(spark, d, baseline="generic").where("config_b = 'method'"))


def scored_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Winners over losers with stage, dominant dimension and deltas; ties are left out."""
    j = judgments(spark, d).where("winner <> 'TIE'")
    won = F.when(F.col("winner") == F.col("config_a"), F.col("scores_a")).otherwise(F.col("scores_b"))
    lost = F.when(F.col("winner") == F.col("config_a"), F.col("scores_b")).otherwise(F.col("scores_a"))
    best = scoring.dominant(won, lost)
    return j.withColumn("_b", best).select("query_id", "config_b", "winner", F.col("_b.stage").alias("stage"), F.col("_b.dimension").alias("dominant_dimension"), F.col("_b.delta").alias("score_delta"), scoring.total_delta(won, lost).alias("total_delta"), F.col("model").alias("source"), "seq")


#: The same relations in SQL.
CTE = """
WITH responses AS (
  SELECT doc_id // 4 AS query_id, ['base','method','generic','random'][doc_id % 4 + 1] AS arm, ['discrimination','force','constraint'][(doc_id // 4) % 3 + 1] AS target_op,
         text AS response, doc_id AS seq, n_chars, lang, source FROM documents
), paired AS (
  SELECT a.query_id, a.arm AS config_a, b.arm AS config_b, b.target_op, b.lang AS model, b.seq,
         [(1 + ((a.n_chars + {s}) // (i + 1) + a.query_id * (i + 2) + (a.seq % 4) * i) % 5)::DOUBLE for i in range(5)] AS sa,
         [(1 + ((b.n_chars + {s}) // (i + 1) + b.query_id * (i + 2) + (b.seq % 4) * i) % 5)::DOUBLE for i in range(5)] AS sb
  FROM responses a JOIN responses b ON a.query_id = b.query_id AND (a.arm = 'base' AND b.arm <> 'base' OR a.arm = 'generic' AND b.arm = 'method')
), judged AS (
  SELECT *, CASE WHEN list_sum(sa) > list_sum(sb) THEN config_a WHEN list_sum(sb) > list_sum(sa) THEN config_b ELSE 'TIE' END AS winner FROM paired
), judgments AS (SELECT * FROM judged WHERE config_a = 'base'
), dims AS (
  SELECT i, ['factual_accuracy','completeness','calibration','reasoning_depth','usefulness'][i] AS dim FROM (SELECT unnest(range(1, 6)) AS i)
), ds AS (
  SELECT query_id, config_b, winner, model, seq, i, dim, (CASE WHEN winner = config_a THEN sa[i] - sb[i] ELSE sb[i] - sa[i] END) AS delta FROM judgments, dims WHERE winner <> 'TIE'
), pairs AS (
  SELECT query_id, config_b, winner, model AS source, seq, sum(delta) AS total_delta,
         coalesce(arg_max(i, delta * 10 - i) FILTER (WHERE delta > -1), 3) AS stage,
         coalesce(arg_max(dim, delta * 10 - i) FILTER (WHERE delta > -1), 'calibration') AS dominant_dimension,
         coalesce(max(delta) FILTER (WHERE delta > -1), 0.0) AS score_delta
  FROM ds GROUP BY ALL
)
"""


#: ``all_judgments``, to stand behind ``cte()``.
ALL = """, all_judgments AS (
  SELECT query_id, CASE WHEN swap THEN config_b ELSE config_a END AS config_a, CASE WHEN swap THEN config_a ELSE config_b END AS config_b, winner, target_op, model, seq
  FROM (SELECT *, config_a = 'base' AND seq % 2 = 0 AS swap FROM judged)
)
"""


def cte(shift: int = 0) -> str:
    return CTE.replace("{s}", str(shift))
