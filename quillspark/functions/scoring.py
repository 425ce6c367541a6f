"""Judgments, scores and statistics as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import DIMENSIONS


def coin(seed: str, key: Column) -> Column:
    """A fair, reproducible coin: the parity of the first hexadecimal digit of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 1), 16, 10).cast("int") % 2 == 1


def realigned(order: Column, raw: Column, scores_first: Column, scores_second: Column, arm_a: Column) -> Column:
    """winner, scores_a, scores_b of a judgment that was made in the positions of ``order``; an unknown winner is a tie."""
    first = order[0] == arm_a
    return F.struct(
        F.when(raw == "A", order[0]).when(raw == "B", order[1]).otherwise(F.lit("TIE")).alias("winner"),
        F.when(first, scores_first).otherwise(scores_second).alias("scores_a"),
        F.when(first, scores_second).otherwise(scores_first).alias("scores_b"),
    )


def _deltas(won: Column, lost: Column, dims: list[str]) -> Column:
    """array<struct<delta, neg, dimension>>; missing scores count as 0, ``neg`` is minus the place of the dimension."""
    score = lambda m, d: F.coalesce(F.try_element_at(m, d), F.lit(0.0))
    return F.transform(F.array(*map(F.lit, dims)), lambda d, i: F.struct((score(won, d) - score(lost, d)).alias("delta"), (-i).alias("neg"), d.alias("dimension")))


def dominant(won: Column, lost: Column, dims: list[str] = DIMENSIONS) -> Column:
    """stage (1..), dimension and delta of the largest score difference; ties go to the earlier dimension; without any over -1: (3, calibration, 0)."""
    best = F.array_max(F.filter(_deltas(won, lost, dims), lambda e: e["delta"] > -1))
    default = F.struct(F.lit(0.0).alias("delta"), F.lit(-2).alias("neg"), F.lit("calibration").alias("dimension"))
    found = F.transform(F.array(F.coalesce(best, default)), lambda e: F.struct((1 - e["neg"]).alias("stage"), e["dimension"].alias("dimension"), e["delta"].alias("delta")))
    return found[0]


def total_delta(won: Column, lost: Column, dims: list[str] = DIMENSIONS) -> Column:
    return F.aggregate(_deltas(won, lost, dims), F.lit(0.0), lambda a, e: a + e["delta"])


def score_sum(scores: Column, dims: list[str] = DIMENSIONS) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(scores[d], F.lit(0.0)) for d in dims))


def prefix_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def rate(wins: Column, total: Column) -> Column:
    return F.when(total > 0, wins / total).otherwise(F.lit(0.0))


def cohens_h(p1: Column, p2: Column | float) -> Column:
    p2 = F.lit(p2) if isinstance(p2, float) else p2
    return 2 * (F.asin(F.sqrt(p1)) - F.asin(F.sqrt(p2)))


def effect_label(h: Column) -> Column:
    return F.when(F.abs(h) < 0.2, "negligible").when(F.abs(h) < 0.5, "small").when(F.abs(h) < 0.8, "medium").otherwise("large")


def percent(x: Column) -> Column:
    """Whole percent, halves to even."""
    return F.bround(x * 100, 0).cast("long").cast("string")


def win_rate_text(total: Column, point: Column, low: Column, high: Column) -> Column:
    return F.when(total == 0, "N/A").otherwise(F.concat(percent(point), F.lit("% ["), percent(low), F.lit("-"), percent(high), F.lit("%]")))


def verdict(best: Column, control: Column, random: Column, best_significant: Column, control_significant: Column) -> Column:
    clear = (best > control) & (best > random) & best_significant
    return F.when(clear & (best - control > 0.05), "PROVEN").when(clear, "PARTIALLY PROVEN").when(((best > random) | (control > random)) & (best_significant | control_significant), "PARTIALLY PROVEN").otherwise("DISPROVEN")


def replication_verdict(n_significant: Column) -> Column:
    return F.when(n_significant >= 2, "CONFIRMED").when(n_significant == 1, "PARTIAL").otherwise("NOT CONFIRMED")
