"""Intervals of proportions and what follows from them.

Resampling n outcomes of which a share p are wins gives Binomial(n, p) wins, so percentiles of bootstrap
rates are quantiles of that distribution.  They are computed exactly: the distribution function is a
regularised incomplete beta function (a continued fraction, for many groups at once), inverted by bisection over the
number of wins.  Drawing resamples stays as an option.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def _stirling_error(n: np.ndarray) -> np.ndarray:
    """log(n!) less Stirling's formula, for n >= 1."""
    small = np.array([0.0, *(math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16))])
    m = np.maximum(n, 1.0)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / m**2) / m**2) / m**2) / m
    return np.where(n < 16, small[np.minimum(n, 15).astype(np.int64)], series)


def _deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x log(x / mean) + mean - x, without cancellation near x = mean."""
    d = (x - mean) / (x + mean)
    term, total = (x - mean) * d, (x - mean) * d
    e = 2 * x * d
    for j in range(1, 60):
        e = e * d * d
        term = e / (2 * j + 1)
        total = total + term
    far = np.abs(x - mean) > 0.1 * (x + mean)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = x * np.log(np.where(x > 0, x, 1) / mean) + mean - x
    return np.where(far, plain, total)


def binomial_term(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of k in n trials, for 0 < k < n and 0 < p < 1; accurate for large n as well."""
    log = _stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - _deviance(k, n * p) - _deviance(n - k, n * (1 - p))
    return np.exp(log) * np.sqrt(n / (2 * math.pi * k * (n - k)))


def _fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function (modified Lentz), for x below about (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, on, m = d.copy(), np.arange(len(x)), 0
    while len(on):
        m += 1
        ao, bo, xo = a[on], b[on], x[on]
        for step in (m * (bo - m) * xo / ((ao + 2 * m - 1) * (ao + 2 * m)), -(ao + m) * (ao + bo + m) * xo / ((ao + 2 * m) * (ao + 2 * m + 1))):
            d[on] = 1 + step * d[on]
            d[on] = 1 / np.where(np.abs(d[on]) < tiny, tiny, d[on])
            c[on] = 1 + step / c[on]
            c[on] = np.where(np.abs(c[on]) < tiny, tiny, c[on])
            change = c[on] * d[on]
            h[on] *= change
        on = on[np.abs(change - 1) > 1e-15]
        if m > 10_000_000:
            raise ValueError("the continued fraction does not converge")
    return h


def binomial_cdf(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of at most k in n trials, for 0 < p < 1: the regularised incomplete beta function of 1 - p at (n - k, k + 1)."""
    k, n, p = (np.asarray(v, float) for v in np.broadcast_arrays(k, n, p))
    out = np.where(k < 0, 0.0, 1.0)
    at = np.flatnonzero((k >= 0) & (k < n))
    a, b, x = n[at] - k[at], k[at] + 1, 1 - p[at]
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, p[at], x)
    part = binomial_term(a, a + b, x) * b / (a + b) * _fraction(a, b, x)
    out[at] = np.where(swap, 1 - part, part)
    return out


def binomial_quantile(q: float, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The least k whose distribution function is q or more; 0 without trials."""
    n, p = np.broadcast_arrays(np.asarray(n, float), np.asarray(p, float))
    low, high = np.full(n.shape, -1.0), np.where(p >= 1, n, np.where(p <= 0, 0.0, n))
    low = np.where((p <= 0) | (p >= 1), high - 1, low)
    while len(on := np.flatnonzero(high - low > 1)):
        middle = np.floor((low[on] + high[on]) / 2)
        enough = binomial_cdf(middle, n[on], p[on]) >= q
        high[on], low[on] = np.where(enough, middle, high[on]), np.where(enough, low[on], middle)
    return high


def exact_interval(wins: np.ndarray, total: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the central 1 - alpha of resampled rates, for arrays of counts; zeros without trials."""
    wins, total = np.asarray(wins, float), np.asarray(total, float)
    n = np.maximum(total, 1)
    return tuple(np.where(total > 0, binomial_quantile(q, total, wins / n) / n, 0.0) for q in (alpha / 2, 1 - alpha / 2))


def parametric_interval(wins: int, total: int, n: int = 10_000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """Percentiles of binomial resamples of a proportion; zeros without trials."""
    if not total:
        return 0.0, 0.0
    draws = np.random.RandomState(seed).binomial(total, wins / total, n) / total
    low, high = np.percentile(draws, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def resampled_interval(outcomes: np.ndarray, n: int = 10_000, alpha: float = 0.05, seed: int = 42) -> tuple[float, float]:
    """Percentiles of means of resamples of 0/1 outcomes, a block of draws at a time."""
    if not len(outcomes):
        return 0.0, 0.0
    rng = np.random.default_rng(seed)
    step = max(1, 2_000_000 // len(outcomes))
    means = np.concatenate([rng.choice(outcomes, (min(step, n - i), len(outcomes))).mean(1) for i in range(0, n, step)])
    low, high = np.percentile(means, [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return float(low), float(high)


def interval(wins: Column, total: Column, alpha: float = 0.05, draws: int | None = None, seed: int = 42) -> Column:
    """struct<low, high>: exact, or by so many ``draws``; a null count is 0."""

    @F.pandas_udf("low double, high double")
    def bounds(w: pd.Series, t: pd.Series) -> pd.DataFrame:
        if draws is None:
            low, high = exact_interval(w.to_numpy(), t.to_numpy(), alpha)
            return pd.DataFrame({"low": low, "high": high})
        return pd.DataFrame([parametric_interval(int(a), int(b), draws, alpha, seed) for a, b in zip(w, t, strict=True)], columns=["low", "high"])

    return bounds(F.coalesce(wins, F.lit(0)).cast("long"), F.coalesce(total, F.lit(0)).cast("long"))


def resampled(outcomes: DataFrame, by: str, value: str, alpha: float = 0.05, draws: int | None = None, seed: int = 42) -> DataFrame:
    """by, wins, total, low, high: intervals of the mean of 0/1 outcomes by resampling.

    A resample of 0/1 outcomes is decided by their counts, so the rows are summed up before the shuffle and a group of any size is two numbers.
    """
    counts = outcomes.groupBy(by).agg(F.coalesce(F.sum(F.col(value).cast("long")), F.lit(0)).alias("wins"), F.count(value).alias("total"))
    return counts.withColumn("_i", interval(F.col("wins"), F.col("total"), alpha, draws, seed)).select(by, "wins", "total", F.col("_i.low").alias("low"), F.col("_i.high").alias("high"))


def with_intervals(counts: DataFrame, wins: str = "wins", total: str = "total", alpha: float = 0.05, draws: int | None = None) -> DataFrame:
    """Adds ci_low, ci_high, significant (ci_low > 0.5), effect (Cohen's h against one half), effect_size and the rate as text."""
    out = counts.withColumn("_ci", interval(F.col(wins), F.col(total), alpha, draws)).withColumns({"ci_low": F.col("_ci.low"), "ci_high": F.col("_ci.high")}).drop("_ci")
    point = scoring.rate(F.col(wins), F.col(total))
    h = scoring.cohens_h(point, 0.5)
    return out.withColumns({"significant": (F.col(total) > 0) & (F.col("ci_low") > 0.5), "effect": h, "effect_size": scoring.effect_label(h), "rate_text": scoring.win_rate_text(F.col(total), point, F.col("ci_low"), F.col("ci_high"))})


def verdict(rates: DataFrame, method: str, control: str, random: str) -> DataFrame:
    """One row with the verdict on a method, from rows of config, win_rate, significant."""
    of = lambda arm, c, d: F.coalesce(F.max(F.when(F.col("config") == arm, F.col(c))), F.lit(d))
    one = rates.agg(of(method, "win_rate", 0.0).alias("m"), of(control, "win_rate", 0.0).alias("c"), of(random, "win_rate", 0.0).alias("r"), of(method, "significant", False).alias("ms"), of(control, "significant", False).alias("cs"))
    return one.select(F.col("m").alias("method_rate"), F.col("c").alias("control_rate"), F.col("r").alias("random_rate"), scoring.verdict(*(F.col(x) for x in ("m", "c", "r", "ms", "cs"))).alias("verdict"))
