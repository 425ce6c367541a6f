"""Aggregations over judgments and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..lexicons import DIMENSIONS
from .relational import ranked, union_all, unpivot_scores


def _counts(won: Column, lost: Column) -> list[Column]:
    n = F.count("*")
    wins, losses = F.count_if(won), F.count_if(lost)
    return [wins.alias("wins"), losses.alias("losses"), (n - wins - losses).alias("ties"), n.alias("total"), scoring.rate(wins, n).alias("win_rate")]


def win_rates(judgments: DataFrame, baseline: str, *by: str, scope: str = "pair") -> DataFrame:
    """Wins, losses, ties, total and rate of each arm against the baseline, which may stand on either side.

    ``scope="config_b_only"``: all judgments whose second arm it is, whatever the first; only wins of the baseline are losses.
    """
    a, b, w = F.col("config_a"), F.col("config_b"), F.col("winner")
    arm = b if scope == "config_b_only" else F.when(a == baseline, b).when(b == baseline, a)
    return judgments.withColumn("config", arm).where(F.col("config").isNotNull() & (F.col("config") != baseline)).groupBy("config", *by).agg(*_counts(w == F.col("config"), w == baseline))


def win_rates_rollup(judgments: DataFrame, baseline: str, by: str) -> DataFrame:
    """As ``win_rates``, for each value of ``by`` and for all (null)."""
    w = F.col("winner")
    rows = judgments.where(F.col("config_a") == baseline).withColumnRenamed("config_b", "config")
    return rows.groupingSets([["config", by], ["config"]], "config", by).agg(*_counts(w == F.col("config"), w == baseline))


def dimension_deltas(judgments: DataFrame, dims: list[str] = DIMENSIONS) -> DataFrame:
    """Mean of the arm's score minus the baseline's, missing scores as 0."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return unpivot_scores(judgments, dims).groupBy(F.col("config_b").alias("config"), "dim").agg(F.avg(z("score_b") - z("score_a")).alias("delta"))


def dimension_deltas_by_order(judgments: DataFrame, arm: str, dims: list[str] = DIMENSIONS) -> DataFrame:
    """Mean of a - b of each dimension where ``arm`` was shown first, and of b - a elsewhere; rows that lack a score don't count.

    Scores that are already realigned to their arms change sign by the order shown; ``dimension_deltas`` is right for those.
    """
    rows = unpivot_scores(judgments, dims).where("score_a is not null and score_b is not null")
    delta = F.col("score_a") - F.col("score_b")
    return rows.groupBy("dim").agg(F.avg(F.when(F.get("order", F.lit(0)) == arm, delta).otherwise(-delta)).alias("delta"))


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of one record type in a log that mixes them; a null type is of none."""
    return rows.where(F.col("type") == kind)


def dimension_means(judgments: DataFrame, dims: list[str] = DIMENSIONS, flag_over: float = 0.3) -> DataFrame:
    rows = unpivot_scores(judgments, dims).where("score_a is not null and score_b is not null").groupBy("dim").agg(F.avg("score_b").alias("exp_mean"), F.avg("score_a").alias("base_mean"))
    delta = F.col("exp_mean") - F.col("base_mean")
    return rows.withColumn("delta", delta).withColumn("flag", F.when(F.abs(delta) > flag_over, "*").otherwise(""))


def generalization(judgments: DataFrame, baseline: str, test: DataFrame, key: str = "query_id") -> DataFrame:
    """Win rates on training and on test queries, and their gap, by arm; a gap only where both sides have judgments."""
    marked = judgments.join(test.select(key).distinct().withColumn("_t", F.lit(True)), key, "left").withColumn("split", F.when(F.col("_t"), "test").otherwise("train"))
    rows = win_rates(marked, baseline, "split").groupBy("config").pivot("split", ["train", "test"]).agg(F.first("wins").alias("wins"), F.first("total").alias("total"))
    rows = rows.fillna(0, ["train_wins", "train_total", "test_wins", "test_total"])
    gap = F.when((F.col("train_total") > 0) & (F.col("test_total") > 0), scoring.rate(F.col("train_wins"), F.col("train_total")) - scoring.rate(F.col("test_wins"), F.col("test_total")))
    return rows.withColumn("gap", gap)


def generalization_verdict(gaps: DataFrame) -> DataFrame:
    mean = F.avg("gap")
    return gaps.agg(mean.alias("mean_gap"), F.when(mean > 0.15, "POOR").when(mean > 0.05, "MODERATE").when(mean.isNotNull(), "GOOD").alias("verdict"))


def compounding(rates: DataFrame, first: str, second: str, combined: str) -> DataFrame:
    """Whether the combined arm beats the mean of its parts by 0.05 (YES), the better part (WEAK), or neither (NO); null unless all three rates are positive."""
    of = lambda arm: F.coalesce(F.max(F.when(F.col("config") == arm, F.col("win_rate"))), F.lit(0.0))
    one = rates.agg(of(first).alias("s"), of(second).alias("y"), of(combined).alias("c"))
    answer = F.when(F.expr("c > (s + y) / 2 + 0.05"), "YES").when(F.expr("c > greatest(s, y)"), "WEAK").otherwise("NO")
    return one.withColumn("compounding", F.when(F.expr("s > 0 and y > 0 and c > 0"), answer))


def three_comparisons(judgments: DataFrame, base: str, method: str, generic: str, by: str) -> DataFrame:
    """Win rates of method over generic, method over base and generic over base, by model."""

    def part(a, b, name):
        of = ((F.col("config_a") == a) & (F.col("config_b") == b)) | ((F.col("config_a") == b) & (F.col("config_b") == a))
        n = F.count_if(of)
        return [n.alias(f"{name}_total"), scoring.rate(F.count_if(of & (F.col("winner") == b)), n).alias(f"{name}_rate")]

    return judgments.groupBy(by).agg(*part(generic, method, "h2h"), *part(base, method, "method"), *part(base, generic, "generic"))


def model_matrix(rates: DataFrame, models: list[str], reference: str) -> DataFrame:
    """One row for each arm, one column for each model; mean over the models besides the reference, its difference from the reference, and how many models exceed one half."""
    wide = rates.groupBy("config").pivot("model", models).agg(F.first("win_rate"))
    others = F.array_compact(F.array(*(F.col(m) for m in models if m != reference)))
    mean = F.when(F.size(others) > 0, F.aggregate(others, F.lit(0.0), lambda a, x: a + x) / F.size(others))
    return wide.withColumn("mean_others", mean).withColumn("vs_reference", F.col("mean_others") - F.col(reference)).withColumn("n_over_half", F.size(F.filter(others, lambda x: x > 0.5)).cast("long"))


def technique_status(registry: DataFrame, rates: DataFrame) -> DataFrame:
    over = F.count_if(F.col("win_rate") > 0.5)
    n = F.count("win_rate")
    status = F.when(n == 0, "NO DATA").when(over == n, "VALIDATED").when(over > 0, "PARTIAL").otherwise("FAILED")
    return registry.join(rates, "config", "left").groupBy("config").agg(n.alias("models"), over.alias("over_half"), status.alias("status"))


def length_stats(rows: DataFrame, value: str = "word_count") -> DataFrame:
    """Mean, least and most by arm (target_op null) and by arm and operation."""
    return rows.groupingSets([["arm"], ["target_op", "arm"]], "target_op", "arm").agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def metric_means(rows: DataFrame, metrics: list[str], by: str = "arm") -> DataFrame:
    """Means with missing metrics as 0."""
    return rows.groupBy(by).agg(*(F.avg(F.coalesce(F.col(m), F.lit(0))).alias(m) for m in metrics))


def routing_stats(rows: DataFrame, by: str) -> DataFrame:
    """Rows that searched, their share, all searches, and mean calls (1 where unknown)."""
    n = F.size(F.coalesce("tool_calls", F.array().cast("array<string>")))
    return rows.withColumn("_n", n).groupBy(by).agg(F.count_if(F.col("_n") > 0).alias("searched"), scoring.rate(F.count_if(F.col("_n") > 0), F.count("*")).alias("search_rate"), F.sum("_n").alias("searches"), F.avg(F.coalesce("api_calls", F.lit(1))).alias("mean_calls"))


def most_common(rows: DataFrame, value: Column, missing: str = "UNKNOWN") -> DataFrame:
    """Frequencies, most first; ties in order of first appearance."""
    return rows.groupBy(F.coalesce(value, F.lit(missing)).alias("value")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq")


def value_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n of several columns in one pass."""
    return rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("_v")).groupBy("_v.column", "_v.value").agg(F.count("*").alias("n"))


def delta_summary(rows: DataFrame, column: str = "total_delta") -> DataFrame:
    return rows.agg(F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"))


def crosstab(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with row totals; empty cells are 0."""
    out = rows.groupBy(row).pivot(column, values).count().fillna(0, values)
    return out.withColumn("total", sum((F.col(f"`{v}`") for v in values[1:]), F.col(f"`{values[0]}`")))


def dataset_stats(raw: DataFrame, filtered: DataFrame, deduped: DataFrame, balanced: DataFrame, split: DataFrame, key: str) -> DataFrame:
    """One row: sizes after each step, test keys, and training counts by stage and by source."""
    train = split.where("split = 'train'")
    by = lambda c, name: train.groupBy(F.col(c).cast("string").alias("k")).count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "count")))).alias(name))
    size = lambda df, name: df.agg(F.count("*").alias(name))
    out = size(raw, "total_raw")
    for part in (size(filtered, "after_filter"), size(deduped, "after_dedup"), size(balanced, "after_balance"), size(train, "train_pairs"), split.where("split = 'test'").agg(F.count_distinct(key).alias("test_queries")), by("stage", "stage_distribution"), by("source", "source_distribution")):
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


def discrimination(scores: DataFrame, by: str = "config") -> DataFrame:
    """Mean and population variance of summed scores; null or empty score maps are left out."""
    return scores.where(F.col("scores").isNotNull() & (F.size("scores") > 0)).withColumn("total", F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))).groupBy(by).agg(F.count("*").alias("n"), F.avg("total").alias("mean"), F.var_pop("total").alias("variance"))


def separation(by_config: DataFrame) -> DataFrame:
    """Largest mean minus smallest; null for a single arm."""
    return by_config.agg(F.when(F.count("*") > 1, F.max("mean") - F.min("mean")).alias("separation"))


def mean_abs_correlation(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Mean |Pearson r| over all pairs of columns; needs more than two rows; pairs with a constant column are left out."""
    wide = rows.agg(F.count("*").alias("n"), *(F.stddev_pop(F.coalesce(c, F.lit(0.0))).alias(f"s_{c}") for c in columns), *(F.covar_pop(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))).alias(f"c_{a}_{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]))
    r = [F.when(F.col(f"s_{a}") * F.col(f"s_{b}") > 0, F.abs(F.col(f"c_{a}_{b}") / F.nullif(F.col(f"s_{a}") * F.col(f"s_{b}"), F.lit(0.0)))) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    found = F.array_compact(F.array(*r))
    return wide.select(F.when((F.col("n") > 2) & (F.size(found) > 0), F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.size(found)).alias("mean_abs_r"), F.size(found).cast("long").alias("pairs"))


def agreement(first: DataFrame, second: DataFrame, key: list[str], by: str) -> DataFrame:
    """How often the second judge names the first one's winner (UNKNOWN where there is none), for each value of ``by`` and for all (null)."""
    both = second.join(first.select(*key, F.col("winner").alias("_w")), key, "left").withColumn("agrees", F.col("winner") == F.coalesce("_w", F.lit("UNKNOWN")))
    return both.groupingSets([[by], []], by).agg(F.count("*").alias("n"), F.count_if(F.col("agrees")).alias("agreed"), F.avg(F.col("agrees").cast("double")).alias("agreement"))


def corpus_totals(docs: DataFrame, words: Column) -> DataFrame:
    return docs.agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.sum(words).alias("words"))


def running_wins(judgments: DataFrame, every: int = 20) -> DataFrame:
    """Wins so far after every ``every`` judgments of an arm, in ``seq`` order."""
    won = (F.col("winner") == F.col("config_b")).cast("long")
    rows = ranked(judgments.select("config_b", "winner", "seq"), "config_b", F.col("seq"), name="n", totals={"wins": won})
    return rows.where(F.col("n") % every == 0).select(F.col("config_b").alias("config"), F.col("n").cast("long"), "wins")


def _exact_sum(x: Column) -> Column:
    """Sum of doubles that doesn't depend on their order: of decimals of 12 places.  Values that these can't hold are added as doubles."""
    d = x.try_cast("decimal(38,12)")
    return F.coalesce(F.when(F.count(d) == F.count(x), F.try_sum(d).cast("double")), F.sum(x))


def overall_variance(frameworks: dict[str, DataFrame]) -> DataFrame:
    """framework, n, variance of all summed scores, and whether it discriminates most (the first one on a tie); no rows unless every framework has scores.

    Frameworks with equal scores have equal variances, however their rows are spread; those of ``var_pop`` differ in the last places.
    """
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    counted = lambda rows: rows.where(F.col("scores").isNotNull() & (F.size("scores") > 0)).groupBy(total.alias("total")).agg(F.count("*").alias("k"))
    totals = union_all([counted(rows).select(F.lit(i).alias("ord"), F.lit(name).alias("framework"), "total", "k") for i, (name, rows) in enumerate(frameworks.items())])
    means = totals.groupBy("ord").agg(F.sum("k").alias("n"), (_exact_sum(F.col("total") * F.col("k")) / F.sum("k")).alias("mean"))
    off = F.col("total") - F.col("mean")
    # One row for each framework, here and below.
    rows = totals.join(F.broadcast(means), "ord").groupBy("ord", "framework", "n").agg((_exact_sum(off * off * F.col("k")) / F.col("n")).alias("variance"))
    best = rows.agg(F.max(F.struct("variance", -F.col("ord"))).alias("b"), F.count("*").alias("found"))
    return rows.crossJoin(F.broadcast(best)).where(F.col("found") == len(frameworks)).select("framework", "n", "variance", (F.col("ord") == -F.col("b.col2")).alias("most_discriminating"))


def pair_wins(judgments: DataFrame) -> DataFrame:
    """Wins of each side and ties of every unordered pair of arms."""
    first, second = F.least("config_a", "config_b"), F.greatest("config_a", "config_b")
    w = F.col("winner")
    return judgments.groupBy(first.alias("first"), second.alias("second")).agg(F.count_if(w == first).alias("first_wins"), F.count_if(w == second).alias("second_wins"), F.count_if(w == "TIE").alias("ties"))


def mean_or_zero(value: str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def category_counts(docs: DataFrame, categories: list[str], column: str = "category") -> DataFrame:
    """Documents of each category, those without any (0) and "unclassified" included."""
    every = docs.sparkSession.createDataFrame([(c, i) for i, c in enumerate([*categories, "unclassified"])], f"{column} string, ord int")
    return every.join(docs.groupBy(column).agg(F.count("*").alias("docs")), column, "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
