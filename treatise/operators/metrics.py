"""Ranking metrics and the paired comparison of two retrievers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import upper_median
from .outline import path_depth

CUTS = (1, 3, 5)
_METRICS = [*(f"recall_at_{k}" for k in CUTS), "mrr", "ndcg_at_3", "mean_rank"]


def _aggregates(rank: Column) -> list[Column]:
    recall = [F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in CUTS]
    gain = F.when(rank <= 3, 1 / F.log2(rank + 1)).otherwise(0.0)
    return [*recall, F.avg(F.coalesce(1 / rank, F.lit(0.0))).alias("mrr"), F.avg(gain).alias("ndcg_at_3"), F.avg(rank).alias("mean_rank")]


def micro_metrics(ranks: DataFrame, rank: str = "gold_rank") -> DataFrame:
    """M1-M4, M7: one row over all queries; a null rank (outside of the beam) counts as 0."""
    r = F.col(rank)
    return ranks.agg(F.count("*").alias("n_queries"), *_aggregates(r), upper_median(rank).cast(dict(ranks.dtypes)[rank]).alias("median_rank"))


def leaf_metrics(ranks: DataFrame, leaf: str = "gold_leaf_id", rank: str = "gold_rank") -> DataFrame:
    """M5"""
    return ranks.groupBy(leaf).agg(F.count("*").alias("n_queries"), *_aggregates(F.col(rank)))


def macro_metrics(ranks: DataFrame, leaf: str = "gold_leaf_id", rank: str = "gold_rank") -> DataFrame:
    """M6, M8: the mean over leaves, each with the same weight."""
    return leaf_metrics(ranks, leaf, rank).agg(F.count("*").alias("n_leaves"), *(F.avg(m).alias(m) for m in _METRICS))


def milliseconds_per_query(seconds: Column, n_queries: Column) -> Column:
    """M9: null without queries."""
    return F.try_divide(seconds * 1000.0, n_queries)


def truncate(ranks: DataFrame, k: int) -> DataFrame:
    """M7: ranks beyond the beam become null."""
    return ranks.withColumn("gold_rank", F.when(F.col("gold_rank") <= k, F.col("gold_rank")))


def pairing_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that one side lacks, and ids whose query, leaf or unit differs."""
    x, y = a.alias("x"), b.alias("y")
    joined = x.join(y, F.col("x.id") == F.col("y.id"), "full_outer")
    differs = ~F.col("x.query").eqNullSafe(F.col("y.query")) | ~F.col("x.gold_leaf_id").eqNullSafe(F.col("y.gold_leaf_id"))
    problem = F.when(F.col("x.id").isNull(), "only in second").when(F.col("y.id").isNull(), "only in first").when(differs, "fields differ")
    return joined.select(F.coalesce("x.id", "y.id").alias("id"), problem.alias("problem")).where("problem IS NOT NULL")


def pair(a: DataFrame, b: DataFrame, splits: DataFrame | None = None) -> DataFrame:
    """(id, gold_leaf_id, path, correct_a, correct_b, outcome, depth, leaf_in_dev, train_count)."""
    first = lambda r: F.coalesce(r == 1, F.lit(False))
    rows = a.select("id", "gold_leaf_id", "canonical_path", first(F.col("gold_rank")).alias("correct_a")).join(b.select("id", first(F.col("gold_rank")).alias("correct_b")), "id")
    outcome = F.when(F.col("correct_a") & F.col("correct_b"), "both_correct").when(F.col("correct_a"), "first_only").when(F.col("correct_b"), "second_only").otherwise("both_wrong")
    rows = rows.withColumn("outcome", outcome).withColumn("depth", path_depth(F.col("canonical_path")))
    if splits is None:
        return rows
    seen = splits.groupBy("gold_leaf_id").agg(F.count_if(F.col("split") == "train").alias("train_count"), (F.count_if(F.col("split") == "dev") > 0).alias("leaf_in_dev"))
    return rows.join(seen, "gold_leaf_id", "left").fillna({"train_count": 0}).withColumn("leaf_in_dev", F.coalesce("leaf_in_dev", F.lit(False)))


def outcome_histogram(paired: DataFrame) -> DataFrame:
    """All four outcomes, zeros included."""
    names = F.explode(F.array(*(F.lit(x) for x in ("both_correct", "first_only", "second_only", "both_wrong"))))
    counts = paired.groupBy("outcome").agg(F.count("*").alias("n"))
    return paired.sparkSession.range(1).select(names.alias("outcome")).join(counts, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def mcnemar(counts: DataFrame, b: str = "b", c: str = "c") -> DataFrame:
    """C4: exact two-sided p of discordant counts, with logarithms of factorials; 1 when there are none.

    The terms of one pair of counts are generated and summed as rows: min(b, c) + 1 of them.
    """
    n, least = F.col(b) + F.col(c), F.least(b, c)
    rows = counts.select(b, c, F.explode(F.sequence(F.lit(0).cast("bigint"), least.cast("bigint"))).alias("i"))
    # ln C(n, i) is the running sum of ln((n - i + 1) / i).
    step = F.when(F.col("i") > 0, F.ln((n - F.col("i") + 1) / F.col("i"))).otherwise(0.0)
    ln_comb = F.sum(step).over(Window.partitionBy(b, c).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("term", F.exp(ln_comb - n * F.ln(F.lit(2.0))))
    return rows.groupBy(b, c).agg(F.least(F.lit(1.0), F.sum("term") * 2).alias("p_value"))


def bootstrap(paired: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """2.5, 50 and 97.5 percentiles of the resampled mean of second minus first.

    The means of resamples with replacement depend only on how often each difference (-1, 0, 1) was drawn, so the
    aggregate of three counts is all that reaches the one task that draws them.
    """
    delta = F.col("correct_b").cast("int") - F.col("correct_a").cast("int")
    counts = paired.groupBy(delta.alias("delta")).agg(F.count("*").alias("n")).withColumn("one", F.lit(0))

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        total = int(group["n"].sum())
        drawn = np.random.default_rng(seed).multinomial(total, group["n"] / total, resamples)
        means = drawn @ group["delta"].to_numpy() / total
        return pd.DataFrame([np.quantile(means, [0.025, 0.5, 0.975])], columns=["low", "median", "high"])

    return counts.orderBy("delta").groupBy("one").applyInPandas(draw, "low double, median double, high double")


def stratum_metrics(paired: DataFrame, by: list[str]) -> DataFrame:
    """N, both recalls, their difference and the share that either gets right, for each stratum."""
    share = lambda c: F.avg(c.cast("double"))
    rows = paired.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("correct_a")).alias("recall_a"), share(F.col("correct_b")).alias("recall_b"), share(F.col("correct_a") | F.col("correct_b")).alias("recall_either"))
    return rows.withColumn("delta", F.col("recall_b") - F.col("recall_a"))


def relative_change(a: Column, b: Column) -> Column:
    """(b - a) / a, null when a is 0."""
    return F.try_divide(b - a, a)


def extremes(strata: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The n lowest and the n highest differences, ties by key."""
    low = strata.orderBy("delta", key).limit(n).withColumn("end", F.lit("lowest"))
    return low.unionByName(strata.orderBy(F.desc("delta"), key).limit(n).withColumn("end", F.lit("highest")))


def first_present(*names: str) -> Column:
    """C11: the first of several alias columns that has a value."""
    return F.coalesce(*names)


def tolerance_violations(actual: DataFrame, expected: DataFrame, tolerance: float = 5.1e-5) -> DataFrame:
    """(metric, actual, expected) that differ by more; a missing value violates too."""
    joined = expected.join(actual, "metric", "full_outer")
    return joined.where(F.coalesce(F.abs(F.col("actual") - F.col("expected")) > tolerance, F.lit(True))).select("metric", "actual", "expected")


def leaderboard(rows: DataFrame) -> DataFrame:
    """K8: one Markdown table, best first recall on top."""
    line = F.format_string("| %s | %.4f | %.4f | %.4f | %.4f |", "method", "recall_at_1", "recall_at_3", "recall_at_5", "mrr")
    body = rows.agg(F.array_sort(F.collect_list(F.struct((-F.col("recall_at_1")).alias("o"), F.col("method"), line.alias("line")))).alias("rows"))
    head = "| Method | R@1 | R@3 | R@5 | MRR |\n| --- | ---: | ---: | ---: | ---: |\n"
    return body.select(F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("markdown"))
