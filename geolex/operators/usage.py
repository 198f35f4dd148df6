"""Word usage between education groups: which words do the groups of regions use differently.

Regions are grouped by the level in which they stand out from the average of all regions.  Each word has a
2 x levels table, its occurrences and those of all other words by group, whose G statistic (the
log-likelihood ratio against equal usage) is compared with the chi-squared distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolex.functions import stats as st

LEVELS = (0, 1, 2, 3)


def level_groups(targets: DataFrame, key: str = "fip") -> DataFrame:
    """``(key, level)``: the level whose share lies furthest above its mean over the regions (first on
    ties).  Regions with a null share have no group.  The means are a one-row broadcast."""
    means = targets.agg(*[F.avg(f"y{k}").alias(f"_mean{k}") for k in LEVELS])
    above = F.array(*[F.round(F.col(f"y{k}") - F.col(f"_mean{k}"), 9) for k in LEVELS])
    known = targets.dropna(subset=[f"y{k}" for k in LEVELS])
    return known.crossJoin(F.broadcast(means)).select(key, st.argmax_first(above).alias("level"))


def _times_log(n: Column, expected: Column) -> Column:
    return F.when(n > 0, n * F.log(n / expected)).otherwise(F.lit(0.0))


def word_usage(counts: DataFrame, groups: DataFrame, key: str = "fip") -> DataFrame:
    """``(word, n_0..n_3, g, pval, top_level)`` from ``(key, word, cnt)``: occurrences by group, the G
    statistic, its p-value (null if fewer than two groups have words) and the group that
    uses the word most above expectation (first on ties).

    ``groups`` has one row per region; the counts are combined by word before their shuffle, and the
    groups' totals are one row.  ``counts`` is read twice, so it should be a written table."""
    by_level = counts.join(groups, key)

    def sums(prefix: str) -> list[Column]:
        return [F.sum(F.when(F.col("level") == k, F.col("cnt")).otherwise(F.lit(0))).alias(f"{prefix}{k}") for k in LEVELS]

    totals = by_level.agg(*sums("_t"))
    words = by_level.groupBy("word").agg(*sums("n_")).crossJoin(F.broadcast(totals))
    of_word = sum((F.col(f"n_{k}") for k in LEVELS), F.lit(0)).cast("double")
    of_all = sum((F.col(f"_t{k}") for k in LEVELS), F.lit(0)).cast("double")
    g, over = F.lit(0.0), []
    for k in LEVELS:
        n, t = F.col(f"n_{k}").cast("double"), F.col(f"_t{k}").cast("double")
        expected = of_word * t / of_all
        g = g + _times_log(n, expected) + _times_log(t - n, t - expected)
        over.append(F.when(t > 0, F.round(n / expected, 9)).otherwise(F.lit(0.0)))
    freedom = sum((F.when(F.col(f"_t{k}") > 0, 1).otherwise(0) for k in LEVELS), F.lit(-1))
    scored = words.select("word", *[f"n_{k}" for k in LEVELS], F.greatest(g * 2.0, F.lit(0.0)).alias("g"),
                          freedom.alias("_df"), st.argmax_first(F.array(*over)).alias("top_level"))
    return scored.select("word", *[f"n_{k}" for k in LEVELS], "g",
                         st.chi2_tail("g", "_df", len(LEVELS) - 1).alias("pval"), "top_level")
