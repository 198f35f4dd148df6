"""Scoring and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolex.functions import stats as st

LEVELS = (0, 1, 2, 3)
#: Parts of a word's rows in bucketed tables, so that a frequent word is no hot bucket.
SALTS = 16


def salted_counts(user_words: DataFrame, key: str = "user_id") -> DataFrame:
    """User counts with the ``salt`` that a table bucketed by word and salt needs."""
    return user_words.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))


def salted_model(model_wide: DataFrame) -> DataFrame:
    """The model, one row per word, once for each salt."""
    return model_wide.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def classify(user_words: DataFrame, users: DataFrame, model_wide: DataFrame,
             key: str = "user_id", on: tuple[str, ...] = ("word",), tasks: int | None = None) -> DataFrame:
    """score = sum(share * slope_k) over the user's words (J8 + M4);
    predicted level = first argmax (W7).

    ``user_words`` is ``(key, word, cnt)``.  The score is linear in the shares,
    so sum(cnt * slope_k) / sum(cnt) needs no join of per-user totals: one
    left join on the word (only words with a weight; an absent word weighs 0)
    and one aggregate.  Users whose words all miss the model score 0 (level 0);
    users without any word never appear and are not classified (P12); the
    inner join to ``users`` attaches their other columns.  ``on`` has ``salt``
    too where both sides are salted; with ``tasks`` they are dealt out by ``on``, so that
    a task joins (and sums by user) its part of the rows only, whatever the number of users.
    """
    slopes = [F.col(f"slope_{k}") for k in LEVELS]
    weights = model_wide.select(*on, *slopes).filter(F.greatest(*[F.abs(s) for s in slopes]) > 0)
    if tasks:
        user_words, weights = user_words.repartition(tasks, *on), weights.repartition(tasks, *on)
    scored = (user_words.join(weights, list(on), "left").groupBy(key)
              .agg(*[(F.sum(F.col("cnt") * F.coalesce(F.col(f"slope_{k}"), F.lit(0.0))) / F.sum("cnt"))
                     .alias(f"score_{k}") for k in LEVELS]))
    out = users.join(scored, key, "inner")
    scores = F.array(*[F.col(f"score_{k}") for k in LEVELS])
    return out.select(*users.columns, *[F.col(f"score_{k}") for k in LEVELS],
                      st.argmax_first(scores).alias("predicted_level"))


def evaluate(predictions: DataFrame, targets: DataFrame, key: str = "fip") -> DataFrame:
    """Per region the share of users predicted at each level (A8,
    absent = 0) against the true fractions (``targets``: y0..y3), and the
    mean absolute error of the two 4-vectors (M5)."""
    n = F.count(F.lit(1))
    dist = predictions.groupBy(key).agg(
        *[(F.count_if(F.col("predicted_level") == k) / n).alias(f"pred_{k}") for k in LEVELS],
        n.alias("n_users"))
    joined = dist.join(targets, key)
    err = sum((F.abs(F.col(f"pred_{k}") - F.col(f"y{k}")) for k in LEVELS), F.lit(0.0)) / F.lit(4.0)
    return joined.select(key, "n_users", *[f"y{k}" for k in LEVELS], *[f"pred_{k}" for k in LEVELS],
                         err.alias("error"))


def mean_error(evaluation: DataFrame) -> DataFrame:
    """A10: unweighted mean of the per-region errors."""
    return evaluation.agg(F.avg("error").alias("mean_error"), F.count(F.lit(1)).alias("n_regions"))
