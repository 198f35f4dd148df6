"""Word model: observations, per-word regression, correction, gate (R1-R6,
A5-A7, A12, P10-P13, W4-W6).

All four levels are fitted in one ``groupBy(word)`` with 4 x
``covar_pop``/``stddev_pop`` (partial aggregation; a hot word is combined
map-side), instead of four passes and a union.  Because x and y are z-scored
in the reference, the regression slope equals Pearson's r.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolex.functions import stats as st
from geolex.functions import text as tx
from geolex.session import materialize

LEVELS = (0, 1, 2, 3)


def drop_stop_words(words: DataFrame, stop_words: Iterable[str] | DataFrame, col: str = "word") -> DataFrame:
    """P10: remove stop words; the typographic apostrophe is normalised for
    the comparison only (T13).  A table of stop words (column ``word``) is an
    anti join, whatever its size; a list is an array literal."""
    if isinstance(stop_words, DataFrame):
        stop = stop_words.select(F.col("word").alias("_stop"))
        return words.join(stop, tx.ascii_apostrophe(col) == F.col("_stop"), "left_anti")
    stop = F.array(*[F.lit(w) for w in sorted(set(stop_words))])
    return words.filter(~F.array_contains(stop, tx.ascii_apostrophe(col)))


def observations(words: DataFrame, targets: DataFrame, stop_words: Iterable[str] = (),
                 key: str = "fip", trim: bool = False, tasks: int | None = None) -> DataFrame:
    """M2 + P10 (+ T11, P11): one row per (region, word) with x = share and
    y_k = level k as a fraction (M1).

    ``targets`` is ``(key, y0, y1, y2, y3)`` in fractions.  With ``trim``
    the word is trimmed (T11), empty words and the literal ``NaN`` dropped
    (D7, P11); trimmed duplicates stay separate observations (R2).  With
    ``tasks`` the rows, of which a word has few, are dealt out by word, so that what is
    aggregated by word needs no other exchange and each task holds its part of the words only.
    """
    w = words.select(key, "word", F.col("share").alias("x"))
    if isinstance(stop_words, DataFrame) or stop_words:
        w = drop_stop_words(w, stop_words)
    if trim:
        w = (w.withColumn("word", tx.trim_word("word"))
             .filter((F.col("word") != "") & (F.col("word") != "NaN")))
    return (w.repartition(tasks, "word") if tasks else w).join(targets, key)


def tested_words(obs: DataFrame, min_n: int, *aggs) -> DataFrame:
    """A5: the words with more than ``min_n`` observations: ``(word, count, aggs...)``."""
    counted = obs.groupBy("word").agg(F.count(F.lit(1)).alias("count"), *aggs)
    return counted.filter(F.col("count") > min_n)


def bonferroni_factor(tested: DataFrame) -> DataFrame:
    """The number of tested words, as one row ``(m)``."""
    return tested.agg(F.count(F.lit(1)).alias("m"))


def fit_word_model(obs: DataFrame, min_n: int = 3, alpha: float = 0.05, min_slope: float = 0.1,
                   bonferroni: bool = True, gate: bool = True) -> DataFrame:
    """``(word, level, slope, pval, count)``.

    * A5: words with more than ``min_n`` observations;
    * R1: slope = r = covar_pop / (stddev_pop x * stddev_pop y); null when
      either side is constant (D14);
    * R3: two-sided p-value with n-2 degrees of freedom;
    * A6/R4: p multiplied by the number of tested words (uncapped); the
      per-word aggregates are written once, as both the model and the number
      of words read them;
    * R5: slope set to 0 when corrected p > alpha or slope < min_slope.
    """
    aggs = [F.stddev_pop("x").alias("sx"),
            F.min("x").alias("minx"), F.max("x").alias("maxx")]
    for k in LEVELS:
        y = f"y{k}"
        aggs += [F.covar_pop("x", y).alias(f"c{k}"), F.stddev_pop(y).alias(f"s{k}"),
                 F.min(y).alias(f"lo{k}"), F.max(y).alias(f"hi{k}")]
    per_word = tested_words(obs, min_n, *aggs)
    if bonferroni:
        per_word = materialize(per_word, "per_word")

    def slope(k):
        ok = (F.col("minx") < F.col("maxx")) & (F.col(f"lo{k}") < F.col(f"hi{k}"))
        return F.when(ok, F.col(f"c{k}") / F.nullif(F.col("sx") * F.col(f"s{k}"), F.lit(0.0)))

    rows = F.array(*[F.struct(F.lit(k).alias("level"), slope(k).alias("slope")) for k in LEVELS])
    model = per_word.select("word", "count", F.inline(rows))
    model = model.withColumn("pval", st.corr_p_value("slope", "count"))
    if bonferroni:
        # one-row aggregate, broadcast to every partition (1-row cross join)
        m = bonferroni_factor(per_word)
        model = model.crossJoin(F.broadcast(m)).withColumn("pval", F.col("pval") * F.col("m"))
    if gate:
        drop = F.col("slope").isNull() | (F.col("pval") > alpha) | (F.col("slope") < min_slope)
        model = model.withColumn("slope", F.when(drop, F.lit(0.0)).otherwise(F.col("slope")))
    return model.select("word", F.col("level").cast("int").alias("level"), "slope", "pval",
                        F.col("count").cast("long").alias("count"))


def model_wide(model: DataFrame) -> DataFrame:
    """One row per word with slope_k / pval_k / count_k (absent = 0)."""
    aggs = []
    for k in LEVELS:
        is_k = F.col("level") == k
        aggs += [F.coalesce(F.max(F.when(is_k, F.col("slope"))), F.lit(0.0)).alias(f"slope_{k}"),
                 F.coalesce(F.max(F.when(is_k, F.col("pval"))), F.lit(0.0)).alias(f"pval_{k}"),
                 F.coalesce(F.max(F.when(is_k, F.col("count"))), F.lit(0)).cast("long").alias(f"count_{k}")]
    return model.groupBy("word").agg(*aggs)


def report_filter(model: DataFrame, level: int = 3, min_n: int = 15, max_p: float = 0.2) -> DataFrame:
    """P13."""
    return model.filter((F.col("level") == level) & (F.col("count") > min_n) & (F.col("pval") < max_p))


def top_words(model: DataFrame, level: int = 3, min_n: int = 15, max_p: float = 0.2,
              n: int = 20, ascending: bool = False) -> DataFrame:
    """The ``n`` words with the largest (smallest) slope, 1-based rank.

    ``orderBy().limit()`` plans a per-partition top-n and a merge of n rows
    per partition; the rank is numbered on those n rows only.
    """
    order = F.col("slope").asc() if ascending else F.col("slope").desc()
    top = report_filter(model, level, min_n, max_p).orderBy(order, F.col("word").asc()).limit(n)
    w = Window.orderBy(order, F.col("word").asc())
    return top.withColumn("rank", F.row_number().over(w).cast("long"))
