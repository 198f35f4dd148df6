"""Reports and map-ready data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_regions(wide: DataFrame, level_cols: Sequence[str], key: str = "fips", n: int = 10,
                keep: Sequence[str] = ()) -> DataFrame:
    """The ``n`` regions with the highest value of each level column, with the
    ``keep`` columns and all levels of the ranked row.

    One scan: each row is turned into one row per level and ranked inside the
    level.  ``rank <= n`` plans a partial and a final window group limit, so
    n rows per level and partition reach the shuffle.
    """
    rows = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"`{c}`").alias("pct"))
                     for i, c in enumerate(level_cols)])
    extra = [F.col(f"`{c}`") for c in (*keep, *(level_cols if keep else ()))]
    w = Window.partitionBy("level").orderBy(F.col("pct").desc(), F.col(key).asc())
    return (wide.select(F.col(key), *extra, F.inline(rows))
            .withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n))


def order_by_level(wide: DataFrame, level_col: str, key: str = "fips") -> DataFrame:
    """All rows by one level, descending, ties by key (range-partitioned sort)."""
    return wide.orderBy(F.col(f"`{level_col}`").desc(), F.col(key).asc())


def long_levels(df: DataFrame, key: str, value_cols: Sequence[str]) -> DataFrame:
    """M7: wide level columns -> ``(key, level, value)``."""
    rows = F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"`{c}`").cast("double").alias("value"))
                     for i, c in enumerate(value_cols)])
    return df.select(key, F.inline(rows))


def bin_edges(wide: DataFrame, value_cols: Sequence[str], k: int = 16) -> DataFrame:
    """A11 + M6: per level, ``k`` equal-width edges from min to max
    (``linspace``: edge_i = i * step + min, the last edge = max).

    One aggregate over the wide rows gives all minima and maxima; the four
    level rows are made from its single row."""
    agg = wide.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{name}{i}")
                     for i, c in enumerate(value_cols) for f, name in ((F.min, "lo"), (F.max, "hi"))])
    mm = agg.select(F.inline(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"lo{i}").alias("lo"),
                                                F.col(f"hi{i}").alias("hi")) for i in range(len(value_cols))])))
    step = (F.col("hi") - F.col("lo")) / F.lit(k - 1)
    edges = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                        lambda i: F.when(i == k - 1, F.col("hi")).otherwise(i * step + F.col("lo")))
    return mm.select("level", "lo", "hi", edges.alias("edges"))


def level_bins(df: DataFrame, key: str, value_cols: Sequence[str], k: int = 16) -> DataFrame:
    """``(key, level, value, bin)``; bin = number of edges <= value.

    The edge table has one row per level (4 rows), so its broadcast is
    bounded by construction.
    """
    long = long_levels(df, key, value_cols)
    edges = bin_edges(df, value_cols, k)
    joined = long.join(F.broadcast(edges), "level")
    nbin = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    return joined.select(key, "level", "value", nbin.cast("long").alias("bin"))
