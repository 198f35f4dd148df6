"""Profiles that grow archive by archive (A1, A2).

Posts come in archives, one a year, some of them still growing.  What a profile needs of an archive is
stored as mergeable counts: ``(archive, fip, word, cnt, url_count, emoji_count)``, one row per region and
word, and one per region with a null word whose ``cnt`` is its number of posts.  The store is
partitioned by archive, and adding an archive replaces just its partition, so it reads
that archive alone and may be repeated (after a failure, or for an archive that has grown).
Shares and totals of any set of archives are sums over the store.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolex.functions import text as tx
from geolex.operators import profiles

SCHEMA = "{key} {kind}, word string, cnt long, url_count long, emoji_count long, archive string"


def archive_counts(persons: DataFrame, key: str = "fip") -> DataFrame:
    """The counts of one archive's person records, from one pass over their texts."""
    words = F.concat(F.array(F.lit(None).cast("string")), tx.tokens(F.col("filtered_text")))
    rows = persons.select(key, "url_count", "emoji_count", F.explode(words).alias("word"))
    post = F.col("word").isNull()
    return rows.groupBy(key, "word").agg(F.count(F.lit(1)).alias("cnt"),
                                         F.sum(F.when(post, F.col("url_count"))).cast("long").alias("url_count"),
                                         F.sum(F.when(post, F.col("emoji_count"))).cast("long").alias("emoji_count"))


def add_archive(persons: DataFrame, archive: str, path: str, key: str = "fip") -> None:
    """Stores the counts of ``archive``, in place of any that it has there."""
    (archive_counts(persons, key).withColumn("archive", F.lit(archive)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("archive").parquet(path))


def stored_counts(spark: SparkSession, path: str, archives: Iterable[str] | None = None, key: str = "fip",
                  kind: str = "long") -> DataFrame:
    """The store, or some archives of it (other partitions are not read)."""
    rows = spark.read.schema(SCHEMA.format(key=key, kind=kind)).parquet(path)
    return rows if archives is None else rows.filter(F.col("archive").isin(list(archives)))


def stored_shares(counts: DataFrame, key: str = "fip") -> DataFrame:
    """A2: ``(key, word, cnt, share)`` over the archives in ``counts``."""
    return profiles.shares(profiles.rollup_counts(counts.filter(F.col("word").isNotNull()), key), key, few_keys=True)


def stored_totals(counts: DataFrame, key: str = "fip") -> DataFrame:
    """A1: ``(key, tweet_count, url_count, emoji_count)`` over the archives in ``counts``."""
    return counts.filter(F.col("word").isNull()).groupBy(key).agg(
        F.sum("cnt").alias("tweet_count"), F.sum("url_count").alias("url_count"), F.sum("emoji_count").alias("emoji_count"))
