"""Decoding raw posts into a table, with its counts and a quarantine from the same pass.

The lines are read and decoded once, by the job that writes the records.  Its counts are observed on
the lines as they flow into that job's only stage, where Spark counts each task once however often
it is repeated.  Lines that are no JSON of the schema go to the same table, with their text in
``_corrupt``; ``quarantine`` is that part of it.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolex.sources import schemas
from geolex.sources.readers import decode_lines


class Ingested(NamedTuple):
    """Records, quarantined lines (``value`` and the columns carried) and the counts of the pass:
    ``total`` lines, of which ``corrupt``, ``notice`` (valid JSON without a post), ``dropped`` by the filter, and
    ``valid`` records."""

    records: DataFrame
    quarantine: DataFrame
    counts: dict[str, int]


def ingest_posts(lines: DataFrame, path: str, keep: Column | None = None, col: str = "value",
                 schema: T.StructType = schemas.RAW_POST, carry: tuple[str, ...] = (),
                 shape: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """Writes the posts in ``lines`` that ``keep`` (a condition on the decoded columns) holds for, and all
    corrupt lines, to ``path`` as Parquet.  ``shape`` may change decoded columns before; ``carry`` names columns of
    ``lines`` that stay with every row."""
    decoded = decode_lines(lines, col, schema, carry=carry)
    decoded = shape(decoded) if shape else decoded
    corrupt = F.col("_corrupt").isNotNull()
    post = ~corrupt & F.col("user").isNotNull()
    kept = post if keep is None else post & F.coalesce(keep, F.lit(False))
    told = decoded.select("*", corrupt.alias("_is_corrupt"), post.alias("_is_post"), kept.alias("_is_kept"))
    seen = Observation()
    counted = told.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if("_is_corrupt").alias("corrupt"),
                           F.count_if(~F.col("_is_corrupt") & ~F.col("_is_post")).alias("notice"),
                           F.count_if(F.col("_is_post") & ~F.col("_is_kept")).alias("dropped"),
                           F.count_if("_is_kept").alias("valid"))
    out = counted.filter(F.col("_is_kept") | F.col("_is_corrupt")).drop("_is_corrupt", "_is_post", "_is_kept")
    out.write.parquet(path)
    table = lines.sparkSession.read.schema(out.schema).parquet(path)
    counts = {name: int(n or 0) for name, n in seen.get.items()}
    return Ingested(table.filter("_corrupt IS NULL").drop("_corrupt"),
                    table.filter("_corrupt IS NOT NULL").select(*carry, F.col("_corrupt").alias("value")), counts)


def observed_write(df: DataFrame, write: Callable[[DataFrame], None], name: str = "written") -> int:
    """Runs ``write`` on ``df`` and returns the number of rows that it wrote, without reading them again."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias(name)))
    return int(seen.get[name] or 0)
