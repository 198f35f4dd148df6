"""Structured Streaming form of the stateless part of X1.

Decode -> flatten -> located filter -> place parts -> name resolution
(J1, J2, J5 by county or state name; stream-static joins against the
gazetteer) -> person records (A4 + J7) are all row-local, so the batch
functions apply unchanged to a streaming DataFrame and the query runs in
append mode without state.  The coordinate branch (J3) needs a per-post
minimum over candidate zips, i.e. an aggregation; it is left to the batch
job, which re-resolves the posts the stream could not place by name.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from geolex.operators import places, profiles
from geolex.sources import schemas
from geolex.sources.readers import decode_lines


def person_record_stream(spark: SparkSession, source_dir: str, names: DataFrame, levels: DataFrame,
                         stop_words: Iterable[str] = (), max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming person-level records from JSON-lines files arriving in ``source_dir``."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(source_dir)
    raw = decode_lines(lines, "value", schemas.RAW_POST)
    posts = places.add_place_parts(places.keep_located(places.flatten_posts(raw)))
    resolved = places.resolve_places(posts, names).filter(F.col("fips").isNotNull())
    return profiles.person_records(resolved, levels, stop_words, key="fips",
                                   keep=["created_at", "resolved_by"])


def write_person_records(stream: DataFrame, path: str, checkpoint: str,
                         once: bool = False) -> StreamingQuery:
    """Append the records as parquet; the checkpoint makes restarts exactly-once."""
    w = (stream.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="10 seconds")
    return w.start(path)
