"""Helpers shared by the training-data operators: tables, lineage cuts, prefix sums."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Words are runs of anything but the ASCII white space space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a Python worker handles at once.
ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(docs: DataFrame) -> DataFrame:
    """All columns as the one struct ``_row``, so that none can clash with the columns
    an operator adds; ``unpacked`` is the way back."""
    return docs.select(F.struct(*map(named, docs.columns)).alias("_row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="geolex-ship-"), "geolex"), "zip",
                                      os.path.dirname(package), os.path.basename(package))
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` whose workers can import this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def replaced(df: DataFrame, source: str, added: list[T.StructField], make) -> DataFrame:
    """``df`` with the columns ``added`` in place of ``source``: ``make`` turns a list of
    the source's values as bytes into one Arrow array per added column.  A task
    handles ``ROWS`` rows at once."""
    others = [c for c in df.columns if c not in (source, *(f.name for f in added))]
    given = df.select(F.struct(F.lit(0).alias("_"), *map(named, others)).alias("_row"),
                      named(source).cast("binary").alias("_source"))
    schema = T.StructType([given.schema["_row"], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), *make(part.column(1).to_pylist())],
                                                 names=schema.names)

    out = in_arrow(given, run, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in others], *[f.name for f in added])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors
    share.  Only a local session that has none gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="geolex-llm-")
        spark.sparkContext.setCheckpointDir(path)
    return path


_written: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``remove_cuts`` deletes what is written there."""
    _written.append(f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def remove_cuts(spark: SparkSession) -> int:
    """Delete the tables and files that operators and pipeline stages have written to the shared
    folder so far; call it when the results that read them have been stored.  Returns their number."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def cut(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` now into a Parquet table of the shared folder and read it
    back: later jobs neither recompute it nor depend on the executors that did."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: crc32(doc_id as text) mod 3 is 1.
    A null id counts as the empty text (not held out)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def running_sum(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``{value}_before``: the sum of ``value`` over the rows of the same
    ``by`` that come earlier in ``order`` (0 for the first).

    A prefix scan in three steps, so no key is ever one task: rows are dealt
    into ranges of (by, order), each range sums its own rows, and the sums of
    the earlier ranges (one row per key and range) are added.  A key holding
    a third of all rows just spans more ranges.  Equal rows take any order.
    """
    ranged = cut(
        df.repartitionByRange(partitions(df.sparkSession), *by, *order)
        .withColumn("_range", F.spark_partition_id()), name)
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy(*by, "_range").agg(F.sum(value).alias("_sum"))
               .withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
               .drop("_sum"))
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    right = offsets.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_range").alias("_r"), "_offset")
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    joined = local.join(right, [F.col("_range") == F.col("_r"), *on], "left")
    return (joined.withColumn(f"{value}_before", F.col("_offset") + F.col("_inside"))
            .drop("_range", "_r", "_offset", "_inside", *[f"_by_{c}" for c in by]))
