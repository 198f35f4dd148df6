"""Sinks (S8-S11): distributed writers, explicit save mode, no driver reduce."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _flatten_for_csv(df: DataFrame) -> DataFrame:
    """Render arrays/maps/structs as text so a delimited sink can hold them."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            cols.append(F.concat(F.lit("["), F.array_join(F.col(f.name).cast("array<string>"), " "),
                                 F.lit("]")).alias(f.name))
        elif isinstance(f.dataType, (T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_table(df: DataFrame, path: str, fmt: str | None = None, sep: str = "\t",
                mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Write ``df`` as json / csv / parquet.

    ``fmt`` defaults to the path's suffix (S8).  CSV is written with a header
    and the given separator (tab as the reference's intermediate files).
    """
    if fmt is None:
        fmt = "json" if path.endswith("json") else "csv" if path.endswith("csv") else "parquet"
    if fmt == "csv":
        df = _flatten_for_csv(df)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").option("sep", sep).option("quote", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    elif fmt == "parquet":
        w.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_bucketed(df: DataFrame, name: str, path: str, by: list[str], buckets: int | None = None) -> DataFrame:
    """``df`` as the table ``name`` of the session catalog, its Parquet files under ``path``, bucketed
    and sorted by the columns ``by`` (one file a bucket).  Tables bucketed alike join on these columns without
    an exchange, however often they are joined.  Buckets: as many as shuffle partitions."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, *by).write.format("parquet").mode("errorifexists").bucketBy(n, *by).sortBy(*by)
     .option("path", path).saveAsTable(name))
    return spark.table(name)
