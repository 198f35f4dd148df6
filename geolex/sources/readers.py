"""Sources (S1-S7).  Every read has an explicit schema; nothing collects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geolex.sources import schemas


def list_files(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """Every file under ``root`` (recursively) whose name matches ``glob``.

    Only the ``path`` column is selected, so the binary content is pruned.
    """
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .load(root)
            .select("path", "length"))


def decode_json(col: Column | str, schema: T.StructType, mode: str = "PERMISSIVE") -> Column:
    """S3: JSON decode.  A bad line yields an all-null struct, or with ``mode="FAILFAST"`` an error."""
    c = F.col(col) if isinstance(col, str) else col
    return F.from_json(c, schema, {"mode": mode})


def read_posts(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False,
               schema: T.StructType = schemas.RAW_POST, mode: str = "PERMISSIVE") -> DataFrame:
    """S1 + S3: JSON-lines posts from one path, a comma list or a list.

    Lines are read as text and decoded with ``from_json`` so a corrupt line
    becomes a null record (dropped by the located-user filter) instead of
    failing the job; ``_corrupt`` keeps the raw text of such lines for
    counting.  With ``mode="FAILFAST"`` such a line is an error.
    """
    if isinstance(paths, str):
        paths = [p for p in paths.split(",") if p]
    reader = spark.read.format("text")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    lines = reader.load(list(paths))
    return decode_lines(lines, "value", schema, mode)


def read_persons(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False,
                 schema: T.StructType = schemas.PERSON, mode: str = "PERMISSIVE") -> DataFrame:
    """S3's second shape: JSON-lines files of person records."""
    return read_posts(spark, paths, recursive, schema, mode)


def decode_lines(df: DataFrame, col: str, schema: T.StructType = schemas.RAW_POST, mode: str = "PERMISSIVE",
                 carry: Sequence[str] = ()) -> DataFrame:
    """Decode a text column of JSON lines into the schema's top-level columns, after the columns in ``carry``.

    ``_corrupt`` is the text of a line that is not JSON of this shape; a valid
    line without the expected fields (e.g. a delete notice) is not corrupt.
    With ``mode="FAILFAST"`` a corrupt line is an error as soon as its columns are read.
    """
    if mode == "FAILFAST":
        rec = F.from_json(F.col(col), schema, {"mode": mode})
        return df.select(*carry, rec.alias("_rec")).select(*carry, "_rec.*", F.lit(None).cast("string").alias("_corrupt"))
    flagged = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rec = F.from_json(F.col(col), flagged, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt"})
    return df.select(*carry, rec.alias("_rec")).select(*carry, "_rec.*")


def read_attainment(spark: SparkSession, path: str) -> DataFrame:
    """Attainment CSV with every column as text.

    The file is read without a header; the header row and any preamble rows
    in front of it (the spreadsheet export has four) are dropped because
    their first cell is not a number.  Cleaning is
    ``operators.places.clean_attainment``.
    """
    raw = spark.read.csv(path, header=False, schema=schemas.ATTAINMENT_RAW, quote='"')
    return raw.filter(F.trim("FIPS").try_cast("long").isNotNull())


def read_zip_county(spark: SparkSession, path: str) -> DataFrame:
    """Zip-to-county CSV; column 0 = zip, column 1 = FIPS, rest ignored."""
    raw = spark.read.csv(path, header=True, quote='"', inferSchema=False)
    c0, c1 = raw.columns[0], raw.columns[1]
    return raw.select(F.col(c0).alias("zip"), F.col(c1).alias("fips"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line (CRLF or LF) -> DataFrame(word)."""
    return (spark.read.text(path)
            .select(F.regexp_replace("value", r"\r$", "").alias("word"))
            .filter(F.col("word") != ""))


def read_word_model(spark: SparkSession, path: str) -> DataFrame:
    """Saved word model CSV with the ``word,level,slope,pval,count`` contract."""
    return spark.read.csv(path, header=True, schema=schemas.WORD_MODEL)
