"""Explicit schemas (no inference on any read)."""

from pyspark.sql import types as T

# Raw post (one JSON object per line).
RAW_POST = T.StructType([
    T.StructField("user", T.StructType([
        T.StructField("id", T.LongType()),
        T.StructField("lang", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("time_zone", T.StringType()),
    ])),
    T.StructField("text", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("geo", T.StructType([
        T.StructField("coordinates", T.ArrayType(T.DoubleType())),
    ])),
])

# Person-level record (one per resolved post).
PERSON = T.StructType([
    T.StructField("fip", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("filtered_text", T.StringType()),
    T.StructField("url_count", T.IntegerType()),
    T.StructField("emoji_count", T.IntegerType()),
    T.StructField("education_level_1", T.DoubleType()),
    T.StructField("education_level_2", T.DoubleType()),
    T.StructField("education_level_3", T.DoubleType()),
    T.StructField("education_level_4", T.DoubleType()),
])

LEVEL_COLUMNS = ("education_level_1", "education_level_2", "education_level_3", "education_level_4")

# Attainment table after import: FIPS, State, Area and 16 percent columns.
ATTAINMENT_YEARS = ("1980", "1990", "2000", "2013")
ATTAINMENT_VALUE_COLUMNS = tuple(f"{y}-{k}" for y in ATTAINMENT_YEARS for k in range(4))
ATTAINMENT_RAW = T.StructType(
    [T.StructField("FIPS", T.StringType()), T.StructField("State", T.StringType()),
     T.StructField("Area", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in ATTAINMENT_VALUE_COLUMNS]
)

# Saved word model (file contract word, level, slope, pval, count).
WORD_MODEL = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("level", T.IntegerType()),
    T.StructField("slope", T.DoubleType()),
    T.StructField("pval", T.DoubleType()),
    T.StructField("count", T.LongType()),
])
