import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])

LONG = "the quick brown fox jumps over the lazy dog and runs away " * 4000

#: Nulls in any column, empty, very long, white-space-only and repeated texts, repeated rows and ids.
ODD = [
    (1, "the cat sat on the mat. the dog ran.", "en", "a", 10), (2, None, "en", "a", 0), (3, "", None, "b", 0),
    (4, "   \t\n ", "en", None, 6), (None, "the cat sat on the mat. the dog ran.", "en", "a", 10),
    (None, None, None, None, None), (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "b", len(LONG)),
    (7, "12345 !!! ???", "de", "c", 13), (8, "der Hund und die Katze sind im Haus", "de", "c", 30),
    (8, "der Hund und die Katze sind im Haus", "de", "c", 30), (9, "Émile l'été, naïve 中文 😀", "fr", "", 20),
    (10, "\x00\x1f\x85\xa0x", "fr", "", 5), (11, "the cat sat on the mat. the dog ran.", "en", "d", 10),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(spark, odd):
    """The odd rows with extra columns named like what operators add."""
    extra = ("_row", "_id", "_full", "_doc", "_key", "_answer", "_text", "_copy", "_position", "size", "kept", "rank",
             "component_id", "fingerprint", "spans", "ids", "score", "lang_pred", "a.b", "target")
    return odd.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])


def same_rows(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))
