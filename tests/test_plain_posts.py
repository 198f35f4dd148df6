"""Posts without urls and emoji are told apart by two searches; the classes for Java regex are the fixed values'."""
from pyspark.sql import functions as F

from geolex.functions import text as tx
from geolex.operators import profiles
from tests.conftest import one_col


def test_java_classes_are_those_of_the_fixed_values(spark):
    c = spark.range(1, 0x110000).filter("(id < 55296 OR id > 57343) AND id <> 65279").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    special = r"[^\p{L}\p{N}" + tx.WS_CLASS + "]"
    emoji = F.col("c").rlike(tx.EMOJI_CLASS)
    row = c.agg(F.count_if(F.col("c").rlike(tx.WS_RUN)).alias("ws"), F.count_if(emoji).alias("emoji"),
                F.count_if(F.col("c").rlike(tx.WS_RUN) != F.col("c").rlike(tx.WS_RUN_JAVA)).alias("ws_other"),
                F.count_if(F.col("c").rlike(special) != F.col("c").rlike(tx.SPECIAL_JAVA)).alias("special_other"),
                F.count_if(F.col("c").rlike(tx.WS_RUN) == tx.has_tokens("c")).alias("token_other"),
                F.count_if(emoji != tx.is_emoji(F.concat(F.lit("aé…"), "c", F.lit("b")))).alias("emoji_other")).first()
    assert row.ws == 29 and row.emoji > 1000
    assert row.ws_other == row.special_other == row.token_other == row.emoji_other == 0


def test_only_texts_with_a_url_or_an_emoji_are_tagged(spark):
    texts = ["Plain  words …", "see HTTPS://x.y/z😀 Now", "a 😀😀 b ★", "x ://y", "", None]
    rows = one_col(spark, texts, "text").select("text", profiles.tag_special(F.col("text")).alias("tag")).collect()
    assert [None if r.tag is None else len(r.tag) for r in rows] == [0, 3, 4, 2, 0, None]
    posts = spark.createDataFrame([("1", i, t) for i, t in enumerate(texts)], "fips string, user_id long, text string")
    levels = spark.createDataFrame([("1", 1., 2., 3., 4.)], ["fips", *[f"education_level_{k}" for k in range(1, 5)]])
    for stop in (None, ("now",)):
        got = {r.user_id: (r.filtered_text, r.url_count, r.emoji_count) for r in profiles.person_records(posts, levels, stop).collect()}
        assert got == {0: ("plain words …", 0, 0), 1: ("see now", 1, 0), 2: ("a b ★", 0, 1), 3: ("x ://y", 0, 0),
                       4: ("", 0, 0), 5: (None, None, None)}
