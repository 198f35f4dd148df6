"""One test per decision row D1-D19 of SURVEY §0.1 (the documented intent)."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from geolex.functions import text as tx
from geolex.operators import places, predict, profiles, split, wordmodel
from geolex.sources import readers, schemas, sinks
from geolex.sources.schemas import ATTAINMENT_VALUE_COLUMNS, LEVEL_COLUMNS


def _lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_d1_bad_json_is_null_dropped_and_counted(spark):
    good = json.dumps({"user": {"id": 1, "lang": "en", "location": "x"}, "text": "t"})
    df = readers.decode_lines(_lines(spark, [good, "{bad", "not json"]), "value")
    assert df.filter(F.col("_corrupt").isNotNull()).count() == 2
    assert places.keep_located(places.flatten_posts(df)).count() == 1


def test_d2_coordinates_assign_fips(spark):
    names = spark.createDataFrame([("x", 1)], "name string, fips long")
    posts = spark.createDataFrame([("p", None, None, [40.0, -74.0])],
                                  "post_id string, county string, state string, coordinates array<double>")
    zips = spark.createDataFrame([("7001", 34017)], "zip string, fips long")
    cents = spark.createDataFrame([(7001, 40.01, -74.0)], "zip long, lat double, lon double")
    r = places.resolve_places(posts, names, zips, cents).first()
    assert (r.fips, r.resolved_by) == (34017, "coordinates")


def test_d3_one_normaliser_case_insensitive(spark):
    df = spark.createDataFrame([("Miami-Dade County", "miami-dade county, fl")], "area string, loc string")
    r = df.select(tx.place_name("area").alias("a"), tx.split_location("loc")["county"].alias("c")).first()
    assert r.a == r.c == "miami-dade"


def _obs(spark, rows):
    return spark.createDataFrame(rows, "fip int, word string, x double, y0 double, y1 double, y2 double, y3 double")


def test_d4_gate_sets_slope_zero(spark):
    rows = [(i, "w", x, y, y, y, y) for i, (x, y) in enumerate(zip([.1, .2, .3, .4, .5], [.3, .1, .4, .2, .5]))]
    m = wordmodel.fit_word_model(_obs(spark, rows), gate=True).collect()
    assert all(r.slope == 0.0 for r in m)


def test_d5_grouped_by_word_model_not_empty(spark):
    rows = [(i, w, 0.1 * i + (0.01 if w == "b" else 0), 0.1 * i, 0.2 * i, 0.05 * i, 0.3 - 0.01 * i)
            for i in range(6) for w in ("a", "b")]
    m = wordmodel.fit_word_model(_obs(spark, rows), bonferroni=False, gate=False)
    assert sorted({r.word for r in m.collect()}) == ["a", "b"]


def test_d6_each_level_has_its_own_target(spark):
    rows = [(i, "w", 0.1 * i, 0.1 * i, -0.1 * i, (i % 2) * 1.0, 0.3) for i in range(6)]
    m = {r.level: r.slope for r in wordmodel.fit_word_model(_obs(spark, rows), bonferroni=False, gate=False).collect()}
    assert round(m[0], 9) == 1.0 and round(m[1], 9) == -1.0 and abs(m[2]) < 1 and m[3] is None


def test_d7_d8_trim_then_drop_empty(spark):
    words = spark.createDataFrame([(1, "[cat]", .1), (1, "...", .2), (1, "^dog", .3)], "fip long, word string, share double")
    t = spark.createDataFrame([(1, .1, .2, .3, .4)], "fip long, y0 double, y1 double, y2 double, y3 double")
    got = sorted(r.word for r in wordmodel.observations(words, t, ["the"], trim=True).collect())
    assert got == ["cat", "dog"]


def test_d9_fips_is_a_number(spark):
    z = spark.createDataFrame([("00501", "036103")], "zip string, fips string")
    assert places.zip_table(z).first().fips == 36103


def test_d10_multi_county_zip(spark):
    z = spark.createDataFrame([("501", "36103"), ("501", "36059")], "zip string, fips string")
    assert places.zip_table(z, "one").count() == 1 and places.zip_table(z, "all").count() == 2


def _att(spark, rows):
    cols = ["FIPS", "State", "Area", *ATTAINMENT_VALUE_COLUMNS]
    return spark.createDataFrame([tuple([*r, *(["1"] * 16)]) for r in rows], ", ".join(f"`{c}` string" for c in cols))


def test_d11_later_row_wins_in_gazetteer(spark):
    raw = _att(spark, [("5001", "AR", "Orange County"), ("6059", "CA", "Orange County")])
    assert places.place_names(raw).filter("name = 'orange'").first().fips == 6059


def test_d12_latest_record_sets_fip_and_levels(spark):
    rows = [(10, 1, 0, "a", 0, 0, 1.0), (20, 1, 1, "b", 0, 0, 2.0)]
    df = spark.createDataFrame(rows, "fip long, user_id long, line_no long, filtered_text string, url_count int, "
                                     "emoji_count int, education_level_1 double")
    for c in LEVEL_COLUMNS[1:]:
        df = df.withColumn(c, F.lit(0.0))
    u = profiles.profile_totals(df.repartition(2), "user_id", "line_no", carry=["fip"]).first()
    assert (u.fip, u.education_level_1) == (20, 2.0)


def test_d13_corrupt_person_lines_dropped(spark):
    rec = {"fip": 1, "user_id": 2, "text": "a", "filtered_text": "a", "url_count": 0, "emoji_count": 0,
           "education_level_1": 1.0, "education_level_2": 1.0, "education_level_3": 1.0, "education_level_4": 1.0}
    df = readers.decode_lines(_lines(spark, [json.dumps(rec), "garbage"]), "value", schemas.PERSON)
    assert df.filter(F.col("_corrupt").isNull()).count() == 1


def test_d14_null_slope_is_weight_zero(spark):
    model = spark.createDataFrame([("a", 0, None, None, 5)], "word string, level int, slope double, pval double, count long")
    uw = spark.createDataFrame([(1, "a", 1)], "user_id long, word string, cnt long")
    users = spark.createDataFrame([(1, 9)], "user_id long, fip long")
    r = predict.classify(uw, users, wordmodel.model_wide(model)).first()
    assert (r.score_0, r.predicted_level) == (0.0, 0)


def test_d15_split_is_reproducible(spark):
    df = spark.range(5000)
    a = split.hash_split(df, ["id"]).collect()
    b = split.hash_split(df.repartition(9), ["id"]).collect()
    assert sorted(a) == sorted(b)


def test_d16_null_user_is_null_safe(spark):
    df = readers.decode_lines(_lines(spark, [json.dumps({"user": None, "text": "x"})]), "value")
    r = places.flatten_posts(df).first()
    assert r.user_id is None and r.text == "x"


def test_d17_sinks_header_sep_and_distributed_json(spark):
    d = tempfile.mkdtemp(prefix="geolex-d17-")
    df = spark.range(100).selectExpr("id", "id * 2 AS v").repartition(4)
    sinks.write_table(df, f"{d}/t.csv")
    first = spark.read.text(f"{d}/t.csv").first().value
    assert first == "id\tv"
    sinks.write_table(df, f"{d}/t.json")
    assert len([p for p in os.listdir(f"{d}/t.json") if p.startswith("part-")]) == 4


def test_d18_file_listing_replaces_recursion(spark):
    d = tempfile.mkdtemp(prefix="geolex-d18-")
    os.makedirs(f"{d}/a/b/c")
    open(f"{d}/a/b/c/x.json", "w").write("{}")
    assert readers.list_files(spark, d).count() == 1


def test_d19_blank_cells_become_zero(spark):
    raw = _att(spark, [("1001", "AL", "Autauga County")]).withColumn("2013-0", F.lit(" "))
    assert places.clean_attainment(raw).first()["2013-0"] == 0.0
