"""Decode, scans and sink round trips (files in a fresh temp dir)."""
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from geolex.operators.wordmodel import drop_stop_words
from geolex.sources import readers, sinks
from geolex.sources.schemas import ATTAINMENT_VALUE_COLUMNS


def tmpdir():
    return tempfile.mkdtemp(prefix="geolex-test-")


def test_s1_s3_decode_tolerant(spark):
    d = tmpdir()
    os.makedirs(f"{d}/a/b")
    good = {"user": {"id": 5, "lang": "en", "location": "Miami, FL", "time_zone": None},
            "text": "hi", "created_at": "x", "geo": {"coordinates": [1.5, 2.5]}}
    with open(f"{d}/a/one.json", "w") as f:
        f.write(json.dumps(good) + "\n{bad\n" + json.dumps({"user": None, "text": "t"}) + "\n")
    with open(f"{d}/a/b/two.json", "w") as f:
        f.write(json.dumps({"delete": {}}) + "\n")
    df = readers.read_posts(spark, f"{d}/a", recursive=True)
    rows = df.collect()
    assert len(rows) == 4
    assert [r._corrupt for r in rows if r._corrupt is not None] == ["{bad"]  # a delete notice is valid
    ok = [r for r in rows if r.user is not None and r.user.id is not None]
    assert len(ok) == 1 and ok[0].geo.coordinates == [1.5, 2.5]


def test_s2_list_files(spark):
    d = tmpdir()
    os.makedirs(f"{d}/x/y")
    for p in ("x/1.json", "x/y/2.json", "x/y/3.txt"):
        open(f"{d}/{p}", "w").write("{}\n")
    paths = sorted(os.path.basename(r.path) for r in readers.list_files(spark, d).collect())
    assert paths == ["1.json", "2.json"]


def test_s5_attainment_preamble_and_d19(spark):
    d = tmpdir()
    header = ",".join(["FIPS", "State", "Area", *ATTAINMENT_VALUE_COLUMNS])
    vals = ",".join(["1.5"] * 15 + [""])
    with open(f"{d}/att.csv", "w") as f:
        f.write("Educational attainment\nsource line\n\n\"notes, more\"\n" + header + "\n")
        f.write(f'01001,AL,"Autauga County",{vals}\n')
    raw = readers.read_attainment(spark, f"{d}/att.csv")
    from geolex.operators.places import clean_attainment
    r = clean_attainment(raw).first()
    assert (r.FIPS, r.Area, r["2013-3"], r["1980-0"]) == (1001, "autauga", 0.0, 1.5)


def test_s6_stop_words_crlf(spark):
    d = tmpdir()
    with open(f"{d}/stop.txt", "wb") as f:
        f.write(b"the\r\nand\r\n\r\nof\r\n")
    stop = readers.read_stop_words(spark, f"{d}/stop.txt")
    assert sorted(r.word for r in stop.collect()) == ["and", "of", "the"]
    words = spark.createDataFrame([("the",), ("cat",), ("of",)], "word string")
    assert [r.word for r in drop_stop_words(words, stop).collect()] == ["cat"]


def test_s7_s10_s11_word_model_round_trip(spark):
    d = tmpdir()
    model = spark.createDataFrame([("cat", 3, 0.5, 0.01, 17), ("dog", 0, -0.2, 0.3, 5)],
                                  "word string, level int, slope double, pval double, count long")
    sinks.write_table(model, f"{d}/model_csv", fmt="csv", sep=",", partition_by=None)
    back = readers.read_word_model(spark, f"{d}/model_csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, model.collect()))


def test_s8_s9_json_round_trip_and_suffix_dispatch(spark):
    d = tmpdir()
    df = spark.createDataFrame([(1, [0.1, 0.2], {"a": 0.5})], "fip long, edu array<double>, words map<string,double>")
    sinks.write_table(df, f"{d}/out.json")
    back = spark.read.schema(df.schema).json(f"{d}/out.json")
    assert back.collect() == df.collect()
    sinks.write_table(df, f"{d}/out.csv")
    text = spark.read.text(f"{d}/out.csv").collect()
    assert text[0].value.split("\t") == ["fip", "edu", "words"]
    assert text[1].value.split("\t")[:2] == ["1", "[0.1 0.2]"]


def test_s11_partitioned_model_sink(spark):
    d = tmpdir()
    model = spark.createDataFrame([("cat", 3, 0.5), ("dog", 0, -0.2)], "word string, level int, slope double")
    sinks.write_table(model, f"{d}/by_level", fmt="parquet", partition_by=["level"])
    assert {"level=0", "level=3"} <= set(os.listdir(f"{d}/by_level"))
    assert spark.read.parquet(f"{d}/by_level").filter(F.col("level") == 3).first().word == "cat"


LINES = ['{"user":{"id":1,"lang":"en","location":"Miami"},"text":"a"}', '{"user":{"id":2,"lang":"fr","location":"Paris"},"text":"b"}',
         "{bad", '{"delete":{"id":3}}', '{"user":{"id":4,"lang":"en"},"text":"c"}', "[1, 2"]


def test_ingest_counts_and_quarantine_come_from_one_pass(spark, tmp_path):
    from geolex.operators import places
    from geolex.sources import ingest
    lines = spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "line_no int, value string").repartition(3)
    taken = ingest.ingest_posts(lines, str(tmp_path / "t"), places.keep_located_raw(), carry=("line_no",))
    assert taken.counts == {"total": 6, "corrupt": 2, "notice": 1, "dropped": 2, "valid": 1}
    assert [r.line_no for r in taken.records.collect()] == [0] and "_corrupt" not in taken.records.columns
    assert sorted(map(tuple, taken.quarantine.collect())) == [(2, "{bad"), (5, "[1, 2")]
    everything = ingest.ingest_posts(lines, str(tmp_path / "u"))
    assert everything.counts["valid"] == 3 and everything.counts["dropped"] == 0
    nothing = ingest.ingest_posts(lines.limit(0), str(tmp_path / "v"))
    assert set(nothing.counts.values()) == {0} and nothing.records.count() == 0


def test_strict_decoding_fails_on_a_corrupt_line(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([(x,) for x in LINES], "value string").write.text(path)
    assert readers.read_posts(spark, path).count() == 6
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        readers.read_posts(spark, path, mode="FAILFAST").select("text").collect()
    good = str(tmp_path / "good")
    spark.createDataFrame([(LINES[0],), (LINES[3],)], "value string").write.text(good)
    assert readers.read_posts(spark, good, mode="FAILFAST").filter("user IS NOT NULL").count() == 1


def test_person_lines(spark, tmp_path):
    path = str(tmp_path / "persons")
    line = '{"fip":1001,"user_id":7,"text":"t","filtered_text":"t","url_count":0,"emoji_count":1,"education_level_1":0.5}'
    spark.createDataFrame([(line,), ("{",)], "value string").write.text(path)
    rows = readers.read_persons(spark, path).orderBy("fip").collect()
    assert (rows[1].fip, rows[1].user_id, rows[1].education_level_1, rows[1]._corrupt) == (1001, 7, 0.5, None)
    assert rows[0]._corrupt == "{" and rows[0].user_id is None
