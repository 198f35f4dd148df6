"""Resolution priority, gazetteer, zips, nearest zips."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolex.operators import nearest, places
from geolex.sources.schemas import ATTAINMENT_VALUE_COLUMNS


def att_raw(spark, rows):
    cols = ["FIPS", "State", "Area", *ATTAINMENT_VALUE_COLUMNS]
    full = [tuple([*r, *([str(i)] * 16)]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ", ".join(f"`{c}` string" for c in cols))


def test_p7_p8_clean_attainment(spark):
    raw = att_raw(spark, [("0", "US", "United States"), ("1000", "AL", "Alabama"), ("1001", "AL", "Autauga County")])
    raw = raw.withColumn("2013-3", F.when(F.col("FIPS") == "1001", F.lit("")).otherwise(F.col("2013-3")))
    out = places.clean_attainment(raw).collect()
    assert [(r.FIPS, r.State, r.Area) for r in out] == [(1001, "al", "autauga")]
    assert out[0]["2013-3"] == 0.0 and out[0]["2013-2"] == 2.0


def test_j9_names_later_row_wins(spark):
    raw = att_raw(spark, [("1000", "AL", "Alabama"), ("1001", "AL", "Kings County"),
                          ("36047", "NY", "Kings County"), ("36000", "NY", "New York")])
    names = {r.name: r.fips for r in places.place_names(raw).collect()}
    assert names == {"alabama": 1000, "al": 1000, "kings": 36047, "newyork": 36000, "ny": 36000}


def test_j10_zip_one_and_all(spark):
    z = spark.createDataFrame([("501", "36103"), ("501", "36059"), ("00601", "072001")], "zip string, fips string")
    assert sorted(tuple(r) for r in places.zip_table(z, "one").collect()) == [("00601", 72001), ("501", 36103)]
    assert places.zip_table(z, "all").count() == 3


@pytest.mark.parametrize("threshold", ["10485760", "-1"])  # planner's broadcast, shuffle join
def test_j5_priority(spark, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    names = spark.createDataFrame([("kings", 36047), ("ny", 36000)], "name string, fips long")
    zips = spark.createDataFrame([("11201", 36047)], "zip string, fips long")
    cents = spark.createDataFrame([(11201, 40.69, -73.99)], "zip long, lat double, lon double")
    posts = spark.createDataFrame([
        ("p1", "kings", "ny", [40.69, -73.99]),      # county wins
        ("p2", "nowhere", "ny", [40.69, -73.99]),    # state wins over coordinates (J5 example)
        ("p3", "nowhere", "zz", [40.70, -73.99]),    # coordinates
        ("p4", "nowhere", None, [10.0, 10.0]),       # nothing within radius
        ("p5", None, None, None),
    ], "post_id string, county string, state string, coordinates array<double>")
    out = {r.post_id: (r.fips, r.resolved_by) for r in
           places.resolve_places(posts, names, zips, cents, zips.select("fips")).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out == {"p1": (36047, "county"), "p2": (36000, "state"), "p3": (36047, "coordinates"),
                   "p4": (None, None), "p5": (None, None)}


def test_j5_repeated_ids_are_resolved_row_by_row(spark):
    names = spark.createDataFrame([("x", 1)], "name string, fips long")
    zips = spark.createDataFrame([("1", 36047), ("2", 6037), ("3", 99)], "zip string, fips long")
    cents = spark.createDataFrame([(1, 40.69, -73.99), (2, 34.05, -118.24), (3, 20.0, 20.0), (4, 20.0, 20.0)],
                                  "zip long, lat double, lon double")
    posts = spark.createDataFrame([("p", None, None, [40.69, -73.99]), ("p", None, None, [34.05, -118.24]),
                                   ("q", None, None, [20.0, 20.01]), ("r", None, None, [None, 1.0])],
                                  "post_id string, county string, state string, coordinates array<double>")
    out = places.resolve_places(posts, names, zips, cents, zips.filter("fips <> 99").select("fips"))
    assert sorted((r.post_id, r.fips, r.zip) for r in out.filter("zip IS NOT NULL").collect()) == [
        ("p", 6037, "2"), ("p", 36047, "1"), ("q", None, "3")]
    assert out.count() == 4
    assert tuple(places.unmatched_zips(out).first()) == (1, 1)


def test_j3_grid_equals_brute_force(spark):
    rnd = random.Random(7)
    cents = [(i, rnd.uniform(-89.9, 89.9), rnd.uniform(-180, 180)) for i in range(300)]
    cents += [(1000 + i, 30 + rnd.uniform(0, .3), 179.9 + rnd.uniform(0, .2) - (360 if i % 2 else 0)) for i in range(40)]
    cents += [(2000 + i, 89.9 + rnd.uniform(0, .1), rnd.uniform(-180, 180)) for i in range(20)]
    pts = [(i, c[1] + rnd.uniform(-.2, .2), c[2] + rnd.uniform(-.2, .2)) for i, c in enumerate(cents)]
    pts = [(i, max(-90.0, min(90.0, la)), ((lo + 180) % 360) - 180.0) for i, la, lo in pts]
    radius = 10.0
    got = {r.point_id: (r.zip, r.dist) for r in places.nearest_zip(
        spark.createDataFrame(pts, "point_id long, lat double, lon double"),
        spark.createDataFrame(cents, "zip long, lat double, lon double"), radius).collect()}

    def hav(a, b, c, d):
        r = math.pi / 180
        s1, s2 = math.sin((c - a) * r / 2), math.sin((d - b) * r / 2)
        x = s1 * s1 + math.cos(a * r) * math.cos(c * r) * s2 * s2
        return 2 * nearest.EARTH_RADIUS_MILES * math.asin(math.sqrt(min(x, 1.0)))
    want = {}
    for pid, la, lo in pts:
        best = min(((hav(la, lo, cl, cn), z) for z, cl, cn in cents), default=None)
        if best and best[0] <= radius:
            want[pid] = (best[1], best[0])
    assert set(got) == set(want)
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9


def brute_nearest(points, cents, radius, k):
    """By numpy, over all pairs."""
    r = math.pi / 180
    lat, lon = (np.array([c[i] for c in cents]) for i in (1, 2))
    out = []
    for pid, la, lo in points:
        s1, s2 = np.sin((lat - la) * r / 2), np.sin((lon - lo) * r / 2)
        x = s1 * s1 + np.cos(la * r) * np.cos(lat * r) * (s2 * s2)
        dist = 2 * nearest.EARTH_RADIUS_MILES * np.arcsin(np.sqrt(np.minimum(x, 1.0)))
        near = np.flatnonzero(dist <= radius)
        best = sorted((float(dist[i]), cents[i][0]) for i in near)
        out += [(pid, rank, zip_, d) for rank, (d, zip_) in enumerate(best[:k], 1)]
    return out


def dense_places(seed):
    """10^4 centroids in one base cell, a few far ones, some at one place, and points around them."""
    rnd = random.Random(seed)
    cents = [(i, 40.1 + rnd.random() * .12, -75.3 + rnd.random() * .12) for i in range(10_000)]
    cents += [(20_000 + i, rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(50)]
    cents += [(30_000 + i, 40.05, -75.0) for i in range(200)]
    pts = [(i, rnd.uniform(39.8, 40.5), rnd.uniform(-75.7, -74.7)) for i in range(150)]
    pts += [(1000 + i, c[1] + rnd.uniform(-.01, .01), c[2]) for i, c in enumerate(cents[::150])]
    return cents, pts


@pytest.mark.parametrize("k", [1, 3])
def test_j3_dense_cells_split_and_equal_brute_force(spark, k):
    cents, pts = dense_places(k)
    c = spark.createDataFrame(cents, "zip long, lat double, lon double")
    p = spark.createDataFrame(pts, "point_id long, lat double, lon double")
    got = sorted(tuple(r) for r in nearest.nearest_zips(p, c, 10.0, k).collect())
    want = sorted(brute_nearest(pts, cents, 10.0, k))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert max(abs(a[3] - b[3]) for a, b in zip(got, want)) < 1e-9
    if k > 1:
        return
    leaves, deepest = nearest.leaf_cells(c, 10.0, k)
    assert 0 < deepest < nearest.DEPTH
    assert leaves.agg(F.max(F.size("cands"))).first()[0] <= nearest.LEAF
    # every cell is a leaf once
    assert leaves.count() == leaves.select(*nearest.CELL).distinct().count()


def test_j3_centroids_on_a_line_stop_splitting(spark):
    cents = [(i, 40.1, -75.3 + i * 1e-4) for i in range(2000)]
    pts = [(i, 40.1 + (i % 10) * .01, -75.3 + i * .002) for i in range(100)]
    got = sorted(tuple(r) for r in nearest.nearest_zips(
        spark.createDataFrame(pts, "point_id long, lat double, lon double"),
        spark.createDataFrame(cents, "zip long, lat double, lon double"), 10.0, 1, leaf=16).collect())
    assert [r[:3] for r in got] == [r[:3] for r in sorted(brute_nearest(pts, cents, 10.0, 1))]


def test_j3_small_leaves_at_poles_and_date_line(spark):
    rnd = random.Random(3)
    cents = [(i, 89.7 + rnd.random() * .3, rnd.uniform(-180, 180)) for i in range(300)]
    cents += [(1000 + i, 10 + rnd.random() * .2, 180 - rnd.random() * .1 if i % 2 else -180 + rnd.random() * .1)
              for i in range(300)]
    pts = [(i, c[1], ((c[2] + rnd.uniform(-.05, .05) + 180) % 360) - 180) for i, c in enumerate(cents[::4])]
    got = sorted(tuple(r) for r in nearest.nearest_zips(
        spark.createDataFrame(pts, "point_id long, lat double, lon double"),
        spark.createDataFrame(cents, "zip long, lat double, lon double"), 10.0, 2, leaf=64).collect())
    want = sorted(brute_nearest(pts, cents, 10.0, 2))
    assert [r[:3] for r in got] == [r[:3] for r in want]


def test_j3_without_centroids_or_points(spark):
    none = spark.createDataFrame([], "zip long, lat double, lon double")
    one = spark.createDataFrame([(1, 40.0, -75.0), (2, None, -75.0)], "point_id long, lat double, lon double")
    assert nearest.nearest_zips(one, none).count() == 0
    assert nearest.nearest_zips(one.limit(0), one.withColumnRenamed("point_id", "zip").filter("lat > 0")).count() == 0


def test_p1_p2_p3_filters(spark):
    raw = spark.createDataFrame([
        ({"id": 1, "lang": "en", "location": "Miami", "time_zone": None}, "t", None, None),
        ({"id": 2, "lang": "fr", "location": "Paris", "time_zone": None}, "t", None, None),
        ({"id": 3, "lang": "en", "location": None, "time_zone": None}, "t", None, {"coordinates": [1.0, 2.0]}),
        ({"id": 0, "lang": "en", "location": "", "time_zone": None}, "t", None, None),
        (None, "t", None, None),
    ], "user struct<id bigint, lang string, location string, time_zone string>, text string, "
       "created_at string, geo struct<coordinates array<double>>")
    flat = places.flatten_posts(raw)
    assert sorted(r.user_id for r in places.keep_located(flat).collect()) == [0, 1, 3]
    assert sorted(r.user_id for r in places.keep_located(flat, strict=True).collect()) == [1]
    parts = places.add_place_parts(places.keep_located(flat)).collect()
    assert {r.user_id: (r.county, r.coordinates) for r in parts} == {
        0: (None, None), 1: ("miami", None), 3: (None, [1.0, 2.0])}
