"""The stateless X1 stages on a streaming DataFrame equal the batch result."""
import json
import os
import tempfile

from pyspark.sql import functions as F

from geolex.operators import places, profiles
from geolex.sources.readers import read_posts
from geolex.sources.schemas import LEVEL_COLUMNS
from geolex.streaming.posts import person_record_stream, write_person_records


def test_stream_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="geolex-stream-")
    os.makedirs(f"{d}/in")
    posts = []
    for i in range(60):
        loc = ["Kings County, NY", "Somewhere, ny", "Nowhere", None][i % 4]
        posts.append({"user": {"id": i, "lang": "en" if i % 5 else "fr", "location": loc, "time_zone": None},
                      "text": f"the word{i % 3} http://x 😀 w", "created_at": str(i), "geo": None})
    for part in range(3):
        with open(f"{d}/in/p{part}.json", "w") as f:
            f.write("\n".join(json.dumps(p) for p in posts[part::3]) + "\n{oops\n")
    names = spark.createDataFrame([("kings", 36047), ("ny", 36000)], "name string, fips long")
    levels = spark.createDataFrame([(36047, 1.0, 2.0, 3.0, 4.0), (36000, 5.0, 6.0, 7.0, 8.0)],
                                   "fips long, " + ", ".join(f"{c} double" for c in LEVEL_COLUMNS))
    stream = person_record_stream(spark, f"{d}/in", names, levels, ["the"], max_files_per_trigger=1)
    q = write_person_records(stream, f"{d}/out", f"{d}/ckpt", once=True)
    q.awaitTermination(120)
    got = spark.read.parquet(f"{d}/out").drop("created_at", "resolved_by")

    batch = places.add_place_parts(places.keep_located(places.flatten_posts(read_posts(spark, f"{d}/in"))))
    batch = places.resolve_places(batch, names).filter(F.col("fips").isNotNull())
    want = profiles.person_records(batch, levels, ["the"], key="fips")
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())
    assert got.count() == 24  # English posts placed by county or state name
