"""Reference-shaped inputs derived from the driver tables.

The reference reads archived posts, an attainment spreadsheet and a zip
file that are not available; these functions derive tables of the same
shape from the given parquet tables, so every query's work grows with them:

* post  = one line of ``documents.text`` (user = ``doc_id``, order =
  line number); a literal emoji is appended on ``doc_id % 7 = 0``, a star on
  ``doc_id % 11 = 0`` and the
  page url of ``pages`` (``page_id = doc_id``) on the first line;
* county (fip) = ``documents.source``; its four levels = the percent of the
  source's documents in each of the four languages (``LEVEL_LANGS`` order);
* gazetteer / attainment = ``region`` (state rows) and ``nation`` (county
  rows) with percents from ``customer`` market segments;
* zip = ``c_custkey`` (county of its nation; every tenth zip in two
  counties), centroid coordinates by arithmetic on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolex.operators import places, profiles
from geolex.session import materialize, spread, tasks_for
from geolex.sources.schemas import ATTAINMENT_VALUE_COLUMNS, LEVEL_COLUMNS

# --- fixed values -----------------------------------------------------------
LEVEL_LANGS = ("de", "en", "es", "fr")
STOP_WORDS = ("the", "and", "of", "a", "to", "in", "is", "it", "that", "for",
              "le", "la", "les", "de", "des", "et", "der", "die", "und", "el")
EMOJI_MARK = "😀"
STAR = "★"  # a symbol that is no emoji
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")
# --- end of fixed values ----------------------------------------------------


TEXT_TABLES = ("documents", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, text: bool = True) -> DataFrame:
    """A driver table; scans of tables whose text gets tokenised are spread as the
    session sets it (``text=False`` for reads of short columns only)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if text and name in TEXT_TABLES else df


def dealt_documents(spark: SparkSession, sf_dir: str, *cols: str, tasks: int | None = None) -> DataFrame:
    """``cols`` (``doc_id`` among them) of ``documents``, dealt out by ``doc_id`` over as many tasks as the stored
    size needs: what is counted by document and more keys meets there, so its words are not exchanged."""
    docs = table(spark, sf_dir, "documents", text=False)
    return docs.select(*cols).repartition(tasks or tasks_for(docs), "doc_id")


# ------------------------------------------------------------ posts / levels
def post_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user_id, line_no, fip, lang, text)``, one row per document line."""
    n = tasks_for(table(spark, sf_dir, "documents", text=False))
    docs = dealt_documents(spark, sf_dir, "doc_id", "text", "lang", "source", tasks=n)
    urls = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    docs = docs.join(urls.repartition(n, "doc_id"), "doc_id", "left")
    lines = docs.select("doc_id", "lang", "source", "url",
                        F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    text = F.concat_ws(" ", F.col("line"),
                       F.when(F.col("doc_id") % 7 == 0, F.lit(EMOJI_MARK)),
                       F.when(F.col("doc_id") % 11 == 0, F.lit(STAR)),
                       F.when(F.col("line_no") == 0, F.col("url")))
    return lines.select(F.col("doc_id").alias("user_id"), F.col("line_no").cast("long").alias("line_no"),
                        F.col("source").alias("fip"), "lang", text.alias("text"))


def region_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(fip, education_level_1..4)`` in percent."""
    docs = table(spark, sf_dir, "documents", text=False).select("source", "lang")
    n = F.count(F.lit(1))
    levels = docs.groupBy(F.col("source").alias("fip")).agg(
        *[(F.count_if(F.col("lang") == lang) * F.lit(100.0) / n).alias(c)
          for lang, c in zip(LEVEL_LANGS, LEVEL_COLUMNS)])
    return materialize(levels, "region_levels")  # one row per region; joins know how small it is


def targets(levels: DataFrame, key: str = "fip") -> DataFrame:
    """``(key, y0..y3)``: the levels as fractions (M1)."""
    return levels.select(key, *[(F.col(c) / F.lit(100.0)).alias(f"y{i}") for i, c in enumerate(LEVEL_COLUMNS)])


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person-level records (A4 + J7) of every post line."""
    return profiles.person_records(post_lines(spark, sf_dir), region_levels(spark, sf_dir),
                                   STOP_WORDS, key="fip", keep=["line_no"])


# ------------------------------------------------------- places stand-ins
def _region_code(r_name):
    return F.upper(F.substring(F.regexp_replace(r_name, " ", ""), 1, 2))


def attainment_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attainment table as text (the CSV import shape), one state row per
    region (FIPS = 1000 * (region + 1)) and one county row per nation
    (FIPS = region FIPS + nation + 1).  Percent columns: share of the
    nation's (region's) customers in four market segments; years repeat the
    2013 values with a year-dependent blank (``''``) to exercise D19."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    cust = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment")
    cust_n = cust.join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    n = F.count(F.lit(1))
    pct = [(F.count_if(F.col("c_mktsegment") == s) * F.lit(100.0) / n).alias(f"p{i}") for i, s in enumerate(SEGMENTS)]
    by_nation = cust_n.groupBy("c_nationkey").agg(*pct)
    by_region = cust_n.groupBy("n_regionkey").agg(*pct)
    counties = (nation.join(region, nation.n_regionkey == region.r_regionkey)
                .join(by_nation, nation.n_nationkey == by_nation.c_nationkey, "left")
                .select(((F.col("n_regionkey") + 1) * 1000 + F.col("n_nationkey") + 1).alias("fips"),
                        _region_code(F.col("r_name")).alias("State"),
                        F.concat(F.col("n_name"), F.lit(" County")).alias("Area"),
                        "p0", "p1", "p2", "p3"))
    states = (region.join(by_region, region.r_regionkey == by_region.n_regionkey, "left")
              .select(((F.col("r_regionkey") + 1) * 1000).alias("fips"),
                      _region_code(F.col("r_name")).alias("State"),
                      F.col("r_name").alias("Area"), "p0", "p1", "p2", "p3"))
    rows = counties.unionByName(states)
    vals = []
    for c in ATTAINMENT_VALUE_COLUMNS:
        year, k = c.split("-")
        v = F.col(f"p{k}").cast("string")
        blank = (F.col("fips") + F.lit(int(year))) % 5 == 0
        vals.append(F.when(blank, F.lit("")).otherwise(F.coalesce(v, F.lit(""))).alias(c))
    return rows.select(F.col("fips").cast("string").alias("FIPS"), "State", "Area", *vals)


def zip_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(zip, fips)`` text pairs: each customer key is a zip in its nation's
    county; every tenth zip also lies in the next nation's county."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    fips = (F.col("n_regionkey") + 1) * 1000 + F.col("n_nationkey") + 1
    own = cust.join(nation, cust.c_nationkey == nation.n_nationkey).select("c_custkey", fips.alias("fips"))
    n_nations = nation.agg(F.count(F.lit(1)).alias("_nn"))
    second = (cust.filter(F.col("c_custkey") % 10 == 0).crossJoin(F.broadcast(n_nations))
              .select("c_custkey", ((F.col("c_nationkey") + 1) % F.col("_nn")).alias("_nk"))
              .join(nation, F.col("_nk") == nation.n_nationkey).select("c_custkey", fips.alias("fips")))
    both = own.unionByName(second)
    return both.select(F.col("c_custkey").cast("string").alias("zip"),
                       F.format_string("%05d", F.col("fips")).alias("fips"))


def lat_of(key):
    return F.lit(25.0) + (key * 7919 % 2500) / F.lit(100.0)


def lon_of(key):
    return F.lit(-125.0) + (key * 104729 % 5800) / F.lit(100.0)


def zip_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    return cust.select(F.col("c_custkey").alias("zip"), lat_of(F.col("c_custkey")).alias("lat"),
                       lon_of(F.col("c_custkey")).alias("lon"))


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points near the centroid of zip ``s_suppkey`` (offset 0.05 deg)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")
    return s.select(k.alias("point_id"), (lat_of(k) + F.lit(0.05)).alias("lat"),
                    (lon_of(k) - F.lit(0.05)).alias("lon"))


def raw_post_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per post line (``value``), nested like a raw post.

    Location by ``doc_id % 6``: 0 ``Nation, REGION``; 1 nation name with a
    repeated tail and ' County'; 2 an unknown place with the region name;
    3 no location, coordinates near a zip centroid; 4 an unknown place;
    5 nation name with the region code.  Non-English documents keep their
    language (and are filtered by P2); every 50th line is not JSON.
    """
    posts = post_lines(spark, sf_dir)
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo_names = (nation.join(region, nation.n_regionkey == region.r_regionkey)
                 .select("n_nationkey", "n_name", "r_name"))
    n_nations = nation.agg(F.count(F.lit(1)).alias("_nn"))
    p = (posts.crossJoin(F.broadcast(n_nations))
         .withColumn("n_nationkey", (F.col("user_id") % F.col("_nn")).cast("int"))
         .join(geo_names, "n_nationkey", "left"))
    kind = F.col("user_id") % 6
    nm = F.col("n_name")
    location = (F.when(kind == 0, F.concat(nm, F.lit(", "), F.col("r_name")))
                .when(kind == 1, F.concat(nm, F.repeat(F.substring(nm, -1, 1), 3), F.lit(" County")))
                .when(kind == 2, F.concat(F.lit("Somewhere, "), F.col("r_name")))
                .when(kind == 4, F.lit("Nowhere, Atlantis"))
                .when(kind == 5, F.concat(nm, F.lit(", "), _region_code(F.col("r_name")))))
    geo = F.when(kind == 3, F.struct(F.array(lat_of(F.col("user_id")) + F.lit(0.02),
                                             lon_of(F.col("user_id")) + F.lit(0.02)).alias("coordinates")))
    user = F.struct(F.col("user_id").alias("id"), F.col("lang"), location.alias("location"),
                    F.lit("UTC").alias("time_zone"))
    rec = F.struct(user.alias("user"), F.col("text"),
                   F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("created_at"),
                   geo.alias("geo"))
    value = F.when((F.col("user_id") * 31 + F.col("line_no")) % 50 == 0, F.lit("{bad json"))\
        .otherwise(F.to_json(rec))
    return p.select("user_id", "line_no", value.alias("value"))


def stated_coordinates(raw: DataFrame) -> DataFrame:
    """X5's stand-in: users without a location text but with coordinates state these as text, ``lat,long``."""
    stated = F.array_join(F.col("geo.coordinates").cast("array<string>"), ",")
    return raw.withColumn("user", F.col("user").withField("location", F.coalesce(F.col("user.location"), stated)))


def located_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3 -> P1 -> P2 -> P4 on the JSON stand-in, keeping the line id."""
    from geolex.sources.readers import decode_lines
    raw = decode_lines(raw_post_json(spark, sf_dir), "value")
    raw = raw.withColumn("post_id", F.concat_ws(":", F.col("user.id").cast("string"), F.col("created_at")))
    flat = places.keep_located(places.flatten_posts(raw))
    return places.add_place_parts(flat)
