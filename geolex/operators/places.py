"""Posts, gazetteers and place resolution.

Lookups are equi joins against tables whose size is bounded by geography
(counties, states, zips), never by the number of posts.  No join hint is
forced: the static planner broadcasts a side whose estimated size is below
``spark.sql.autoBroadcastJoinThreshold`` and AQE re-checks the measured size
of every shuffle stage, so a side that turns out large falls back to a
sort-merge join (and AQE splits a skewed partition of it).

The nearest-zip search (J3) is an equi join on adaptive cells (``operators.nearest``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolex.functions import text as tx
from geolex.operators.nearest import nearest_zips, with_nearest
from geolex.sources.schemas import ATTAINMENT_VALUE_COLUMNS, LEVEL_COLUMNS

# ----------------------------------------------------------------- posts ---
def flatten_posts(raw: DataFrame) -> DataFrame:
    """Nested post -> flat columns; a null ``user`` gives null fields."""
    return raw.select(
        F.col("user.id").alias("user_id"), F.col("user.lang").alias("lang"),
        F.col("user.location").alias("location"), F.col("user.time_zone").alias("time_zone"),
        "text", "created_at", "geo",
        *[c for c in raw.columns if c not in ("user", "text", "created_at", "geo", "_corrupt")])


def located(user_id: Column, lang: Column, location: Column, geo: Column, wanted: str = "en",
            strict: bool = False) -> Column:
    """P2 (default): id present, language ``wanted``, location or geo present.
    P3 (``strict``): id non-zero, location non-empty, language ``wanted``."""
    if strict:
        place = (user_id != 0) & location.isNotNull() & (location != "")
    else:
        place = location.isNotNull() | geo.isNotNull()
    return user_id.isNotNull() & (lang == wanted) & place


def keep_located(df: DataFrame, lang: str = "en", strict: bool = False) -> DataFrame:
    """P2, or with ``strict`` P3, on flat posts."""
    return df.filter(located(F.col("user_id"), F.col("lang"), F.col("location"), F.col("geo"), lang, strict))


def keep_located_raw(lang: str = "en", strict: bool = False) -> Column:
    """The same condition on decoded posts, before they are flattened."""
    user = F.col("user")
    return located(user["id"], user["lang"], user["location"], F.col("geo"), lang, strict)


def coordinates(geo: Column | str) -> Column:
    """P5: the coordinate pair, null when geo or its coordinates are missing/empty."""
    g = F.col(geo) if isinstance(geo, str) else geo
    c = g.getField("coordinates")
    return F.when(c.isNotNull() & (F.size(c) > 0), c)


def add_place_parts(df: DataFrame) -> DataFrame:
    """Add state / county (T3) and coordinates (P5); lang and geo dropped."""
    loc = tx.split_location("location")
    keep = [c for c in df.columns if c not in ("lang", "geo", "location", "user_id", "time_zone",
                                                "text", "created_at")]
    return df.select("user_id", "location", loc.getField("state").alias("state"),
                     loc.getField("county").alias("county"), "time_zone", "text", "created_at",
                     coordinates("geo").alias("coordinates"), *keep)


# ------------------------------------------------------------ attainment ---
def clean_attainment(raw: DataFrame, counties_only: bool = True) -> DataFrame:
    """P8 (+P9, P7): FIPS as long, state lower-cased, area by the canonical
    place-name normaliser (T2), every value a double with blanks -> 0.0
    (D19); ``counties_only`` keeps FIPS not divisible by 1000 (P7)."""
    out = raw.select(
        F.trim("FIPS").try_cast("long").alias("FIPS"),
        F.lower("State").alias("State"),
        tx.place_name("Area").alias("Area"),
        *[F.coalesce(F.trim(F.col(f"`{c}`")).try_cast("double"), F.lit(0.0)).alias(c)
          for c in ATTAINMENT_VALUE_COLUMNS])
    if counties_only:
        out = out.filter(F.col("FIPS") % 1000 != 0)
    return out


def attainment_levels(att: DataFrame, key: str = "fips") -> DataFrame:
    """The last four value columns as ``education_level_1..4``."""
    last4 = ATTAINMENT_VALUE_COLUMNS[-4:]
    return att.select(F.col("FIPS").cast("long").alias(key),
                      *[F.col(f"`{c}`").alias(n) for c, n in zip(last4, LEVEL_COLUMNS)])


def place_names(att_raw: DataFrame) -> DataFrame:
    """Gazetteer ``(name, fips)``.

    Every row is known by its normalised area name; a state row (FIPS
    divisible by 1000) also by its lower-cased state abbreviation.  When a
    name repeats, the later row wins (file order = ascending FIPS, the area
    name before the abbreviation of the same row; D11).
    """
    fips = F.trim("FIPS").try_cast("long")
    by_area = att_raw.select(tx.place_name("Area").alias("name"), fips.alias("fips"),
                             F.lit(0).alias("_kind"))
    by_state = (att_raw.filter(fips % 1000 == 0)
                .select(F.lower("State").alias("name"), fips.alias("fips"), F.lit(1).alias("_kind")))
    rows = by_area.unionByName(by_state).filter(F.col("name").isNotNull() & F.col("fips").isNotNull())
    # order (fips, kind) as one number so the aggregate stays hash-based
    return rows.groupBy("name").agg(F.max_by("fips", F.col("fips") * 2 + F.col("_kind")).alias("fips"))


def zip_table(zips: DataFrame, multi: str = "one") -> DataFrame:
    """J10 (+M12): ``(zip, fips)`` with FIPS as a number (leading zero gone).

    ``multi='one'`` keeps one county per zip (the largest FIPS, a
    deterministic stand-in for "the last row wins"); ``'all'`` keeps all.
    """
    z = zips.select(F.trim(F.col("zip").cast("string")).alias("zip"),
                    F.trim(F.col("fips").cast("string")).try_cast("long").alias("fips"))
    z = z.filter(F.col("zip").isNotNull() & F.col("fips").isNotNull())
    if multi == "one":
        return z.groupBy("zip").agg(F.max("fips").alias("fips"))
    if multi == "all":
        return z.distinct()
    raise ValueError("multi must be 'one' or 'all'")


def zip_to_fips(df: DataFrame, zips_all: DataFrame, zip_col: str = "zip") -> DataFrame:
    """Every county of the row's zip (inner join, all matches kept)."""
    return df.join(zips_all.withColumnRenamed("zip", zip_col), zip_col, "inner")


# ------------------------------------------------------------- geo search ---
def nearest_zip(points: DataFrame, centroids: DataFrame, radius_miles: float = 10.0,
                id_cols: Sequence[str] = ("point_id",)) -> DataFrame:
    """For each point ``(id..., lat, lon)`` the nearest zip centroid
    ``(zip, lat, lon)``: ``(id..., zip, dist)``.  Points with no zip in range are
    absent."""
    return nearest_zips(points, centroids, radius_miles, 1, id_cols).drop("rank")


# ------------------------------------------------------------ resolution ---
def resolve_places(posts: DataFrame, names: DataFrame, zips_one: DataFrame | None = None,
                   centroids: DataFrame | None = None, known_fips: DataFrame | None = None,
                   radius_miles: float = 10.0) -> DataFrame:
    """``fips``, ``resolved_by`` and the nearest ``zip`` for every post.

    Priority county name -> state name -> coordinates; coordinates count
    only when neither name matched.  The nearest zip decides, even if its
    county is not in ``known_fips`` (J4): then the post has a ``zip`` but no
    ``fips`` (counted by ``unmatched_zips``, filtered by P6).

    The posts are read once: those resolved by name, or without coordinates, take
    part in the join with the cells under salted keys that no centroid has.  Each
    zip's county is attached to the candidates before, so no post is joined on a
    zip.  Rows need no id.
    """
    county = names.select(F.col("name").alias("county"), F.col("fips").alias("_f_county"))
    state = names.select(F.col("name").alias("state"), F.col("fips").alias("_f_state"))
    r = posts.join(county, "county", "left").join(state, "state", "left")
    none = F.lit(None)
    if zips_one is None or centroids is None:
        r = r.withColumn("_f_coord", none.cast("long")).withColumn("zip", none.cast("string"))
    else:
        zips = zips_one.select("zip", "fips")
        if known_fips is not None:
            zips = zips.join(known_fips.select("fips").distinct(), "fips", "left_semi")
        spots = (centroids.select(F.col("zip").cast("string").alias("zip"), "lat", "lon")
                 .join(zips, "zip", "left"))
        need = F.col("_f_county").isNull() & F.col("_f_state").isNull()
        salt = [c for c in posts.columns if c != "text"]
        r = with_nearest(r, F.get("coordinates", 0), F.get("coordinates", 1), spots, radius_miles, need=need, salt=salt)
        first = F.get("_near", 0)
        r = r.withColumn("_f_coord", first["fips"]).withColumn("zip", first["zip"]).drop("_near")
    resolved_by = (F.when(F.col("_f_county").isNotNull(), "county")
                   .when(F.col("_f_state").isNotNull(), "state")
                   .when(F.col("_f_coord").isNotNull(), "coordinates"))
    return (r.withColumn("fips", F.coalesce("_f_county", "_f_state", "_f_coord"))
            .withColumn("resolved_by", resolved_by)
            .drop("_f_county", "_f_state", "_f_coord"))


def unmatched_zips(resolved: DataFrame) -> DataFrame:
    """J4's counter: posts (``n_posts``) and zips (``n_zips``) whose county is unknown."""
    lost = resolved.filter(F.col("zip").isNotNull() & F.col("fips").isNull())
    return lost.agg(F.count(F.lit(1)).alias("n_posts"), F.countDistinct("zip").alias("n_zips"))
