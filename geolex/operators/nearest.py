"""Nearest centroids within a radius (J3), by cells that split where centroids are dense.

The sphere is cut into base cells of ``SIDE`` radii.  A centroid belongs to every base cell that
its radius cap reaches, which for most is one or two.  A cell with more than ``LEAF`` centroids
splits into four, level by level: a child keeps the centroids that can be among the k
nearest of a point in it, those not farther from its centre than the k-th nearest centroid plus
the child's diameter.  The rows (cell, centroid) of a level are a table, so no array grows with
the data; only leaves, which hold at most ``LEAF`` centroids, become arrays.  Where halving
cells does not thin their centroids out (many are equally near to all of a cell: on one circle, or on a line seen
from afar), levels multiply the pairs; splitting ends at ``BUDGET`` times the pairs of the base
cells, at the latest after ``DEPTH`` levels, and such leaves hold more.

A point is looked up at each level that has leaves, by one equi join on (level, cell): it
lies in exactly one leaf, or in a base cell that no centroid reaches.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geolex.session import materialize

EARTH_RADIUS_MILES = 3958.8  # fixed value
#: A base cell's side in radii, centroids of a leaf, halvings of a base cell, rows without coordinates
#: are dealt to so many cells that no centroid has.
SIDE, LEAF, DEPTH, SALTS = 4, 256, 16, 1024
#: A level that has so many times the pairs of the base cells is the last.
BUDGET = 128
#: Slack for rounding, in degrees and as a share of a distance.
SLACK = 1e-9

CELL = ("level", "cy", "cx")


def _rad(c: Column) -> Column:
    return c * F.lit(math.pi / 180.0)


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in miles."""
    s_lat = F.sin(_rad(lat2 - lat1) / 2)
    s_lon = F.sin(_rad(lon2 - lon1) / 2)
    a = s_lat * s_lat + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * (s_lon * s_lon)
    return F.lit(2 * EARTH_RADIUS_MILES) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def base_grid(radius_miles: float) -> tuple[int, float]:
    """Base cells around the equator, and their side in degrees."""
    n_lon = max(1, math.floor(360.0 / (SIDE * math.degrees(radius_miles / EARTH_RADIUS_MILES))))
    return n_lon, 360.0 / n_lon


def _index(degrees: Column, size: float) -> Column:
    return F.floor(degrees / F.lit(size)).cast("long")


def cell_of(lat: Column, lon: Column, level: int, n_lon: int, size: float) -> tuple[Column, Column]:
    """(cy, cx) at a level.  Halving a cell's side is exact, so levels nest."""
    side = size / 2 ** level
    return _index(lat + 90.0, side), F.pmod(_index(lon + 180.0, side), F.lit(n_lon << level))


def base_pairs(spots: DataFrame, radius_miles: float) -> DataFrame:
    """``(level, cy, cx, spot, c_lat, c_lon)``: each spot in every base cell that its radius cap
    reaches (exact longitude half-width by latitude; all cells near a pole; wrap-around)."""
    n_lon, size = base_grid(radius_miles)
    delta = radius_miles / EARTH_RADIUS_MILES
    reach = math.degrees(delta) + SLACK
    lat, lon = F.col("c_lat"), F.col("c_lon")
    span = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(delta)) / F.cos(_rad(F.abs(lat)))))) + SLACK
    west, east = _index(lon - span + 180.0, size), _index(lon + span + 180.0, size)
    around = (F.abs(lat) + reach >= 90.0) | (east - west + 1 >= n_lon)
    xs = F.when(around, F.sequence(F.lit(0).cast("long"), F.lit(n_lon - 1).cast("long"))).otherwise(
        F.transform(F.sequence(west, east), lambda x: F.pmod(x, F.lit(n_lon))))
    ys = F.sequence(_index(lat - reach + 90.0, size), _index(lat + reach + 90.0, size))
    return (spots.select("*", F.explode(ys).alias("cy"))
            .select(F.lit(0).alias("level"), "cy", F.explode(xs).alias("cx"), "spot", "c_lat", "c_lon"))


def _quarters() -> Column:
    return F.array(*[F.struct((F.col("cy") * 2 + i).alias("cy"), (F.col("cx") * 2 + j).alias("cx"))
                     for i in (0, 1) for j in (0, 1)])


def child_pairs(pairs: DataFrame, level: int, radius_miles: float, k: int) -> DataFrame:
    """The pairs of the children, at ``level``, of the cells in ``pairs``."""
    _, size = base_grid(radius_miles)
    side = size / 2 ** level
    rows = pairs.select(F.explode(_quarters()).alias("_c"), "spot", "c_lat", "c_lon").select(
        F.lit(level).alias("level"), "_c.cy", "_c.cx", "spot", "c_lat", "c_lon")
    lat, lon = (F.col("cy") + 0.5) * side - 90.0, (F.col("cx") + 0.5) * side - 180.0
    # no point of the cell is farther from its centre: sin^2(d/2) <= (dlat/2)^2 + cos^2 (dlon/2)^2
    widest = F.cos(_rad(F.greatest(F.abs(lat) - side / 2, F.lit(0.0))))
    quarter = F.lit(math.radians(side / 4))
    half = 2 * EARTH_RADIUS_MILES * F.asin(F.least(F.lit(1.0), quarter * F.sqrt(1.0 + widest * widest)))
    rows = rows.withColumn("_d", haversine_miles(lat, lon, F.col("c_lat"), F.col("c_lon"))).withColumn("_half", half)
    if k == 1:
        kth = rows.groupBy(*CELL).agg(F.min("_d").alias("_kth"))
    else:
        nth = F.row_number().over(Window.partitionBy(*CELL).orderBy("_d"))
        kth = (rows.select(*CELL, "_d", nth.alias("_n")).filter(F.col("_n") <= k)
               .groupBy(*CELL).agg(F.max(F.when(F.col("_n") == k, F.col("_d"))).alias("_kth")))
    far = F.least(F.col("_kth") + 2 * F.col("_half"), F.col("_half") + radius_miles) * (1 + SLACK) + SLACK
    return rows.join(kth, [*CELL]).filter(F.col("_d") <= far).select(*CELL, "spot", "c_lat", "c_lon")


def leaf_cells(centroids: DataFrame, radius_miles: float, k: int = 1, leaf: int = LEAF) -> tuple[DataFrame, int]:
    """``(level, cy, cx, split, cands)`` and the deepest level.  ``cands`` are a leaf's candidates; ``split``
    marks base cells that have children instead.  A ``fips`` column of the centroids is carried
    along (null: unknown).  Of zips at one place the k smallest are kept."""
    known = F.col("fips") if "fips" in centroids.columns else F.lit(None).cast("long")
    spot = F.struct("zip", known.alias("fips"))
    places = [F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")]

    def crowded(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*CELL).count().filter(F.col("count") > leaf).select(*CELL)

    def arrays(rows: DataFrame) -> DataFrame:
        cand = F.struct("spot.zip", "spot.fips", F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"))
        return rows.groupBy(*CELL).agg(F.lit(False).alias("split"), F.collect_list(cand).alias("cands"))

    pairs = base_pairs(centroids.select(spot.alias("spot"), *places), radius_miles)
    if crowded(pairs).isEmpty():
        return arrays(pairs), 0
    if k == 1:
        spots = centroids.groupBy("lat", "lon").agg(F.min(spot).alias("spot"))
    else:
        nth = F.row_number().over(Window.partitionBy("lat", "lon").orderBy(spot))
        spots = centroids.select("lat", "lon", spot.alias("spot"), nth.alias("_n")).filter(F.col("_n") <= k)
    pairs = base_pairs(spots.select("spot", *places), radius_miles)
    full, parts, level, most = crowded(pairs), [], 0, BUDGET * pairs.count()
    while True:
        full = materialize(full, "crowded_cells")
        parts.append(arrays(pairs.join(full, [*CELL], "left_anti")))
        if level == 0:
            parts.append(full.select(*CELL, F.lit(True).alias("split"), F.lit(None).cast(parts[0].schema["cands"].dataType)
                                     .alias("cands")))
        level += 1
        children = full.select(F.lit(level).alias("level"), F.explode(_quarters()).alias("_c")).select(
            "level", "_c.cy", "_c.cx")
        pairs = materialize(child_pairs(pairs.join(full, [*CELL], "left_semi"), level, radius_miles, k), "cell_pairs")
        bare = children.join(pairs.select(*CELL).distinct(), [*CELL], "left_anti")
        parts.append(bare.select(*CELL, F.lit(False).alias("split"), F.array().cast(parts[0].schema["cands"].dataType)
                                 .alias("cands")))
        full = crowded(pairs)
        if level == DEPTH or full.isEmpty() or pairs.count() > most:
            parts.append(arrays(pairs))
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialize(out, "leaf_cells"), level


def with_nearest(points: DataFrame, lat: Column, lon: Column, centroids: DataFrame, radius_miles: float, k: int = 1,
                 need: Column | None = None, salt: Sequence[str] = (), leaf: int = LEAF) -> DataFrame:
    """``points`` with ``_near``, the k nearest zip centroids within ``radius_miles`` as an array of
    struct(dist, zip, fips), nearest first, ties to the smaller zip (null or empty if there is none).

    One plan for every size: an equi join of each point's cells with the leaves, whose strategy is the
    planner's (a broadcast where the leaves are measured small, else a shuffle join that AQE
    splits at a hot cell).  Rows that do not ``need`` it, or have no coordinates, take part in the same
    join under cells that no centroid has, dealt by a hash of the columns in ``salt``."""
    n_lon, size = base_grid(radius_miles)
    leaves, deepest = leaf_cells(centroids, radius_miles, k, leaf)
    has = lat.isNotNull() & lon.isNotNull()
    has = F.coalesce(has if need is None else need & has, F.lit(False))
    away = F.struct(F.lit(0).alias("level"),
                    (F.lit(-1000) - F.pmod(F.xxhash64(F.lit(0), *salt), F.lit(SALTS))).cast("long").alias("cy"),
                    F.lit(0).cast("long").alias("cx"))

    def at(level: int) -> Column:
        cy, cx = cell_of(lat, lon, level, n_lon, size)
        return F.struct(F.lit(level).alias("level"), cy.alias("cy"), cx.alias("cx"))

    if deepest:
        cells = F.when(has, F.array(*[at(n) for n in range(deepest + 1)])).otherwise(F.array(away))
        keyed = points.withColumn("_cell", F.explode(cells))
    else:
        keyed = points.withColumn("_cell", F.when(has, at(0)).otherwise(away))
    cell = leaves.select(F.struct(*CELL).alias("_leaf"), "split", "cands")
    on = [F.col("_cell")[c] == F.col("_leaf")[c] for c in CELL]
    met = keyed.join(cell, on, "left")
    if deepest:
        met = met.filter(F.coalesce(~F.col("split"), F.col("_cell.level") == 0))
    scored = F.filter(F.transform("cands", lambda c: F.struct(
        haversine_miles(lat, lon, c["lat"], c["lon"]).alias("dist"), c["zip"].alias("zip"), c["fips"].alias("fips"))),
        lambda s: s["dist"] <= radius_miles)
    if k == 1:
        near = F.filter(F.array(F.array_min(scored)), lambda s: s.isNotNull())
    else:
        near = F.slice(F.array_sort(scored), 1, k)
    return met.withColumn("_near", near).drop("_cell", "_leaf", "split", "cands")


def nearest_zips(points: DataFrame, centroids: DataFrame, radius_miles: float = 10.0, k: int = 1,
                 id_cols: Sequence[str] = ("point_id",), leaf: int = LEAF) -> DataFrame:
    """``(id..., rank, zip, dist)``: the k nearest zips of each point ``(id..., lat, lon)``."""
    near = with_nearest(points.select(*id_cols, "lat", "lon"), F.col("lat"), F.col("lon"), centroids, radius_miles, k,
                        leaf=leaf)
    ranked = near.select(*id_cols, F.posexplode("_near").alias("_i", "_n"))
    return ranked.select(*id_cols, (F.col("_i") + 1).alias("rank"), F.col("_n.zip").alias("zip"),
                         F.col("_n.dist").alias("dist"))
