"""Places within a radius."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brinewell.functions.text import haversine_miles

#: Miles in a degree of latitude, taken low for boxes and high for bounds, and the least share of it that a degree of longitude is taken for (84 degrees north or south).
DEGREE, DEGREE_HIGH, LEAST = 69.0, 69.1, 0.1
#: Times that a cell is halved where places are dense.
HALVED = 8


def _cells(df: DataFrame, size: float, levels: int) -> DataFrame:
    """df with its cell at each level: _level, _row, _col."""
    at = df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    cell = lambda c: F.floor(F.col(c) * F.pow(F.lit(2.0), F.col("_level")) / size)
    return at.withColumns({"_row": cell("lat"), "_col": cell("lon")})


def within_miles(origins: DataFrame, places: DataFrame, origin: str, place: str, radius: float, limit: int | None = None) -> DataFrame:
    """(origin, place, miles) of all places within a radius of each origin, or of the `limit` nearest, ties by place.

    Both have lat and lon. Places lie in one cell each, cells being a radius
    high, and origins are dealt to the cells that their bounding box touches:
    a join on equal keys, whatever the tables' sizes. Rows without a position
    match nothing; boxes don't pass the date line.

    With a limit, a position is searched once for all origins there, and only
    the first `limit` places of a position can be among the nearest. Cells are
    halved HALVED times: where a position's own small cell holds `limit` places,
    none of the nearest is further away than that cell's diagonal, so only
    that far is searched. Candidates so grow with the positions, not with the
    places in a radius.
    """
    size = max(radius / DEGREE, 0.05)
    levels = HALVED if limit else 0
    o = origins.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col(origin), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    p = places.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col(place), F.col("lat"), F.col("lon"))
    searched = o
    if limit is not None:
        p = p.withColumn("_n", F.row_number().over(Window.partitionBy("lat", "lon").orderBy(place))).where(F.col("_n") <= limit).drop("_n")
        searched = o.select("_lat", "_lon").distinct()
    p = _cells(p, size, levels)
    high, wide, level = F.lit(radius / DEGREE), F.lit(radius) / (DEGREE * F.greatest(F.cos(F.radians("_lat")), F.lit(LEAST))), F.lit(0)
    if levels:
        # a cell is dense if it holds as many places as are wanted; its diagonal bounds the search, if it lies within the radius and no pole is near
        dense = p.where("_level > 0").groupBy("_level", "_row", "_col").agg(F.count(F.lit(1)).alias("_held")).where(F.col("_held") >= limit).drop("_held")
        own = _cells(searched.select("_lat", "_lon", F.col("_lat").alias("lat"), F.col("_lon").alias("lon")), size, levels).join(dense, ["_level", "_row", "_col"], "left_semi")
        best = own.groupBy("_lat", "_lon").agg(F.max("_level").alias("_level"))
        bound = DEGREE_HIGH * 2**0.5 * size / F.pow(F.lit(2.0), F.col("_level"))
        narrow = (F.coalesce("_level", F.lit(0)) > 0) & (bound < radius) & (F.radians(bound / DEGREE) <= F.cos(F.radians("_lat")) / 2)
        searched = searched.join(best, ["_lat", "_lon"], "left").withColumn("_reach", F.when(narrow, bound / DEGREE)).withColumn("_level", F.when(narrow, F.col("_level")).otherwise(0))
        high, level = F.coalesce("_reach", high), F.col("_level")
        wide = F.least(wide, F.coalesce(1.05 * F.col("_reach") / F.cos(F.radians("_lat")), wide))  # asin(x) is below 1.05 x up to a half
    cell = lambda c: F.floor(c * F.pow(F.lit(2.0), level) / size)
    s = searched.withColumns({"_level": level.cast("int"), "_high": high, "_wide": wide})
    s = s.withColumn("_row", F.explode(F.sequence(cell(F.col("_lat") - F.col("_high")), cell(F.col("_lat") + F.col("_high"))))).withColumn("_col", F.explode(F.sequence(cell(F.col("_lon") - F.col("_wide")), cell(F.col("_lon") + F.col("_wide")))))
    box = (F.abs(F.col("lat") - F.col("_lat")) <= F.col("_high")) & (F.abs(F.col("lon") - F.col("_lon")) <= F.col("_wide"))
    miles = haversine_miles(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")).alias("miles")
    found = s.join(p, ["_level", "_row", "_col"]).where(box).select(*searched.drop("_level", "_reach").columns, place, miles).where(F.col("miles") <= radius)
    if limit is None:
        return found.select(origin, place, "miles")
    w = Window.partitionBy("_lat", "_lon").orderBy("miles", place)
    nearest = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    # an origin in one row has its nearest by now; those in several rows, if any, are ranked once more
    once = o.groupBy(origin).agg(F.count(F.lit(1)).alias("_rows"), F.first("_lat").alias("_lat"), F.first("_lon").alias("_lon")).where("_rows = 1").drop("_rows")
    more = o.groupBy(origin).agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select(F.col(origin).alias("_again"))
    several = o.join(more, F.col(origin).eqNullSafe(F.col("_again")), "left_semi").join(nearest, ["_lat", "_lon"])
    last = Window.partitionBy(origin).orderBy("miles", place)
    several = several.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= limit)
    return once.join(nearest, ["_lat", "_lon"]).select(origin, place, "miles").unionByName(several.select(origin, place, "miles"))
