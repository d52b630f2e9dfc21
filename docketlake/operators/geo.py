"""Nearest places by great circles, and centroids of polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RADIUS_KM = 6371.0088
MOST_PLACES = 100_000


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in kilometres on the sphere."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.least(F.sqrt(half), F.lit(1.0)))


def nearest(points: DataFrame, places: DataFrame, degrees: float = 1.0) -> DataFrame:
    """The points (lat, lon, ...) with the ``nearest`` of the places (name, lat, lon) and its ``distance_km``; ties by name. Null points have none.

    The sphere is cut into cells of ``degrees``. A place can only be nearest to a point of a cell if its distance from the cell's
    centre is within twice the cell's radius of the least one (triangle inequality), across the date line and at the poles too.
    There are at most (180 / degrees) * (360 / degrees) cells, so their short lists are broadcast; the places are a lookup of checked size.
    """
    n = places.count()
    if n > MOST_PLACES:
        raise ValueError(f"a lookup of {n} places is larger than {MOST_PLACES}")
    listed = places.where("lat is not null and lon is not null").agg(F.array_sort(F.collect_list(F.struct("name", "lat", "lon"))).alias("_places"))
    row, column = F.floor((F.col("lat") + 90) / degrees), F.floor(F.pmod(F.col("lon") + 180, F.lit(360.0)) / degrees)
    keyed = points.withColumn("_cell", F.struct(row.alias("r"), column.alias("c")))
    cells = keyed.where("lat is not null and lon is not null").select("_cell").distinct()
    south, west = F.col("_cell.r") * degrees - 90, F.col("_cell.c") * degrees - 180
    lat, lon = south + degrees / 2, west + degrees / 2
    # the farthest points of a cell from its centre are corners; a little is added for rounding
    radius = F.greatest(great_circle(lat, lon, south, west), great_circle(lat, lon, south + degrees, west)) * 1.000001 + 1e-6
    measured = F.transform("_places", lambda p: F.struct(great_circle(F.col("_lat"), F.col("_lon"), p["lat"], p["lon"]).alias("d"), p.alias("p")))
    cells = cells.select("_cell", lat.alias("_lat"), lon.alias("_lon"), radius.alias("_radius")).join(F.broadcast(listed))  # one row
    cells = cells.select("_cell", "_radius", measured.alias("_m"))
    near = F.transform(F.filter("_m", lambda m: m["d"] <= F.array_min(F.transform("_m", lambda x: x["d"])) + 2 * F.col("_radius")), lambda m: m["p"])
    found = keyed.join(F.broadcast(cells.select("_cell", near.alias("_near"))), "_cell", "left")
    best = F.array_min(F.transform("_near", lambda p: F.struct(great_circle(F.col("lat"), F.col("lon"), p["lat"], p["lon"]).alias("d"), p["name"].alias("name"))))
    return found.withColumn("_best", best).select(*points.columns, F.col("_best.name").alias("nearest"), F.col("_best.d").alias("distance_km"))


def _ring(points: Column) -> Column:
    """struct<a,x,y>: area of a ring and its moments, positive whichever way it runs."""

    def step(s: Column, i: Column) -> Column:
        x0, y0, x1, y1 = (F.get(F.get(points, j), F.lit(k)) for j in (i, i + 1) for k in (0, 1))
        cross = x0 * y1 - x1 * y0
        return F.struct((s["a"] + cross / 2).alias("a"), (s["x"] + (x0 + x1) * cross / 6).alias("x"), (s["y"] + (y0 + y1) * cross / 6).alias("y"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("a", "x", "y")])
    sides = F.when(F.size(points) > 1, F.sequence(F.lit(0), F.size(points) - 2)).otherwise(F.array().cast("array<int>"))
    turned = lambda s: F.struct(*[(s[c] * F.signum(s["a"])).alias(c) for c in ("a", "x", "y")])
    return F.aggregate(sides, zero, step, turned)


def centroids(shapes: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Adds lat and lon of the area's centre (in the plane of degrees) of a struct<type,coordinates: JSON text> of Polygon or MultiPolygon; holes do not count, other shapes have none."""
    g = F.col(geometry)
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    polygons = F.when(g["type"] == "Polygon", F.array(F.from_json(g["coordinates"], one))).when(g["type"] == "MultiPolygon", F.from_json(g["coordinates"], many))
    signed = lambda rings: F.transform(rings, lambda r, i: F.struct(_ring(r).alias("m"), F.when(i == 0, 1).otherwise(-1).alias("s")))
    parts = F.flatten(F.transform(polygons, signed))
    total = lambda c: F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["s"] * p["m"][c])
    area = F.nullif(total("a"), F.lit(0.0))
    return shapes.withColumns({"lat": total("y") / area, "lon": total("x") / area})


def read_geojson(spark: SparkSession, path: str, name: str = "NAME") -> DataFrame:
    """(name, lat, lon): centres of the features of GeoJSON files (whole collections), by the property that names them."""
    kind = f"features array<struct<properties: struct<`{name}`: string>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return centroids(rows.select(F.col(f"f.properties.`{name}`").alias("name"), F.col("f.geometry").alias("geometry"))).select("name", "lat", "lon")
