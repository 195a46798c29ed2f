"""Bounding boxes, tiles, projections and planar geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kilometres per degree, metres per degree used by the trip-distance rule, warning size.
KM_PER_DEGREE = 111.0
LON_METRES = 75000.0
LAT_METRES = 111000.0
LARGE_AREA_KM2 = 25.0

# WGS84 ellipsoid and UTM grid constants.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING = 10000000.0


def valid_bbox(west: Column, south: Column, east: Column, north: Column) -> Column:
    """``struct<ok, message>`` where the message names the first failing rule."""
    message = (
        F.when(~(west.between(-180, 180) & east.between(-180, 180)), "Longitude must be between -180 and 180")
        .when(~(south.between(-90, 90) & north.between(-90, 90)), "Latitude must be between -90 and 90")
        .when(west >= east, "West must be less than East")
        .when(south >= north, "South must be less than North")
    )
    known = west.isNotNull() & south.isNotNull() & east.isNotNull() & north.isNotNull()
    return F.struct(
        (known & message.isNull()).alias("ok"),
        F.when(known, F.coalesce(message, F.lit("Valid bbox"))).otherwise("Missing coordinate").alias("message"),
    )


def bbox_area_km2(west: Column, south: Column, east: Column, north: Column) -> Column:
    lon_km = F.lit(KM_PER_DEGREE) * F.cos(F.radians((south + north) / 2))
    return ((east - west) * lon_km) * ((north - south) * KM_PER_DEGREE)


def oversize_bbox(west: Column, south: Column, east: Column, north: Column) -> Column:
    return bbox_area_km2(west, south, east, north) > LARGE_AREA_KM2


def tile_x(lon: Column, zoom: Column) -> Column:
    return ((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def tile_y(lat: Column, zoom: Column) -> Column:
    rad = F.radians(lat)
    mercator = F.log(F.tan(rad) + F.lit(1.0) / F.cos(rad))
    return ((F.lit(1.0) - mercator / math.pi) / 2.0 * F.pow(F.lit(2.0), zoom)).cast("long")


def lonlat_to_tile(lon: Column, lat: Column, zoom: Column) -> Column:
    """``struct<x, y>`` of the web-mercator tile that holds the point."""
    return F.struct(tile_x(lon, zoom).alias("x"), tile_y(lat, zoom).alias("y"))


def _mercator_lat(fraction: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - fraction * 2.0))))


def tile_bounds(x: Column, y: Column, zoom: Column) -> Column:
    """``struct<west, south, east, north>`` of a tile."""
    n = F.pow(F.lit(2.0), zoom)
    return F.struct(
        (x / n * 360.0 - 180.0).alias("west"),
        _mercator_lat((y + 1) / n).alias("south"),
        ((x + 1) / n * 360.0 - 180.0).alias("east"),
        _mercator_lat(y / n).alias("north"),
    )


def tile_to_lonlat(px: Column, py: Column, x: Column, y: Column, zoom: Column, extent: Column) -> Column:
    """``struct<lon, lat>`` of a tile-local point (0..extent)."""
    scale = F.pow(F.lit(2.0), zoom) * extent.cast("double")
    return F.struct(
        ((x * extent + px) / scale * 360.0 - 180.0).alias("lon"),
        _mercator_lat((y * extent + py) / scale).alias("lat"),
    )


def grid_size(west: Column, south: Column, east: Column, north: Column) -> Column:
    # 0.002 degree spacing, at least 3 and at most 20 points a side.
    side = F.sqrt(F.abs(east - west) * F.abs(north - south)) / 0.002
    return F.greatest(F.lit(3), F.least(F.lit(20), side.cast("long"))).cast("int")


def geometry_bbox(geometry: Column) -> Column:
    """``struct<west, south, east, north>`` of a point array, null when it is empty."""
    lons = F.transform(geometry, lambda p: p["lon"])
    lats = F.transform(geometry, lambda p: p["lat"])
    return F.when(
        F.size(geometry) > 0,
        F.struct(
            F.array_min(lons).alias("west"), F.array_min(lats).alias("south"),
            F.array_max(lons).alias("east"), F.array_max(lats).alias("north"),
        ),
    )


def bbox_intersects(a: Column, b: Column) -> Column:
    """Closed intersection of two box structs."""
    apart = (a["east"] < b["west"]) | (b["east"] < a["west"]) | (a["north"] < b["south"]) | (b["north"] < a["south"])
    return ~apart


def has_point_in_bbox(geometry: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.exists(geometry, lambda p: p["lon"].between(west, east) & p["lat"].between(south, north))


def longest_line(lines: Column) -> Column:
    """The part with the most points, the first one on ties."""
    ranked = F.transform(
        lines, lambda line, i: F.struct(F.size(line).alias("n"), (-i).alias("order"), line.alias("line"))
    )
    return F.array_max(ranked)["line"]


def utm_zone(lon: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(60), (F.floor((lon + 180) / 6) + 1).cast("int")))


def utm_epsg(west: Column, south: Column, east: Column, north: Column) -> Column:
    lat = (south + north) / 2.0
    zone = F.lpad(utm_zone((west + east) / 2.0).cast("string"), 2, "0")
    return F.when(lat >= 0, F.concat(F.lit("EPSG:326"), zone)).otherwise(F.concat(F.lit("EPSG:327"), zone))


def projection_zone(proj: Column) -> Column:
    """``struct<zone, south>`` of a projection text; null unless it is a UTM projection."""
    zone = F.regexp_extract(proj, r"\+zone=(\d+)", 1)
    return F.when(
        proj.contains("+proj=utm") & (zone != ""),
        F.struct(zone.try_cast("int").alias("zone"), proj.contains("+south").alias("south")),
    )


def to_network_xy(lon: Column, lat: Column, zone: Column, south: Column, x_off: Column, y_off: Column) -> Column:
    """``struct<x, y>``: transverse Mercator (Krueger series, fourth order) plus the network offset."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    ecc = 2 * math.sqrt(n) / (1 + n)
    phi = F.radians(lat)
    dlon = F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(ecc) * F.atanh(F.lit(ecc) * F.sin(phi)))
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        north = north + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    scale = UTM_K0 * radius
    return F.struct(
        (east * scale + UTM_FALSE_EASTING + x_off).alias("x"),
        (north * scale + F.when(south, UTM_FALSE_NORTHING).otherwise(0.0) + y_off).alias("y"),
    )


def line_pieces(points: Column) -> Column:
    """Array of ``struct<x1, y1, x2, y2>``; empty for fewer than two points."""
    following = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    heads = F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0)))
    return F.zip_with(
        heads, following,
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def line_centroid(points: Column) -> Column:
    """``struct<x, y>``: length-weighted mean of piece midpoints, (0, 0) without geometry."""
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, p: Column) -> Column:
        length = F.hypot(p["x2"] - p["x1"], p["y2"] - p["y1"])
        return F.struct(
            (acc["w"] + length).alias("w"),
            (acc["x"] + length * (p["x1"] + p["x2"]) / 2).alias("x"),
            (acc["y"] + length * (p["y1"] + p["y2"]) / 2).alias("y"),
        )

    def finish(acc: Column) -> Column:
        return F.struct(
            F.when(acc["w"] > 0, acc["x"] / acc["w"]).otherwise(points[0]["x"]).alias("x"),
            F.when(acc["w"] > 0, acc["y"] / acc["w"]).otherwise(points[0]["y"]).alias("y"),
        )

    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.when(F.size(points) >= 2, F.aggregate(line_pieces(points), zero, add, finish)).otherwise(origin)


def _point_to_piece_sq(px, py, x1, y1, x2, y2) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length_sq = dx * dx + dy * dy
    along = (px - x1) * dx + (py - y1) * dy
    t = F.when(length_sq > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / length_sq))).otherwise(0.0)
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_distance(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Distance between pieces A-B and C-D, 0 where they cross."""
    crossing = (_side(ax, ay, bx, by, cx, cy) * _side(ax, ay, bx, by, dx, dy) < 0) & (
        _side(cx, cy, dx, dy, ax, ay) * _side(cx, cy, dx, dy, bx, by) < 0
    )
    nearest = F.least(
        _point_to_piece_sq(ax, ay, cx, cy, dx, dy), _point_to_piece_sq(bx, by, cx, cy, dx, dy),
        _point_to_piece_sq(cx, cy, ax, ay, bx, by), _point_to_piece_sq(dx, dy, ax, ay, bx, by),
    )
    return F.when(crossing, 0.0).otherwise(F.sqrt(nearest))


def min_trip_distance(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A tenth of the box diagonal, at least 200 m and at most 1 km."""
    dx = (east - west) * LON_METRES
    dy = (north - south) * LAT_METRES
    return F.least(F.lit(1000.0), F.greatest(F.lit(200.0), F.sqrt(dx * dx + dy * dy) * 0.1))
