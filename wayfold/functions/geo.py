"""Geometry as column expressions: distances, Web Mercator tiles, grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres per degree of the local flat approximation, and the explorer tile zoom.
METRES_PER_DEGREE_LAT = 110_574.0
METRES_PER_DEGREE_LON = 111_320.0
TILE_ZOOM = 14
MAX_TILE_LAT = 85.0511
# Metres per degree used for widening bounding boxes, and the least cosine.
BOX_METRES_PER_DEGREE = 111_000.0
MIN_COSINE = 0.2


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value if isinstance(value, Column) else F.lit(value)


def distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Equirectangular distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)) * METRES_PER_DEGREE_LON
    dy = (lat2 - lat1) * METRES_PER_DEGREE_LAT
    return F.sqrt(dx * dx + dy * dy)


def catalogue_distance_m(lat1, lon1, lat2, lon2) -> Column:
    """Distance used by the ferry and trail catalogues: longitude scaled at the first point."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    return F.hypot((lat2 - lat1) * METRES_PER_DEGREE_LAT,
                   (lon2 - lon1) * METRES_PER_DEGREE_LON * F.cos(F.radians(lat1)))


def segment_distance_m(plat, plon, alat, alon, blat, blon) -> Column:
    """Metres from a point to the segment a-b in the plane around the point."""
    plat, plon, alat, alon, blat, blon = map(_c, (plat, plon, alat, alon, blat, blon))
    scale = F.cos(F.radians(plat)) * METRES_PER_DEGREE_LON
    ax, ay = (alon - plon) * scale, (alat - plat) * METRES_PER_DEGREE_LAT
    dx, dy = (blon - alon) * scale, (blat - alat) * METRES_PER_DEGREE_LAT
    len2 = dx * dx + dy * dy
    along = F.when(len2 > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(ax * dx + ay * dy) / len2))).otherwise(F.lit(0.0))
    return F.hypot(ax + along * dx, ay + along * dy)


def box_margin_lat(metres) -> Column:
    return _c(metres) / BOX_METRES_PER_DEGREE


def box_margin_lon(metres, lat) -> Column:
    return box_margin_lat(metres) / F.greatest(F.cos(F.radians(_c(lat))), F.lit(MIN_COSINE))


def _mercator_row(lat: Column, tiles: float) -> Column:
    phi = F.radians(lat)
    return F.floor((1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * tiles)


def tile_x(lon, zoom: int = TILE_ZOOM) -> Column:
    tiles = 1 << zoom
    x = F.floor((_c(lon) + 180) / 360 * float(tiles))
    return F.greatest(F.lit(0), F.least(F.lit(tiles - 1), x)).cast("int")


def tile_y(lat, zoom: int = TILE_ZOOM) -> Column:
    tiles = 1 << zoom
    return F.greatest(F.lit(0), F.least(F.lit(tiles - 1), _mercator_row(_c(lat), float(tiles)))).cast("int")


def on_tile_map(lat, lon) -> Column:
    return (F.abs(_c(lat)) < MAX_TILE_LAT) & _c(lon).between(-180.0, 180.0)


def tile_xy(lat, lon, zoom: int = TILE_ZOOM) -> Column:
    """STRUCT<x,y> of the tile, null off the Web Mercator map."""
    return F.when(on_tile_map(lat, lon), F.struct(tile_x(lon, zoom).alias("x"), tile_y(lat, zoom).alias("y")))


def tile_key(x, y) -> Column:
    return F.shiftleft(_c(x).cast("bigint"), 32).bitwiseOR(_c(y).cast("bigint"))


def key_x(key) -> Column:
    return F.shiftright(_c(key), 32).cast("int")


def key_y(key) -> Column:
    return _c(key).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def tile_unkey(key) -> Column:
    return F.struct(key_x(key).alias("x"), key_y(key).alias("y"))


def tile_key_at(lat, lon) -> Column:
    return F.when(on_tile_map(lat, lon), tile_key(tile_x(lon), tile_y(lat)))


def tile_lat(y, zoom: int = TILE_ZOOM) -> Column:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * _c(y).cast("double") / float(1 << zoom)))))


def tile_lon(x, zoom: int = TILE_ZOOM) -> Column:
    return _c(x).cast("double") / float(1 << zoom) * 360 - 180


def tile_corner(x, y) -> Column:
    """North-west corner of a tile; x and y may be fractional."""
    return F.struct(tile_lat(y).alias("lat"), tile_lon(x).alias("lon"))


def tile_center(x, y) -> Column:
    return tile_corner(_c(x) + 0.5, _c(y) + 0.5)


def cell(value, size: float) -> Column:
    return F.floor(_c(value) / size).cast("bigint")


def cell_1deg(lat, lon) -> Column:
    """Name of the 1 degree cell, such as n50e005."""
    row, column = F.floor(_c(lat)), F.floor(_c(lon))
    return F.concat(F.when(row >= 0, F.lit("n")).otherwise(F.lit("s")), F.lpad(F.abs(row).cast("string"), 2, "0"),
                    F.when(column >= 0, F.lit("e")).otherwise(F.lit("w")), F.lpad(F.abs(column).cast("string"), 3, "0"))


def boxes_overlap(box: dict, other: dict, metres: float, at_lat) -> Column:
    """Whether two bounding boxes overlap once the first is widened by ``metres``.

    A box maps min_lat, max_lat, min_lon, max_lon to columns."""
    dlat, dlon = box_margin_lat(metres), box_margin_lon(metres, at_lat)
    return (
        (_c(other["min_lat"]) <= _c(box["max_lat"]) + dlat) & (_c(other["max_lat"]) >= _c(box["min_lat"]) - dlat)
        & (_c(other["min_lon"]) <= _c(box["max_lon"]) + dlon) & (_c(other["max_lon"]) >= _c(box["min_lon"]) - dlon))
