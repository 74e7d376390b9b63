"""Places on grids and angles of beams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.functions import codes
from isohyet.functions.physics import great_circle


def beam(lon: Column, lat: Column, height: Column, site: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Azimuth in [0, 360) and elevation, in degrees, from a radar at ``site`` (lon, lat, z); null above the site itself."""
    degrees = 180 / codes.PI
    east, north = (lon - site[0]) * F.cos(site[1] / degrees), lat - site[1]
    at_site = (lon == site[0]) & (lat == site[1])
    azimuth = F.atan2(east, north) * degrees
    azimuth = F.when(azimuth < 0, azimuth + 360).otherwise(azimuth)
    elevation = F.atan2(height - site[2], great_circle(lon, lat, site[0], site[1])) * degrees
    return F.when(~at_site, azimuth), F.when(~at_site, elevation)


def rotated(u: Column, v: Column, cosine: Column, sine: Column) -> tuple[Column, Column]:
    """Wind turned from the map's directions to east and north."""
    return u * cosine - v * sine, u * sine + v * cosine


def tile_id(ri: Column, rj: Column, size: tuple[int, int], tiles: tuple[int, int]) -> Column:
    """Number of the tile of ``size`` points that holds a place, along i first; -1 outside of all."""
    inside = ri.between(1, size[0] * tiles[0]) & rj.between(1, size[1] * tiles[1])
    a, b = F.ceil((ri - 0.5) / size[0]) - 1, F.ceil((rj - 0.5) / size[1]) - 1
    return F.when(inside, a + b * tiles[0]).otherwise(-1).cast("int")
