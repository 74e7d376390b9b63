"""Levels, angles and skies of satellite channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.functions import codes

# The Earth's flattening as squares of axes' ratios, its polar radius and a geostationary orbit's radius (m).
AXES_RATIO, ECCENTRICITY2 = 0.993305616, 0.00669438444
POLAR_RADIUS, ORBIT = 6356752.3, 42164.0e3


def channel_level(transmittance: Column, pressure: Column) -> Column:
    """Pressure (Pa) of the layer that a channel sees most of: the middle of the two levels between which transmittance to space grows fastest with pressure.

    Both are arrays from the lowest level up. The lowest layer counts by its size whatever its sign; of equal layers the lowest counts. Null for fewer than two levels or a null value.
    """
    n = F.size(transmittance)
    weight = F.transform(F.sequence(F.lit(1), n - 1), lambda k: (F.get(transmittance, k) - F.get(transmittance, k - 1)) / F.abs(F.get(pressure, k) - F.get(pressure, k - 1)))
    signed = F.transform(weight, lambda w, k: F.when(k == 0, F.abs(w)).otherwise(w))
    at = F.array_position(signed, F.array_max(signed)).cast("int")
    whole = (n >= 2) & (F.size(pressure) >= n) & F.forall(transmittance, lambda x: x.isNotNull()) & F.forall(pressure, lambda x: x.isNotNull())
    return F.when(whole, (F.get(pressure, at) + F.get(pressure, at - 1)) / 2)


def zenith_angle(lon: Column, lat: Column, sub_lon: float) -> Column:
    """Angle (degrees) at a place between its zenith and a geostationary satellite above ``sub_lon``."""
    rad = codes.PI / 180
    geocentric = F.atan(AXES_RATIO * F.tan(lat * rad))
    radius = POLAR_RADIUS / F.sqrt(1 - ECCENTRICITY2 * F.cos(geocentric) * F.cos(geocentric))
    x, y, z = radius * F.cos(geocentric) * F.cos((lon - sub_lon) * rad), -radius * F.cos(geocentric) * F.sin((lon - sub_lon) * rad), radius * F.sin(geocentric)
    toward = (ORBIT - x, -y, -z)
    length = F.sqrt(sum((c * c for c in toward), F.lit(0.0)))
    up = (x * toward[0] + y * toward[1] + z * toward[2]) / (radius * length)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), up))) / rad


def cloud_fraction(water: Column, ice: Column, whole: float = 0.0, least: float = 0.0) -> Column:
    """Share of a layer that is cloud, of its contents of water and ice (g/m3): in proportion up to ``whole``; if that is 0, all or nothing above ``least``."""
    both = F.greatest(water, F.lit(0.0)) + F.greatest(ice, F.lit(0.0))
    known = water.isNotNull() & ice.isNotNull()
    return F.when(known, F.least(both / whole, F.lit(1.0)) if whole > 0 else F.when(both > least, 1.0).otherwise(0.0))


def signed_by_sky(all_sky: Column, clear_sky: Column, threshold: float) -> Column:
    """Brightness temperature, negative where cloud changes it by more than ``threshold``."""
    return F.when(F.abs(all_sky - clear_sky) > threshold, -all_sky).otherwise(all_sky)
