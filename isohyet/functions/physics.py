"""Thermodynamics, radar and statistics functions as Spark columns."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions import codes

P00 = 1.0e5


def state_to_physical(rho: Column, mom: Sequence[Column], rhot: Column, tracers: Sequence[Column], heat: Sequence[float]) -> dict[str, Column]:
    """u, v, w, t, p from density, momenta, density-weighted potential temperature and tracers (vapour first)."""
    r, cp, cv = _gas(tracers, heat)
    p = P00 * F.pow(rhot * r / P00, (cv + r) / cv)
    return {"u": mom[0] / rho, "v": mom[1] / rho, "w": mom[2] / rho, "t": p / (rho * r), "p": p}


def physical_to_state(u: Column, v: Column, w: Column, t: Column, p: Column, tracers: Sequence[Column], heat: Sequence[float]) -> dict[str, Column]:
    """The inverse: rho, rhou, rhov, rhow, rhot."""
    r, cp, cv = _gas(tracers, heat)
    rho = p / (r * t)
    return {"rho": rho, "rhou": rho * u, "rhov": rho * v, "rhow": rho * w, "rhot": P00 / r * F.pow(p / P00, cv / (cv + r))}


def clipped(tracers: Sequence[Column], vapour: bool = False, condensate: bool = False) -> list[Column]:
    """Tracers (vapour first) without negative amounts: of vapour, of all others, or both; a null stays null."""
    flags = [vapour, *[condensate] * (len(tracers) - 1)]
    return [F.when(q < 0, 0.0).otherwise(q) if flag else q for q, flag in zip(tracers, flags, strict=True)]


def _gas(tracers: Sequence[Column], heat: Sequence[float]) -> tuple[Column, Column, Column]:
    dry = F.lit(1.0)
    cv = F.lit(0.0)
    for q, c in zip(tracers, heat, strict=True):
        dry, cv = dry - q, cv + q * c
    cv = cv + (codes.CP_DRY - codes.R_DRY) * dry
    r = codes.R_DRY * dry + codes.R_VAPOUR * tracers[0]
    return r, cv + r, cv


def relative_humidity(t: Column, q: Column, p: Column) -> Column:
    """Over water above 0 C, over ice below -15 C, a blend between."""
    c = t - 273.15
    water, ice = 6.11 * F.exp(17.3 * c / (237.3 + c)), 6.1121 * F.exp(22.587 * c / (273.86 + c))
    saturated = F.when(c >= 0, water).when(c <= -15, ice).otherwise((water * (15 + c) - ice * c) / 15)
    return q * p * 0.01 / (0.378 * q + 0.622) / saturated


def pressure_at(p: Column, dz: Column, t: Column, q: Column, lapse: float = 5.0e-3) -> Column:
    """Hypsometric adjustment of p over the height difference dz."""
    tv = t * (1 + 0.608 * q)
    return F.when(dz == 0, p).otherwise(p * F.pow((tv - lapse * dz) / tv, codes.GRAVITY / (lapse * codes.R_DRY)))


def reflectivity_of_total(rho: Column, qr: Column, qs: Column, qg: Column) -> Column:
    """Method 1: all condensate counts as rain."""
    total = qr + qs + qg
    scale = 72 * 1.0e19 / (codes.PI**1.75 * 8.0e6**0.75 * 1000.0**1.75)
    return F.when(total > 0, scale * F.pow(rho * total, F.lit(1.75))).otherwise(0.0)


def terminal_velocity(total: Column, p: Column) -> Column:
    return F.when(total > 0, 5.4 * F.pow(P00 / p, F.lit(0.4)) * F.pow(total, F.lit(0.125))).otherwise(0.0)


def radial_velocity(u: Column, v: Column, w: Column, azimuth: Column, elevation: Column, fall: Column | None = None) -> Column:
    """Wind along the beam; angles in degrees; ``fall`` is a terminal velocity to take off w."""
    rad = codes.PI / 180
    level = F.cos(elevation * rad) * (u * F.sin(azimuth * rad) + v * F.cos(azimuth * rad))
    return level + (w if fall is None else w - fall) * F.sin(elevation * rad)


def radar_preprocessed(z: Column, least: float = 10.0, least_dbz: float = 10.0, shift: float = 0.0) -> tuple[Column, Column]:
    """Element name and dBZ of a linear reflectivity; dBZ is null outside [0, 1e10) and for a null."""
    element = F.when(z < least, "RE0").otherwise("REF")
    dbz = F.when(z.isNull() | (z < 0) | (z >= 1e10), F.lit(None)).when(z < least, least_dbz + shift).otherwise(10 * F.log10(F.greatest(z, F.lit(1e-30))))
    return element, dbz


def radar_error(elm: Column, err: Column, reflectivity: float | None = None, wind: float | None = None) -> Column:
    """A radar observation's error, or the one that the settings give for reflectivities (with and without an echo) and for winds."""
    out = err
    if reflectivity is not None:
        out = F.when(elm.isin(codes.ID["REF"], codes.ID["RE0"]), reflectivity).otherwise(out)
    return out if wind is None else F.when(elm == codes.ID["Vr"], wind).otherwise(out)


def taper(distance: Column, scale: float) -> Column:
    """Fifth-order compactly supported correlation with half width ``scale * sqrt(10/3)``."""
    b = distance / (scale * (10 / 3) ** 0.5)

    def poly(*c: float) -> Column:
        out = F.lit(0.0)
        for x in c:
            out = out * b + x
        return out

    near = poly(-0.25, 0.5, 0.625, -5 / 3, 0, 1)
    far = poly(1 / 12, -0.5, 0.625, 5 / 3, -5, 4) - F.lit(2 / 3) / F.when(b > 0, b)
    return F.when(b <= 1, near).when(b <= 2, far).otherwise(0.0)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Distance in metres of points in degrees."""
    rad = codes.PI / 180
    c = F.sin(lat1 * rad) * F.sin(lat2 * rad) + F.cos(lat1 * rad) * F.cos(lat2 * rad) * F.cos((lon2 - lon1) * rad)
    return F.when(c.isNotNull(), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))) * codes.EARTH_RADIUS)


def destination(lon: Column, lat: Column, distance: Column, azimuth: Column) -> tuple[Column, Column]:
    """Longitude and latitude at a distance (m) along an azimuth (degrees from north)."""
    rad = codes.PI / 180
    d, a, y = distance / codes.EARTH_RADIUS, azimuth * rad, lat * rad
    lat2 = F.asin(F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.cos(a))
    lon2 = lon * rad + F.atan2(F.sin(d) * F.sin(a) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(lat2))
    return lon2 / rad, lat2 / rad


# Fixed values of the drop-size distributions: intercepts (m^-4), densities (kg/m3), dielectric factors, fall coefficients.
N0_RAIN, N0_SNOW, N0_GRAUPEL = 8.0e6, 3.0e6, 4.0e4
RHO_RAIN, RHO_SNOW, RHO_GRAUPEL, RHO_ICE = 1000.0, 100.0, 913.0, 917.0
K2_ICE, K2_WATER = 0.176, 0.930
FALL_RAIN, FALL_SNOW, DRAG = (2115.0, 0.8), (152.93, 0.25), 0.6
MELTING_POINT = 273.16


def _where_positive(q: Column, value: Column) -> Column:
    return F.when(q > 0, value).otherwise(0.0)


def _with_fall(df: DataFrame, species: dict[str, str], intercepts: Sequence[float], graupel: float, exponent: float) -> DataFrame:
    """``fall``: reflectivity-weighted mean fall speed (m/s) of exponential size distributions, in cgs units inside.

    ``species`` gives, for each column of reflectivity, its fall speed: that of rain, snow or graupel. ``exponent`` is
    that of the air-density correction, which graupel has in its drag instead. Steps are columns of their own.
    """
    df = df.withColumn("air", F.col("rho") * 1e-3)
    air = F.col("air")

    def slope(q: str, dense: float, n0: float, power: float) -> Column:
        return F.pow(air * F.col(q) / (codes.PI * dense * n0), F.lit(power / 4))

    def liquid(q: str, law: tuple[float, float], dense: float, n0: float) -> Column:
        factor = 0.01 * law[0] * math.gamma(4 + law[1]) / 6
        return _where_positive(F.col(q), factor * slope(q, dense, n0, law[1]) * F.pow(0.001 / air, F.lit(exponent)))

    drag = F.sqrt(4 * codes.GRAVITY * 100 * graupel / (3 * DRAG * air))
    df = df.withColumns({
        "wr": liquid("qr", FALL_RAIN, RHO_RAIN * 1e-3, intercepts[0]),
        "ws": liquid("qs", FALL_SNOW, RHO_SNOW * 1e-3, intercepts[1]),
        "wg": _where_positive(F.col("qg"), 0.01 * math.gamma(4.5) / 6 * drag * slope("qg", graupel, intercepts[2], 0.5)),
    })
    total = functools.reduce(operator.add, [F.col(z) for z in species])
    flux = functools.reduce(operator.add, [F.col(z) * F.col(w) for z, w in species.items()])
    df = df.withColumn("ref", total).withColumn("flux", flux)
    return df.withColumn("fall", F.when(F.col("ref") > 0, F.col("flux") / F.col("ref")).otherwise(0.0)).drop("air", "wr", "ws", "wg", "flux", *species)


def with_reflectivity_by_species(df: DataFrame) -> DataFrame:
    """Method 2, columns ``ref`` and ``fall`` of rho, t, qr, qs, qg: rain, snow (dry up to the melting point, then wet) and graupel."""
    rho, t, qr, qs, qg = (F.col(c) for c in ("rho", "t", "qr", "qs", "qg"))
    scale = 720e18 / codes.PI**1.75
    zr = scale / (N0_RAIN**0.75 * RHO_RAIN**1.75) * F.pow(rho * qr, F.lit(1.75))
    dry = scale * K2_ICE * RHO_SNOW**0.25 / (K2_WATER * N0_SNOW**0.75 * RHO_ICE**2)
    wet = scale / (N0_SNOW**0.75 * RHO_ICE**1.75)
    zs = F.when(t <= MELTING_POINT, dry).otherwise(wet) * F.pow(rho * qs, F.lit(1.75))
    zg = (scale / (N0_GRAUPEL**0.75 * RHO_GRAUPEL**1.75)) ** 0.95 * F.pow(rho * qg, F.lit(1.6625))
    df = df.withColumns({"zr": _where_positive(qr, zr), "zs": _where_positive(qs, zs), "zg": _where_positive(qg, zg)})
    return _with_fall(df, {"zr": "wr", "zs": "ws", "zg": "wg"}, (N0_RAIN * 1e-3, N0_SNOW * 1e-3, N0_GRAUPEL * 1e-3), RHO_GRAUPEL * 1e-3, 0.25)


MOST_MELTING = 0.5
# Rain, dry snow, dry graupel: factor and exponent of the content in g/m3
Z_POWER = ((2.53e4, 1.84), (3.48e3, 1.66), (5.54e3, 1.70))
# melting snow, melting graupel: factor (1e5) and exponent as parabolas of the water fraction
Z_MELTING = (((0.00491, 5.75, -5.588), (1.67, -0.202, 0.398)), ((0.809, 10.13, -5.98), (1.48, 0.0448, -0.0313)))


def with_reflectivity_melting(df: DataFrame) -> DataFrame:
    """Method 3, columns ``ref`` and ``fall`` of rho, qr, qs, qg: part of rain and ice counts as melting particles where both occur."""
    rho, qr = F.col("rho"), F.col("qr")
    for ice in ("s", "g"):
        q = F.col("q" + ice)
        both = (qr > 0) & (q > 0)
        df = df.withColumns({
            "share_" + ice: F.when(both, MOST_MELTING * F.pow(F.least(qr, q) / F.greatest(qr, q), F.lit(1 / 3))).otherwise(0.0),
            "water_" + ice: F.when(both, qr / (qr + q)).otherwise(0.0),
        })
    share_s, share_g = F.col("share_s"), F.col("share_g")
    df = df.withColumns({"pr": (1 - share_s - share_g) * qr, "ps": (1 - share_s) * F.col("qs"), "pg": (1 - share_g) * F.col("qg"), "ms": share_s * (qr + F.col("qs")), "mg": share_g * (qr + F.col("qg"))})
    z = {"z" + c: _where_positive(F.col(c), a * F.pow(rho * F.col(c) * 1000, F.lit(b))) for c, (a, b) in zip(("pr", "ps", "pg"), Z_POWER, strict=True)}
    for ice, laws in zip(("s", "g"), Z_MELTING, strict=True):
        water = F.col("water_" + ice)
        factor, exponent = (c[0] + c[1] * water + c[2] * water * water for c in laws)
        z["zm" + ice] = _where_positive(F.col("m" + ice), factor * 1e5 * F.pow(rho * F.col("m" + ice) * 1000, exponent))
    df = df.withColumns(z).drop("pr", "ps", "pg", "ms", "mg", "share_s", "share_g", "water_s", "water_g")
    return _with_fall(df, {"zpr": "wr", "zps": "ws", "zpg": "wg", "zms": "ws", "zmg": "wg"}, (8.0e-2, 3.0e-2, 4.0e-4), 0.917, 0.5)


def terrain_height(topo: Column, cz: Column, top: float) -> Column:
    """Height of a terrain-following level."""
    return (top - topo) / top * cz + topo


def advected(lon: Column, lat: Column, u: Column, v: Column, hours: float, rate: float = 1.0) -> tuple[Column, Column]:
    """Where air now at a point was ``hours`` ago; over a pole the longitude turns by half, longitudes are in [0, 360]."""
    degrees = rate * hours * 3600 * 180 / (codes.PI * codes.EARTH_RADIUS)
    y = lat - v * degrees
    x = lon - u / F.cos(lat * (codes.PI / 180)) * degrees
    over = F.abs(y) > 90
    x, y = F.when(over, x + 180).otherwise(x), F.when(over, F.signum(y) * 180 - y).otherwise(y)
    return F.when((x > 360) | (x < 0), F.pmod(x, F.lit(360.0))).otherwise(x), y


def boundary_taper(ri: Column, rj: Column, nx: int, ny: int, dx: float, dy: float, width: float, rz: Column | None = None, ceiling: float | None = None) -> Column:
    """Weight of an update: 0 at the domain's edge, 1 from ``width`` inside it.

    With a ``ceiling`` (``radar_ceiling``, where radar observations are the only ones), it is 0 at heights ``rz`` above that too; null for a null height.
    """
    edge = F.least(F.least(ri, nx + 1 - ri) * dx, F.least(rj, ny + 1 - rj) * dy)
    beta = F.when(ri.isNotNull() & rj.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), edge / width))) if width > 0 else F.lit(1.0)
    return beta if rz is None or ceiling is None else F.when(rz > ceiling, 0.0).when(rz.isNotNull(), beta)


def radar_ceiling(top: float, vertical: float, vertical_wind: float, cutoff: float) -> float:
    """Height above which no radar observation below ``top`` has any weight, by the two vertical scales."""
    return top + max(vertical, vertical_wind) * cutoff


def energy_terms(u: Column, v: Column, t: Column, q: Column, thickness: Column, area: Column, moist: float = 1.0, latent: float = 2.5e6, cp: float = codes.CP_DRY) -> dict[str, Column]:
    """Kinetic, thermal and moist terms of the total-energy norm of a layer whose thickness is relative to surface pressure."""
    layer = thickness * area * area
    reference = 280.0
    return {"ke": layer * (u * u + v * v), "pe": layer * cp / reference * t * t, "me": layer * moist * latent**2 / (cp * reference) * q * q}
