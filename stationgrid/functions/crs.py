"""Transverse Mercator projection as Column expressions.

Krüger's series in the third flattening, to fourth order, for the national grid
EPSG:2180 (GRS80, central meridian 19 E, scale 0.9993). Everything stays inside
code generation; there is no Python per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# --- fixed values: EPSG:2180 -------------------------------------------------
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
CENTRAL_MERIDIAN = 19.0
SCALE = 0.9993
FALSE_EASTING = 500000.0
FALSE_NORTHING = -5300000.0
# ----------------------------------------------------------------------------

_F = 1.0 / INVERSE_FLATTENING
_N = _F / (2.0 - _F)
_E = 2.0 * math.sqrt(_N) / (1.0 + _N)
RADIUS = SCALE * SEMI_MAJOR / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
ECCENTRICITY = _E


def to_metres(lon: str, lat: str) -> tuple[Column, Column]:
    """(easting, northing) in metres of geographic degrees given as SQL expressions.

    The series are written as SQL text: one parsed expression instead of some
    hundred nested Column calls.
    """
    sine, dlon = f"sin(radians({lat}))", f"radians(({lon}) - {CENTRAL_MERIDIAN}D)"
    t = f"sinh(atanh({sine}) - {_E!r}D * atanh({_E!r}D * {sine}))"
    xi = f"atan2({t}, cos({dlon}))"
    eta = f"atanh(sin({dlon}) / sqrt(1D + {t} * {t}))"
    orders = list(enumerate(FORWARD, start=1))
    east = " + ".join([eta] + [f"{a!r}D * cos({2 * j}D * {xi}) * sinh({2 * j}D * {eta})" for j, a in orders])
    north = " + ".join([xi] + [f"{a!r}D * sin({2 * j}D * {xi}) * cosh({2 * j}D * {eta})" for j, a in orders])
    return F.expr(f"{FALSE_EASTING}D + {RADIUS!r}D * ({east})"), F.expr(f"{FALSE_NORTHING}D + {RADIUS!r}D * ({north})")


def to_degrees(x: str, y: str) -> tuple[Column, Column]:
    """Geographic (lon, lat) of metres given as SQL expressions."""
    xi0 = f"((({y}) - {FALSE_NORTHING}D) / {RADIUS!r}D)"
    eta0 = f"((({x}) - {FALSE_EASTING}D) / {RADIUS!r}D)"
    orders = list(enumerate(INVERSE, start=1))
    xi = "(" + " - ".join([xi0] + [f"{b!r}D * sin({2 * j}D * {xi0}) * cosh({2 * j}D * {eta0})" for j, b in orders]) + ")"
    eta = "(" + " - ".join([eta0] + [f"{b!r}D * cos({2 * j}D * {xi0}) * sinh({2 * j}D * {eta0})" for j, b in orders]) + ")"
    chi = f"asin(sin({xi}) / cosh({eta}))"
    lat = " + ".join([chi] + [f"{d!r}D * sin({2 * j}D * {chi})" for j, d in enumerate(LATITUDE, start=1)])
    return F.expr(f"{CENTRAL_MERIDIAN}D + degrees(atan2(sinh({eta}), cos({xi})))"), F.expr(f"degrees({lat})")


def with_metres(df, lon: str = "lon", lat: str = "lat"):
    """Attach ``x_pl, y_pl``."""
    x, y = to_metres(lon, lat)
    return df.withColumns({"x_pl": x, "y_pl": y})


def with_degrees(df, x: str = "x", y: str = "y"):
    """Attach ``lon, lat``."""
    lon, lat = to_degrees(x, y)
    return df.withColumns({"lon": lon, "lat": lat})
