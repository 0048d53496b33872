"""Transverse Mercator on WGS 84 as columns: degrees to metres and back (Krüger's series in n,
to the fourth order: below a hundredth of a millimetre within a zone)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the ellipsoid, the scale on the meridian, the shift to the east
AXIS, FLATTENING, SCALE, EAST = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
N = FLATTENING / (2 - FLATTENING)
RADIUS = SCALE * AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(N) / (1 + N)
#: fixed values: the series' coefficients
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630)


def meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def _series(coefficients, one, other, a: Column, b: Column, start: Column, sign: int = 1) -> Column:
    for j, c in enumerate(coefficients, 1):
        start = start + F.lit(sign * c) * one(a * (2 * j)) * other(b * (2 * j))
    return start


def to_metres(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """(x, y) of northern latitudes; null degrees give null."""
    sine, turn = F.sin(F.radians(lat)), F.radians(lon - meridian(zone))
    t = F.sinh(F.atanh(sine) - ECCENTRICITY * F.atanh(ECCENTRICITY * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    return _series(ALPHA, F.cos, F.sinh, xi, eta, eta) * RADIUS + EAST, _series(ALPHA, F.sin, F.cosh, xi, eta, xi) * RADIUS


def to_degrees(x: Column, y: Column, zone: int) -> tuple[Column, Column]:
    """(lat, lon) of metres on the northern half."""
    xi, eta = y / RADIUS, (x - EAST) / RADIUS
    xi, eta = _series(BETA, F.sin, F.cosh, xi, eta, xi, -1), _series(BETA, F.cos, F.sinh, xi, eta, eta, -1)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(chi * (2 * j))
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + meridian(zone)
