"""Map projections and frame changes as Column arithmetic.

Scene frame: metres, x east, z south, y up; ``x = E - A`` and ``z = B - N`` for UTM zone 16N.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoids and grid parameters: fixed values of EPSG:4326, 32616 and 6473.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
GRS80_F = 1 / 298.257222101
UTM16_LON0, UTM_K0, UTM_FE = -87.0, 0.9996, 500000.0
FT_US = 0.3048006096
KY_LAT0, KY_LON0 = 36 + 20 / 60, -(85 + 45 / 60)
KY_SP1, KY_SP2 = 37 + 5 / 60, 38 + 40 / 60
KY_FE_M, KY_FN_M = 1500000.0, 1000000.0
US_FOOT_M = 1200 / 3937


def _poly(n: float, *coef: float) -> float:
    return sum(c * n**i for i, c in enumerate(coef, 1))


_N = WGS84_F / (2 - WGS84_F)
_E = math.sqrt(WGS84_F * (2 - WGS84_F))
_RECT = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Kruger series in the third flattening, to fourth order.
_ALPHA = (
    _poly(_N, 1 / 2, -2 / 3, 5 / 16, 41 / 180),
    _poly(_N, 0, 13 / 48, -3 / 5, 557 / 1440),
    _poly(_N, 0, 0, 61 / 240, -103 / 140),
    _poly(_N, 0, 0, 0, 49561 / 161280),
)
_BETA = (
    _poly(_N, 1 / 2, -2 / 3, 37 / 96, -1 / 360),
    _poly(_N, 0, 1 / 48, 1 / 15, -437 / 1440),
    _poly(_N, 0, 0, 17 / 480, -37 / 840),
    _poly(_N, 0, 0, 0, 4397 / 161280),
)
_DELTA = (
    _poly(_N, 2, -2 / 3, -2, 116 / 45),
    _poly(_N, 0, 7 / 3, -8 / 5, -227 / 45),
    _poly(_N, 0, 0, 56 / 15, -136 / 35),
    _poly(_N, 0, 0, 0, 4279 / 630),
)


def lonlat_to_utm16n(lon: Column, lat: Column) -> tuple[Column, Column]:
    """WGS84 degrees to UTM 16N easting and northing."""
    phi, dlam = F.radians(lat), F.radians(lon - F.lit(UTM16_LON0))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_E) * F.atanh(F.lit(_E) * s))
    xi0 = F.atan2(t, F.cos(dlam))
    eta0 = F.asinh(F.sin(dlam) / F.sqrt(t * t + F.cos(dlam) * F.cos(dlam)))
    xi, eta = xi0, eta0
    for j, a in enumerate(_ALPHA, 1):
        xi = xi + F.lit(a) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta + F.lit(a) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    k = F.lit(UTM_K0 * _RECT)
    return F.lit(UTM_FE) + k * eta, k * xi


def utm16n_to_lonlat(e: Column, n: Column) -> tuple[Column, Column]:
    """UTM 16N to WGS84 degrees."""
    xi0, eta0 = n / F.lit(UTM_K0 * _RECT), (e - F.lit(UTM_FE)) / F.lit(UTM_K0 * _RECT)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - F.lit(b) * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - F.lit(b) * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + F.lit(UTM16_LON0)
    return lon, F.degrees(phi)


def utm_to_scene(e: Column, n: Column, a: float, b: float) -> tuple[Column, Column]:
    return e - F.lit(a), F.lit(b) - n


def scene_to_utm(x: Column, z: Column, a: float, b: float) -> tuple[Column, Column]:
    return F.lit(a) + x, F.lit(b) - z


def lonlat_to_scene(lon: Column, lat: Column, a: float, b: float) -> tuple[Column, Column]:
    return utm_to_scene(*lonlat_to_utm16n(lon, lat), a, b)


def ue_cm_to_scene(ux: Column, uy: Column, uz: Column, origin: tuple[float, float, float]):
    """Z-up centimetres to y-up metres."""
    ox, oy, oz = (F.lit(float(v)) for v in origin)
    return (ux - ox) * 0.01, (uz - oz) * 0.01, (uy - oy) * 0.01


def scene_to_ue_cm(x: Column, y: Column, z: Column, origin: tuple[float, float, float]):
    ox, oy, oz = (F.lit(float(v)) for v in origin)
    return x * 100.0 + ox, z * 100.0 + oy, y * 100.0 + oz


def _ky_constants() -> tuple[float, float, float, float]:
    e = math.sqrt(GRS80_F * (2 - GRS80_F))

    def m(lat: float) -> float:
        p = math.radians(lat)
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(lat: float) -> float:
        p = math.radians(lat)
        s = e * math.sin(p)
        return math.tan(math.pi / 4 - p / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    n = math.log(m(KY_SP1) / m(KY_SP2)) / math.log(t(KY_SP1) / t(KY_SP2))
    big_f = m(KY_SP1) / (n * t(KY_SP1) ** n)
    return e, n, big_f, WGS84_A * big_f * t(KY_LAT0) ** n


def stateplane_ky_to_lonlat(x_ft: Column, y_ft: Column) -> tuple[Column, Column]:
    """Kentucky Single Zone (US survey feet) to degrees: inverse Lambert conformal conic."""
    e, n, big_f, rho0 = _ky_constants()
    dx = x_ft * F.lit(US_FOOT_M) - F.lit(KY_FE_M)
    dy = F.lit(rho0) - (y_ft * F.lit(US_FOOT_M) - F.lit(KY_FN_M))
    rho = F.sqrt(dx * dx + dy * dy)
    t = F.pow(rho / F.lit(WGS84_A * big_f), F.lit(1 / n))
    chi = F.lit(math.pi / 2) - 2 * F.atan(t)
    phi = chi
    for _ in range(5):
        # exp(-e atanh(e sin phi)) is the usual ((1 - e sin phi)/(1 + e sin phi))^(e/2) with phi used once
        phi = F.lit(math.pi / 2) - 2 * F.atan(t * F.exp(F.lit(-e) * F.atanh(F.lit(e) * F.sin(phi))))
    lon = F.degrees(F.atan2(dx, dy) / F.lit(n)) + F.lit(KY_LON0)
    return lon, F.degrees(phi)


def stateplane_ky_to_utm(x_ft: Column, y_ft: Column) -> tuple[Column, Column]:
    return lonlat_to_utm16n(*stateplane_ky_to_lonlat(x_ft, y_ft))


def ftus_to_m(z_ft: Column) -> Column:
    return z_ft * F.lit(FT_US)


def geodetic_to_ecef(lon: Column, lat: Column, h: Column) -> tuple[Column, Column, Column]:
    e2 = WGS84_F * (2 - WGS84_F)
    lam, phi = F.radians(lon), F.radians(lat)
    s, c = F.sin(phi), F.cos(phi)
    n = F.lit(WGS84_A) / F.sqrt(1 - F.lit(e2) * s * s)
    return (n + h) * c * F.cos(lam), (n + h) * c * F.sin(lam), (n * F.lit(1 - e2) + h) * s


def apply_affine4(m: list[float], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Column-major 4x4 times (x, y, z, 1)."""
    return tuple(F.lit(m[r]) * x + F.lit(m[4 + r]) * y + F.lit(m[8 + r]) * z + F.lit(m[12 + r]) for r in range(3))


def rotator_matrix(pitch: Column, yaw: Column, roll: Column) -> list[Column]:
    """Row-major 3x3 of a pitch/yaw/roll rotator in degrees, for row vectors."""
    sp, cp = F.sin(F.radians(pitch)), F.cos(F.radians(pitch))
    sy, cy = F.sin(F.radians(yaw)), F.cos(F.radians(yaw))
    sr, cr = F.sin(F.radians(roll)), F.cos(F.radians(roll))
    forward = [cp * cy, cp * sy, sp]
    right = [sr * sp * cy - cr * sy, sr * sp * sy + cr * cy, -sr * cp]
    up = [-(cr * sp * cy + sr * sy), cy * sr - cr * sp * sy, cr * cp]
    return forward + right + up


def apply_rotation(m: list[Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Row vector (x, y, z) times a row-major 3x3."""
    return tuple(x * m[c] + y * m[3 + c] + z * m[6 + c] for c in range(3))
