"""Geometry as Column expressions: distances, grids, projection and path measures."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: WGS84, and the scale and false easting of UTM.
WGS84_A, WGS84_F, UTM_SCALE, UTM_EAST = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the great circle."""
    s = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(s))


def between(p: Column, q: Column) -> Column:
    """Haversine of two (lat, lon, ...) structs."""
    return haversine(p["lat"], p["lon"], q["lat"], q["lon"])


@dataclass(frozen=True)
class Grid:
    """Row-major cells over a box of degrees; points outside count to the border cells."""

    min_lon: float
    min_lat: float
    max_lon: float
    max_lat: float
    rows: int
    cols: int

    @property
    def cells(self) -> int:
        return self.rows * self.cols

    def cell(self, lat: Column, lon: Column) -> Column:
        def part(x: Column, low: float, high: float, n: int) -> Column:
            return F.least(F.greatest(((x - low) / (high - low) * n).cast("int"), F.lit(0)), F.lit(n - 1))

        return part(lat, self.min_lat, self.max_lat, self.rows) * self.cols + part(lon, self.min_lon, self.max_lon, self.cols)


def zone_cell(x: Column, y: Column, box: tuple, rows: int, cols: int) -> Column:
    """Cell of projected metres in box (x0, y0, x1, y1), numbers or Columns; only the upper border clamps."""

    def part(v: Column, low, high, n: int) -> Column:
        return F.least(((v - low) / (high - low + 1e-9) * n).cast("int"), F.lit(n - 1))

    x0, y0, x1, y1 = box
    return part(y, y0, y1, rows) * cols + part(x, x0, x1, cols)


def tm_series() -> tuple[float, list[float], float]:
    """Krüger's series to the fourth order: rectifying radius, coefficients, second eccentricity-like constant."""
    n = WGS84_F / (2 - WGS84_F)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return radius, alpha, 2 * math.sqrt(n) / (1 + n)


def utm(lon: Column, lat: Column, zone: int = 50) -> tuple[Column, Column]:
    """(x, y) metres of the northern UTM zone."""
    radius, alpha, e = tm_series()
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(alpha, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return UTM_EAST + UTM_SCALE * radius * x, UTM_SCALE * radius * y


def length_m(points: Column) -> Column:
    """Sum of haversines along an array of (lat, lon, ...) structs."""
    steps = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), between)
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, d: s + d))


def evenly_spaced(seq: Column, k: int) -> Column:
    """k elements at evenly spaced positions (rounded half to even), all where there are no more; k = 1: the first."""
    n = F.size(seq)
    if k == 1:
        return F.slice(seq, 1, 1)
    step = (n - 1) / F.lit(float(k - 1))
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(seq, (F.bround(i * step) + 1).cast("int")))
    return F.when(n <= k, seq).otherwise(picked)


def planar(p: Column, q: Column) -> Column:
    """Euclidean distance of two (x, y) structs."""
    return F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))


def dtw(a: Column, b: Column) -> Column:
    """Dynamic time warping of two arrays of (x, y) structs, row by row; infinite where either is empty."""
    inf = F.lit(float("inf"))

    def row(before: Column, p: Column) -> Column:
        # element 0 of a row stands before the first point of b
        start = F.struct(F.array(inf).alias("row"), inf.alias("left"))

        def cell(acc: Column, j: Column) -> Column:
            best = F.least(acc["left"], F.element_at(before, j + 1), F.element_at(before, j))
            value = best + planar(p, F.element_at(b, j))
            return F.struct(F.concat(acc["row"], F.array(value)).alias("row"), value.alias("left"))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), start, cell)["row"]

    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(inf, F.size(b)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), inf).otherwise(F.element_at(F.aggregate(a, first, row), -1))


def hausdorff(a: Column, b: Column) -> Column:
    """The larger of the two directed Hausdorff distances; infinite where either is empty."""

    def directed(p: Column, q: Column) -> Column:
        return F.array_max(F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: planar(x, y)))))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(float("inf"))).otherwise(F.greatest(directed(a, b), directed(b, a)))


def mean_spatial_error(a: Column, b: Column) -> Column:
    """Mean distance of points of equal position; an error for unequal lengths, NaN for empty arrays."""
    total = F.aggregate(F.zip_with(a, b, planar), F.lit(0.0), lambda s, d: s + d)
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("unequal lengths")).cast("double")).otherwise(total / F.size(a))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(float("nan"))).otherwise(checked)
