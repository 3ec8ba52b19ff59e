"""Geometry on the sphere and in the plane, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.0
ARROW_LEAST_M, ARROW_LENGTHS, ARROW_DEFAULT_HULL_M = 900.0, 4.0, 150.0
BARB_DEGREES, BARB_SHARE, BACK_SHARE, UNSURE_BELOW = 150.0, 0.28, 0.55, 0.15


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    up, across = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(up), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(across), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def rounded(x: Column, digits: int) -> Column:
    """A double rounded as SQL's round() does elsewhere: its product with a power of ten, half away from zero. F.round goes by the decimals
    that are shown, which differ where the product is next to a half, and takes some ten times as long."""
    size = F.abs(x * float(10**digits))
    whole = F.rint(size)
    whole = whole + F.when(size - whole == 0.5, 1.0).otherwise(0.0)  # rint goes to the even one
    return F.signum(x) * whole / float(10**digits)


def half_height(radius_km: float) -> float:
    return radius_km / KM_PER_DEGREE


def half_width(lat: Column, radius_km: float) -> Column:
    return F.lit(radius_km) / F.greatest(KM_PER_DEGREE * F.cos(F.radians(lat)), F.lit(1e-6))


def bounding_box(lat: Column, lon: Column, radius_km: float) -> Column:
    """lat_lo, lat_hi, lon_lo, lon_hi of a box around a circle; it neither wraps at 180 degrees nor ends at a pole."""
    up, across = half_height(radius_km), half_width(lat, radius_km)
    return F.struct((lat - up).alias("lat_lo"), (lat + up).alias("lat_hi"), (lon - across).alias("lon_lo"), (lon + across).alias("lon_hi"))


def destination_point(lat: Column, lon: Column, bearing: Column, metres: Column) -> Column:
    """lat and lon reached from a point on a bearing; lon from -180 up to 180."""
    way, course, north = metres / (EARTH_RADIUS_KM * 1000), F.radians(bearing), F.radians(lat)
    sine = F.sin(north) * F.cos(way) + F.cos(north) * F.sin(way) * F.cos(course)
    turn = F.atan2(F.sin(course) * F.sin(way) * F.cos(north), F.cos(way) - F.sin(north) * sine)
    return F.struct(F.degrees(F.asin(sine)).alias("lat"), (F.pmod(lon + F.degrees(turn) + 540, F.lit(360.0)) - 180).alias("lon"))


def arrow_length_m(hull_m: Column) -> Column:
    """Of a heading arrow; a hull of no length counts as unknown."""
    return F.greatest(F.lit(ARROW_LEAST_M), ARROW_LENGTHS * F.coalesce(F.nullif(hull_m, F.lit(0.0)), F.lit(ARROW_DEFAULT_HULL_M)))


def heading_arrow(lat: Column, lon: Column, heading: Column, confidence: Column, hull_m: Column) -> Column:
    """tip, two barbs, dashed and, for an unsure heading, the line back; null without a heading."""
    length = arrow_length_m(hull_m)
    tip = destination_point(lat, lon, heading, length)
    unsure = F.coalesce(confidence < UNSURE_BELOW, F.lit(False))
    barb = lambda turn: destination_point(tip["lat"], tip["lon"], heading + turn, length * BARB_SHARE)
    back = F.when(unsure, destination_point(lat, lon, heading + 180, length * BACK_SHARE))
    return F.when(heading.isNotNull(), F.struct(tip.alias("tip"), barb(BARB_DEGREES).alias("right"), barb(-BARB_DEGREES).alias("left"), unsure.alias("dashed"), back.alias("back")))


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(math.pi / 4 + lat * (math.pi / 360)))


def swath_clip(bounds: Column, swath: Column) -> Column:
    """A CSS polygon of a swath in percent of its overview's bounds; empty for fewer than three corners. Both are arrays
    of lat and lon; bounds begin at the upper left and go round by the right."""
    at = lambda quad, corner, k: F.element_at(F.element_at(quad, corner), k)
    top, bottom = mercator_y(at(bounds, 1, 1)), mercator_y(at(bounds, 3, 1))
    left, right = at(bounds, 1, 2), at(bounds, 2, 2)

    def placed(c: Column) -> Column:
        x = (F.element_at(c, 2) - left) / (right - left) * 100
        y = (mercator_y(F.element_at(c, 1)) - top) / (bottom - top) * 100
        return F.format_string("%.3f%% %.3f%%", x + 0.0, y + 0.0)  # no minus before a zero

    points = F.concat(F.lit("polygon("), F.array_join(F.transform(swath, placed), ", "), F.lit(")"))
    return F.when(F.size(swath) >= 3, points).otherwise("")


def square_to_quad(x: list[Column], y: list[Column]) -> Column:
    """a to h of the projective map that takes the unit square's corners to four points, in the order given:
    (a u + b v + c, d u + e v + f) / (g u + h v + 1). Points that close a parallelogram get the affine map."""
    ends = [(p[1] - p[2], p[3] - p[2], p[0] - p[1] + p[2] - p[3]) for p in (x, y)]
    (ux, vx, wx), (uy, vy, wy) = ends
    affine = (F.abs(wx) < 1e-9) & (F.abs(wy) < 1e-9)
    det = ux * vy - vx * uy
    g = F.when(affine, 0.0).otherwise((wx * vy - vx * wy) / F.nullif(det, F.lit(0.0)))
    h = F.when(affine, 0.0).otherwise((ux * wy - wx * uy) / F.nullif(det, F.lit(0.0)))
    out = []
    for p in (x, y):
        out += [p[1] - p[0] + g * p[1], F.when(affine, p[2] - p[1]).otherwise(p[3] - p[0] + h * p[3]), p[0]]
    return F.struct(*(c.alias(n) for c, n in zip([*out, g, h], "abcdefgh", strict=True)))
