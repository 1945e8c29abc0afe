"""Feature geometry, geodesy, epipolar geometry and poses, Column -> Column. Matrices are tuples of numbers or Columns by rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half axis and flattening of the ellipsoids.
ELLIPSOIDS = {"GRS80": (6378137.0, 1.0 / 298.257222100882711243162837), "WGS84": (6378137.0, 1.0 / 298.257223563)}


def affine_shape(scale: Column, orientation: Column) -> tuple[Column, Column, Column, Column]:
    """(a11, a12, a21, a22) of a feature."""
    c, s = scale * F.cos(orientation), scale * F.sin(orientation)
    return c, -s, s, c


def shape_parts(a11: Column, a12: Column, a21: Column, a22: Column) -> dict[str, Column]:
    """Scale, orientation and shear of an affine shape."""
    turn = F.atan2(a21, a11)
    return {"scale": (F.sqrt(a11 * a11 + a21 * a21) + F.sqrt(a12 * a12 + a22 * a22)) / 2, "orientation": turn, "shear": F.atan2(-a12, a22) - turn}


def similarity(x1: Column, y1: Column, s1: Column, o1: Column, x2: Column, y2: Column, s2: Column, o2: Column) -> dict[str, Column]:
    """Scale, angle and translation that take the first feature to the second."""
    scale, angle = s2 / s1, o2 - o1
    c, s = scale * F.cos(angle), scale * F.sin(angle)
    return {"scale": scale, "angle": angle, "tx": x2 - (c * x1 - s * y1), "ty": y2 - (s * x1 + c * y1)}


def area(scale: Column) -> Column:
    return scale * scale / 2


def area_under(scale: Column, a: Sequence[float]) -> Column:
    """The area under a 2x2 transform."""
    n00, n11, n01 = a[0] * a[0] + a[2] * a[2], a[1] * a[1] + a[3] * a[3], a[0] * a[1] + a[2] * a[3]
    return scale * scale / (4.0 * n00 * n11 - 4.0 * n01 * n01) ** 0.5


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees of a direction: 90 or 270 straight up or down, the left half shifted by 180; no wrap-around."""
    flat = F.degrees(F.atan(F.try_divide(dy, dx)))
    return F.when(dx == 0, F.when(dy >= 0, 90.0).otherwise(270.0)).when(dx > 0, flat).when(dy >= 0, flat + 180).otherwise(flat - 180)


def pair_consistent(a0: tuple, a1: tuple, b0: tuple, b1: tuple, most: float = 10.0) -> Column:
    """Two matches agree in the difference of angles and of bearings. Each feature: x, y, angle in degrees."""
    turn = F.abs((a0[2] - a1[2]) - (b0[2] - b1[2]))
    way = F.abs((bearing(a1[0] - a0[0], a1[1] - a0[1]) - a0[2]) - (bearing(b1[0] - b0[0], b1[1] - b0[1]) - b0[2]))
    return (turn < most) & (way < most)


def ell_to_xyz(lat: Column, lon: Column, alt: Column, ellipsoid: str = "WGS84") -> tuple[Column, Column, Column]:
    a, f = ELLIPSOIDS[ellipsoid]
    e2 = f * (2.0 - f)
    p, m = F.radians(lat), F.radians(lon)
    n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    return (n + alt) * F.cos(p) * F.cos(m), (n + alt) * F.cos(p) * F.sin(m), (n * (1 - e2) + alt) * F.sin(p)


def xyz_to_enu(x: Column, y: Column, z: Column, lat0: float, lon0: float, origin: tuple[float, float, float]) -> tuple[Column, Column, Column]:
    from math import cos, radians, sin

    p, m = radians(lat0), radians(lon0)
    dx, dy, dz = x - origin[0], y - origin[1], z - origin[2]
    return -sin(m) * dx + cos(m) * dy, -sin(p) * cos(m) * dx - sin(p) * sin(m) * dy + cos(p) * dz, cos(p) * cos(m) * dx + cos(p) * sin(m) * dy + sin(p) * dz


def product3(m: Sequence, x: Column, y: Column, z: Column | float = 1.0) -> tuple[Column, Column, Column]:
    return tuple(m[3 * i] * x + m[3 * i + 1] * y + m[3 * i + 2] * z for i in range(3))


def sampson(e: Sequence[float], x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The squared Sampson error of a correspondence under a 3x3 matrix."""
    l0, l1, l2 = product3(e, x1, y1)
    t0, t1, _ = product3([e[0], e[3], e[6], e[1], e[4], e[7], e[2], e[5], e[8]], x2, y2)
    r = x2 * l0 + y2 * l1 + l2
    return r * r / (l0 * l0 + l1 * l1 + t0 * t0 + t1 * t1)


def transfer(h: Sequence[float], x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """The squared distance of a point from the image of its partner under a homography."""
    u, v, w = product3(h, x1, y1)
    return (x2 - u / w) * (x2 - u / w) + (y2 - v / w) * (y2 - v / w)


def quaternion_product(p: Sequence, q: Sequence) -> tuple:
    w, x, y, z = p
    a, b, c, d = q
    return (w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a)


def rotated(q: Sequence, v: Sequence) -> tuple:
    """A vector turned by a unit quaternion."""
    w, x, y, z = quaternion_product(quaternion_product(q, (0.0, *v)), (q[0], -q[1], -q[2], -q[3]))
    return x, y, z


def xyz_to_ell(x: Column, y: Column, z: Column, ellipsoid: str = "WGS84", steps: int = 6) -> tuple[Column, Column, Column]:
    """(latitude, longitude, altitude) of a place, by fixed-point steps on the latitude; six are far under a millimetre near the surface."""
    a, f = ELLIPSOIDS[ellipsoid]
    e2 = f * (2.0 - f)
    r = F.sqrt(x * x + y * y)

    def step(p: Column, _: Column) -> Column:
        return F.atan2(z + e2 * (a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))) * F.sin(p), r)

    # As a fold, so that the expression does not grow with the steps.
    p = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.atan2(z, r * (1 - e2)), step)
    n = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    alt = F.when(F.abs(F.cos(p)) > 0.1, r / F.cos(p) - n).otherwise(z / F.sin(p) - n * (1 - e2))
    return F.degrees(p), F.degrees(F.atan2(y, x)), alt
