"""Scalar functions of pixel values, gradients, angles and coordinates: Column in, Column out, all within code generation.

Angles of the line pipeline are in degrees, those of the feature pipelines in radians. Where the pipelines differ on purpose
(weights, clips, rounding) there are separate functions.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

PI = F.pi


def _d(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def r6(c: Column) -> Column:
    """Rounded to 6 places, for comparison with other engines; never -0."""
    return F.round(c, 6) + F.lit(0.0)


def trunc(c: Column) -> Column:
    """Towards zero, as int."""
    return c.cast("int")


def gray(c0: Column, c1: Column, c2: Column) -> Column:
    """The weights of red, green, blue on channels 0, 1, 2 as they come (blue first for decoded images)."""
    return F.lit(0.299) * c0 + F.lit(0.587) * c1 + F.lit(0.114) * c2


def gray_true(blue: Column, green: Column, red: Column) -> Column:
    """Weights by colour, rounded to whole values."""
    return F.round(F.lit(0.114) * blue + F.lit(0.587) * green + F.lit(0.299) * red)


def contrast_factor(c: float) -> float:
    return 259 * (c + 255) / (255 * (259 - c))


def contrast_clip(v: Column, c: float = 200) -> Column:
    """Contrast about 128, held between 0 and 255."""
    return F.least(_d(255), F.greatest(_d(0), _d(contrast_factor(c)) * (v - 128) + 128))


def contrast_trunc(v: Column, c: float = 50) -> Column:
    """Contrast about 128, held between 0 and 256 and cut to an integer."""
    return trunc(F.least(_d(256), F.greatest(_d(0), _d(contrast_factor(c)) * (v - 128) + 128)))


def threshold(v: Column, t: float) -> Column:
    return F.when(v > t, _d(255)).otherwise(_d(0))


def double_threshold(v: Column, low: float, high: float) -> Column:
    """0 below low, 255 above high, the band between as it is."""
    return F.when(v < low, _d(0)).when(v > high, _d(255)).otherwise(v)


def binary(v: Column) -> Column:
    """v / 255 to the nearest integer, halves to even."""
    return F.rint(v / 255)


def limit(v: Column) -> Column:
    return F.least(_d(255), F.greatest(_d(0), v))


def magnitude(gx: Column, gy: Column) -> Column:
    return F.hypot(gx, gy)


def direction_degrees(gx: Column, gy: Column) -> Column:
    """In (-180, 180]."""
    return F.lit(180.0) * F.atan2(gy, gx) / PI()


def direction(gx: Column, gy: Column) -> Column:
    return F.atan2(gy, gx)


def direction_unsigned(gx: Column, gy: Column) -> Column:
    """In [0, pi)."""
    return F.pmod(F.atan2(gy, gx), PI())


def direction_class(degrees: Column) -> Column:
    """0 to 3: the nearest multiple of 45 degrees, modulo 180."""
    return F.pmod(F.rint(degrees / 45).cast("int"), F.lit(4))


def max_normalise(v: Column, *keys: str) -> Column:
    """255 * v / the image's maximum; unchanged where that is 0."""
    top = F.max(v).over(Window.partitionBy(*keys))
    return F.when(top != 0, 255 * v / top).otherwise(v)


def harris(xx: Column, yy: Column, xy: Column, k: float = 0.04) -> Column:
    """Determinant of the structure matrix less k times its squared trace."""
    return xx * yy - xy * xy - F.lit(float(k)) * (xx + yy) * (xx + yy)


def orientation_class(angle: Column, bins: int = 8) -> Column:
    """The angle in bins of pi / 4, towards zero, modulo ``bins``."""
    return F.pmod(trunc(4 * angle / PI()), F.lit(bins))


def theta_class(gx: Column, gy: Column, n: int = 90) -> Column:
    """The direction modulo 180 degrees in n classes."""
    return trunc(F.pmod(F.lit(float(n)) * F.atan2(gy, gx) / PI(), F.lit(float(n))))


def radius(x: Column, y: Column, degrees: Column) -> Column:
    """Distance from the origin of a line with this normal, towards zero; may be negative."""
    return trunc(x * F.cos(F.radians(degrees)) + y * F.sin(F.radians(degrees)))


def angle_gap(a: Column, b: Column) -> Column:
    """Circular distance of two directions modulo 180 degrees."""
    d = F.pmod(a - b, _d(180))
    return F.least(d, 180 - d)


def bound(value: Column, f) -> Column:
    """f(value), with value computed once: lambda variables are the only ones that expressions inside lambdas don't recompute."""
    return F.transform(F.array(value), f)[0]


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e * e))


def normalise(v: Column, cap: float = 0.2) -> Column:
    """To length 1, components held at cap, to length 1 again; all zeros stay."""
    scaled = lambda w, held: bound(norm(w), lambda n: F.when(n == 0, w).otherwise(F.transform(w, lambda e: F.least(F.lit(float(cap)), e / n) if held else e / n)))
    return bound(v, lambda a: bound(scaled(a, True), lambda b: scaled(b, False)))


def project(y: Column, x: Column, h: list[Column] | Column) -> tuple[Column, Column]:
    """(y, x) under a homography of nine numbers, row by row; (0, 0) where the divisor is 0."""
    e = [h[i] for i in range(9)]
    a, b, w = (e[3 * k] * y + e[3 * k + 1] * x + e[3 * k + 2] for k in range(3))
    return tuple(F.when(w != 0, v / w).otherwise(F.lit(0.0)) for v in (a, b))


def cylinder_to_plane(y: Column, x: Column, height: Column, width: Column, r: Column, d: Column) -> tuple[Column, Column]:
    """Plane coordinates of a place on a cylinder of radius r seen from d; x is counted from the middle."""
    px = d * F.tan((x - width / 2) / r)
    return (y - height / 2) * F.sqrt(px * px + d * d) / r + height / 2, px


def enlarge_box(x: Column, y: Column, w: Column, h: Column, scale: float = 1.4, clamp: bool = True) -> list[Column]:
    """x, y, w, h of the box grown about its middle by whole pixels a side; with clamp x and y are not below 0."""
    dw, dh = trunc((scale - 1) * w / 2), trunc((scale - 1) * h / 2)
    corner = [F.greatest(F.lit(0), c) if clamp else c for c in (x - dw, y - dh)]
    return [*corner, w + 2 * dw, h + 2 * dh]


def landmark(fraction: Column, size: Column) -> Column:
    """The pixel of a landmark given as a share of the image's size."""
    return trunc(fraction * size)


def mirrored(x: Column, width: Column) -> Column:
    return width - 1 - x


def other_channel(c: Column) -> Column:
    """Blue-green-red to red-green-blue and back."""
    return 2 - c


def verdict(a: Column, b: Column) -> Column:
    """1 if a is less than b, else 2; a missing number on either side gives 2."""
    known = ~(F.isnan(a) | F.isnan(b))
    return F.when(known & (a < b), 1).otherwise(2)
