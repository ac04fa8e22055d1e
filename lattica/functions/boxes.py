"""Expressions over boxes (x0, y0, x1, y1), points (x, y) and segments (ax, ay, bx, by). Null if any coordinate is; sides may have no length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns x0, y0, x1, y1 behind a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def _null_if(parts: tuple[Column, ...], value: Column) -> Column:
    """greatest() and least() pass over nulls; here one null makes the result null."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known &= p.isNotNull()
    return F.when(known, value)


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def centre(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2, (b[1] + b[3]) / 2


def expanded(b: Box, by: float) -> Box:
    return b[0] - by, b[1] - by, b[2] + by, b[3] + by


def scaled(b: Box, by: float, width: float, height: float) -> Box:
    """Coordinates times a factor, no less than 0 and no more than the width or height."""
    most = (width, height, width, height)
    return tuple(_null_if((c,), F.greatest(F.lit(0.0), F.least(F.lit(float(m)), c * by))) for c, m in zip(b, most, strict=True))


def grid_key(x: Column, y: Column, size: float) -> Column:
    """The same text for all points that round to the same multiples of size, halves up."""
    return F.concat(F.floor(x / size + 0.5), F.lit(","), F.floor(y / size + 0.5))


def joined(a: Box, b: Box) -> Box:
    """The least box that holds both."""
    return tuple(_null_if((p, q), (F.least if k < 2 else F.greatest)(p, q)) for k, (p, q) in enumerate(zip(a, b, strict=True)))


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How long two spans run together; 0 if they do not."""
    return _null_if((a0, a1, b0, b1), F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0)))


def shared_area(a: Box, b: Box) -> Column:
    return span_overlap(a[0], a[2], b[0], b[2]) * span_overlap(a[1], a[3], b[1], b[3])


def iou(a: Box, b: Box) -> Column:
    """Shared area over the area of both together; 0 if that has no area."""
    shared = shared_area(a, b)
    both = area(a) + area(b) - shared
    return F.when(both > 0, shared / both).when(both <= 0, 0.0)


def rounded(value: Column, digits: int) -> Column:
    """value to so many digits, halves away from 0, by doubles as databases do it; F.round goes by way of decimals, which takes far longer. Values that no long holds
    at so many digits stay as they are."""
    scaled = F.abs(value) * F.lit(10.0**digits) + 0.5
    near = F.floor(scaled).cast("double") / F.lit(10.0**digits)
    return F.when(scaled < 2.0**52, F.when(value < 0, -near).otherwise(near)).otherwise(value)


def pixel_iou(a: Box, b: Box) -> Column:
    """Of boxes in whole pixels: coordinates are cut to whole numbers and the area of both together counts as 1 at least, so boxes without area
    share nothing instead of dividing by 0."""
    whole = lambda box: tuple(c.try_cast("long") for c in box)
    a, b = whole(a), whole(b)
    shared = shared_area(a, b)
    return shared / _null_if((*a, *b), F.greatest(area(a) + area(b) - shared, F.lit(1)))


def contained_share(inner: Box, outer: Box) -> Column:
    """The share of the inner box's area that lies in the outer; null if it has no area."""
    return F.try_divide(shared_area(inner, outer), area(inner))


def least_area_share(a: Box, b: Box) -> Column:
    """Shared area over the smaller box's; null if that has no area."""
    return F.try_divide(shared_area(a, b), F.least(area(a), area(b)))


def touches(a: Box, b: Box, pad: float = 0.0) -> Column:
    """Whether two boxes share a point if one is widened by pad."""
    return (a[0] - pad <= b[2]) & (b[0] <= a[2] + pad) & (a[1] - pad <= b[3]) & (b[1] <= a[3] + pad)


def holds_point(b: Box, x: Column, y: Column, pad: float = 0.0) -> Column:
    return (x >= b[0] - pad) & (x <= b[2] + pad) & (y >= b[1] - pad) & (y <= b[3] + pad)


def border_distance(b: Box, x: Column, y: Column) -> Column:
    """From a point to the box's border, from inside or outside."""
    out_x, out_y = (_null_if((lo, hi, v), F.greatest(F.lit(0.0), lo - v, v - hi)) for lo, hi, v in ((b[0], b[2], x), (b[1], b[3], y)))
    inside = _null_if((x, y, *b), F.least(x - b[0], b[2] - x, y - b[1], b[3] - y))
    return F.when(holds_point(b, x, y), inside).otherwise(F.sqrt(out_x * out_x + out_y * out_y))


def gap(a: Box, b: Box) -> Column:
    """Squared distance between two boxes; 0 if they share a point."""
    dx, dy = (_null_if((a[k], a[k + 2], b[k], b[k + 2]), F.greatest(F.lit(0.0), a[k] - b[k + 2], b[k] - a[k + 2])) for k in (0, 1))
    return dx * dx + dy * dy


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the nearest point of a segment."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    along = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / size))).otherwise(0.0)
    return point_distance(x, y, ax + along * dx, ay + along * dy)


def pixel_segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to the pixel that the nearest point of a segment rounds to, halves up."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    along = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / size))).otherwise(0.0)
    return point_distance(x, y, F.floor(ax + along * dx + 0.5), F.floor(ay + along * dy + 0.5))


def segment_length(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return point_distance(ax, ay, bx, by)


def orientation(ax: Column, ay: Column, bx: Column, by: Column, tolerance: float = 0.0) -> Column:
    """'point', 'h', 'v' or 'other'; within tolerance of an axis counts as along it."""
    dx, dy = F.abs(ax - bx), F.abs(ay - by)
    return F.when((dx <= tolerance) & (dy <= tolerance), "point").when(dy <= tolerance, "h").when(dx <= tolerance, "v").when(dx.isNotNull() & dy.isNotNull(), "other")


def segment_meets_box(ax: Column, ay: Column, bx: Column, by: Column, b: Box) -> Column:
    """Whether a segment shares a point with a box: its parameter range is clipped by each side in turn."""
    lo, hi, apart = F.lit(0.0), F.lit(1.0), F.lit(False)
    for p, d, least, most in ((ax, bx - ax, b[0], b[2]), (ay, by - ay, b[1], b[3])):
        one, two = F.try_divide(least - p, d), F.try_divide(most - p, d)
        lo = F.greatest(lo, F.when(d != 0, F.least(one, two)))
        hi = F.least(hi, F.when(d != 0, F.greatest(one, two)))
        apart |= (d == 0) & ((p < least) | (p > most))
    return _null_if((ax, ay, bx, by, *b), ~apart & (lo <= hi))
