"""Box arithmetic. A box is ``struct<l,t,r,b>`` in PDF points, origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import NORM_SPACE

SIDES = ("l", "t", "r", "b")


def box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    values = (left, top, right, bottom)
    return F.struct(*[v.cast("double").alias(s) for s, v in zip(SIDES, values)])


def _at(values: Column, i: int) -> Column:
    return F.get(values, F.lit(i))


def box_readable(bbox: Column) -> Column:
    """False for a box of four entries of which one is no number."""
    return ~F.coalesce((F.size(bbox) == 4) & F.exists(bbox, lambda v: v.isNull()), F.lit(False))


def polygon_readable(polygon: Column, bbox: Column) -> Column:
    """False for a polygon with a point of less than two numbers, where the box does not serve."""
    broken = F.exists(
        polygon, lambda p: F.coalesce(F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull(), F.lit(True))
    )
    needed = ~F.coalesce(F.size(bbox) == 4, F.lit(False))
    return ~F.coalesce(needed & broken, F.lit(False))


def block_box(bbox: Column, polygon: Column) -> Column:
    """The four-number box, else the extent of the polygon, else null."""
    xs = F.transform(polygon, lambda p: F.get(p, F.lit(0)))
    ys = F.transform(polygon, lambda p: F.get(p, F.lit(1)))
    extent = box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    given = box(*[_at(bbox, i) for i in range(4)])
    return F.when(F.size(bbox) == 4, given).when(F.size(polygon) > 0, extent)


def block_quad(polygon: Column, bbox: Column) -> Column:
    """First four polygon points, else the box corners clockwise, else null."""
    points = F.transform(
        F.slice(polygon, 1, 4),
        lambda p: F.array(F.get(p, F.lit(0)), F.get(p, F.lit(1))),
    )
    broken = F.exists(points, lambda p: F.exists(p, lambda v: v.isNull()))
    x0, y0, x1, y1 = (_at(bbox, i) for i in range(4))
    corners = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    complete = (F.size(bbox) == 4) & ~F.exists(bbox, lambda v: v.isNull())
    return F.when((F.size(polygon) >= 4) & ~broken, points).when(complete, corners)


def quad_box(quad: Column) -> Column:
    return block_box(F.lit(None).cast("array<double>"), quad)


def scale_quad(quad: Column, sx: Column, sy: Column) -> Column:
    return F.transform(
        quad, lambda p: F.array(F.get(p, F.lit(0)) * sx, F.get(p, F.lit(1)) * sy)
    )


def scale_factor(rendered: Column, source: Column) -> Column:
    """Pixels per source unit; 1 where the source size is unknown or not positive."""
    return F.when(source > 0, rendered / source).otherwise(F.lit(1.0))


def norm_box_valid(norm: Column) -> Column:
    x0, y0, x1, y1 = (_at(norm, i) for i in range(4))
    return F.coalesce((F.size(norm) == 4) & (x1 >= x0) & (y1 >= y0), F.lit(False))


def norm_box_to_bbox(norm: Column, page_w: Column, page_h: Column) -> Column:
    """``[x0, y0, x1, y1]`` in the 1000 x 1000 space to points; null if malformed."""
    sx, sy = page_w / NORM_SPACE, page_h / NORM_SPACE
    scaled = box(_at(norm, 0) * sx, _at(norm, 1) * sy, _at(norm, 2) * sx, _at(norm, 3) * sy)
    return F.when(norm_box_valid(norm), scaled)


def bbox_to_norm_box(b: Column, page_w: Column, page_h: Column) -> Column:
    """Points back to the 1000 x 1000 space; ``rint`` rounds halves to even."""
    sx, sy = F.lit(NORM_SPACE) / page_w, F.lit(NORM_SPACE) / page_h
    return F.array(
        *[
            F.rint(b.getField(side) * scale).cast("int")
            for side, scale in zip(SIDES, (sx, sy, sx, sy))
        ]
    )


def area(b: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, b.getField("r") - b.getField("l")) * F.greatest(
        zero, b.getField("b") - b.getField("t")
    )


def overlap(a: Column, b: Column) -> Column:
    zero = F.lit(0.0)

    def span(low: str, high: str) -> Column:
        return F.greatest(
            zero,
            F.least(a.getField(high), b.getField(high))
            - F.greatest(a.getField(low), b.getField(low)),
        )

    return span("l", "r") * span("t", "b")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for disjoint or degenerate boxes."""
    shared = overlap(a, b)
    union = area(a) + area(b) - shared
    return F.when((shared > 0) & (union > 0), shared / union).otherwise(F.lit(0.0))
