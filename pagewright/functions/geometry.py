"""Rectangle algebra on STRUCT<x0,y0,x1,y1: DOUBLE> columns (points, y upwards); null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x0, y0, x1, y1) -> Column:
    c = [F.lit(v) if not isinstance(v, Column) else v for v in (x0, y0, x1, y1)]
    return F.struct(*[v.cast("double").alias(n) for v, n in zip(c, ("x0", "y0", "x1", "y1"), strict=True)])


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def area(r: Column) -> Column:
    """Area; an inverted rectangle has none."""
    return F.greatest(width(r), F.lit(0.0)) * F.greatest(height(r), F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Area that two rectangles share."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def union(a: Column, b: Column) -> Column:
    """Smallest rectangle around both."""
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    """Shared area over covered area, 0 where nothing is covered."""
    both = overlap(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def intersects(a: Column, b: Column) -> Column:
    """Whether the shared part has an area."""
    return (a["x0"] < b["x1"]) & (b["x0"] < a["x1"]) & (a["y0"] < b["y1"]) & (b["y0"] < a["y1"])


def contains_point(r: Column, x: Column, y: Column) -> Column:
    return x.between(r["x0"], r["x1"]) & y.between(r["y0"], r["y1"])


def encloses(outer: Column, inner: Column, tol: float = 0.0) -> Column:
    """Whether ``inner`` lies in ``outer`` grown by ``tol`` (shrunk where negative)."""
    return (inner["x0"] >= outer["x0"] - tol) & (inner["y0"] >= outer["y0"] - tol) & (inner["x1"] <= outer["x1"] + tol) & (inner["y1"] <= outer["y1"] + tol)


def cuts(r: Column, block: Column, tol: float = 0.05) -> Column:
    """Whether ``r`` takes a part of ``block``, neither (nearly) nothing nor (nearly) all; never for an empty block."""
    whole = area(block)
    share = overlap(r, block) / F.when(whole > 0, whole)
    return F.coalesce((share > tol) & (share < 1 - tol), F.lit(False))


def flip(r: Column, page_height: Column) -> Column:
    """Between y upwards and y downwards."""
    return rect(r["x0"], page_height - r["y1"], r["x1"], page_height - r["y0"])


def px_to_points(px: Column, w_px: Column, h_px: Column, w_pt: Column, h_pt: Column) -> Column:
    """A pixel box (array x0,y0,x1,y1, y downwards) as points, clamped to the sheet, four decimals."""
    def clamp(v: Column, top: Column) -> Column:
        return F.bround(F.greatest(F.least(v, top), F.lit(0.0)), 4)

    sx, sy = w_pt / w_px, h_pt / h_px
    return rect(clamp(px[0] * sx, w_pt), clamp(h_pt - px[3] * sy, h_pt), clamp(px[2] * sx, w_pt), clamp(h_pt - px[1] * sy, h_pt))


def percent_view(r: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    """(left, top, right, bottom) in percent of the sheet from its left and top edge."""
    return 100 * r["x0"] / w, 100 * (1 - r["y1"] / h), 100 * r["x1"] / w, 100 * (1 - r["y0"] / h)


def rotate(x: Column, y: Column, w: Column, h: Column, rotation: Column) -> tuple[Column, Column]:
    """A point of a w x h sheet after a clockwise turn by 0, 90, 180 or 270 degrees (y downwards)."""
    t = F.pmod(rotation, F.lit(360))
    return (F.when(t == 90, h - y).when(t == 180, w - x).when(t == 270, y).otherwise(x),
            F.when(t == 90, x).when(t == 180, h - y).when(t == 270, w - x).otherwise(y))


def straddles(r: Column, block: Column) -> Column:
    """Which edges of ``block`` a cutting region leaves outside: both, side, end or inside."""
    side = (block["x0"] < r["x0"]) | (block["x1"] > r["x1"])
    end = (block["y0"] < r["y0"]) | (block["y1"] > r["y1"])
    return F.when(side & end, "corner").when(side, "side").when(end, "end").otherwise("inside")


def to_screen(x: Column, y: Column, w: Column, h: Column, rotation: Column, scale: Column) -> tuple[Column, Column]:
    """A point of a sheet (y upwards) on the turned and scaled picture of it (y downwards)."""
    sx, sy = rotate(x, h - y, w, h, rotation)
    return sx * scale, sy * scale


def from_screen(sx: Column, sy: Column, w: Column, h: Column, rotation: Column, scale: Column) -> tuple[Column, Column]:
    """The inverse of ``to_screen``: ``w`` and ``h`` are the unturned sheet's."""
    t = F.pmod(rotation, F.lit(360))
    quarter = t.isin(90, 270)
    x, y = rotate(sx / scale, sy / scale, F.when(quarter, h).otherwise(w), F.when(quarter, w).otherwise(h), 360 - t)
    return x, h - y


def fit_scale(w: Column, h: Column, view_w: Column, view_h: Column, low: float = 0.1, high: float = 8.0) -> Column:
    """The scale at which a sheet just fits a view, within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), view_w / w, view_h / h))
