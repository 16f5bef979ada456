"""Boxes as Column expressions.

A box is a struct of x, y, width and height (int); x + width and y + height are exclusive.
Coordinates are rounded half to even. Every function works on whole columns, inside
generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,width:int,height:int>"


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height")).cast(BOX)


def _int(x: Column) -> Column:
    return F.rint(x).cast("int")


def right(b: Column) -> Column:
    return b["x"] + b["width"]


def bottom(b: Column) -> Column:
    return b["y"] + b["height"]


def center_x(b: Column) -> Column:
    return b["x"] + b["width"] / F.lit(2.0)


def center_y(b: Column) -> Column:
    return b["y"] + b["height"] / F.lit(2.0)


def area(b: Column) -> Column:
    return b["width"].cast("long") * b["height"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for boxes that only touch."""
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"])
    common = w.cast("long") * h
    union = area(a) + area(b) - common
    return F.when((w > 0) & (h > 0) & (union > 0), common / union).otherwise(0.0)


def center_distance(a: Column, b: Column) -> Column:
    return F.hypot(center_x(a) - center_x(b), center_y(a) - center_y(b))


def diagonal(width: Column, height: Column) -> Column:
    """Length of a frame's diagonal; sizes that are not positive are an error."""
    return F.when((width > 0) & (height > 0), F.hypot(width.cast("double"), height.cast("double"))).otherwise(F.raise_error(F.lit("a frame needs a positive size")))


def scale(b: Column, factor: float) -> Column:
    """All four numbers times factor; sizes are 1 at least."""
    if factor <= 0:
        raise ValueError("a scale factor must be positive")
    return box(_int(b["x"] * factor), _int(b["y"] * factor), F.greatest(F.lit(1), _int(b["width"] * factor)), F.greatest(F.lit(1), _int(b["height"] * factor)))


def _between(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2 - x1, y2 - y1))


def clip(b: Column, frame_w: Column | int, frame_h: Column | int) -> Column:
    """The part inside the frame; null if there is none."""
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (frame_w, frame_h))
    return _between(F.greatest(F.lit(0), b["x"]), F.greatest(F.lit(0), b["y"]), F.least(w, right(b)), F.least(h, bottom(b)))


def contains(region: Column, x: Column, y: Column) -> Column:
    """Whether a region holds a point, its four edges included."""
    return x.between(region["x"], right(region)) & y.between(region["y"], bottom(region))


def polygon_box(points: Column, scale_x: Column, scale_y: Column, frame_w: Column, frame_h: Column) -> Column:
    """The box around scaled points (an array of [x, y]), inside the frame; null if empty."""
    xs, ys = F.transform(points, lambda p: p[0] * scale_x), F.transform(points, lambda p: p[1] * scale_y)
    x1, y1 = F.greatest(F.lit(0), _int(F.array_min(xs))), F.greatest(F.lit(0), _int(F.array_min(ys)))
    return _between(x1, y1, F.least(frame_w, _int(F.array_max(xs))), F.least(frame_h, _int(F.array_max(ys))))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """The box at share t of the way from a to b; sizes are 1 at least."""
    x, y, w, h = (_int(a[c] + (b[c] - a[c]) * t) for c in ("x", "y", "width", "height"))
    return box(x, y, F.greatest(F.lit(1), w), F.greatest(F.lit(1), h))


def _centred(b: Column, w: Column, h: Column, frame_w: Column | int, frame_h: Column | int) -> Column:
    return clip(box(_int(center_x(b) - w / F.lit(2.0)), _int(center_y(b) - h / F.lit(2.0)), w, h), frame_w, frame_h)


def expand(b: Column, factor_w: float, factor_h: float, frame_w: Column | int, frame_h: Column | int) -> Column:
    """The box grown around its centre, inside the frame; null if it does not grow."""
    if factor_w <= 1 and factor_h <= 1:
        return F.lit(None).cast(BOX)
    out = _centred(b, _int(b["width"] * factor_w), _int(b["height"] * factor_h), frame_w, frame_h)
    return F.when((out["width"] > b["width"]) | (out["height"] > b["height"]), out)


def force_expand(b: Column, need_w: Column, need_h: Column, frame_w: Column | int, frame_h: Column | int) -> Column:
    """The box grown around its centre to a needed size, inside the frame."""
    return _centred(b, F.greatest(b["width"], need_w), F.greatest(b["height"], need_h), frame_w, frame_h)


def place_centered(text_w: Column, text_h: Column, b: Column, tolerance: int = 2) -> Column:
    """Top left corner that centres a text in a box; null if keeping it inside moves it further than tolerance."""
    x, y = _int(b["x"] + (b["width"] - text_w) / F.lit(2.0)), _int(b["y"] + (b["height"] - text_h) / F.lit(2.0))
    kept_x = F.greatest(b["x"], F.least(x, right(b) - text_w))
    kept_y = F.greatest(b["y"], F.least(y, bottom(b) - text_h))
    return F.when((F.abs(kept_x - x) <= tolerance) & (F.abs(kept_y - y) <= tolerance), F.struct(kept_x.alias("x"), kept_y.alias("y")))


def fits(text_w: Column, text_h: Column, b: Column) -> Column:
    return (text_w <= b["width"]) & (text_h <= b["height"])


def padded(b: Column, padding: int, frame_w: Column | int, frame_h: Column | int) -> Column:
    """The box with a margin, inside the frame: what a mask covers."""
    p = F.lit(padding)
    return clip(box(b["x"] - p, b["y"] - p, b["width"] + 2 * p, b["height"] + 2 * p), frame_w, frame_h)


def downscaled(width: Column, height: Column, factor: float) -> Column:
    """Size of a frame made smaller by factor, and the way back: width, height, scale_x, scale_y."""
    if factor <= 1:
        w, h = width, height
    else:
        w, h = (F.greatest(F.lit(1), _int(v / F.lit(float(factor)))) for v in (width, height))
    return F.struct(w.alias("width"), h.alias("height"), (width / w).alias("scale_x"), (height / h).alias("scale_y"))


def crop_region(width: Column, height: Column, crop_percent: Column, zoom: Column, drift_x: Column, drift_y: Column) -> Column:
    """The visible part of a frame under crop, zoom and drift, moved inside the frame."""
    share = F.greatest((1.0 - crop_percent / 100.0) / zoom, F.lit(0.01))
    w, h = (F.greatest(F.lit(1), _int(v * share)) for v in (width, height))
    x = _int(width / F.lit(2.0) + drift_x - w / F.lit(2.0))
    y = _int(height / F.lit(2.0) + drift_y - h / F.lit(2.0))
    return box(F.greatest(F.lit(0), F.least(x, width - w)), F.greatest(F.lit(0), F.least(y, height - h)), w, h)


def inscribed_size(width: Column, height: Column, degrees: Column) -> Column:
    """Size of an upright rectangle inside a rotated frame, nine tenths of it at least."""
    turn = F.abs(F.radians(degrees))

    def side(own: Column, other: Column) -> Column:
        cut = (own * F.cos(turn) - other * F.sin(turn)).cast("int")
        return F.least(own, F.greatest(cut, (own * F.lit(0.9)).cast("int")))

    return F.struct(side(width, height).alias("width"), side(height, width).alias("height"))


def canvas_to_frame(x1: Column, y1: Column, x2: Column, y2: Column, scale_: Column, frame_w: Column, frame_h: Column) -> Column:
    """A rectangle drawn between any two corners of a scaled canvas, in frame coordinates; null if empty."""
    def back(v: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least((v / scale_).cast("int"), most))

    return _between(back(F.least(x1, x2), frame_w), back(F.least(y1, y2), frame_h), back(F.greatest(x1, x2), frame_w), back(F.greatest(y1, y2), frame_h))
