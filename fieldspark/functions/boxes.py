"""Box arithmetic as Column expressions.

A *box* is a struct ``x1,y1,x2,y2`` of DOUBLE. Every function takes and returns
Columns built from plain arithmetic, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x1", "y1", "x2", "y2")


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else lit(c)


def make_box(x1="x1", y1="y1", x2="x2", y2="y2") -> Column:
    return F.struct(*[col(c).cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), EDGES)])


def box_of(arr) -> Column:
    """Array of four numbers -> box; any other length -> null."""
    arr = col(arr)
    return F.when(F.size(arr) == 4, make_box(*[F.get(arr, F.lit(i)) for i in range(4)]))


def to_array(b) -> Column:
    b = col(b)
    return F.array(*[b[n] for n in EDGES])


def _zero_floor(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def _size(b: Column) -> tuple[Column, Column]:
    return b["x2"] - b["x1"], b["y2"] - b["y1"]


def area(b) -> Column:
    w, h = _size(col(b))
    return _zero_floor(w) * _zero_floor(h)


def intersection(a, b) -> Column:
    a, b = col(a), col(b)
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return _zero_floor(w) * _zero_floor(h)


def iou(a, b, kind: str = "eps") -> Column:
    """Intersection over union. The kinds differ in how areas and empty unions are treated.

    ``eps``: signed areas, 1e-9 added to the union. ``union_guard``: signed areas,
    0 when the union is not positive. ``clamped``: areas floored at 0.
    ``plain``: signed areas; 0/0 gives 0 here, never NaN.
    """
    a, b = col(a), col(b)
    inter = intersection(a, b)
    if kind == "clamped":
        total = area(a) + area(b)
    else:
        (aw, ah), (bw, bh) = _size(a), _size(b)
        total = aw * ah + bw * bh
    union = total - inter
    zero = F.lit(0.0)
    if kind == "eps":
        return F.when(inter <= 0, zero).otherwise(inter / (union + F.lit(1e-9)))
    if kind == "union_guard":
        return F.when(union > 0, inter / union).otherwise(zero)
    if kind == "clamped":
        return F.when((inter <= 0) | (union <= 0), zero).otherwise(inter / union)
    if kind == "plain":
        return F.when(union == 0, zero).otherwise(inter / union)
    raise ValueError(f"unknown iou kind {kind!r}")


def inside(a, b) -> Column:
    """``a`` lies in ``b``, edges included."""
    a, b = col(a), col(b)
    return (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"]) & (a["x2"] <= b["x2"]) & (a["y2"] <= b["y2"])


def _clamp(v: Column, lo, hi) -> Column:
    return F.greatest(lit(lo), F.least(v, lit(hi)))


def clip(b, w, h) -> Column:
    """Clip to ``[0, w-1] x [0, h-1]``."""
    b, w, h = col(b), col(w), col(h)
    xm, ym = (w - 1).cast("double"), (h - 1).cast("double")
    return make_box(
        _clamp(b["x1"], 0.0, xm), _clamp(b["y1"], 0.0, ym),
        _clamp(b["x2"], 0.0, xm), _clamp(b["y2"], 0.0, ym),
    )


def expand(b, ratio: float, w, h) -> Column:
    """Grow by ``ratio`` of the size on each side of the centre, then clip."""
    b = col(b)
    bw, bh = _size(b)
    cx, cy = b["x1"] + bw / 2.0, b["y1"] + bh / 2.0
    hw, hh = bw / 2.0 + bw * F.lit(float(ratio)), bh / 2.0 + bh * F.lit(float(ratio))
    return clip(make_box(cx - hw, cy - hh, cx + hw, cy + hh), w, h)


def shift(b, ox, oy) -> Column:
    """Tile-local to image coordinates."""
    b, ox, oy = col(b), col(ox), col(oy)
    return make_box(b["x1"] + ox, b["y1"] + oy, b["x2"] + ox, b["y2"] + oy)


def letterbox(w, h, tw: int = 960, th: int = 960) -> Column:
    """Scale-to-fit with centred padding: scale, resized size and left/top pads."""
    w, h = col(w), col(h)
    scale = F.least(F.lit(float(th)) / h, F.lit(float(tw)) / w)
    new_w, new_h = (w * scale).cast("int"), (h * scale).cast("int")
    return F.struct(
        w.cast("int").alias("orig_w"), h.cast("int").alias("orig_h"),
        scale.alias("scale"), new_w.alias("new_w"), new_h.alias("new_h"),
        F.floor((F.lit(tw) - new_w) / 2).cast("int").alias("pad_left"),
        F.floor((F.lit(th) - new_h) / 2).cast("int").alias("pad_top"),
    )


def unletterbox(b, meta) -> Column:
    """Letterboxed coordinates back to the original image, clamped to ``[0, size]``."""
    b, meta = col(b), col(meta)
    sx = meta["orig_w"].cast("double") / meta["new_w"]
    sy = meta["orig_h"].cast("double") / meta["new_h"]
    w, h = meta["orig_w"].cast("double"), meta["orig_h"].cast("double")
    return make_box(
        _clamp((b["x1"] - meta["pad_left"]) * sx, 0.0, w), _clamp((b["y1"] - meta["pad_top"]) * sy, 0.0, h),
        _clamp((b["x2"] - meta["pad_left"]) * sx, 0.0, w), _clamp((b["y2"] - meta["pad_top"]) * sy, 0.0, h),
    )


def cxcywh_to_xyxy(cx, cy, bw, bh, w, h, clamp: bool = True) -> Column:
    """Normalised centre/size to pixel corners; both axes scale by the padded square side."""
    cx, cy, bw, bh, w, h = (col(c) for c in (cx, cy, bw, bh, w, h))
    side = F.greatest(w, h).cast("double")
    px, py, hw, hh = cx * side, cy * side, bw * side / 2.0, bh * side / 2.0
    b = make_box(px - hw, py - hh, px + hw, py + hh)
    if not clamp:
        return b
    wd, hd = w.cast("double"), h.cast("double")
    return make_box(
        _clamp(b["x1"], 0.0, wd), _clamp(b["y1"], 0.0, hd),
        _clamp(b["x2"], 0.0, wd), _clamp(b["y2"], 0.0, hd),
    )


def xywh_to_xyxy(b) -> Column:
    """``[x, y, w, h]`` array to a box."""
    b = col(b)
    x, y, w, h = (F.get(b, F.lit(i)).cast("double") for i in range(4))
    return make_box(x, y, x + w, y + h)


def xyxy_to_xywh(b) -> Column:
    b = col(b)
    return F.array(b["x1"], b["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"])


def xywh_area(b, given=None) -> Column:
    """Given area, else width times height of an ``[x, y, w, h]`` array."""
    b = col(b)
    wh = (F.get(b, F.lit(2)) * F.get(b, F.lit(3))).cast("double")
    return wh if given is None else F.coalesce(col(given).cast("double"), wh)


def parse_roi(s) -> Column:
    """``x,y:x,y:x,y:x,y`` -> four points; anything else is an error."""
    s = col(s)
    points = F.transform(
        F.split(s, ":"),
        lambda pair: F.struct(
            F.get(F.split(pair, ","), F.lit(0)).cast("double").alias("x"),
            F.get(F.split(pair, ","), F.lit(1)).cast("double").alias("y"),
        ),
    )
    return F.when(F.size(points) == 4, points).otherwise(F.raise_error(F.concat(F.lit("ROI needs four points: "), s)))


def roi_to_pixels(points, w, h) -> Column:
    """Percent points -> bounding pixel box, half-to-even rounding; an empty box is an error."""
    points, w, h = col(points), col(w), col(h)
    xs = F.transform(points, lambda p: p["x"])
    ys = F.transform(points, lambda p: p["y"])

    def px(v: Column, size: Column) -> Column:
        return F.bround(v / 100.0 * size, 0).cast("int")

    x1, x2 = F.greatest(px(F.array_min(xs), w), F.lit(0)), F.least(px(F.array_max(xs), w), w)
    y1, y2 = F.greatest(px(F.array_min(ys), h), F.lit(0)), F.least(px(F.array_max(ys), h), h)
    crop = F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return F.when((x2 > x1) & (y2 > y1), crop).otherwise(F.raise_error(F.lit("ROI is empty in pixels")))


def center_crop(w, h, cx, cy, size) -> Column:
    """Square crop round a point, clamped and snapped back to its full size where it fits."""
    w, h, cx, cy, size = (col(c) for c in (w, h, cx, cy, size))

    def axis(length: Column, centre: Column):
        side = F.least(size, length)
        lo = F.greatest(F.lit(0), centre - F.floor(side / 2))
        hi = F.least(length, lo + side)
        return F.greatest(F.lit(0), hi - side), hi

    x1, x2 = axis(w, cx)
    y1, y2 = axis(h, cy)
    return F.struct(*[v.cast("int").alias(n) for v, n in zip((x1, y1, x2, y2), EDGES)])


def _clamp_int(v: Column, hi: Column) -> Column:
    return F.greatest(F.lit(0), F.least(v.cast("int"), hi))


def clamp_gt(b, w, h) -> Column:
    """Ground-truth box clamped to the image in whole pixels; null when nothing is left."""
    b, w, h = col(b), col(w), col(h)
    x1, y1 = _clamp_int(b["x1"], w - 1), _clamp_int(b["y1"], h - 1)
    x2, y2 = _clamp_int(b["x2"], w), _clamp_int(b["y2"], h)
    return F.when((x2 > x1) & (y2 > y1), make_box(x1, y1, x2, y2))


def centered_crop(b, w, h, size=1024) -> Column:
    """Crop of ``size`` centred on a ground-truth box, snapped to the image edge.

    Returns the crop (``cx1..cy2``) and the box in crop-local pixels (``rx1..ry2``).
    """
    b, w, h = col(b), col(w), col(h)
    gx1, gy1 = _clamp_int(b["x1"], w - 1), _clamp_int(b["y1"], h - 1)
    gx2, gy2 = _clamp_int(b["x2"], w), _clamp_int(b["y2"], h)
    size = lit(size)
    half = size / 2.0

    def axis(lo: Column, hi: Column, length: Column):
        mid = (lo + hi) / 2.0
        c1 = F.greatest(F.lit(0), (mid - half).cast("int"))
        c2 = F.least(length, (mid + half).cast("int"))
        short = (c2 - c1) < size
        s1 = F.when(short, F.when(c1 == 0, F.lit(0)).otherwise(F.greatest(F.lit(0), c2 - size))).otherwise(c1)
        s2 = F.when(short, F.least(length, s1 + size)).otherwise(c2)
        return s1, s2

    cx1, cx2 = axis(gx1, gx2, w)
    cy1, cy2 = axis(gy1, gy2, h)
    fields = {
        "cx1": cx1, "cy1": cy1, "cx2": cx2, "cy2": cy2,
        "rx1": F.greatest(F.lit(0), gx1 - cx1), "ry1": F.greatest(F.lit(0), gy1 - cy1),
        "rx2": F.least(cx2 - cx1, gx2 - cx1), "ry2": F.least(cy2 - cy1, gy2 - cy1),
    }
    return F.struct(*[v.cast("int").alias(k) for k, v in fields.items()])


def crop_clamp(b, w, h) -> Column:
    """Pixel crop for an embedder; ``empty`` marks boxes replaced by a 1x1 placeholder."""
    b, w, h = col(b), col(w), col(h)
    x1, y1 = F.greatest(F.lit(0), b["x1"].cast("int")), F.greatest(F.lit(0), b["y1"].cast("int"))
    x2, y2 = F.least(w, b["x2"].cast("int")), F.least(h, b["y2"].cast("int"))
    return F.struct(
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
        ((x2 <= x1) | (y2 <= y1)).alias("empty"),
    )


def valid_bbox(arr) -> Column:
    """Four numbers, ``x1<x2``, ``y1<y2``, ``x1,y1>=0``."""
    arr = col(arr)
    x1, y1, x2, y2 = (F.get(arr, F.lit(i)) for i in range(4))
    ok = (F.size(arr) == 4) & (x1 < x2) & (y1 < y2) & (x1 >= 0) & (y1 >= 0)
    return F.coalesce(ok, F.lit(False))


def min_visible(b, w, h) -> Column:
    """Boxes under two pixels wide or high become 4-pixel boxes about their centre."""
    b, w, h = col(b), col(w).cast("double"), col(h).cast("double")
    bw, bh = _size(b)
    cx, cy = (b["x1"] + b["x2"]) / 2.0, (b["y1"] + b["y2"]) / 2.0
    grown = make_box(
        _zero_floor(cx - 2.0), _zero_floor(cy - 2.0), F.least(w, cx + 2.0), F.least(h, cy + 2.0)
    )
    return F.when((bw < 2) | (bh < 2), grown).otherwise(b)


def too_large(b, w, h, area_frac: float = 0.40, side_frac: float = 0.90) -> Column:
    """Near-full-frame boxes, and boxes without a positive size."""
    b, w, h = col(b), col(w).cast("double"), col(h).cast("double")
    bw, bh = _size(b)
    return (
        (bw <= 0) | (bh <= 0)
        | ((bw * bh) / (w * h + F.lit(1e-9)) > area_frac)
        | (F.greatest(bw, bh) > F.greatest(w, h) * F.lit(side_frac) + F.lit(1e-6))
    )
