"""Box algebra as column expressions. A box is a struct (or a table alias) with x1, y1, x2, y2."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlaps(a: Column, b: Column) -> Column:
    """A cheap test that a positive intersection implies."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the union is empty; sides below zero count as zero."""
    side = lambda x: F.greatest(x["x2"] - x["x1"], F.lit(0.0)) * F.greatest(x["y2"] - x["y1"], F.lit(0.0))
    union = side(a) + side(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(F.lit(0.0))


def ioa(a: Column, b: Column) -> Column:
    """Intersection over the area of b, 0 where that is empty."""
    return F.when(area(b) > 0, intersection(a, b) / area(b)).otherwise(F.lit(0.0))


def contains(outer: Column, inner: Column) -> Column:
    return (inner["x1"] >= outer["x1"]) & (inner["y1"] >= outer["y1"]) & (inner["x2"] <= outer["x2"]) & (inner["y2"] <= outer["y2"])


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), x2.cast("double").alias("x2"), y2.cast("double").alias("y2"))


def clip(b: Column, width: Column, height: Column) -> Column:
    within = lambda v, top: F.greatest(F.least(v, top.cast("double")), F.lit(0.0))
    return box(within(b["x1"], width), within(b["y1"], height), within(b["x2"], width), within(b["y2"], height))


def scale(b: Column, sx: Column, sy: Column) -> Column:
    return box(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def non_empty(b: Column, least: float = 0.0) -> Column:
    return (b["x2"] - b["x1"] > least) & (b["y2"] - b["y1"] > least)


def from_xywh(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def around_rotated(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """The axis-aligned box around a box turned by an angle."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    nw, nh = c * w + s * h, c * h + s * w
    return box(cx - nw / 2, cy - nh / 2, cx + nw / 2, cy + nh / 2)


def edge_distances(x: Column, y: Column, b: Column) -> Column:
    """From a point to the left, top, right and bottom edge."""
    return F.array(x - b["x1"], y - b["y1"], b["x2"] - x, b["y2"] - y)


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace formula over arrays of coordinates."""
    turn = lambda v: F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
    terms = F.zip_with(F.zip_with(xs, turn(ys), lambda a, b: a * b), F.zip_with(ys, turn(xs), lambda a, b: a * b), lambda a, b: a - b)
    return 0.5 * F.abs(F.aggregate(terms, F.lit(0.0), lambda t, v: t + v))


def polygon_box(xs: Column, ys: Column) -> Column:
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def normal_angle(degrees: Column) -> Column:
    """Into [-180, 180)."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def tight_crop(b: Column, width: Column, height: Column) -> Column:
    """Whole pixels inside the image; null if nothing is left."""
    c = box(F.greatest(b["x1"].cast("int"), F.lit(0)), F.greatest(b["y1"].cast("int"), F.lit(0)), F.least(b["x2"].cast("int"), width), F.least(b["y2"].cast("int"), height))
    return F.when((c["x2"] > c["x1"]) & (c["y2"] > c["y1"]), c)


def within(b: Column, width: Column, height: Column, slack: float = 0.0) -> Column:
    return (b["x1"] >= -slack) & (b["y1"] >= -slack) & (b["x2"] <= width + slack) & (b["y2"] <= height + slack)


def centred(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), (b["x2"] - b["x1"]).alias("w"), (b["y2"] - b["y1"]).alias("h"))


def clockwise(xs: Column, ys: Column) -> Column:
    """Sign of the shoelace sum in coordinates whose y grows downward."""
    turn = lambda v: F.concat(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, 1, 1))
    terms = F.zip_with(F.zip_with(xs, turn(ys), lambda a, b: a * b), F.zip_with(ys, turn(xs), lambda a, b: a * b), lambda a, b: a - b)
    return F.aggregate(terms, F.lit(0.0), lambda t, v: t + v) > 0


def _side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """-1, 0 or 1: on which side of the line from a to b the point c lies."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _meet(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether the sides from a to b and from c to d have a point in common (structs x, y)."""
    of = lambda p, q, r: _side(p["x"], p["y"], q["x"], q["y"], r["x"], r["y"])
    within = lambda p, q, r: r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
    on = [(of(a, b, c) == 0) & within(a, b, c), (of(a, b, d) == 0) & within(a, b, d), (of(c, d, a) == 0) & within(c, d, a), (of(c, d, b) == 0) & within(c, d, b)]
    return ((of(a, b, c) != of(a, b, d)) & (of(c, d, a) != of(c, d, b))) | on[0] | on[1] | on[2] | on[3]


def crossing(points: Column) -> Column:
    """Whether two sides of a polygon (array of structs x, y) that aren't neighbours meet: then it isn't simple."""
    n = F.size(points)
    side = lambda i: (F.get(points, i), F.get(points, (i + 1) % n))
    later = lambda i: F.filter(F.sequence(i + 2, F.greatest(n - 1, i + 2)), lambda j: (j < n) & ~((i == 0) & (j == n - 1)))
    return F.exists(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.exists(later(i), lambda j: _meet(*side(i), *side(j))))


def refusal(points: Column, width: Column, height: Column) -> Column:
    """Why a transcription's polygon (array of structs x, y, y grows downward) can't be taken, null if it can: 'points' (under three, or one without a number), 'outside' the image, 'line' (all
    points on one), 'crossing' sides, 'counterclockwise'."""
    n = F.size(points)
    at = lambda k: F.get(points, k % n)
    number = F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    inside = F.forall(points, lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] <= width) & (p["y"] <= height))
    flat = F.forall(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: _side(at(k)["x"], at(k)["y"], at(k + 1)["x"], at(k + 1)["y"], at(k + 2)["x"], at(k + 2)["y"]) == 0)
    turns = clockwise(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))
    return F.when(points.isNull() | (n < 3) | ~number, "points").when(~inside, "outside").when(flat, "line").when(crossing(points), "crossing").when(~turns, "counterclockwise")


def shifted_keypoints(values: Column, by: float = 0.5) -> Column:
    """x, y, visibility triples with x and y moved."""
    return F.transform(values, lambda v, k: F.when(k % 3 != 2, v + by).otherwise(v))


def rle_area(counts: Column) -> Column:
    """Set pixels of alternating run lengths, the first run unset."""
    return F.aggregate(F.transform(counts, lambda n, k: F.when(k % 2 == 1, n).otherwise(0)), F.lit(0).cast("bigint"), lambda t, n: t + n)


def matched_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes as they are; null where the union is empty."""
    i = intersection(a, b)
    return F.try_divide(i, area(a) + area(b) - i)


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _around(r: Column) -> Column:
    b = around_rotated(r[0], r[1], r[2], r[3], r[4])
    return F.array(b["x1"], b["y1"], b["x2"], b["y2"])


_MODES: dict[tuple[str, str], Callable[[Column], Column]] = {
    ("xywh", "xyxy"): lambda b: F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]),
    ("xyxy", "xywh"): lambda b: F.array(b[0], b[1], b[2] - b[0], b[3] - b[1]),
    ("xywh", "xywha"): lambda b: F.array(b[0] + b[2] / 2, b[1] + b[3] / 2, b[2], b[3], F.lit(0.0)),
    ("xywha", "xyxy"): _around,
}


def to_mode(b: Column, source: str, target: str) -> Column:
    """Arrays of a box in another mode: xyxy, xywh, xywha (centre, size, degrees)."""
    if source == target:
        return b
    if (source, target) not in _MODES:
        raise ValueError(f"no conversion from {source} to {target}")
    return _once(b, _MODES[source, target])


def rotated_clip(r: Column, width: float, height: float, flat: float = 1.0) -> Column:
    """A turned box (array cx, cy, w, h, degrees) cut to the image if turned by ``flat`` degrees or less; its angle is brought into [-180, 180)."""
    angle = normal_angle(r[4])
    low = lambda c, s, top: F.greatest(F.least(c - s / 2, F.lit(float(top))), F.lit(0.0))
    high = lambda c, s, top: F.greatest(F.least(c + s / 2, F.lit(float(top))), F.lit(0.0))
    x1, x2, y1, y2 = low(r[0], r[2], width), high(r[0], r[2], width), low(r[1], r[3], height), high(r[1], r[3], height)
    cut = F.array((x1 + x2) / 2, (y1 + y2) / 2, F.least(r[2], x2 - x1), F.least(r[3], y2 - y1), angle)
    return F.when(F.abs(angle) <= flat, cut).otherwise(F.array(r[0], r[1], r[2], r[3], angle))


def rotated_scale(r: Column, sx: float, sy: float) -> Column:
    """A turned box after scaling by two factors: the turned rectangle that fits the skewed one."""
    c, s = F.cos(F.radians(r[4])), F.sin(F.radians(r[4]))
    size = lambda v, a, b: v * F.sqrt(a * a + b * b)
    return F.array(r[0] * sx, r[1] * sy, size(r[2], sx * c, sy * s), size(r[3], sx * s, sy * c), F.degrees(F.atan2(sx * s, sy * c)))


def rotated_inside(r: Column, width: float, height: float, slack: float = 0.0) -> Column:
    """Whether the upright box around a turned one is inside the image."""
    return within(around_rotated(r[0], r[1], r[2], r[3], r[4]), F.lit(width), F.lit(height), slack)


def vertical_crossings(xs: Column, ys: Column, at: Column) -> Column:
    """Heights at which a line of points meets the vertical at x: its points there, and where a side passes from one hand to the other."""
    sides = F.transform(F.sequence(F.lit(0), F.size(xs) - 1), lambda k: F.struct(F.get(xs, k).alias("x"), F.get(ys, k).alias("y"), F.get(xs, k + 1).alias("nx"), F.get(ys, k + 1).alias("ny")))
    passes = lambda p: (p["x"] == at) | (F.least(p["x"], p["nx"]) < at) & (F.greatest(p["x"], p["nx"]) > at) & p["nx"].isNotNull()
    height = lambda p: F.when(p["x"] == at, p["y"]).otherwise(p["y"] + (at - p["x"]) * (p["ny"] - p["y"]) / (p["nx"] - p["x"]))
    return F.transform(F.filter(sides, lambda p: F.coalesce(passes(p), F.lit(False))), height)


def from_pairs(b: Column) -> Column:
    """A box of two corners [[x1, y1], [x2, y2]]; another shape raises."""
    right = (F.size(b) == 2) & F.forall(b, lambda c: F.size(c) == 2)
    return F.when(right, box(b[0][0], b[0][1], b[1][0], b[1][1])).otherwise(F.raise_error(F.lit("box isn't two corners")).cast("struct<x1:double,y1:double,x2:double,y2:double>"))


def valid_polygons(polygons: Column) -> Column:
    """Polygons (flat arrays) of an even number of values, three points or more."""
    return F.filter(polygons, lambda p: (F.size(p) % 2 == 0) & (F.size(p) >= 6))
