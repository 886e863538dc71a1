"""Overlap of polygons and of turned boxes, as Arrow functions: no expression of the engine cuts polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import DoubleType

#: Numbers that one step over a batch holds in an array, at most.
CELLS = 1_000_000


def _sides(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """x1, y1, x2, y2 of the sides of each row's polygon, lower end first."""
    u, v = np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
    down = y > v
    return np.where(down, u, x), np.where(down, v, y), np.where(down, x, u), np.where(down, y, v)


def _crossings(e: tuple[np.ndarray, ...], f: tuple[np.ndarray, ...]) -> np.ndarray:
    """Heights at which sides of e and f cross, NaN for pairs that don't."""
    ex, ey, eu, ev = (v[:, :, None] for v in e)
    fx, fy, fu, fv = (v[:, None, :] for v in f)
    det = (eu - ex) * (fv - fy) - (ev - ey) * (fu - fx)
    t = ((fx - ex) * (fv - fy) - (fy - ey) * (fu - fx)) / det
    s = ((fx - ex) * (ev - ey) - (fy - ey) * (eu - ex)) / det
    met = (det != 0) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1)
    return np.where(met, ey + t * (ev - ey), np.nan).reshape(len(det), -1)


def _spans(e: tuple[np.ndarray, ...], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left and right ends of the inside at each row's heights; both 0 where there is none."""
    x1, y1, x2, y2 = (v[:, None, :] for v in e)
    y = y[:, :, None]
    x = np.sort(np.where((y1 <= y) & (y2 > y), x1 + (y - y1) / (y2 - y1) * (x2 - x1), np.inf), axis=-1)
    left, right = x[..., 0 : x.shape[-1] // 2 * 2 : 2], x[..., 1::2]
    inside = np.isfinite(right)
    return np.where(inside, left, 0.0), np.where(inside, right, 0.0)


def shared_areas(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Areas of a, of b and of what they share, a row each; polygons are rows of coordinates, inside by the even-odd rule.

    Between two neighbouring heights of corners and crossings no sides meet, so widths change evenly and the width half-way times the height is the area."""
    out = np.zeros((len(ax), 3))
    corners = ax.shape[1] + bx.shape[1]
    step = max(1, CELLS // (corners**2 * corners))
    with np.errstate(all="ignore"):
        for k in range(0, len(ax), step):
            a, b = _sides(ax[k : k + step], ay[k : k + step]), _sides(bx[k : k + step], by[k : k + step])
            cuts = np.sort(np.concatenate([ay[k : k + step], by[k : k + step], _crossings(a, b), _crossings(a, a), _crossings(b, b)], axis=1), axis=1)
            height, middle = np.nan_to_num(cuts[:, 1:] - cuts[:, :-1]), (cuts[:, 1:] + cuts[:, :-1]) / 2
            (al, ar), (bl, br) = _spans(a, middle), _spans(b, middle)
            both = np.maximum(np.minimum(ar[..., :, None], br[..., None, :]) - np.maximum(al[..., :, None], bl[..., None, :]), 0.0).sum(axis=(-1, -2))
            for j, width in enumerate(((ar - al).sum(axis=-1), (br - bl).sum(axis=-1), both)):
                out[k : k + step, j] = (height * width).sum(axis=1)
    return out


def _meet(ax, ay, bx, by) -> np.ndarray:
    """Whether the bounding boxes overlap."""
    lo, hi = (lambda v: v.min(axis=1)), (lambda v: v.max(axis=1))
    return (lo(ax) < hi(bx)) & (lo(bx) < hi(ax)) & (lo(ay) < hi(by)) & (lo(by) < hi(ay))


def _twice(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice the signed area of each row's polygon."""
    x, y = x - x[:, :1], y - y[:, :1]
    return (x * np.roll(y, -1, axis=1) - np.roll(x, -1, axis=1) * y).sum(axis=1)


def _convex(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether a row's polygon of at most four corners surely is convex: turns of one direction, each below half a turn, can't go round twice."""
    if x.shape[1] > 4:
        return np.zeros(len(x), dtype=bool)
    ex, ey = np.roll(x, -1, axis=1) - x, np.roll(y, -1, axis=1) - y
    fx, fy = np.roll(ex, -1, axis=1), np.roll(ey, -1, axis=1)
    turn, ahead = ex * fy - ey * fx, ex * fx + ey * fy
    one_way = (turn >= 0).all(axis=1) | (turn <= 0).all(axis=1)
    return one_way & ((turn != 0) | (ahead > 0)).all(axis=1) & (turn != 0).any(axis=1)


def _clipped(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Areas that convex a and b share: a is cut along each side of b. A cut adds one corner at most; places without a corner repeat the first."""
    side, row = np.sign(_twice(bx, by)), np.arange(len(ax))[:, None]
    x, y = ax, ay
    for k in range(bx.shape[1]):
        ox, oy = bx[:, [k]], by[:, [k]]
        ux, uy = np.roll(bx, -1, axis=1)[:, [k]] - ox, np.roll(by, -1, axis=1)[:, [k]] - oy
        far = side[:, None] * (ux * (y - oy) - uy * (x - ox))
        then, nx, ny = np.roll(far, -1, axis=1), np.roll(x, -1, axis=1), np.roll(y, -1, axis=1)
        crossed = (far >= 0) != (then >= 0)
        t = np.where(crossed, far / np.where(crossed, far - then, 1.0), 0.0)
        pairs = lambda own, cut: np.stack([own, cut], axis=2).reshape(len(ax), 2 * own.shape[1])
        kept = pairs(far >= 0, crossed)
        order = np.argsort(~kept, axis=1, kind="stable")[:, : x.shape[1] + 1]
        x, y, kept = pairs(x, x + t * (nx - x))[row, order], pairs(y, y + t * (ny - y))[row, order], kept[row, order]
        x, y = np.where(kept, x, x[:, :1]), np.where(kept, y, y[:, :1])
        x, y = np.where(kept[:, :1], x, 0.0), np.where(kept[:, :1], y, 0.0)
    return np.abs(_twice(x, y)) / 2


def _areas(ax, ay, bx, by) -> np.ndarray:
    """``shared_areas``, where both polygons are convex by cutting."""
    fast, out = _convex(ax, ay) & _convex(bx, by), np.empty((len(ax), 3))
    a, b = (ax[fast], ay[fast]), (bx[fast], by[fast])
    with np.errstate(all="ignore"):
        out[fast] = np.stack([np.abs(_twice(*a)) / 2, np.abs(_twice(*b)) / 2, _clipped(*a, *b)], axis=1)
    out[~fast] = shared_areas(ax[~fast], ay[~fast], bx[~fast], by[~fast])
    return out


def _ious(ax, ay, bx, by) -> np.ndarray:
    out, near = np.zeros(len(ax)), _meet(ax, ay, bx, by)
    areas = _areas(ax[near], ay[near], bx[near], by[near])
    union = areas[:, 0] + areas[:, 1] - areas[:, 2]
    out[near] = np.divide(areas[:, 2], union, out=np.zeros(len(union)), where=union > 0)
    return out


def _even(column: pa.Array) -> np.ndarray:
    """Arrays of one length: short ones repeat their last corner, which changes no area."""
    size = pc.list_value_length(column).to_numpy()
    starts = np.cumsum(size) - size
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return values[starts[:, None] + np.minimum(np.arange(size.max()), size[:, None] - 1)]


def _by_row(args: tuple[pa.Array, ...], f) -> pa.Array:
    known = np.logical_and.reduce([pc.fill_null(pc.list_value_length(a), 0).to_numpy() > 0 for a in args])
    out = np.full(len(args[0]), np.nan)
    if known.any():
        out[known] = f(*[_even(a if known.all() and not a.null_count else a.filter(pa.array(known))) for a in args])
    return pa.array(out, mask=np.isnan(out))


@arrow_udf(DoubleType())
def polygon_iou(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
    """Null for a null or empty polygon; 0 where the union is empty. Both coordinates of a polygon have one length."""
    return _by_row((ax, ay, bx, by), _ious)


@arrow_udf(DoubleType())
def polygon_intersection(ax: pa.Array, ay: pa.Array, bx: pa.Array, by: pa.Array) -> pa.Array:
    """Null for a null or empty polygon."""
    return _by_row((ax, ay, bx, by), lambda *c: shared_areas(*c)[:, 2])


def corners(boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x and y of the corners of rows cx, cy, w, h, degrees, turned counterclockwise on screen, y growing downward."""
    cx, cy, w, h, turn = (boxes[:, [k]] for k in range(5))
    c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
    dx, dy = np.array([-0.5, 0.5, 0.5, -0.5]) * w, np.array([-0.5, -0.5, 0.5, 0.5]) * h
    return cx + c * dx + s * dy, cy - s * dx + c * dy


@pandas_udf(DoubleType())
def rotated_iou(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    """Of two structs cx, cy, w, h, degrees without nulls."""
    return pd.Series(_ious(*corners(a.to_numpy(dtype=float)), *corners(b.to_numpy(dtype=float))))
