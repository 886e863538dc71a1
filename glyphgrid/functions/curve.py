"""Curves around text lines: sampled cubic curves and the order of label points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType


def curve_polygon(control: Column, samples: int = 20) -> Column:
    """Array of (x, y): ``samples`` points of the upper, then of the lower cubic curve of 16 numbers (four points each); another length gives null."""

    def at(k: Column) -> Column:
        u, base = (k % samples) / F.lit(float(samples - 1)), F.when(k < samples, 0).otherwise(8)
        weights = ((1 - u) * (1 - u) * (1 - u), 3 * u * (1 - u) * (1 - u), 3 * u * u * (1 - u), u * u * u)
        value = lambda axis: sum((w * F.get(control, base + 2 * j + axis) for j, w in enumerate(weights)), F.lit(0.0))
        return F.struct(value(0).alias("x"), value(1).alias("y"))

    return F.when(F.size(control) == 16, F.transform(F.sequence(F.lit(0), F.lit(2 * samples - 1)), at))


def _heights(line: np.ndarray, x: float) -> list[float]:
    """Where a vertical line meets the open line: its own points on it, and crossings strictly inside a piece."""
    (px, py), (qx, qy) = line[:-1].T, line[1:].T
    cut = (np.minimum(px, qx) < x) & (np.maximum(px, qx) > x)
    return [*line[line[:, 0] == x, 1], *((x - px[cut]) * (qy[cut] - py[cut]) / (qx[cut] - px[cut]) + py[cut])]


def _upside_down(points: np.ndarray, first: np.ndarray, second: np.ndarray) -> bool:
    if first[:, 1].min() > second[:, 1].max():
        return True
    top = points[:, 1].min()
    if first[:, 0].min() > second[:, 0].max() or first[:, 0].max() < second[:, 0].min():
        return top == second[:, 1].min()
    for x, y in first:
        met = _heights(second, x)
        if met and max(met) < y:
            return True
        if met and top == first[:, 1].min():
            return False
    return False


@pandas_udf(ArrayType(DoubleType()))
def label_order(polygons: pd.Series) -> pd.Series:
    """The 32 numbers of 16 points (eight a side) so that the first side is the upper one, read as a picture is; another length raises, null stays."""

    def one(flat):
        if flat is None:
            return None
        p = np.asarray(flat, dtype=float).reshape(16, 2)
        x, y = p.T
        if (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() <= 0:  # the other way round: both sides are read backwards
            p = np.concatenate((p[:7:-1], p[7::-1]))
        return (np.roll(p, 8, axis=0) if _upside_down(p, p[:8], p[:7:-1]) else p).ravel()

    return polygons.map(one)
