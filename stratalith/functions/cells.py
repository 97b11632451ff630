"""Cells of a regular grid as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import CellModel


def node_id(ix: Column, iy: Column, nx: Column) -> Column:
    return iy.cast("long") * nx + ix


def step(low: Column, high: Column, count: Column) -> Column:
    return (high - low) / (count - 1)


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def cell_of(x: Column, low: Column, high: Column, count: Column) -> tuple[Column, Column]:
    """Cell number and fraction in it; the upper bound belongs to the last cell."""
    at = (x - low) / step(low, high, count)
    cell = F.least(F.floor(at), count.cast("long") - 2)
    return cell, clamped(at - cell, F.lit(0.0), F.lit(1.0))


def corner_weights(fx: Column, fy: Column, model: CellModel) -> list[Column]:
    """Weights of the corners bottom-left, bottom-right, top-left, top-right."""
    one, zero = F.lit(1.0), F.lit(0.0)
    if model is CellModel.BILINEAR:
        return [(one - fx) * (one - fy), fx * (one - fy), (one - fx) * fy, fx * fy]
    if model is CellModel.BOTTOM_LEFT_TO_TOP_RIGHT:
        lower = fy <= fx
        sides = ((one - fx, one - fy), (fx - fy, zero), (zero, fy - fx), (fy, fx))
    else:
        lower = fx + fy <= one
        sides = ((one - fx - fy, zero), (fx, one - fy), (fy, one - fx), (zero, fx + fy - one))
    return [F.when(lower, a).otherwise(b) for a, b in sides]
