"""Correlation and covariance of two nodes as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import Correlation


def correlation(dx: Column, dy: Column, major_range: Column | float, minor_range: Column | float, azimuth_degrees: float, model: Correlation) -> Column:
    """By the lag, turned into the azimuth (counter-clockwise from +x) and divided by the ranges."""
    c, s = math.cos(azimuth_degrees * math.pi / 180), math.sin(azimuth_degrees * math.pi / 180)
    along, across = (dx * c + dy * s) / major_range, (dy * c - dx * s) / minor_range
    h = F.sqrt(along * along + across * across)
    if model is Correlation.GAUSSIAN:
        return F.exp(h * h * -3.0)
    if model is Correlation.EXPONENTIAL:
        return F.exp(h * -3.0)
    return F.when(h >= 1.0, 0.0).otherwise(1.0 - h * 1.5 + h * h * h * 0.5)


def covariance(rho: Column, same_node: Column, variance: Column | float, nugget: float) -> Column:
    return rho * variance + F.when(same_node, nugget).otherwise(0.0)


def signed_lag(k: Column, size: Column | int) -> Column:
    return F.when(k * 2 <= size, k).otherwise(k - size)
