"""Display mapping of values to 8-bit grays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def render(v: Column, low: Column, high: Column, log: bool = False) -> Column:
    """Linear or logarithmic, clipped, rounded half up."""
    low, high = low.cast("double"), high.cast("double")
    share = (F.log1p(F.greatest(F.lit(0.0), v - low)) / F.log1p(high - low)) if log else (v - low) / (high - low)
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * 255 + 0.5).cast("long")


def render_gamma(v: Column, low: Column, high: Column, gamma: float = 0.5) -> Column:
    """The older mapping: a power, truncated."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low)))
    return F.floor(F.pow(share, F.lit(gamma)) * 255).cast("long")


def window_ok(low: Column, high: Column) -> Column:
    return (low >= 0) & (low < high) & (high <= 65535)
