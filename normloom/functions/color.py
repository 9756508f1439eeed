"""Colours as column expressions: HSL to hexadecimal, and weighted blending on the hue circle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _channel(m1: Column, m2: Column, hue: Column) -> Column:
    h = F.pmod(hue, F.lit(1.0))
    return (
        F.when(h < 1 / 6, m1 + (m2 - m1) * h * 6.0).when(h < 0.5, m2)
        .when(h < 2 / 3, m1 + (m2 - m1) * (F.lit(2 / 3) - h) * 6.0).otherwise(m1)
    )


def hsl_to_hex(h: Column, s: Column, l: Column) -> Column:  # noqa: E741
    """``#rrggbb`` of hue in degrees, saturation and lightness in percent; halves round to even."""
    hue, sat, light = h / 360.0, s / 100.0, l / 100.0
    m2 = F.when(light <= 0.5, light * (sat + 1.0)).otherwise(light + sat - light * sat)
    m1 = light * 2.0 - m2
    two = lambda c: F.lpad(F.lower(F.hex(F.bround(c * 255.0, 0).cast("int"))), 2, "0")
    parts = [two(F.when(sat == 0, light).otherwise(_channel(m1, m2, hue + d))) for d in (1 / 3, 0.0, -1 / 3)]
    return F.concat(F.lit("#"), *parts)


def blended(h: Column, s: Column, l: Column, w: Column) -> Column:  # noqa: E741
    """Aggregate: the weighted circular mean of hues and linear means of the rest as struct h, s, l; null without weight."""
    total = F.sum(w)
    y, x = F.sum(w * F.sin(F.radians(h))), F.sum(w * F.cos(F.radians(h)))
    mean = F.struct(F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)).alias("h"), (F.sum(w * s) / total).alias("s"), (F.sum(w * l) / total).alias("l"))
    return F.when(total > 0, mean)
