"""Colour conversion and blending as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(x: Column) -> Column:
    """Clamped to [0, 1], times 255, truncated."""
    return F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")


def cmyk(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [_byte((1 - x) * (1 - k)) for x in (c, m, y)]


def gray(g: Column) -> list[Column]:
    return [_byte(g)] * 3


def rgb(r: Column, g: Column, b: Column) -> list[Column]:
    return [_byte(x) for x in (r, g, b)]


def blend(mode: str, s: Column, d: Column) -> Column:
    """Separable blend of a source over a backdrop in [0, 1]; unknown modes are Normal."""
    screen = lambda a, b: a + b - a * b
    hard = lambda a, b: F.when(a <= 0.5, 2 * a * b).otherwise(screen(2 * a - 1, b))
    return {"Multiply": lambda: s * d, "Screen": lambda: screen(s, d), "Darken": lambda: F.least(s, d), "Lighten": lambda: F.greatest(s, d), "Overlay": lambda: hard(d, s)}.get(mode, lambda: s)()


def over(s: Column, alpha: Column, d: Column) -> Column:
    """Source-over of a straight source on an opaque backdrop."""
    return s * alpha + d * (1 - alpha)
