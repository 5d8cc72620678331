"""Affine matrices, rectangles, tiles and shading as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Six = tuple[Column, Column, Column, Column, Column, Column]
Box = tuple[Column, Column, Column, Column]


def concat(m: Six, n: Six) -> list[Column]:
    """The product of two matrices, m applied first."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return [a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + l]


def transform_point(m: Six, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def inverse(m: Six) -> list[Column]:
    """The inverse matrix; null where the determinant is below 1e-10."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    ok = F.when(F.abs(det) >= 1e-10, det)
    return [d / ok, -b / ok, -c / ok, a / ok, (c * f - d * e) / ok, (b * e - a * f) / ok]


def shear(m: Six) -> Column:
    a, b, c, d = m[:4]
    n = a * a + b * b
    return F.when(n > 0, (a * c + b * d) / F.when(n > 0, n)).otherwise(0.0)


def intersects(p: Box, q: Box) -> Column:
    """Whether two rectangles overlap; touching edges don't."""
    return (p[0] < q[2]) & (p[2] > q[0]) & (p[1] < q[3]) & (p[3] > q[1])


def quad_bounds(quads: Column) -> list[Column]:
    """Bounds of quad points: least and greatest of the even and the odd places."""
    xs, ys = F.filter(quads, lambda _, i: i % 2 == 0), F.filter(quads, lambda _, i: i % 2 == 1)
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def quads(points: Column) -> Column:
    """Groups of eight numbers; a rest is dropped."""
    n = F.floor(F.size(points) / 8).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(points, i * 8 + 1, F.lit(8)))).otherwise(F.array().cast("array<array<double>>"))


def tiles(width: Column, height: Column, size: Column | float) -> Column:
    """Tiles (col, row, x, y, w, h) of a page; the last of a row or column may be smaller."""
    size = F.lit(size) if not isinstance(size, Column) else size
    count = lambda n: F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0)))
    cell = lambda c, r: F.struct(c.alias("col"), r.alias("row"), (c * size).alias("x"), (r * size).alias("y"), F.least(size, width - c * size).alias("w"), F.least(size, height - r * size).alias("h"))
    return F.flatten(F.transform(count(height), lambda r: F.transform(count(width), lambda c: cell(c, r))))


def exponential(t: Column, c0: Column, c1: Column, n: Column) -> Column:
    """Shading function of type 2."""
    return c0 + F.pow(t, n) * (c1 - c0)


def stitch(t: Column, bounds: list[float], encode: list[tuple[float, float]], domain: tuple[float, float], parts: list) -> Column:
    """Shading function of type 3 over ``parts``, functions of a column."""
    edges = [domain[0], *bounds, domain[1]]
    out = F.lit(None).cast("double")
    for i in reversed(range(len(parts))):
        lo, hi = edges[i], edges[i + 1]
        e0, e1 = encode[i]
        own = F.lit(e0) if hi == lo else e0 + (t - lo) * (e1 - e0) / (hi - lo)
        out = parts[i](own) if i == len(parts) - 1 else F.when(t < hi, parts[i](own)).otherwise(out)
    return out


def axial(x: Column, y: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """The parameter of an axial shading, before extension rules."""
    dx, dy = x1 - x0, y1 - y0
    return ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy)
