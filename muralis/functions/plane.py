"""Plane homographies as column expressions; a homography maps millimetres to pixels, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apply_h(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    w = h[6] * x + h[7] * y + h[8]
    return (h[0] * x + h[1] * y + h[2]) / w, (h[3] * x + h[4] * y + h[5]) / w


def invert3(m: list[Column]) -> list[Column]:
    """Inverse by cofactors."""
    a, b, c, d, e, f, g, h, i = m
    co = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    det = a * co[0] + b * co[3] + c * co[6]
    return [x / det for x in co]


def local_scale(h: list[Column], px: Column, py: Column) -> tuple[Column, Column]:
    """Pixels per millimetre and anisotropy at a pixel: half a millimetre to either side, along each axis."""
    x, y = apply_h(invert3(h), px, py)

    def along(dx: float, dy: float) -> Column:
        ax, ay = apply_h(h, x - dx, y - dy)
        bx, by = apply_h(h, x + dx, y + dy)
        return F.hypot(bx - ax, by - ay)

    sx, sy = along(0.5, 0.0), along(0.0, 0.5)
    return F.sqrt(sx * sy), F.abs(sx - sy) / F.greatest(sx, sy)
