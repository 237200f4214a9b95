"""Header geometry as Column expressions: scalars, offsets, azimuths, grids, distances and units."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FEET_PER_METRE = 3.28084


def apply_scalar(x: Column, scalar: Column) -> Column:
    """The coordinate scalar convention: negative divides by its magnitude, positive multiplies, zero leaves."""
    return F.when(scalar < 0, x / F.abs(scalar)).when(scalar > 0, x * scalar).otherwise(x.cast("double"))


def offset(sx: Column, sy: Column, rx: Column, ry: Column) -> Column:
    return F.hypot(rx - sx, ry - sy)


def azimuth(sx: Column, sy: Column, rx: Column, ry: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(rx - sx, ry - sy)), F.lit(360.0))


def signed_offset(sx: Column, sy: Column, rx: Column, ry: Column, inline_azimuth: float = 0.0) -> Column:
    """Offset, negative where the receiver lies against the inline direction; 0 projection counts as positive."""
    a = math.radians(inline_azimuth)
    along = (rx - sx) * math.sin(a) + (ry - sy) * math.cos(a)
    return F.when(along < 0, -offset(sx, sy, rx, ry)).otherwise(offset(sx, sy, rx, ry))


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def inline_xline(x: Column, y: Column, origin: tuple[float, float], spacing: tuple[float, float], inline_azimuth: float = 0.0, start: tuple[int, int] = (1, 1)) -> tuple[Column, Column]:
    """Line numbers of a midpoint: rotated to the inline azimuth, rounded half to even."""
    a = math.radians(inline_azimuth)
    dx, dy = x - origin[0], y - origin[1]
    along, across = dx * math.sin(a) + dy * math.cos(a), dx * math.cos(a) - dy * math.sin(a)
    return F.rint(along / spacing[0]).cast("long") + start[0], F.rint(across / spacing[1]).cast("long") + start[1]


def cdp_of(inline: Column, xline: Column, origin: tuple[float, float], spacing: tuple[float, float], inline_azimuth: float = 0.0, start: tuple[int, int] = (1, 1)) -> tuple[Column, Column]:
    """The midpoint of line numbers; undoes inline_xline up to its rounding."""
    a = math.radians(inline_azimuth)
    along, across = (inline - start[0]) * spacing[0], (xline - start[1]) * spacing[1]
    return along * math.sin(a) + across * math.cos(a) + origin[0], along * math.cos(a) - across * math.sin(a) + origin[1]


def distance_3d(x1: Column, y1: Column, z1: Column, x2: Column, y2: Column, z2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) + (z2 - z1) * (z2 - z1))


def angle_from_vertical(horizontal: Column, vertical: Column) -> Column:
    return F.degrees(F.atan2(horizontal, vertical))


def rotate(x: Column, y: Column, degrees: float, origin: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy = x - origin[0], y - origin[1]
    return dx * c - dy * s + origin[0], dx * s + dy * c + origin[1]


def scale(x: Column, y: Column, factor: float, origin: tuple[float, float] = (0.0, 0.0)) -> tuple[Column, Column]:
    return (x - origin[0]) * factor + origin[0], (y - origin[1]) * factor + origin[1]


def world_to_bin(x: Column, y: Column, origin: tuple[float, float], size: tuple[float, float], degrees: float = 0.0) -> tuple[Column, Column, Column]:
    """(ix, iy, distance to the bin's centre) on a grid rotated by so many degrees."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    dx, dy = x - origin[0], y - origin[1]
    u, v = dx * c + dy * s, dy * c - dx * s
    ix, iy = F.floor(u / size[0]).cast("long"), F.floor(v / size[1]).cast("long")
    return ix, iy, F.hypot(u - (ix + 0.5) * size[0], v - (iy + 0.5) * size[1])


def bin_to_world(ix: Column, iy: Column, origin: tuple[float, float], size: tuple[float, float], degrees: float = 0.0) -> tuple[Column, Column]:
    """The centre of a bin."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    u, v = (ix + 0.5) * size[0], (iy + 0.5) * size[1]
    return u * c - v * s + origin[0], u * s + v * c + origin[1]


def grid_index(x: Column, y: Column, origin: tuple[float, float], spacing: tuple[float, float], shape: tuple[int, int], azimuth_degrees: float = 0.0) -> tuple[Column, Column, Column]:
    """(inline index, crossline index, whether both were inside) on an image grid: rounded half to even, clipped to the grid."""
    a = math.radians(azimuth_degrees)
    dx, dy = x - origin[0], y - origin[1]
    il = F.rint((dx * math.sin(a) + dy * math.cos(a)) / spacing[0]).cast("long")
    xl = F.rint((dx * math.cos(a) - dy * math.sin(a)) / spacing[1]).cast("long")
    clip = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("long")
    return clip(il, shape[0]), clip(xl, shape[1]), il.between(0, shape[0] - 1) & xl.between(0, shape[1] - 1)


def to_feet(metres: Column) -> Column:
    return metres * FEET_PER_METRE


def to_metres(feet: Column) -> Column:
    return feet / FEET_PER_METRE


def wavenumber_to_feet(per_metre: Column) -> Column:
    return per_metre / FEET_PER_METRE


def decibels(amplitude: Column) -> Column:
    return 20 * F.log10(amplitude + 1e-10)
