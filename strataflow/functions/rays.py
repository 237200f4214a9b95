"""Rays in a medium whose velocity is a line between knots of depth: ray parameter, times and spreading, in NumPy.

A ray from the surface to a point at distance h and depth z keeps its parameter p, the sine of its angle
over the velocity. Distance and time of a ray are sums over the layers, in closed form for each; p is
found by bisection for all points at once. A point farther than the flattest direct ray goes is reached by
a ray that has turned below it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

STEPS = 60
#: What 1 may lack where a ray lies level.
ROUNDING = 2e-15
#: Fixed value: the least cosine that spreading is divided by.
LEAST_COSINE = 0.1


class Rays(NamedTuple):
    """parameter: NaN where no ray gets; angle: from the vertical at the surface; turning: the depth where the ray turns, infinite if it never does; spreading: length times the root of the velocities' ratio over the cosine."""

    parameter: np.ndarray
    angle: np.ndarray
    turning: np.ndarray
    time: np.ndarray
    spreading: np.ndarray


class Medium:
    """Velocities at knots (z, v) by a line, which don't fall with depth; level beyond the last. The first knot is the surface's."""

    def __init__(self, knots: list[tuple[float, float]]):
        self.z, self.v = (np.array(c, float) for c in zip(*sorted(knots), strict=True))
        if self.z[0] != 0 or (np.diff(self.z) <= 0).any() or (np.diff(self.v) < 0).any() or self.v[0] <= 0:
            raise ValueError("knots start at depth 0, at different depths, with positive velocities that don't fall")

    def velocity(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, self.z, self.v)

    def depth_of(self, v: np.ndarray) -> np.ndarray:
        """The least depth of a velocity; infinite beyond the last."""
        return np.where(v > self.v[-1], np.inf, np.interp(v, self.v, self.z))

    def down(self, p: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and time of the rays of parameter p from the surface down to z."""
        x, t = np.zeros(np.broadcast_shapes(p.shape, z.shape)), np.zeros(np.broadcast_shapes(p.shape, z.shape))
        square = lambda v: 1 - (p * v) ** 2
        cosine = lambda v: np.sqrt(np.where(square(v) > ROUNDING, square(v), 0))
        ends = [*self.z[1:], np.inf]
        for k, top in enumerate(self.z):
            bottom = np.clip(z, top, ends[k])
            dz, a, b = bottom - top, self.v[k], self.velocity(bottom)
            ca, cb = cosine(a), cosine(b)
            slope = (self.v[k + 1] - a) / (ends[k] - top) if k + 1 < len(self.z) else 0.0
            with np.errstate(divide="ignore", invalid="ignore"):
                x += np.where(dz > 0, p * dz * (a + b) / (ca + cb), 0)
                t += np.where(dz > 0, np.log(b / a * (1 + ca) / (1 + cb)) / slope if slope > 1e-9 else dz / (a * ca), 0)
        return x, t

    def _whole(self, p: np.ndarray, z: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance and time to z of direct rays, or of those that have turned below it."""
        x, t = self.down(p, z)
        low = self.depth_of(1 / np.maximum(p, 1e-300))
        xt, tt = self.down(p, np.where(turned & np.isfinite(low), low, z))
        return np.where(turned, 2 * xt - x, x), np.where(turned, 2 * tt - t, t)

    def rays(self, h: np.ndarray, z: np.ndarray) -> Rays:
        """The rays to points at distances h and depths z (at least a millionth)."""
        h, z = np.broadcast_arrays(np.abs(np.asarray(h, float)), np.maximum(np.abs(np.asarray(z, float)), 1e-6))
        flattest = 1 / self.velocity(z)
        turned = self.down(flattest, z)[0] < h
        low, high = np.where(turned, 1 / self.v[-1], 0.0), flattest.copy()
        for _ in range(STEPS):
            p = (low + high) / 2
            far = self._whole(p, z, turned)[0] > h
            # a direct ray goes farther the flatter it is, one that turns the steeper
            high, low = np.where(far != turned, p, high), np.where(far != turned, low, p)
        p = (low + high) / 2
        x, time = self._whole(p, z, turned)
        reached = np.abs(x - h) <= 1e-6 * (h + z)
        p, time = np.where(reached, p, np.nan), np.where(reached, time, np.nan)
        angle = np.arcsin(np.clip(p * self.v[0], -1, 1))
        spreading = np.hypot(h, z) * np.sqrt(self.velocity(z) / self.v[0]) / np.maximum(np.cos(angle), LEAST_COSINE)
        with np.errstate(divide="ignore", invalid="ignore"):
            turning = np.where(p > 0, self.depth_of(1 / p), np.where(np.isnan(p), np.nan, np.inf))
        return Rays(p, angle, turning, time, spreading)
