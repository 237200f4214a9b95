"""Moveout, velocity, anisotropy, traveltimes, weights and antialiasing as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_VELOCITY, LEAST_RADIUS, LEAST_NMO_FACTOR = 100.0, 1.0, 0.01


def nmo_time(t0: Column, x: Column, v: Column) -> Column:
    return F.sqrt(t0 * t0 + (x / v) * (x / v))


def stretch(t0: Column, x: Column, v: Column) -> Column:
    """Moveout time over zero-offset time; null at zero."""
    return F.try_divide(nmo_time(t0, x, v), t0)


def vti_phase_velocity(v0: Column, theta: Column, epsilon: Column, delta: Column) -> Column:
    s, c = F.sin(theta), F.cos(theta)
    return v0 * (1 + delta * s * s * c * c + epsilon * s * s * s * s)


def vti_nmo_velocity(v0: Column, delta: Column) -> Column:
    return v0 * F.sqrt(F.greatest(1 + 2 * delta, F.lit(LEAST_NMO_FACTOR)))


def vti_horizontal_velocity(v0: Column, epsilon: Column) -> Column:
    return v0 * F.sqrt(F.greatest(1 + 2 * epsilon, F.lit(LEAST_NMO_FACTOR)))


def eta(epsilon: Column, delta: Column) -> Column:
    return (epsilon - delta) / F.greatest(1 + 2 * delta, F.lit(LEAST_NMO_FACTOR))


def straight_time(r: Column, v: Column) -> Column:
    return r / F.greatest(v, F.lit(LEAST_VELOCITY))


def curved_time(h: Column, z: Column, v0: float, k: float) -> Column:
    """Traveltime in v = v0 + k z; straight where k is next to nothing."""
    r2 = h * h + z * z
    if abs(k) < 1e-6:
        return F.sqrt(r2) / v0
    vz = v0 + k * z
    return F.acosh(1 + k * k * r2 / (2 * v0 * vz)) / abs(k)


def vti_time(h: Column, t0: Column, vn: Column, eta_: Column) -> Column:
    """Anelliptic moveout."""
    h2, t2, v2 = h * h, t0 * t0, vn * vn
    bend = F.try_divide(2 * eta_ * h2 * h2, v2 * (t2 * v2 + (1 + 2 * eta_) * h2))
    return F.sqrt(F.greatest(t2 + h2 / v2 - F.coalesce(bend, F.lit(0.0)), F.lit(0.0)))


def two_way_ms(rs: Column, rr: Column, v: Column) -> Column:
    return (rs + rr) / v * 1000


def image_weight(rs: Column, rr: Column, z: Column, hs: Column, hr: Column, aperture: float, max_angle: float) -> Column:
    """cos(source ray) cos(receiver ray) / (rs rr), zero unless both rays lie strictly within aperture and angle."""
    t = math.tan(math.radians(max_angle))
    inside = (hs < aperture) & (hr < aperture) & (hs < z * t) & (hr < z * t)
    return F.when(inside, (z / rs) * (z / rr) / (rs * rr + 1e-6)).otherwise(0.0)


def amplitude_weight(mode: str, rs: Column, rr: Column, z: Column, v: Column) -> Column:
    """none, spreading (1 / (v rs rr)), obliquity (mean cosine), or full (their product)."""
    rs, rr, v = F.greatest(rs, F.lit(LEAST_RADIUS)), F.greatest(rr, F.lit(LEAST_RADIUS)), F.greatest(v, F.lit(LEAST_VELOCITY))
    spreading, obliquity = 1 / (rs * rr * v), (z / rs + z / rr) / 2
    return {"none": F.lit(1.0), "spreading": spreading, "obliquity": obliquity, "full": spreading * obliquity}[mode]


def taper(x: Column, most: float, width: float) -> Column:
    """1, falling as half a cosine to 0 over the last width (a share) before most."""
    inner = most * (1 - width)
    ramp = 0.5 * (1 + F.cos(F.lit(math.pi) * (x - inner) / (most - inner)))
    return F.when(x <= inner, 1.0).when(x >= most, 0.0).otherwise(ramp)


def alias_frequency(v: Column, dip: Column, dx: float, nyquist: float) -> Column:
    """Frequency beyond which a dip is aliased at spacing dx, at most Nyquist."""
    return F.least(F.coalesce(F.try_divide(v, 2 * dx * F.abs(F.sin(dip))), F.lit(nyquist)), F.lit(nyquist))


def antialias_weight(method: str, fa: Column, f_max: float, width: float = 0.1) -> Column:
    r = fa / f_max
    if method == "triangle":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), r))
    if method == "sinc":
        s = F.sin(F.lit(math.pi / 2) * F.least(r, F.lit(1.0)))
        return s * s
    low, high = f_max * (1 - width), f_max * (1 + width)
    return F.when(fa <= low, 0.0).when(fa >= high, 1.0).otherwise(0.5 * (1 - F.cos(F.lit(math.pi) * (fa - low) / (high - low))))


def vti_time_exact(h: Column, z: Column, v0: Column, epsilon: Column, delta: Column) -> Column:
    """Distance over the phase velocity at the ray's angle."""
    z = F.greatest(F.abs(z), F.lit(1e-6))
    return F.hypot(h, z) / vti_phase_velocity(v0, F.atan2(h, z), epsilon, delta)


def vti_time_weak(h: Column, z: Column, v0: Column, epsilon: Column, delta: Column) -> Column:
    """First-order correction: the velocity goes with the root of the phase velocity's factor, 0.1 at least."""
    z = F.greatest(F.abs(z), F.lit(1e-6))
    factor = vti_phase_velocity(F.lit(1.0), F.atan2(h, z), epsilon, delta)
    return F.hypot(h, z) / (v0 * F.sqrt(F.greatest(factor, F.lit(0.1))))


def true_amplitude_weight(rs: Column, rr: Column, angle_s: Column, angle_r: Column, v: Column) -> Column:
    """Spreading and obliquity with the 2.5-D Jacobian, one over the cosine of the mean angle."""
    rs, rr, v = F.greatest(rs, F.lit(LEAST_RADIUS)), F.greatest(rr, F.lit(LEAST_RADIUS)), F.greatest(v, F.lit(LEAST_VELOCITY))
    return F.cos(angle_s) * F.cos(angle_r) / (rs * rr * v) / F.greatest(F.cos((angle_s + angle_r) / 2), F.lit(0.1))


def effective_aperture(z: Column, most: float, max_angle: float) -> Column:
    """What the angle allows at depth z, at most the aperture."""
    return F.least(F.abs(z) * math.tan(math.radians(max_angle)), F.lit(float(most)))


def aperture_weight(hs: Column, hr: Column, z: Column, offset: Column, most: float, max_angle: float, offsets: tuple[float, float] = (0.0, 10000.0), width: float = 0.1) -> Column:
    """Product of cosine tapers by distance and angle of both rays; 0 outside the offsets."""
    out = F.when(offset.between(*offsets), 1.0).otherwise(0.0)
    for h in (hs, hr):
        out = out * taper(h, most, width) * taper(F.degrees(F.atan2(h, F.greatest(z, F.lit(1e-6)))), max_angle, width)
    return out
