"""Velocity cones of frequency and two wavenumbers: their parameters, presets, weights and edges, in NumPy."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

import numpy as np


@dataclass(frozen=True)
class Cone:
    """Apparent velocities f / |k| between v_min and v_max to reject or to pass.

    taper: the edges' share of each velocity, over which weights follow a cosine. Azimuths, 0 along x, may
    wrap; only those within are filtered. Frequencies outside f_min to f_max stay. agc_ms: gain control
    before the filter, taken off after it. pad_ms: copies of the first and last sample before and after
    each trace, tapered to zero. edges: "taper" puts copies of edge traces, tapered to zero, around the volume
    (pad_traces of them, 0: by the volume's size), "repeat" plain copies, corners and samples too, "none" nothing. The
    volume is then filled with zeros to powers of two, of at least factor times its sizes; with exact it isn't.
    """

    v_min: float = 200.0
    v_max: float = 1500.0
    mode: str = "reject"
    taper: float = 0.1
    azimuth_min: float = 0.0
    azimuth_max: float = 360.0
    f_min: float | None = None
    f_max: float | None = None
    agc_ms: float | None = None
    pad_ms: tuple[float, float] = (0.0, 0.0)
    edges: str = "taper"
    pad_traces: tuple[int, int] = (0, 0)
    factor: float = 1.0
    exact: bool = False

    def __post_init__(self) -> None:
        right = {
            "0 < v_min < v_max": 0 < self.v_min < self.v_max,
            "mode is reject or pass": self.mode in ("reject", "pass"),
            "taper is within 0 and 0.5": 0 <= self.taper <= 0.5,
            "azimuths are within 0 and 360": all(0 <= a <= 360 for a in (self.azimuth_min, self.azimuth_max)),
            "0 <= f_min < f_max": (self.f_min or 0) >= 0 and (self.f_max is None or self.f_max > (self.f_min or 0)),
            "agc_ms is positive": self.agc_ms is None or self.agc_ms > 0,
            "edges are taper, repeat or none": self.edges in ("taper", "repeat", "none"),
            "padding isn't negative": min(*self.pad_ms, *self.pad_traces) >= 0 and self.factor >= 1,
        }
        if wrong := [k for k, v in right.items() if not v]:
            raise ValueError(f"a cone must satisfy: {'; '.join(wrong)}")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Cone:
        """Unknown keys are passed over."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items() if k in known})

    def samples(self, dt: float) -> tuple[int, int]:
        return tuple(int(ms / 1000.0 / dt + 1e-9) for ms in self.pad_ms)

    def traces(self, nx: int, ny: int) -> tuple[int, int]:
        """Copies of edge traces to each side in x and y."""
        if self.edges == "none":
            return 0, 0
        return tuple(p or (0 if self.edges == "repeat" else automatic(n)) for p, n in zip(self.pad_traces, (nx, ny), strict=True))

    def length(self, n: int) -> int:
        """What n samples or traces are filled up to."""
        return n if self.exact else 1 << max(0, int(max(n, int(n * self.factor))) - 1).bit_length()


#: Presets of common use.
PRESETS = {
    "Ground Roll Rejection": Cone(v_min=100.0, v_max=800.0, taper=0.15, mode="reject"),
    "Linear Noise Rejection": Cone(v_min=200.0, v_max=1200.0, taper=0.1, mode="reject"),
    "Reflection Pass": Cone(v_min=1500.0, v_max=6000.0, taper=0.1, mode="pass"),
    "Low Velocity Rejection": Cone(v_min=50.0, v_max=500.0, taper=0.2, mode="reject"),
}


def preset(name: str, **changes) -> Cone:
    if name not in PRESETS:
        raise KeyError(f"{name} is none of {', '.join(PRESETS)}")
    return replace(PRESETS[name], **changes)


def automatic(n: int) -> int:
    """Copies of edge traces for so many traces (fixed values): a half of few, a fifth, a tenth of many, from 5 to 30."""
    return min(30, max(5, n // 2 if n <= 20 else n // 5 if n <= 50 else n // 10))


def falling(n: int) -> np.ndarray:
    """A cosine from 1 towards 0 in n steps."""
    return 0.5 * (1 + np.cos(np.pi * np.arange(n) / max(1, n)))


def weights(f: np.ndarray, kx: np.ndarray, ky: np.ndarray, cone: Cone) -> np.ndarray:
    """Weights of frequencies f (one axis) by kx and ky, as an array of (f, kx, ky). f = 0 and k = 0 stay."""
    k = np.hypot(kx[:, None], ky[None, :])[None]
    v = np.abs(f)[:, None, None] / np.maximum(k, 1e-10)
    ramp = lambda edge: 0.5 * (1 - np.cos(np.pi * np.clip((v - edge * (1 - cone.taper)) / (2 * cone.taper * edge), 0, 1)))
    inside = ramp(cone.v_min) * (1 - ramp(cone.v_max)) if cone.taper else ((v >= cone.v_min) & (v <= cone.v_max)).astype(float)
    if (cone.azimuth_min, cone.azimuth_max) != (0.0, 360.0):
        a = (np.degrees(np.arctan2(ky[None, :], kx[:, None])) % 360.0)[None]
        within = (a >= cone.azimuth_min) & (a <= cone.azimuth_max) if cone.azimuth_min <= cone.azimuth_max else (a >= cone.azimuth_min) | (a <= cone.azimuth_max)
        inside = inside * within
    w = 1 - inside if cone.mode == "reject" else inside
    high = np.inf if cone.f_max is None else cone.f_max
    w[(np.abs(f) < (cone.f_min or 0)) | (np.abs(f) > high) | (f == 0)] = 1
    w[np.broadcast_to(k == 0, w.shape)] = 1
    return w
