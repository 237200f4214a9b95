"""Configurations of imaging jobs: validated, as JSON, from templates."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession

from strataflow.operators import binning, imaging


@dataclasses.dataclass(frozen=True)
class ImagingJob:
    name: str
    input_path: str
    output_path: str
    velocity: float = 2500.0
    time_max_ms: float = 4000.0
    dt_ms: float = 4.0
    origin: tuple[float, float] = (0.0, 0.0)
    spacing: tuple[float, float] = (25.0, 25.0)
    shape: tuple[int, int] = (100, 100)
    aperture_m: float = 3000.0
    max_angle_deg: float = 60.0
    binning: str = "full_stack"
    min_fold: int = 1

    def problems(self) -> list[str]:
        """What is wrong; empty if nothing."""
        positive = ("velocity", "time_max_ms", "dt_ms", "aperture_m", "min_fold")
        out = [f"{n} must be positive" for n in positive if getattr(self, n) <= 0]
        out += ["spacing and shape must be positive"] * (min(*self.spacing, *self.shape) <= 0)
        out += ["max_angle_deg must lie between 0 and 90"] * (not 0 < self.max_angle_deg < 90)
        return out + [f"no {n}" for n in ("name", "input_path", "output_path") if not getattr(self, n)]

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), indent=2)

    @classmethod
    def from_json(cls, text: str) -> ImagingJob:
        values = json.loads(text)
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    def run(self, spark: SparkSession, traces: DataFrame) -> DataFrame:
        """(bin_name, il, xl, t_index, image, fold): an image for each offset bin of traces(tx, ty, offset, azimuth, samples)."""
        if found := self.problems():
            raise ValueError("; ".join(found))
        grid = imaging.Grid(self.origin, self.spacing, self.shape)
        out = None
        for b in binning.preset(self.binning):
            own = traces.where(binning.contains(traces["offset"], traces["azimuth"], b))
            image = imaging.migrate(own, grid, self.velocity, self.dt_ms / 1000, int(self.time_max_ms / self.dt_ms), self.aperture_m, self.max_angle_deg, self.min_fold)
            image = image.selectExpr(f"'{b.bin_name}' AS bin_name", "*")
            out = image if out is None else out.unionByName(image)
        return out


# Templates by survey.
TEMPLATES = {
    "land_3d": {"velocity": 3000.0, "binning": "land_3d"},
    "marine": {"velocity": 2000.0, "binning": "marine", "spacing": (12.5, 25.0)},
    "wide_azimuth": {"velocity": 2500.0, "binning": "wide_azimuth_ovt"},
    "full_stack": {"velocity": 2500.0, "binning": "full_stack"},
}


def from_template(template: str, name: str, input_path: str, output_path: str, **changes) -> ImagingJob:
    return ImagingJob(name, input_path, output_path, **(TEMPLATES[template] | changes))
