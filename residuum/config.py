"""Typed settings of the tools; text files of settings are JSON and never run."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from residuum.functions import constants as K

SAMPLERS = ("uniform", "coverage", "spectrum", "lysine", "phospho")


@dataclass(frozen=True)
class TestSettings:
    """Settings of the structure and interface tests."""

    ttype: str | None = None
    classes: tuple[str, ...] = ("M",)
    sampler: str = "uniform"
    sample_weights: bool = True
    hill: tuple[float, float] | None = (2.0, 4.0)
    scales: tuple[float, ...] = K.SCALES
    max_draws: int = 10_000
    seed: int = 0

    def __post_init__(self) -> None:
        if self.sampler not in SAMPLERS:
            raise ValueError(f"unknown sampler: {self.sampler}")
        if self.sampler == "lysine" and set(self.classes) != {"A"}:
            raise ValueError("the lysine sampler is for acetylation sites")
        if self.sampler == "phospho" and set(self.classes) != {"P"}:
            raise ValueError("the phospho sampler is for phosphorylation sites")
        if self.max_draws < 1 or not self.scales or min(self.scales) <= 0:
            raise ValueError("draws and scales must be positive")

    @classmethod
    def from_json(cls, text: str) -> TestSettings:
        given, known = json.loads(text), {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
