"""Tunable settings. The defaults are fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass


def _check_range(settings, low: float, high: float, names: list[str]) -> None:
    for name in names:
        value = getattr(settings, name)
        if not low <= value <= high:
            raise ValueError(f"{name}={value} is outside {low}..{high}")


@dataclass(frozen=True)
class Weights:
    """Share of each signal in the confidence, and how hard each penalty bites."""

    visual: float = 0.25
    semantic: float = 0.25
    spectral: float = 0.15
    spatial: float = 0.15
    quality: float = 0.08
    registration: float = 0.08
    sensor: float = 0.02
    seasonal: float = 0.02
    cloud_multiplier: float = 1.2
    shadow_multiplier: float = 0.8
    misalignment_multiplier: float = 1.5
    seasonal_veg_multiplier: float = 1.2

    def __post_init__(self) -> None:
        _check_range(self, 0.0, 1.0, ["visual", "semantic", "spectral", "spatial",
                                      "quality", "registration", "sensor", "seasonal"])
        _check_range(self, 0.0, 3.0, ["cloud_multiplier", "shadow_multiplier",
                                      "misalignment_multiplier", "seasonal_veg_multiplier"])


@dataclass(frozen=True)
class Thresholds:
    """Tier borders and the limits beyond which a change is suppressed."""

    high: float = 0.70
    medium: float = 0.45
    low: float = 0.25
    cloud_limit: float = 0.25
    registration_limit: float = 0.40
    seasonal_veg_limit: float = 0.60
    shadow_limit: float = 0.40

    def __post_init__(self) -> None:
        _check_range(self, 0.0, 1.0, list(self.__dataclass_fields__))


@dataclass(frozen=True)
class TilingConfig:
    """Window geometry for cutting scenes into tiles."""

    tile_size: int = 512
    overlap: int = 0
    min_valid: float = 0.3

    def __post_init__(self) -> None:
        _check_range(self, 64, 4096, ["tile_size"])
        _check_range(self, 0, 2048, ["overlap"])
        _check_range(self, 0.0, 1.0, ["min_valid"])

    @property
    def step(self) -> int:
        return self.tile_size - min(max(self.overlap, 0), self.tile_size - 16)
