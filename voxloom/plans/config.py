"""Defaults of the whole analysis, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Acquisition:
    tr: float = 2.0
    slices: int = 36
    pixels: int = 64
    dummies: int = 6
    reference_slice: int = 0
    #: Milliseconds; two halves that are acquired together.
    slice_times: tuple[float, ...] = tuple(1870.0 * k / 17 for k in range(18)) * 2

    def __post_init__(self):
        if self.tr <= 0 or self.slices < 1 or self.dummies < 0:
            raise ValueError("tr and slices must be positive, dummies not negative")
        if len(self.slice_times) != self.slices or not 0 <= self.reference_slice < self.slices:
            raise ValueError("one time per slice, and the reference among them")
        if max(self.slice_times) >= 1000 * self.tr:
            raise ValueError("slice times must lie within a scan")


@dataclass(frozen=True)
class FirstLevel:
    cutoff: float = 128.0
    ar1: bool = True
    mask_fraction: float = 0.5
    p: float = 0.05
    correction: str = "fdr"
    t_threshold: float = 3.0
    conditions: dict = field(default_factory=lambda: {"Task": ((0, 30, 60, 90, 120), (15,) * 5)})
    contrast: tuple[float, ...] = (1.0,)

    def __post_init__(self):
        if self.correction not in ("fdr", "fwe", "none"):
            raise ValueError("correction is fdr, fwe or none")
        if not 0 <= self.mask_fraction <= 1 or not 0 < self.p < 1:
            raise ValueError("mask_fraction and p are shares")
        for name, (onsets, durations) in self.conditions.items():
            if len(onsets) != len(durations) or any(d < 0 for d in durations):
                raise ValueError(f"condition {name}: one duration for each onset")
        if len(self.contrast) > len(self.conditions):
            raise ValueError("the contrast has more weights than conditions")


@dataclass(frozen=True)
class Spatial:
    fwhm: float = 6.0
    voxel: float = 3.0
    low: tuple[float, float, float] = (-90, -126, -72)
    high: tuple[float, float, float] = (90, 90, 108)
    classes: int = 3
    mrf_beta: float = 0.1

    def __post_init__(self):
        if self.fwhm < 0 or self.voxel <= 0 or any(a >= b for a, b in zip(self.low, self.high, strict=True)):
            raise ValueError("fwhm, voxel size and box must be positive")
