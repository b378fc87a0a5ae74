"""Presets and thresholds."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # fixed values: defaults of the calling method
    size_ratio: float = 0.8
    mismatch: float = 0.04
    min_support: int = 5
    min_mapq: int = 20
    min_size: int = 50
    max_size: int = 50_000
    max_coverage: int = 500
    tile: int = 10_000_000
    near: int = 1000
    merge_gap: int = 1000
    diff_freq: float = 0.3
    short_slack: int = 20
    vote: int = 5
    poly_bin: int = 200
    # switches
    skip_bnd: bool = False
    skip_nearby: bool = False
    skip_coverage_filter: bool = False
    rescue_large: bool = False
    rescue_uncovered: bool = True


# fixed values: what a read type changes
PRESETS = {
    "hifi": Params(),
    "error-prone": replace(Params(), size_ratio=0.7, mismatch=0.15),
    "asm": replace(Params(), size_ratio=0.6, mismatch=1.0, min_support=1, rescue_uncovered=False),
}
