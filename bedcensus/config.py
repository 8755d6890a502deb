"""Parameters of the four prediction variants.

A variant is fully described by a :class:`VariantConfig`: which adjustment is
applied to the predictions, the closed day windows of the "new" and "old"
timelines (the old predicted upper bound differs by variant), which shape the
old-timeline occupancy table has, the focus year of the daily series, the
look-ahead distance and the constant inflow of the look-ahead error.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

ADJUSTMENTS = ("none", "halve", "symmetric", "symmetric_halve")
OLD_SHAPES = ("by_id", "by_side")


@dataclass(frozen=True)
class DayWindow:
    """Closed calendar window ``[lo, hi]``; both ends are counted."""

    lo: date
    hi: date

    def __post_init__(self) -> None:
        if self.lo > self.hi:
            raise ValueError(f"empty window {self.lo} .. {self.hi}")

    @property
    def n_days(self) -> int:
        return (self.hi - self.lo).days + 1


@dataclass(frozen=True)
class VariantConfig:
    name: str
    adjust: str
    new_window: DayWindow
    old_predicted_window: DayWindow
    old_actual_window: DayWindow
    old_shape: str
    year: int
    lookahead_days: int
    inflow: int
    error_threshold: int = 2

    def __post_init__(self) -> None:
        if self.adjust not in ADJUSTMENTS:
            raise ValueError(f"adjust must be one of {ADJUSTMENTS}")
        if self.old_shape not in OLD_SHAPES:
            raise ValueError(f"old_shape must be one of {OLD_SHAPES}")
        if self.lookahead_days < 0:
            raise ValueError("lookahead_days must be >= 0")


@dataclass(frozen=True)
class Params:
    """Dates and constants shared by the four variants of one data set."""

    new_window: DayWindow
    old_lo: date
    old_hi_actual: date
    # predicted upper bound of the old timeline, per variant
    old_hi_predicted: dict
    year: int
    lookahead_days: int = 3
    inflow: int = 92


# Variant name -> (adjustment, old-timeline occupancy shape).
VARIANTS = {
    "normal": ("none", "by_side"),
    "narrow": ("halve", "by_id"),
    "symmetric": ("symmetric", "by_id"),
    "symmetric_narrow": ("symmetric_halve", "by_id"),
}

# Fixed values of the original study: new window 1970-01-01 .. 1982-01-01,
# old window from 2110-01-11, old upper bound 2212-04-12 (predicted:
# normal 2212-04-12, narrow 2212-04-10, symmetric 2212-04-08,
# symmetric_narrow 2212-04-10), focus year 1972, look-ahead 3 days, inflow 92.
REFERENCE = Params(
    new_window=DayWindow(date(1970, 1, 1), date(1982, 1, 1)),
    old_lo=date(2110, 1, 11),
    old_hi_actual=date(2212, 4, 12),
    old_hi_predicted={
        "normal": date(2212, 4, 12),
        "narrow": date(2212, 4, 10),
        "symmetric": date(2212, 4, 8),
        "symmetric_narrow": date(2212, 4, 10),
    },
    year=1972,
)

# Fixed values for the test tables (dates shifted to fit them, same offsets):
# new window 1995-01-03 .. 2001-08-05, old window 2109-01-01 .. 2214-06-12
# (predicted: normal 2214-06-12, narrow 2214-06-10, symmetric 2214-06-08,
# symmetric_narrow 2214-06-10), focus year 1996, look-ahead 3 days, inflow 92.
FIXTURE = Params(
    new_window=DayWindow(date(1995, 1, 3), date(2001, 8, 5)),
    old_lo=date(2109, 1, 1),
    old_hi_actual=date(2214, 6, 12),
    old_hi_predicted={
        "normal": date(2214, 6, 12),
        "narrow": date(2214, 6, 10),
        "symmetric": date(2214, 6, 8),
        "symmetric_narrow": date(2214, 6, 10),
    },
    year=1996,
)


def variant_config(name: str, params: Params = FIXTURE, **overrides) -> VariantConfig:
    """The :class:`VariantConfig` of variant ``name`` under ``params``."""
    if name not in VARIANTS:
        raise KeyError(f"unknown variant {name!r}; expected one of {list(VARIANTS)}")
    adjust, shape = VARIANTS[name]
    cfg = VariantConfig(
        name=name,
        adjust=adjust,
        new_window=params.new_window,
        old_predicted_window=DayWindow(params.old_lo, params.old_hi_predicted[name]),
        old_actual_window=DayWindow(params.old_lo, params.old_hi_actual),
        old_shape=shape,
        year=params.year,
        lookahead_days=params.lookahead_days,
        inflow=params.inflow,
    )
    return replace(cfg, **overrides) if overrides else cfg
