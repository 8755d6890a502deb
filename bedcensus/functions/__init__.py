from bedcensus.functions.columns import (
    clip_end,
    clip_start,
    day_span,
    discharge_day,
    los_error,
    rounded,
    uniform01,
)

__all__ = ["clip_end", "clip_start", "day_span", "discharge_day", "los_error", "rounded", "uniform01"]
