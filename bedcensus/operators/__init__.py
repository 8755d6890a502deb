from bedcensus.operators.adjust import (
    adjust_predictions,
    halve_error,
    shift_probability,
    symmetric_evaluation,
    symmetrise,
    tail_error_counts,
)
from bedcensus.operators.lookahead import (
    lookahead_daily,
    lookahead_error_histogram,
    lookahead_presence,
)
from bedcensus.operators.occupancy import (
    align_presence,
    daily_actual_distinct,
    daily_occupancy,
    daily_occupancy_by_side,
    presence_flags,
    presence_timeline,
)
from bedcensus.operators.reports import (
    bed_occupancy_series,
    histogram,
    los_error_histogram,
    occupancy_error_histogram,
    occupancy_error_series,
    occupancy_level_frequency,
)
from bedcensus.operators.stays import (
    actual_stay_days,
    actual_stay_days_old,
    predicted_stay_days,
    predicted_stay_days_old,
    rebase_admissions,
    stay_days,
)

__all__ = [
    "actual_stay_days",
    "actual_stay_days_old",
    "adjust_predictions",
    "align_presence",
    "bed_occupancy_series",
    "daily_actual_distinct",
    "daily_occupancy",
    "daily_occupancy_by_side",
    "halve_error",
    "histogram",
    "lookahead_daily",
    "lookahead_error_histogram",
    "lookahead_presence",
    "los_error_histogram",
    "occupancy_error_histogram",
    "occupancy_error_series",
    "occupancy_level_frequency",
    "predicted_stay_days",
    "predicted_stay_days_old",
    "presence_flags",
    "presence_timeline",
    "rebase_admissions",
    "shift_probability",
    "stay_days",
    "symmetric_evaluation",
    "symmetrise",
    "tail_error_counts",
]
