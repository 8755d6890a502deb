from bedcensus.plans.forms import (
    daily_occupancy_by_side_sweep,
    daily_occupancy_flags,
    daily_occupancy_sweep,
    daily_sweep,
    lookahead_counts_by_id,
    presence_flag_pass,
)
from bedcensus.plans.variant import FORMS, Inputs, Variant, keys_unique

__all__ = [
    "FORMS",
    "Inputs",
    "Variant",
    "daily_occupancy_by_side_sweep",
    "daily_occupancy_flags",
    "daily_occupancy_sweep",
    "daily_sweep",
    "keys_unique",
    "lookahead_counts_by_id",
    "presence_flag_pass",
]
