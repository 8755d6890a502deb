"""bedcensus: stay-occupancy analytics as Spark DataFrame jobs.

Given one row per stay (start, predicted length, actual length), the library
expands stays into days, aligns predicted with actual presence, and reports
daily occupancy, occupancy-error histograms and series, and a look-ahead
occupancy error, for four prediction variants (as given, error halved,
large errors mirrored until symmetric, and mirrored-then-halved).

Layout:
    sources/    readers for the two input tables, result CSV sink
    functions/  column expressions (rounding, day spans, reproducible uniform)
    operators/  DataFrame -> DataFrame operators, literal semantics
    plans/      O(stays) sweep forms, form selection, the variant job
"""

from bedcensus.config import (
    FIXTURE,
    REFERENCE,
    VARIANTS,
    DayWindow,
    Params,
    VariantConfig,
    variant_config,
)

__all__ = [
    "DayWindow",
    "Params",
    "VariantConfig",
    "FIXTURE",
    "REFERENCE",
    "VARIANTS",
    "variant_config",
]
