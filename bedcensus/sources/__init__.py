from bedcensus.sources.layout import read_layout, within, write_bucketed, write_dated
from bedcensus.sources.results import read_result, write_result
from bedcensus.sources.tables import (
    ADMISSIONS_SCHEMA,
    EVALUATION_COLUMNS,
    EVALUATION_SCHEMA,
    admissions_from_evaluation,
    evaluation_from_orders,
    load_inputs,
    read_admissions,
    read_evaluation,
)

__all__ = [
    "ADMISSIONS_SCHEMA",
    "EVALUATION_COLUMNS",
    "EVALUATION_SCHEMA",
    "admissions_from_evaluation",
    "evaluation_from_orders",
    "load_inputs",
    "read_admissions",
    "read_evaluation",
    "read_layout",
    "read_result",
    "within",
    "write_bucketed",
    "write_dated",
    "write_result",
]
