"""Outlier detection and ranking for large tables, written with Spark DataFrames."""

from raritas.plans.detect import detect
from raritas.plans.rank import rank_attributes, rank_rows
from raritas.plans.settings import Settings, size_profile
from raritas.sources.tables import numeric_projection, read_table, string_projection, with_row_id

__all__ = [
    "Settings",
    "detect",
    "numeric_projection",
    "rank_attributes",
    "rank_rows",
    "read_table",
    "size_profile",
    "string_projection",
    "with_row_id",
]
