from .columns import (
    band,
    hash_key,
    hash_number,
    label_nulls,
    month_of,
    ratio,
    row_as_json,
    whole_days,
    within_years,
    year_of,
)

__all__ = [
    "band", "hash_key", "hash_number", "label_nulls", "month_of", "ratio", "row_as_json",
    "whole_days", "within_years", "year_of",
]
