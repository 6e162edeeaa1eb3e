"""Conversions of levels: named ones, or any SQL expression in x."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONVERSIONS = {
    "identity": "x",
    "fahrenheit_to_celsius": "(x - 32) * 5 / 9",
    "mgdl_to_mmoll": "x / 18.0182",
    "hundredth": "x * 0.01",
    "minutes_to_days": "x / (24 * 60)",
    "seconds_to_days": "x / (24 * 60 * 60)",
}


def convert(column: str, conversion: str) -> Column:
    """``column`` under a named conversion or an expression in x; what is not finite is null."""
    expression = CONVERSIONS.get(conversion.strip(), conversion.strip()) or "x"
    x = f"`{column}`"
    value = F.expr(f"element_at(transform(array(cast({x} as double)), x -> cast({expression} as double)), 1)")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
