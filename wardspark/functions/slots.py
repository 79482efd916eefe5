"""Whole-number slots of times and offsets."""

from pyspark.sql import Column, functions as F


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def slot(value: Column, width: int) -> Column:
    """floor(value / width) on whole numbers, also below zero."""
    width_col = F.lit(width).cast("long")
    return F.call_function("div", value - F.pmod(value, width_col), width_col)
