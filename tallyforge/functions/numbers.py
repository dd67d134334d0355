"""Scalar functions on amounts, dates, bits and boxes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tier(value: Column, steps: list[tuple[float, int]], falling: bool = True) -> Column:
    """Points of the first step that ``value`` is within (at most, or at least where not ``falling``); else 0."""
    out = F.lit(0)
    for bound, points in reversed(steps):
        out = F.when(value <= bound if falling else value >= bound, points).otherwise(out)
    return out


def day_difference(a: Column, b: Column) -> Column:
    """Whole days of 24 hours between two times, rounded towards the past, without sign."""
    seconds = F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    return F.abs(F.floor(seconds / F.lit(86_400_000_000.0)))


def minutes_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(60_000_000.0)


def formatted_amount(value: Column, style: Column, separator: Column) -> Column:
    """As a decimal with two places, in hundredths (``cents``) or ten-thousandths (``integer4dp``); empty for null.

    Halves are rounded away from zero.
    """
    exact = value.cast("decimal(18,4)")
    two = F.round(exact, 2).cast("decimal(18,2)").cast("string")
    text = (
        F.when(style == "cents", F.round(exact * 100, 0).cast("long").cast("string"))
        .when(style == "integer4dp", F.round(exact * 10000, 0).cast("long").cast("string"))
        .otherwise(F.when(separator == ",", F.replace(two, F.lit("."), F.lit(","))).otherwise(two))
    )
    return F.coalesce(text, F.lit(""))


def formatted_date(value: Column, style: Column) -> Column:
    """The day as DD.MM.YYYY, MM/DD/YYYY or else YYYY-MM-DD; empty for null."""
    text = (
        F.when(style == "DD.MM.YYYY", F.date_format(value, "dd.MM.yyyy"))
        .when(style == "MM/DD/YYYY", F.date_format(value, "MM/dd/yyyy"))
        .otherwise(F.date_format(value, "yyyy-MM-dd"))
    )
    return F.coalesce(text, F.lit(""))


def hash_bits(hexadecimal: Column) -> Column:
    """16 hexadecimal digits as a signed 64-bit number."""
    return F.conv(F.trim(hexadecimal), 16, -10).cast("long")


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(values: Column) -> Column:
    """One bit for each of 64 numbers: set where it is above zero, the first in the lowest place."""
    pairs = F.transform(values, lambda x, i: F.struct(i.alias("i"), (x > 0).alias("on")))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.when(p.on, F.call_function("shiftleft", F.lit(1).cast("long"), p.i)).otherwise(F.lit(0).cast("long"))))


def overlap(a: str, b: str) -> Column:
    """Area that two boxes (structs x, y, width, height) share."""
    side = lambda start, size: F.greatest(
        F.lit(0.0),
        F.least(F.col(f"{a}.{start}") + F.col(f"{a}.{size}"), F.col(f"{b}.{start}") + F.col(f"{b}.{size}"))
        - F.greatest(F.col(f"{a}.{start}"), F.col(f"{b}.{start}")),
    )
    return side("x", "width") * side("y", "height")


def area(a: str) -> Column:
    return F.col(f"{a}.width") * F.col(f"{a}.height")


def intersection_over_union(a: str, b: str) -> Column:
    shared = overlap(a, b)
    return F.when(shared == 0, 0.0).otherwise(shared / (area(a) + area(b) - shared))


def coverage(inner: str, outer: str) -> Column:
    """Share of ``inner`` that lies in ``outer``."""
    return F.when(area(inner) > 0, overlap(inner, outer) / area(inner)).otherwise(0.0)
