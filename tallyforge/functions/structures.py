"""Scalar functions on JSON, bytes, grids and boxes of images, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_objects(text: Column, schema: str) -> Column:
    """The objects of a JSON array, or a single object as an array of one; null where it is neither."""
    t = F.trim(text)
    as_array = F.from_json(t, f"array<{schema}>", {"mode": "PERMISSIVE"})
    as_one = F.from_json(t, schema, {"mode": "PERMISSIVE"})
    return F.when(t.startswith("["), as_array).when(t.startswith("{"), F.array(as_one))


def image_kind(content: Column) -> Column:
    """``jpeg``, ``png`` or ``webp`` by the first bytes, else null."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.rlike("^52494646.{8}57454250"), "webp")
    )


def difference_bits(grid: Column) -> Column:
    """64 bits from 8 rows of 9 grey values in one array: set where a value is larger than its right neighbour,
    the first in the highest place. Null for a grid of another size."""
    places = F.sequence(F.lit(0), F.lit(63))
    at = lambda i: F.element_at(grid, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int"))
    right = lambda i: F.element_at(grid, (F.floor(i / 8) * 9 + i % 8 + 2).cast("int"))
    bit = lambda i: F.when(at(i) > right(i), F.call_function("shiftleft", F.lit(1).cast("long"), (63 - i).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(grid) == 72, F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(bit(i))))


def clamped_box(top: Column, left: Column, bottom: Column, right: Column, edge: float = 1000.0) -> Column:
    """Corners in any order as a struct (x, y, width, height) within 0..edge; null where nothing is left."""
    hold = lambda c: F.least(F.lit(edge), F.greatest(F.lit(0.0), c.cast("double")))
    x, y = F.least(hold(left), hold(right)), F.least(hold(top), hold(bottom))
    width, height = F.abs(hold(right) - hold(left)), F.abs(hold(bottom) - hold(top))
    return F.when((width > 0) & (height > 0), F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height")))


def turn_back(degrees: Column, confidence: Column, least: float) -> Column:
    """Degrees that set an image upright; 0 where it is, or where the finding is not sure enough."""
    return F.when((degrees != 0) & (confidence >= least), (F.lit(360) - degrees) % 360).otherwise(0)


def day_time(day: Column, time: Column) -> Column:
    """A day and a time of day (midnight where there is none) as one moment; null where they are none."""
    return F.concat(day, F.lit(" "), F.coalesce(F.nullif(time, F.lit("")), F.lit("00:00:00"))).try_cast("timestamp_ntz")


def not_in_future(day: Column, now: Column) -> Column:
    """A day later than tomorrow with day and month exchanged, if that is not; else as it is. ``now`` is a day."""
    late = lambda d: d > F.date_add(now, 1)
    swapped = F.regexp_replace(day.cast("string"), r"^(\d{4})-(\d\d)-(\d\d)$", "$1-$3-$2").try_cast("date")
    return F.when(late(day) & swapped.isNotNull() & ~late(swapped), swapped).otherwise(day)


def is_json(text: Column) -> Column:
    """Whether a text is JSON; null for null."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull())


def processing_metadata(text: Column, layout: Column, region: Column, again: Column) -> Column:
    """What is recorded of a reading: whether a text was there, its length, layout and region with defaults, and one retry where ``again``."""
    return F.struct(
        text.isNotNull().alias("ocr_used"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_ocr"), F.coalesce(layout, F.lit("simple")).alias("layout"),
        F.coalesce(region, F.lit("eu")).alias("region"), F.when(again, 1).alias("retry_count"),
    )
