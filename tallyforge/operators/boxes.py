"""Bounding boxes per image: overlaps, clean-up and ordered merging.

Boxes are in long form (image_id, box_no, x, y, width, height[, rotation, confidence]). Pairwise
work is a self-join on the image; the ordered folds run over the boxes of one image, of
which a detector returns few.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import coverage, intersection_over_union

# fixed values: smallest area in thousandths squared; covered share and number of boxes that make a
# container; covered share and relative size that make a part of another box
MIN_AREA, CONTAINS, CONTAINED, INSIDE, SMALLER = 10_000, 0.60, 2, 0.80, 0.70
# fixed value: largest share of the image that a detected box may hold
LARGEST = 0.70


def box_pairs(boxes: DataFrame) -> DataFrame:
    """(image_id, box_a, box_b, iou, cover_ab, cover_ba) for pairs that overlap, box_a < box_b."""
    a, b = boxes.alias("a"), boxes.alias("b")
    return (
        a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.box_no") < F.col("b.box_no")))
        .select(
            F.col("a.image_id").alias("image_id"), F.col("a.box_no").alias("box_a"), F.col("b.box_no").alias("box_b"),
            intersection_over_union("a", "b").alias("iou"), coverage("a", "b").alias("cover_ab"), coverage("b", "a").alias("cover_ba"),
        )
        .where("iou > 0")
    )


def _shared(a: Column, b: Column) -> Column:
    """Area that two boxes, as structs, share."""
    side = lambda at, size: F.greatest(F.lit(0.0), F.least(a[at] + a[size], b[at] + b[size]) - F.greatest(a[at], b[at]))
    return side("x", "width") * side("y", "height")


def _covered(inner: Column, outer: Column, share: float) -> Column:
    area = inner["width"] * inner["height"]
    return (area > 0) & (_shared(inner, outer) >= share * area)


def plausible_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes left after dropping tiny ones, containers of two or more, and parts of a larger box.

    An image with a single box keeps it; so does one that a step leaves a single box. The boxes of an
    image, which a detector returns few of, are compared in one row.
    """
    rest = [c for c in boxes.columns if c != "image_id"]
    listed = boxes.groupBy("image_id").agg(F.collect_list(F.struct(*rest)).alias("b"))
    area = lambda x: x["width"] * x["height"]
    other = lambda x, y: x["box_no"] != y["box_no"]
    large = listed.select("image_id", F.when(F.size("b") == 1, F.col("b")).otherwise(F.filter("b", lambda x: area(x) >= MIN_AREA)).alias("b"))
    holds = lambda x: F.size(F.filter(F.col("b"), lambda y: other(x, y) & _covered(y, x, CONTAINS))) >= CONTAINED
    single = large.select("image_id", F.filter("b", lambda x: ~holds(x)).alias("b"))
    part = lambda x: F.exists(F.col("b"), lambda y: other(x, y) & _covered(x, y, INSIDE) & (area(x) < area(y) * SMALLER))
    return single.select("image_id", F.inline(F.filter("b", lambda x: ~part(x)))).select(*boxes.columns)


def from_corners(corners: DataFrame, image_width: int, image_height: int, largest: float = LARGEST) -> DataFrame:
    """Boxes in thousandths of the image, as whole numbers, from corners in pixels (image_id, box_no, confidence, x1, y1, x2, y2).

    Corners are held within the image; boxes under a pixel wide or high fall away, as do those with
    more than ``largest`` of the image.
    """
    hold = lambda c, edge: F.least(F.lit(float(edge)), F.greatest(F.lit(0.0), F.col(c)))
    held = corners.select("image_id", "box_no", "confidence", *(hold(c, image_width).alias(c) for c in ("x1", "x2")), *(hold(c, image_height).alias(c) for c in ("y1", "y2")))
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    kept = held.where((width >= 1) & (height >= 1) & (width * height / float(image_width * image_height) <= largest))
    whole = lambda v, edge: F.rint(v / edge * 1000).cast("int")
    return kept.select(
        "image_id", "box_no", "confidence", whole(F.col("x1"), image_width).alias("x"), whole(F.col("y1"), image_height).alias("y"),
        whole(width, image_width).alias("width"), whole(height, image_height).alias("height"), F.lit(0.0).alias("rotation"),
    )


def majority_orientation(boxes: DataFrame) -> DataFrame:
    """Where an image has three boxes or more and one orientation is twice as common, the boxes that have it.

    A square counts as landscape. In reading order (y, x) within the image: ``place``.
    """
    landscape = F.col("width") >= F.col("height")
    c = boxes.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(landscape).alias("wide"))
    tall = F.col("n") - F.col("wide")
    keep = F.when(F.col("n") < 3, True).when(F.col("wide") >= 2 * tall, landscape).when(tall >= 2 * F.col("wide"), ~landscape).otherwise(True)
    order = F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x", "box_no"))
    return boxes.join(c, "image_id").where(keep).drop("n", "wide").withColumn("place", order)


def pixel_crops(boxes: DataFrame, image_width: int, image_height: int, padding: float = 0.05) -> DataFrame:
    """Boxes in thousandths of the image as padded pixel rectangles, held within the image; empty ones are left out."""
    left = F.greatest(F.lit(0.0), F.floor((F.col("x") - F.col("width") * padding) / 1000 * image_width).cast("double"))
    top = F.greatest(F.lit(0.0), F.floor((F.col("y") - F.col("height") * padding) / 1000 * image_height).cast("double"))
    right = F.least(F.lit(float(image_width)), F.ceil((F.col("x") + F.col("width") * (1 + padding)) / 1000 * image_width).cast("double"))
    bottom = F.least(F.lit(float(image_height)), F.ceil((F.col("y") + F.col("height") * (1 + padding)) / 1000 * image_height).cast("double"))
    return boxes.select(
        "image_id", "box_no", left.alias("left"), top.alias("top"), (right - left).alias("crop_width"), (bottom - top).alias("crop_height")
    ).where("crop_width > 0 AND crop_height > 0")


def suppressed(boxes: DataFrame, most: float = 0.5) -> DataFrame:
    """Non-maximum suppression: by falling confidence, boxes whose overlap with every box kept so far is at most ``most``.

    Ties go by box_no. One left fold over the boxes of an image, in the JVM.
    """
    listed = boxes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "box_no", "x", "y", "width", "height"))).alias("boxes"))
    fold = F.expr(
        f"""aggregate(boxes, slice(boxes, 1, 0), (kept, b) -> CASE WHEN forall(kept, k ->
              greatest(0D, least(b.x + b.width, k.x + k.width) - greatest(b.x, k.x)) * greatest(0D, least(b.y + b.height, k.y + k.height) - greatest(b.y, k.y))
              <= {most} * (b.width * b.height + k.width * k.height
              - greatest(0D, least(b.x + b.width, k.x + k.width) - greatest(b.x, k.x)) * greatest(0D, least(b.y + b.height, k.y + k.height) - greatest(b.y, k.y))))
            THEN concat(kept, array(b)) ELSE kept END)"""
    )
    return listed.select("image_id", F.inline(fold)).select("image_id", "box_no", "x", "y", "width", "height", (-F.col("c")).alias("confidence"))


def _merge_in_order(rows: list[list[float]], more_than: float) -> list[tuple]:
    """The boxes [box_no, x, y, width, height, rotation] of one image, merged."""
    out = []
    while rows:
        number, x, y, w, h, turn = rows[0]
        later = []
        for r in rows[1:]:
            _, x2, y2, w2, h2, turn2 = r
            shared = max(0.0, min(x + w, x2 + w2) - max(x, x2)) * max(0.0, min(y + h, y2 + h2) - max(y, y2))
            if shared and shared / (w * h + w2 * h2 - shared) > more_than:
                right, low = max(x + w, x2 + w2), max(y + h, y2 + h2)
                x, y = min(x, x2), min(y, y2)
                w, h, turn = right - x, low - y, (turn + turn2) / 2
            else:
                later.append(r)
        out.append((int(number), x, y, w, h, turn))
        rows = later
    return out


def merged(boxes: DataFrame, more_than: float = 0.3) -> DataFrame:
    """Overlapping boxes of an image merged in order: each box takes later ones that overlap what it has become.

    The result depends on the order (box_no), so the boxes of an image, which a detector returns few
    of, are folded together; images go through Python in Arrow batches.
    """
    listed = boxes.groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.array(F.col("box_no").cast("double"), "x", "y", "width", "height", F.coalesce("rotation", F.lit(0.0))))).alias("boxes")
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(image, *m) for image, of_image in zip(b["image_id"], b["boxes"]) for m in _merge_in_order([list(map(float, r)) for r in of_image], more_than)]
            yield pd.DataFrame(rows, columns=["image_id", "box_no", "x", "y", "width", "height", "rotation"])

    return listed.mapInPandas(fold, "image_id long, box_no int, x double, y double, width double, height double, rotation double")
