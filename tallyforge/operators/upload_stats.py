"""Statistics of uploads and their receipts: conditional aggregates over a left join.

Receipts are aggregated per upload before the join, so the join moves one row an upload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import url_file_name

SORTABLE = {"createdAt": "created_at", "updatedAt": "updated_at", "status": "status"}


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def receipt_counters(receipts: DataFrame, deleted_too: bool = False) -> DataFrame:
    """Counters of each upload's receipts; of those not deleted unless ``deleted_too``.

    An upload without receipts has no row here. Nulls in a tested column count for nothing.
    """
    live = F.lit(True) if deleted_too else F.col("deleted_at").isNull()
    status = F.col("status")
    currency = F.when(live, F.col("currency"))
    return receipts.where(F.col("upload_id").isNotNull()).groupBy("upload_id").agg(
        count_where(live).alias("total_receipts"),
        count_where(live & (status == "processed")).alias("successful"),
        count_where(live & status.isin("failed", "unreadable")).alias("failed"),
        count_where(live & (status == "pending")).alias("processing"),
        count_where(live & (F.col("review_status") == "needs_review")).alias("needs_review"),
        count_where(live & F.col("edited_at").isNotNull()).alias("edited"),
        count_where(live & (status == "rate_limited")).alias("rate_limited"),
        count_where(F.col("deleted_at").isNotNull()).alias("deleted"),
        F.coalesce(F.sum(F.when(live, F.col("total_amount"))), F.lit(0)).cast("decimal(23,4)").alias("total_value"),
        F.count_distinct(currency).alias("n_currencies"),
        F.min(currency).alias("first_currency"),
    )


def upload_statistics(uploads: DataFrame, receipts: DataFrame, empty_counts_one: bool = True) -> DataFrame:
    """One row an upload with its counters.

    ``empty_counts_one``: an upload without receipts shows a total of 1, as the null row of a left
    join does when only deleted rows are ruled out; else 0.
    """
    c = receipt_counters(receipts)
    counters = ["successful", "failed", "processing", "needs_review", "edited", "rate_limited"]
    joined = uploads.join(c, uploads.id == c.upload_id, "left")
    return joined.select(
        F.col("id").alias("upload_id"), "user_id", "upload_number",
        F.coalesce(F.nullif(F.col("original_file_name"), F.lit("")), url_file_name(F.col("original_image_url"))).alias("file_name"),
        uploads.status.alias("status"),
        F.coalesce(F.col("has_receipts") == 1, F.lit(False)).alias("has_receipts"),
        "created_at", "updated_at",
        F.coalesce("total_receipts", F.lit(1 if empty_counts_one else 0)).cast("long").alias("total_receipts"),
        *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in counters),
        F.coalesce("total_value", F.lit(0)).cast("decimal(23,4)").alias("total_value"),
        F.when(F.col("n_currencies") == 1, F.col("first_currency")).alias("currency"),
        F.coalesce(F.col("n_currencies") > 1, F.lit(False)).alias("mixed_currencies"),
    )


# fixed values: states by which a page can be narrowed
STATUSES = ("processing", "completed", "partly_completed", "failed", "duplicate")


def page(
    statistics: DataFrame, limit: int | None = 50, offset: int = 0, sort_by: str = "createdAt", descending: bool = True, status: str | None = None
) -> DataFrame:
    """The same page of every user's uploads, with the user's ``total`` and ``has_more``.

    With a known ``status`` only uploads of that state are shown and counted; an unknown one is passed over.

    ``limit`` is held within 1..100, ``offset`` at 0 or more, an unknown column sorts by created_at;
    ties go by upload_id.
    """
    limit, offset = min(max(limit or 50, 1), 100), max(offset, 0)
    statistics = statistics.where(F.col("status") == status) if status in STATUSES else statistics
    by = F.col(SORTABLE.get(sort_by, "created_at"))
    order = [by.desc() if descending else by.asc(), F.col("upload_id")]
    mine = Window.partitionBy("user_id")
    placed = statistics.withColumn("place", F.row_number().over(mine.orderBy(*order))).where(F.col("place") <= offset + limit)
    totals = statistics.groupBy("user_id").agg(F.count("*").alias("total"))
    return (
        placed.where(F.col("place") > offset)
        .join(totals, placed.user_id.eqNullSafe(totals.user_id))
        .drop(totals.user_id)
        .withColumn("has_more", F.col("total") > offset + limit)
    )


def export_statistics(uploads: DataFrame, receipts: DataFrame) -> DataFrame:
    """Counters of the export: deleted receipts count, an upload without receipts has 0, the file name is the URL's."""
    c = receipt_counters(receipts, deleted_too=True)
    return uploads.join(c, uploads.id == c.upload_id, "left").select(
        F.col("id").alias("upload_id"), "user_id", url_file_name(F.col("original_image_url")).alias("file_name"), uploads.status.alias("status"),
        *(F.coalesce(k, F.lit(0)).cast("long").alias(n) for k, n in (("total_receipts", "total_detected"), ("successful", "successful"), ("failed", "failed"), ("processing", "processing"))),
        "created_at", "updated_at",
    )


#: Ids of a bucket in which rows are numbered together.
NUMBER_SPAN = 50_000


def numbered(rows: DataFrame, group: str, order: str, span: int = NUMBER_SPAN) -> DataFrame:
    """``rows`` with ``number``: 1, 2, ... within each group in order of the id ``order``.

    In two steps: rows are numbered within buckets of ids, and the counts of a group's buckets are
    summed up before each; so the rows of one group are never in one task, however many they are.
    """
    bucket = F.floor(F.col(order) / span)
    placed = rows.withColumn("bucket", bucket).withColumn("local", F.row_number().over(Window.partitionBy(group, "bucket").orderBy(order)))
    counts = rows.groupBy(F.col(group).alias("g"), bucket.alias("b")).agg(F.count("*").alias("n"))
    counts = counts.select("g", "b", F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return (
        placed.join(counts, F.col(group).eqNullSafe(F.col("g")) & F.col("bucket").eqNullSafe(F.col("b")))
        .withColumn("number", (F.col("before") + F.col("local")).cast("int"))
        .drop("g", "b", "before", "local", "bucket")
    )


def receipt_numbers(uploads: DataFrame, receipts: DataFrame) -> DataFrame:
    """(receipt_id, user_id, number): receipts of each user numbered by id."""
    owned = receipts.select(F.col("id").alias("receipt_id"), "upload_id").join(uploads.select(F.col("id").alias("upload_id"), "user_id"), "upload_id")
    return numbered(owned.select("receipt_id", "user_id"), "user_id", "receipt_id")


def next_numbers(users: DataFrame, uploads: DataFrame) -> DataFrame:
    """(user_id, next_number): one more than the user's largest upload number; 1 without uploads."""
    largest = uploads.groupBy(F.col("user_id").alias("owner")).agg(F.max("upload_number").alias("n"))
    return users.join(largest, users.id == F.col("owner"), "left").select(
        F.col("id").alias("user_id"), (F.coalesce("n", F.lit(0)) + 1).alias("next_number")
    )


def numbered_inserts(new_rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``new_rows`` (user_id, id) with upload_number going on from each user's largest, in order of id."""
    largest = existing.groupBy(F.col("user_id").alias("owner")).agg(F.max("upload_number").alias("n"))
    return numbered(new_rows.select("id", "user_id"), "user_id", "id").join(largest, F.col("user_id") == F.col("owner"), "left").select(
        "id", "user_id", (F.coalesce("n", F.lit(0)) + F.col("number")).alias("upload_number")
    )


def majority_category(line_items: DataFrame, ignored: tuple[str, ...] = ("discount", "tax")) -> DataFrame:
    """(receipt_id, category, n): the category of most lines of a receipt; of equals the first met."""
    counted = (
        line_items.where(F.col("category").isNotNull() & (F.col("category") != "") & ~F.col("item_type").isin(*ignored) & F.col("receipt_id").isNotNull())
        .groupBy("receipt_id", "category")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    )
    return counted.groupBy("receipt_id").agg(
        F.max_by("category", F.struct("n", -F.col("first_id"))).alias("category"), F.max("n").alias("n")
    )


def sum_check(receipts: DataFrame, line_items: DataFrame) -> DataFrame:
    """(receipt_id, n_items, line_sum, apart): sum of a receipt's lines (null is 0) and its distance from the total."""
    sums = line_items.where(F.col("receipt_id").isNotNull()).groupBy("receipt_id").agg(
        F.count("*").alias("n_items"), F.sum(F.coalesce("total_price", F.lit(0))).cast("decimal(23,4)").alias("line_sum"),
        F.coalesce(F.avg(F.col("confidence").cast("double")), F.lit(0.0)).alias("mean_confidence"),
    )
    return receipts.join(sums, receipts.id == sums.receipt_id, "left").select(
        F.col("id").alias("receipt_id"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("line_sum", F.lit(0)).cast("decimal(23,4)").alias("line_sum"),
        F.abs(F.coalesce("line_sum", F.lit(0)) - F.col("total_amount")).cast("decimal(23,4)").alias("apart"), F.coalesce("mean_confidence", F.lit(0.0)).alias("mean_confidence"),
    )


def all_states(receipts: DataFrame) -> DataFrame:
    """(upload_id, all_processed, any_live): whether all receipts, and all that are not deleted, are processed."""
    done = F.coalesce(F.col("status") == "processed", F.lit(False))
    live = F.col("deleted_at").isNull()
    return receipts.where("upload_id IS NOT NULL").groupBy("upload_id").agg(
        F.bool_and(done).alias("all_processed"), F.coalesce(F.bool_and(F.when(live, done)), F.lit(True)).alias("all_live_processed")
    )


def line_flags(line_items: DataFrame, flag: str = "ocr_mismatch", least: int = 3) -> DataFrame:
    """(receipt_id, n_products, n_flagged, ratio, unreliable, has_discount): flagged products of each receipt.

    ``unreliable``: with ``least`` products or more, four fifths or more are flagged.
    """
    product = F.col("item_type") == "product"
    counted = line_items.where("receipt_id IS NOT NULL").groupBy("receipt_id").agg(
        F.count_if(product).alias("n_products"),
        F.count_if(product & (F.col("extraction_flag") == flag)).alias("n_flagged"),
        F.bool_or(F.coalesce(F.col("item_type").isin("discount", "refund"), F.lit(False))).alias("has_discount"),
    )
    ratio = F.when(F.col("n_products") > 0, F.round(F.col("n_flagged") / F.col("n_products"), 6)).otherwise(0.0)
    return counted.withColumn("ratio", ratio).withColumn("unreliable", (F.col("n_products") >= least) & (F.col("ratio") >= 0.8))


def lines_with_parents(line_items: DataFrame) -> DataFrame:
    """(id, parent_id, parent_description, parent_price): lines that name a parent, and the parent where it exists."""
    child = line_items.where("parent_line_item_id IS NOT NULL").select("id", "parent_line_item_id")
    parent = line_items.select(F.col("id").alias("parent_id"), F.col("description").alias("parent_description"), F.col("total_price").alias("parent_price"))
    return child.join(parent, child.parent_line_item_id == F.col("parent_id"), "left").drop("parent_line_item_id")


def staggered(rows: DataFrame, group: str, order: str, delay_seconds: int) -> DataFrame:
    """``rows`` with ``delay``: the first of each group at once, each later one ``delay_seconds`` after the one before."""
    return numbered(rows, group, order).withColumn("delay", (F.col("number") - 1) * delay_seconds).drop("number")


def not_listed(rows: DataFrame, value: str, known: DataFrame) -> DataFrame:
    """(value, n_rows) of values that the first column of ``known`` has not; nulls are no values."""
    used = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n_rows"))
    return used.join(known, F.col(value) == F.col(known.columns[0]), "left_anti")
