"""Life of uploads, receipts and lines as changes of tables: reprocess, resume, edit, reset, clean up.

Rows are named by other tables and met by joins on their keys. Each function takes and returns
whole tables; columns it does not name stay as they are. Ids named more than once count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.edits import originals
from tallyforge.operators.upload_stats import count_where, numbered

# fixed values: what reprocessing takes off a receipt
CLEARED = ("store_name", "total_amount", "tax_amount", "transaction_date", "currency", "keywords", "duplicate_of_receipt_id", "duplicate_confidence_score")
ITEM_FIELDS = {"description": "description", "amount": "amount", "unit": "unit", "pricePerUnit": "price_per_unit", "totalPrice": "total_price"}
#: Fields of a line that may not become null by a reset.
KEPT_IF_NULL = ("description", "totalPrice")


def marked(rows: DataFrame, key: str, named: DataFrame, flag: str = "is_named") -> DataFrame:
    """``rows`` with ``flag``: whether ``key`` is in the first column of ``named``. A column of that name is replaced."""
    ids = named.select(F.col(named.columns[0]).alias("__id")).where("__id IS NOT NULL").distinct()
    joined = rows.join(ids, F.col(key) == F.col("__id"), "left")
    return joined.withColumn(flag, F.col("__id").isNotNull()).drop("__id")


def updated(rows: DataFrame, key: str, named: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``rows`` with new values in the named ones; a value is cast to the type of its column."""
    m = marked(rows, key, named, "__named")
    new = [F.when(F.col("__named"), values[c].cast(m.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns]
    return m.select(*new)


def without(rows: DataFrame, key: str, named: DataFrame) -> DataFrame:
    """``rows`` but those whose ``key`` is named; a null key is named by nothing."""
    return marked(rows, key, named, "__named").where("NOT __named").drop("__named")


def reprocessed_receipts(tables: dict[str, DataFrame], named: DataFrame) -> dict[str, DataFrame]:
    """Receipts set back to where nothing was read: fields null, their lines and errors gone, their uploads in work."""
    r = tables["receipts"]
    values = {c: F.lit(None) for c in CLEARED} | {"status": F.lit("pending"), "review_status": F.lit("not_required"), "is_duplicate": F.lit(False)}
    uploads = marked(r, "id", named).where("is_named").select("upload_id")
    return {
        "receipts": updated(r, "id", named, values),
        "line_items": without(tables["line_items"], "receipt_id", named),
        "processing_errors": without(tables["processing_errors"], "receipt_id", named),
        "receipt_uploads": updated(tables["receipt_uploads"], "id", uploads, {"status": F.lit("processing")}),
    }


def reprocessed_uploads(tables: dict[str, DataFrame], named: DataFrame) -> dict[str, DataFrame]:
    """Uploads set back to before they were split: all that hangs on them is gone. Duplicates stay as they are."""
    u = tables["receipt_uploads"]
    ids = marked(u, "id", named).where("is_named AND NOT status <=> 'duplicate'").select("id")
    receipts = marked(tables["receipts"], "upload_id", ids).where("is_named").select("id")
    return {
        "receipt_uploads": updated(u, "id", ids, {"status": F.lit("processing"), "has_receipts": F.lit(None)}),
        "receipts": without(tables["receipts"], "upload_id", ids),
        "line_items": without(tables["line_items"], "receipt_id", receipts),
        "processing_errors": without(tables["processing_errors"], "upload_id", ids),
    }


def resumable(receipts: DataFrame, errors: DataFrame, kind: str = "RATE_LIMITED") -> DataFrame:
    """Receipts that wait for the limiter and have an error that says so."""
    waiting = errors.where((F.get_json_object("metadata", "$.errorType") == kind) & F.col("receipt_id").isNotNull()).select("receipt_id")
    return receipts.where("status = 'rate_limited'").join(waiting.distinct(), F.col("id") == F.col("receipt_id"), "left_semi")


def resumed(tables: dict[str, DataFrame], kind: str = "RATE_LIMITED") -> dict[str, DataFrame]:
    """Resumable receipts pending again, with ``delay_no`` 0, 1, ... within their upload; the errors of such uploads gone."""
    r, e = tables["receipts"], tables["processing_errors"]
    back = resumable(r, e, kind)
    uploads = back.select("upload_id").distinct()
    is_kind = F.coalesce(F.get_json_object("metadata", "$.errorType") == kind, F.lit(False)) & F.col("receipt_id").isNotNull()
    left = marked(e, "upload_id", uploads, "__named").where(~(F.col("__named") & is_kind)).drop("__named")
    queue = numbered(back.select("id", "upload_id"), "upload_id", "id").select("id", "upload_id", (F.col("number") - 1).alias("delay_no"))
    return {
        "receipts": updated(r, "id", back.select("id"), {"status": F.lit("pending")}),
        "processing_errors": left,
        "receipt_uploads": updated(tables["receipt_uploads"], "id", uploads, {"status": F.lit("processing")}),
        "queue": queue,
    }


def history_rows(changes: DataFrame, entity_type: str, changed_by: Column, at: Column) -> DataFrame:
    """Rows for the edit history of ``changes`` (entity_id, field_name, old_value, new_value); equal values are no change."""
    return changes.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(
        F.lit(entity_type).alias("entity_type"), "entity_id", "field_name", "old_value", "new_value", changed_by.alias("changed_by"), at.alias("changed_at")
    )


def appended(rows: DataFrame, more: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """``rows`` and ``more``, whose keys go on from the largest there is, in the given order; columns ``more`` lacks are null.

    The order is a range partitioning; the keys come from the sizes of the partitions, so no
    task sees all rows.
    """
    largest = rows.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    placed = numbered_by_order(more, order or more.columns)
    return rows.unionByName(placed.withColumn(key, (F.col("place") + largest).cast(rows.schema[key].dataType)).drop("place"), allowMissingColumns=True)


def numbered_by_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` 1, 2, ... in the given order, without one task for all."""
    from pyspark.sql import Window

    from tallyforge.storage import materialize

    sorted_rows = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", before.alias("before"))
    return sorted_rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", F.col("before") + at + 1).drop("part", "before", "at")


def with_new_items(line_items: DataFrame, new: DataFrame) -> DataFrame:
    """Lines with those a user added (receipt_id, description, total_price and what else is given), by receipt and text.

    Without a type a line is a product, without an amount it is one. No history is written.
    """
    # fixed values: the type and amount of an added line
    defaults = {"item_type": "product", "amount": "1.000"}
    out = new
    for c, value in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(value)) if c in new.columns else F.lit(value))
    out = out.withColumn("amount", F.col("amount").cast(line_items.schema["amount"].dataType)).withColumn("is_user_added", F.lit(True))
    return appended(line_items, out, order=["receipt_id", "description", "total_price"])


def without_items(line_items: DataFrame, named: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Lines with the named ones marked as deleted, and the changes that say so; lines deleted before stay as they are."""
    ids = marked(line_items, "id", named).where("is_named AND deleted_at IS NULL").select("id")
    changes = ids.select(F.col("id").alias("entity_id"), F.lit("__deleted__").alias("field_name"), F.lit("false").alias("old_value"), F.lit("true").alias("new_value"))
    return updated(line_items, "id", ids, {"deleted_at": at}), changes


def reset_items(line_items: DataFrame, history: DataFrame, receipts: DataFrame, at: Column) -> DataFrame:
    """Lines of the named receipts as first extracted: added ones deleted, others back, with their first values.

    Description and total stay where their first value is null; text that is no number becomes null.
    A line with a null is_user_added stays as it is.
    """
    firsts = originals(history, "line_item").where(F.col("field_name").isin(*ITEM_FIELDS))
    wide = firsts.groupBy(F.col("entity_id").alias("__entity")).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "original"))).alias("__first"))
    joined = marked(line_items, "receipt_id", receipts, "__named").join(wide, F.col("id") == F.col("__entity"), "left")
    added, own = F.col("__named") & F.col("is_user_added"), F.col("__named") & ~F.col("is_user_added")
    out = []
    by_column = {c: f for f, c in ITEM_FIELDS.items()}
    for c in line_items.columns:
        if c in by_column:
            field, kind = by_column[c], line_items.schema[c].dataType
            text = F.col("__first")[field]
            value = text if kind.simpleString() == "string" else F.trim(text).try_cast(kind)
            known = F.array_contains(F.map_keys("__first"), field) & ((text.isNotNull()) if field in KEPT_IF_NULL else F.lit(True))
            out.append(F.when(own & known, value).otherwise(F.col(c)).alias(c))
        elif c == "deleted_at":
            out.append(F.when(added, at).when(own, F.lit(None)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def overridden(receipts: DataFrame, named: DataFrame) -> DataFrame:
    """Receipts of which the named ones are no duplicates by a user's word; ``duplicate_override`` says so."""
    m = marked(receipts, "id", named, "duplicate_override")
    return m.withColumn("is_duplicate", F.when(F.col("duplicate_override"), F.lit(False)).otherwise(F.col("is_duplicate")))


def backfilled_review(receipts: DataFrame, errors: DataFrame) -> DataFrame:
    """Processed receipts with a validation warning that were never reviewed, marked for it."""
    warned = errors.where("category = 'VALIDATION_WARNING'").select("receipt_id")
    m = marked(receipts, "id", warned, "__named")
    due = F.col("__named") & (F.col("review_status") == "not_required") & (F.col("status") == "processed")
    return m.withColumn("review_status", F.when(due, "needs_review").otherwise(F.col("review_status"))).drop("__named")


def rolled_up(receipts: DataFrame) -> DataFrame:
    """(upload_id, all_rows, live_rows): what an upload's receipts add up to, over all and over those not deleted.

    ``completed`` if all are processed, also of none; ``failed`` if all failed; else ``partly_completed``.
    """
    live = F.col("deleted_at").isNull()
    done, failed = F.col("status") == "processed", F.col("status").isin("failed", "unreadable")
    c = receipts.where("upload_id IS NOT NULL").groupBy("upload_id").agg(
        F.count("*").alias("n"), count_where(done).alias("done"), count_where(failed).alias("failed"),
        count_where(live).alias("live"), count_where(live & done).alias("live_done"), count_where(live & failed).alias("live_failed"),
    )
    kind = lambda n, d, f: F.when(F.col(n) == F.col(d), "completed").when(F.col(n) == F.col(f), "failed").otherwise("partly_completed")
    return c.select("upload_id", kind("n", "done", "failed").alias("all_rows"), kind("live", "live_done", "live_failed").alias("live_rows"))


def upload_details(uploads: DataFrame, receipts: DataFrame, errors: DataFrame) -> DataFrame:
    """One row an upload: counters, receipts by bucket, and when and by whom it was rate limited.

    Receipts in a bucket stand by id; deleted ones are in them, but not in the counters. The provider is the first
    one that an error names, the reset time the latest.
    """
    live, status, review = F.col("deleted_at").isNull(), F.col("status"), F.col("review_status")
    buckets = {
        "successful": (status == "processed") & review.isin("not_required", "reviewed"),
        "needs_review": review == "needs_review",
        "failed": status.isin("failed", "unreadable"),
        "processing": status == "pending",
        "rate_limited": status == "rate_limited",
        "all": F.lit(True),
    }
    counters = {"n_detected": live, "n_processed": live & (status == "processed"), "n_failed": live & buckets["failed"], "n_deleted": ~live, "n_rate_limited": buckets["rate_limited"]}
    r = receipts.where("upload_id IS NOT NULL").groupBy("upload_id").agg(
        *(count_where(c).alias(n) for n, c in counters.items()),
        *(F.array_join(F.array_sort(F.collect_list(F.when(F.coalesce(c, F.lit(False)), F.col("id")))), ",").alias(f"{n}_ids") for n, c in buckets.items()),
    )
    limited = errors.where(F.get_json_object("metadata", "$.errorType") == "RATE_LIMITED")
    provider = F.get_json_object("metadata", "$.provider")
    e = limited.groupBy(F.col("upload_id").alias("of_upload")).agg(
        F.max(F.get_json_object("metadata", "$.resetTime").try_cast("timestamp")).alias("resumable_at"),
        F.min_by(provider, F.when(F.nullif(provider, F.lit("")).isNotNull(), F.col("id"))).alias("provider"),
    )
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in counters]
    listed = [F.coalesce(f"{n}_ids", F.lit("")).alias(f"{n}_ids") for n in buckets]
    u = uploads.select("id", "user_id", F.col("status").alias("upload_status"))
    joined = u.join(r, F.col("id") == F.col("upload_id"), "left").drop("upload_id").join(e, F.col("id") == F.col("of_upload"), "left")
    has = F.coalesce(F.col("n_rate_limited") > 0, F.lit(False))
    return joined.select(
        F.col("id").alias("upload_id"), "user_id", "upload_status", *zero, *listed,
        F.when(has, F.col("resumable_at")).alias("resumable_at"), F.when(has, F.col("provider")).alias("provider"),
    )


def retries(rows: DataFrame, attempts: int = 3, first_seconds: int = 30) -> DataFrame:
    """``rows`` once for each attempt, with ``attempt`` from 1 and the seconds ``wait`` before it, doubled each time."""
    tries = F.sequence(F.lit(1), F.lit(attempts))
    return rows.withColumn("attempt", F.explode(tries)).withColumn(
        "wait", F.when(F.col("attempt") == 1, 0).otherwise(first_seconds * F.pow(F.lit(2), F.col("attempt") - 2)).cast("int")
    )


def line_totals(line_items: DataFrame, capped: Column) -> DataFrame:
    """(id, total): the stated total, or amount times price rounded to cents where there is none.

    Where ``capped``, a total of anything but a discount that is over the computed one by more than 0.02 becomes that.
    """
    computed = F.round(F.col("amount").cast("double") * F.col("price_per_unit").cast("double"), 2)
    stated = F.col("total_price").cast("double")
    over = capped & ~(F.col("item_type") == "discount") & (stated > computed + 0.02)
    return line_items.select("id", F.when(stated.isNull() | F.coalesce(over, F.lit(False)), computed).otherwise(stated).alias("total"))
