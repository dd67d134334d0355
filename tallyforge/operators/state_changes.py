"""Changes of stored state, as functions from tables to tables.

Parquet has no row-level update; each change is a projection, an anti join or an append. Rows are
named by another table (a semi join), never by a list of literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def without_uploads(tables: dict[str, DataFrame], uploads_gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after deleting uploads (id) with all that hangs on them: receipts, lines, errors."""
    gone = uploads_gone.select(F.col("id").alias("gone"))
    receipts_gone = tables["receipts"].join(gone, F.col("upload_id") == F.col("gone"), "left_semi").select(F.col("id").alias("gone"))
    return {
        "receipt_uploads": tables["receipt_uploads"].join(gone, F.col("id") == F.col("gone"), "left_anti"),
        "receipts": tables["receipts"].join(gone, F.col("upload_id") == F.col("gone"), "left_anti"),
        "line_items": tables["line_items"].join(receipts_gone, F.col("receipt_id") == F.col("gone"), "left_anti"),
        "processing_errors": tables["processing_errors"].join(gone, F.col("upload_id") == F.col("gone"), "left_anti"),
    }


def user_data_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(user_id, uploads, receipts, line_items, errors): what a deletion of each user's data would remove."""
    up = tables["receipt_uploads"].select(F.col("id").alias("upload_id"), "user_id")
    items = tables["line_items"].where("receipt_id IS NOT NULL").groupBy("receipt_id").agg(F.count("*").alias("items"))
    r = tables["receipts"].select("id", "upload_id").join(items, F.col("id") == F.col("receipt_id"), "left")
    per_upload = r.groupBy("upload_id").agg(F.count("*").alias("receipts"), F.sum(F.coalesce("items", F.lit(0))).alias("items"))
    errors = tables["processing_errors"].groupBy("upload_id").agg(F.count("*").alias("errors"))
    joined = up.join(per_upload, "upload_id", "left").join(errors, "upload_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return joined.groupBy("user_id").agg(
        F.count("*").alias("uploads"), total("receipts").alias("receipts"), total("items").alias("line_items"), total("errors").alias("errors")
    )


def soft_deleted(rows: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """``deleted_at`` set on the rows named by ``gone`` (id) that are not deleted yet."""
    marked = rows.join(gone.select(F.col("id").alias("gone")).distinct(), F.col("id") == F.col("gone"), "left")
    return marked.withColumn("deleted_at", F.when(F.col("gone").isNotNull(), F.coalesce("deleted_at", at)).otherwise(F.col("deleted_at"))).drop("gone")


def undeleted(rows: DataFrame, back: DataFrame) -> DataFrame:
    """``deleted_at`` cleared on the rows named by ``back`` (id)."""
    marked = rows.join(back.select(F.col("id").alias("back")).distinct(), F.col("id") == F.col("back"), "left")
    return marked.withColumn("deleted_at", F.when(F.col("back").isNull(), F.col("deleted_at"))).drop("back")


def either_end(rows: DataFrame, key: str, links: DataFrame, left: str, right: str) -> DataFrame:
    """Rows that stand at either end of a link: two semi joins, as an OR of equalities would be a nested loop."""
    ends = links.select(F.col(left).alias("end")).unionAll(links.select(F.col(right).alias("end"))).where("end IS NOT NULL").distinct()
    return rows.join(ends, F.col(key) == F.col("end"), "left_semi")


def merged_settings(stored: Column, defaults: dict[str, object]) -> list[Column]:
    """Each field of a settings struct, or its default where it is null."""
    return [F.coalesce(stored[name], F.lit(value)).alias(name) for name, value in defaults.items()]


def marked_duplicates(receipts: DataFrame, links: DataFrame) -> DataFrame:
    """Receipts with the duplicate columns set from ``links`` (id, candidate_id, score); others as they are."""
    found = links.select(F.col("id").alias("marked"), F.col("candidate_id").alias("of"), F.col("score").cast("decimal(5,2)").alias("points"))
    joined = receipts.join(found, F.col("id") == F.col("marked"), "left")
    hit = F.col("marked").isNotNull()
    return (
        joined.withColumn("is_duplicate", F.when(hit, F.lit(True)).otherwise(F.col("is_duplicate")))
        .withColumn("duplicate_of_receipt_id", F.when(hit, F.col("of")).otherwise(F.col("duplicate_of_receipt_id")))
        .withColumn("duplicate_confidence_score", F.when(hit, F.col("points")).otherwise(F.col("duplicate_confidence_score")))
        .drop("marked", "of", "points")
    )


def with_edits(rows: DataFrame, edits: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Rows with the newest value of each edited field: ``edits`` (entity_id, field_name, new_value, changed_at, id).

    ``columns`` maps field names to columns. Text that does not fit a column's type becomes null.
    """
    newest = edits.where(F.col("field_name").isin(*columns)).groupBy("entity_id", "field_name").agg(F.max_by(F.struct("new_value"), F.struct("changed_at", "id")).alias("n"))
    wide = newest.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.col("n.new_value").alias("v")))).alias("now"))
    joined = rows.join(wide, F.col(key) == F.col("entity_id"), "left")
    for field, column in columns.items():
        kind = joined.schema[column].dataType.simpleString()
        text = F.col("now")[field]
        text = text if kind == "string" else F.trim(F.regexp_replace(F.regexp_replace(text, "T", " "), "Z$", "")).try_cast(kind)
        edited = F.coalesce(F.array_contains(F.map_keys("now"), field), F.lit(False))
        joined = joined.withColumn(column, F.when(edited, text).otherwise(F.col(column)))
    return joined.drop("entity_id", "now")


def patched_settings(stored: Column, patch: Column, defaults: dict[str, object]) -> list[Column]:
    """Each field of a settings struct after a patch: the patch's value, else the stored one, else the default."""
    return [F.coalesce(patch[name], stored[name], F.lit(value)).alias(name) for name, value in defaults.items()]
