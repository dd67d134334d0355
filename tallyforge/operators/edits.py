"""What an edit log says: values as first extracted, the overlay that restores them, real changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADER = {"storeName": "store_name", "totalAmount": "total_amount", "taxAmount": "tax_amount", "currency": "currency", "transactionDate": "transaction_date"}


def originals(history: DataFrame, entity_type: str) -> DataFrame:
    """(entity_id, field_name, original): the old value of the first change of each field; null is a value.

    Changes are taken by changed_at, then id.
    """
    mine = history.where(F.col("entity_type") == entity_type).where("entity_id IS NOT NULL AND field_name IS NOT NULL AND changed_at IS NOT NULL")
    first = mine.groupBy("entity_id", "field_name").agg(F.min_by(F.struct("old_value"), F.struct("changed_at", "id")).alias("o"))
    return first.select("entity_id", "field_name", F.col("o.old_value").alias("original"))


def restored_receipts(receipts: DataFrame, history: DataFrame) -> DataFrame:
    """Receipts with their edited header fields as first extracted.

    Text that is no number or time becomes null; fields never edited stay.
    """
    per = originals(history, "receipt").where(F.col("field_name").isin(*HEADER)).groupBy("entity_id").agg(
        F.map_from_entries(F.collect_list(F.struct("field_name", "original"))).alias("o")
    )
    joined = receipts.join(per, receipts.id == per.entity_id, "left")

    def value(field: str):
        column = HEADER[field]
        kept = F.col("o")[field]
        kind = joined.schema[column].dataType.simpleString()
        text = F.trim(F.regexp_replace(F.regexp_replace(kept, "T", " "), "Z$", "")) if kind.startswith("timestamp") else F.trim(kept) if kind != "string" else kept
        return F.when(F.map_contains_key(F.coalesce("o", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), field), text.try_cast(kind)).otherwise(F.col(column)).alias(column)

    return joined.select("id", *(value(f) for f in HEADER), F.col("o").isNotNull().alias("was_edited"))


def real_changes(history: DataFrame) -> DataFrame:
    """Changes whose new value differs from the old one, a null among them."""
    return history.where(~F.col("old_value").eqNullSafe(F.col("new_value")))


def change_rows(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, old_value, new_value) for each field that differs between two states of a table."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias(name)) for f in fields))
        return df.select(key, F.inline(pairs))

    joined = long(before, "old_value").join(long(after, "new_value"), [key, "field_name"])
    return joined.where(~F.col("old_value").eqNullSafe(F.col("new_value")))
