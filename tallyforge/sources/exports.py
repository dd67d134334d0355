"""Export rows in the layout and number format of each user's settings, and a partitioned text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.numbers import formatted_amount, formatted_date
from tallyforge.functions.text import csv_quoted, joined
from tallyforge.operators.state_changes import merged_settings
from tallyforge.operators.upload_stats import export_statistics

DEFAULTS = {"decimal_separator": ".", "amount_format": "decimal", "date_format": "YYYY-MM-DD", "include_currency": True, "include_header": True}
# fixed values: the columns of the exports
RECEIPT_COLUMNS = ["Receipt ID", "Upload ID", "Store Name", "Total Amount", "Tax Amount", "Currency", "Transaction Date", "Status", "Review Status", "Keywords", "Item Count", "Top 5 Items"]
ITEM_COLUMNS = ["Item ID", "Receipt ID", "Upload ID", "Store Name", "Item Type", "Description", "Quantity", "Unit", "Price Per Unit", "Total Price", "Currency", "Transaction Date", "Keywords"]
UPLOAD_COLUMNS = ["Upload ID", "File Name", "Status", "Total Detected", "Successful", "Failed", "Processing", "Created At", "Updated At"]


def settings_of(users: DataFrame) -> DataFrame:
    """(user_id, delimiter and each setting), defaults filled in."""
    s = users.select(F.col("id").alias("user_id"), *merged_settings(F.col("export_settings"), DEFAULTS))
    return s.withColumn("delimiter", F.when(F.col("decimal_separator") == ",", ";").otherwise(","))


def header(columns: list[str], include_currency: Column, delimiter: Column) -> Column:
    """The heading line; without the currency where it is not included."""
    line = lambda names: F.array_join(F.array(*(F.lit(n) for n in names)), "\x00")
    without = [c for c in columns if c != "Currency"]
    return F.replace(F.when(include_currency, line(columns)).otherwise(line(without)), F.lit("\x00"), delimiter)


def _line(cells: list[Column | tuple[Column, str]]) -> Column:
    """Cells joined by the delimiter of the row; the currency cell only where it is included."""
    shown = [F.when(F.col("include_currency"), c[0]) if isinstance(c, tuple) else F.coalesce(c.cast("string"), F.lit("")) for c in cells]
    return F.replace(F.array_join(F.array(*shown), "\x00"), F.lit("\x00"), F.col("delimiter"))


def _with_settings(receipts: DataFrame, uploads: DataFrame, users: DataFrame) -> DataFrame:
    r = receipts.select(F.col("id").alias("receipt_id"), "upload_id", "store_name", "total_amount", "tax_amount", "currency", "transaction_date", "status", "review_status", "keywords")
    return r.join(uploads.select(F.col("id").alias("upload_id"), "user_id"), "upload_id").join(settings_of(users), "user_id")


def top_items(line_items: DataFrame, most: int = 5) -> DataFrame:
    """(receipt_id, item_id, place, description, total_price): the dearest lines that are not deleted; of equals the smaller id.

    Partial top lists form before the shuffle, so a receipt with very many lines sends few.
    """
    live = line_items.where("deleted_at IS NULL AND total_price IS NOT NULL AND receipt_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("receipt_id").orderBy(F.col("total_price").desc(), "id"))
    return live.select("receipt_id", F.col("id").alias("item_id"), "description", "total_price", place.alias("place")).where(F.col("place") <= most)


def receipt_rows(receipts: DataFrame, uploads: DataFrame, users: DataFrame, line_items: DataFrame) -> DataFrame:
    """(user_id, receipt_id, line): one export line a receipt, deleted ones among them."""
    counts = line_items.where("receipt_id IS NOT NULL").groupBy("receipt_id").agg(F.count_if(F.col("deleted_at").isNull()).alias("n_items"))
    tops = top_items(line_items).groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("place", "description", "total_price"))).alias("tops"))
    base = _with_settings(receipts, uploads, users).join(counts, "receipt_id", "left").join(tops, "receipt_id", "left")
    amount = lambda c: formatted_amount(c, F.col("amount_format"), F.col("decimal_separator"))
    named = F.transform(
        "tops", lambda t: F.concat(F.coalesce(t["description"], F.lit("null")), F.lit("("), amount(t["total_price"]), F.coalesce(F.col("currency"), F.lit("")), F.lit(")"))
    )
    cells = [
        F.col("receipt_id"), F.col("upload_id"), csv_quoted(F.col("store_name")), amount(F.col("total_amount")), amount(F.col("tax_amount")),
        (csv_quoted(F.col("currency")), "currency"), csv_quoted(formatted_date(F.col("transaction_date"), F.col("date_format"))), csv_quoted(F.col("status")),
        csv_quoted(F.coalesce("review_status", F.lit("not_required"))), csv_quoted(joined(F.col("keywords"))),
        csv_quoted(F.coalesce("n_items", F.lit(0))), csv_quoted(F.coalesce(F.array_join(named, " | "), F.lit(""))),
    ]
    return base.select("user_id", "receipt_id", _line(cells).alias("line"))


def item_rows(receipts: DataFrame, uploads: DataFrame, users: DataFrame, line_items: DataFrame) -> DataFrame:
    """(user_id, item_id, line): one export line an item, deleted ones among them; the amount is formatted like money."""
    items = line_items.select(F.col("id").alias("item_id"), F.col("receipt_id").alias("of_receipt"), "item_type", "description", "amount", "unit", "price_per_unit", "total_price")
    base = items.join(_with_settings(receipts, uploads, users), F.col("of_receipt") == F.col("receipt_id"))
    amount = lambda c: formatted_amount(F.col(c), F.col("amount_format"), F.col("decimal_separator"))
    quantity = F.when(F.col("amount").isNull(), csv_quoted(F.lit(None).cast("string"))).otherwise(amount("amount"))
    cells = [
        F.col("item_id"), F.col("receipt_id"), F.col("upload_id"), csv_quoted(F.col("store_name")), csv_quoted(F.col("item_type")), csv_quoted(F.col("description")),
        quantity, csv_quoted(F.col("unit")), amount("price_per_unit"), amount("total_price"), (csv_quoted(F.col("currency")), "currency"),
        csv_quoted(formatted_date(F.col("transaction_date"), F.col("date_format"))), csv_quoted(F.lit("")),
    ]
    return base.select("user_id", "item_id", _line(cells).alias("line"))


def upload_rows(uploads: DataFrame, receipts: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, upload_id, line): one export line an upload."""
    base = export_statistics(uploads, receipts).join(settings_of(users), "user_id")
    day = lambda c: csv_quoted(formatted_date(F.col(c), F.col("date_format")))
    cells = [
        F.col("upload_id"), csv_quoted(F.col("file_name")), csv_quoted(F.col("status")), F.col("total_detected"), F.col("successful"), F.col("failed"),
        F.col("processing"), day("created_at"), day("updated_at"),
    ]
    return base.select("user_id", "upload_id", _line(cells).alias("line"))


def write_lines(rows: DataFrame, users: DataFrame, columns: list[str], order: str, path: str, descending: bool = False) -> None:
    """Text files below ``path``/user_id=..., each user's lines by the number ``order``, the heading first where it is wanted.

    Rows are dealt out by ranges of user and order, so a user with very many lines has several files, in order of
    their names, and none goes through a single task.
    """
    heads = settings_of(users).where("include_header").join(rows.select("user_id").distinct(), "user_id", "left_semi")
    heads = heads.select("user_id", F.lit(None).cast("long").alias("at"), header(columns, F.col("include_currency"), F.col("delimiter")).alias("value"))
    at = F.col(order).cast("long")
    body = rows.select("user_id", (-at if descending else at).alias("at"), F.col("line").alias("value"))
    by = ["user_id", F.col("at").asc_nulls_first()]
    heads.unionAll(body).repartitionByRange(*by).sortWithinPartitions(*by).select("user_id", "value").write.partitionBy("user_id").text(path)


def nested(children: DataFrame, parent: str, fields: dict[str, str], span: int = 10_000) -> DataFrame:
    """(parent, chunk, n, document): the children of each parent as JSON arrays in order of id.

    A parent's children come in chunks of a span of ids, so no parent, however many children it
    has, is gathered into one value of more than ``span`` entries.
    """
    entry = F.struct(F.col("id"), *(F.col(c).cast("string").alias(name) for name, c in fields.items()))
    grouped = children.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("parent"), F.floor(F.col("id") / span).alias("chunk")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(entry)).alias("entries")
    )
    return grouped.select("parent", "chunk", "n", F.to_json("entries").alias("document"))
