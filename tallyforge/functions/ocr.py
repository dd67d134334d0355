"""Numbers in recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what counts as a number token, after blanks inside numbers are closed up
TOKEN = r"\d{1,3}(?:[.,]\d{3})*[.,]\d{1,4}|\d+[.,]\d{1,4}|\d{1,7}"


# fixed values: a number with blanks about its mark
BLANKS_INSIDE = r"(\d)\s*([.,])\s*(\d)"


def number_tokens(text: Column) -> Column:
    closed = F.regexp_replace(text, BLANKS_INSIDE, "$1$2$3")
    return F.regexp_extract_all(closed, F.lit(f"({TOKEN})"), 1)


def _leading_number(text: Column) -> Column:
    """The number a text begins with, as a double."""
    return F.regexp_extract(text, r"^\d+(?:\.\d+)?", 0).try_cast("double")


def readings(token: Column) -> Column:
    """The values a token can mean, as doubles.

    The last mark splits off decimals, the other mark groups digits. Where there is one kind of mark,
    three digits behind it may be decimals or a group, and more are a group.
    """
    mark = F.regexp_extract(token, r"([.,])\d*$", 1)
    tail = F.regexp_extract(token, r"[.,](\d*)$", 1)
    head = F.regexp_extract(token, r"^(.*)[.,]\d*$", 1)
    both = token.contains(".") & token.contains(",")
    ungrouped = F.when(mark == ".", F.replace(head, F.lit(","))).otherwise(F.replace(head, F.lit(".")))
    digits = F.regexp_replace(token, "[.,]", "").try_cast("double")
    decimal = lambda h: _leading_number(F.concat(h, F.lit("."), tail))
    values = (
        F.when(mark == "", F.array(token.try_cast("double")))
        .when(both, F.array(decimal(ungrouped)))
        .when(F.length(tail) < 3, F.array(decimal(head)))
        .when(F.length(tail) == 3, F.array(decimal(head), _leading_number(F.concat(head, tail))))
        .otherwise(F.array(digits))
    )
    return F.filter(values, lambda v: v.isNotNull())


def numbers_in(text: Column) -> Column:
    """All readings of all number tokens of a text, in order; empty for null."""
    return F.coalesce(F.flatten(F.transform(number_tokens(text), readings)), F.array().cast("array<double>"))


def holds_number(numbers: Column, target: Column, within: float = 0.01) -> Column:
    """Whether a number nearer than ``within`` to the target occurs; false for a null target."""
    return F.coalesce(F.exists(numbers, lambda v: F.abs(v - target) < within), F.lit(False))


def cross_checked(receipts: DataFrame, line_items: DataFrame, texts: DataFrame, least: int = 3) -> DataFrame:
    """(receipt_id, total_found, n_products, n_missing, unreliable, issues) of the receipts that have a text.

    Looked for in the numbers of the receipt's own text (receipt_id, text) are its total and the prices of its
    products, without sign; 0 counts as found, null as missing. With ``least`` products or more a text is no
    measure where four fifths of the prices are missing, or half of them and the total: then that is the only issue.
    """
    seen = texts.where("text IS NOT NULL").select("receipt_id", numbers_in(F.col("text")).alias("seen"))
    known = lambda c: F.coalesce((F.col(c) == 0) | holds_number(F.col("seen"), F.abs(F.col(c).cast("double"))), F.lit(False))
    totals = seen.join(receipts.select(F.col("id").alias("receipt_id"), "total_amount"), "receipt_id").select("receipt_id", known("total_amount").alias("total_found"))
    prices = line_items.where("item_type = 'product'").select("receipt_id", "price_per_unit").join(seen, "receipt_id")
    items = prices.groupBy("receipt_id").agg(F.count("*").alias("n"), F.count_if(~known("price_per_unit")).alias("n_missing"))
    n, missing = F.coalesce("n", F.lit(0)), F.coalesce("n_missing", F.lit(0))
    bad = (n >= least) & ((~F.col("total_found") & (missing >= n * 0.5)) | (missing >= n * 0.8))
    issues = F.concat(
        F.when(F.col("total_found"), F.array().cast("array<string>")).otherwise(F.array(F.lit("OCR_MISMATCH:total"))),
        F.when(missing == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("OCR_MISMATCH:unitPrice x"), missing.cast("string")))),
    )
    return totals.join(items, "receipt_id", "left").select(
        "receipt_id", "total_found", n.alias("n_products"), missing.alias("n_missing"), bad.alias("unreliable"), F.when(bad, "LOW_IMAGE_QUALITY").otherwise(F.array_join(issues, ";")).alias("issues")
    )
