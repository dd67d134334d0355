"""The queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.batch_dedup import repeated_uploads
from tallyforge.llm.eval_leaks import leaks
from tallyforge.llm.listing_match import listing_pairs, match_listings
from tallyforge.llm.name_variants import name_entities, name_pairs
from tallyforge.llm.reading_level import reading_levels
from tallyforge.llm.window_packing import packed_windows, window_use
from tallyforge.storage import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_pairs(match_listings(table(spark, sf_dir, "line_items")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_uploads(table(spark, sf_dir, "receipt_uploads"), table(spark, sf_dir, "receipts"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_pairs(name_entities(table(spark, sf_dir, "receipts")))


def p7_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_windows"))


def p7_window_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_use(p7_assignment(spark, sf_dir), table(spark, sf_dir, "pack_windows"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each test item the documents it leaked into and the longest passage."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("words").alias("longest_passage"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p4_found": p4_found,
        "p7_assignment": p7_assignment,
        "p7_window_use": p7_window_use,
        "p8_found": p8_found,
        "p8_passages": p8_passages,
        "p9_found": p9_found,
    }


def oracle_sql() -> dict[str, str]:
    return {}
