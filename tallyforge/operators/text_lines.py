"""Lines of recognised text from several sources, merged without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import line_key


def first_seen_lines(texts: DataFrame, key: str, text: str, order: str | None = None) -> DataFrame:
    """(key, pos, line): the lines of each key's texts in order, without those met before.

    Lines are the same apart from case and white space; blank ones are left out. With ``order``
    several texts of a key are read in that order.
    """
    rank = F.col(order) if order else F.lit(0)
    lines = texts.select(key, rank.alias("rank"), F.posexplode(F.split(F.col(text), "\r?\n")).alias("at", "raw"))
    lines = lines.withColumn("line", F.regexp_replace("raw", r"(?U)^\s+|\s+$", "")).where("line <> ''")
    first = lines.groupBy(key, line_key(F.col("line")).alias("k")).agg(F.min(F.struct("rank", "at", "line")).alias("f"))
    return first.select(key, F.col("f.rank").alias("source_rank"), F.col("f.at").alias("pos"), F.col("f.line").alias("line"))


def merged_texts(texts: DataFrame, key: str, text: str, order: str | None = None) -> DataFrame:
    """(key, merged, n_lines): those lines in order, as one text."""
    lines = first_seen_lines(texts, key, text, order)
    sorted_lines = F.array_sort(F.collect_list(F.struct("source_rank", "pos", "line")))
    return lines.groupBy(key).agg(sorted_lines.alias("ls")).select(
        key, F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("merged"), F.size("ls").alias("n_lines")
    )
