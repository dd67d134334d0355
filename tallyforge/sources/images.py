"""Image files as a table, named by their content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.structures import image_kind
from tallyforge.functions.text import content_hash

MAX_BYTES = 15 * 1024 * 1024


def image_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, length, kind, hash, stored_name, accepted): accepted if of a known kind and not too large. The reader
    passes over empty files, so they have no row.

    Content is read once, for its hash and first bytes, and not passed on.
    """
    files = spark.read.format("binaryFile").load(path)
    kind, digest = image_kind(F.col("content")), content_hash(F.col("content"))
    return files.select("path", "length", kind.alias("kind"), digest.alias("hash")).select(
        "*", F.concat("hash", F.lit("."), F.coalesce("kind", F.lit("bin"))).alias("stored_name"),
        (F.col("kind").isNotNull() & (F.col("length") <= max_bytes)).alias("accepted"),
    )
