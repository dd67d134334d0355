"""Likely duplicates among a user's receipts: a banded self-join, scored by factors.

Pairs are ordered: the score of a receipt against a candidate is not the score the other way
round, as the day difference is rounded towards the past.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.numbers import bits_apart, day_difference, hash_bits, minutes_apart, tier
from tallyforge.functions.text import plain_name, plain_similarity

DAYS = 3
# fixed values: points of each factor by its bounds, and the classes of the sum
STORE = [(100, 30), (90, 28), (80, 23), (70, 18), (60, 12)]
AMOUNT = [(0.0, 25), (0.01, 23), (0.10, 20), (1.0, 15), (5.0, 10)]
TAX = [(0.0, 10), (0.01, 8), (0.10, 5)]
ITEMS = [(0, 15), (1, 12), (2, 8), (3, 5)]
CLASSES = [(95, "DEFINITE_DUPLICATE"), (85, "LIKELY_DUPLICATE"), (70, "POSSIBLE_DUPLICATE"), (50, "UNCERTAIN")]


def owned_receipts(receipts: DataFrame, uploads: DataFrame, line_items: DataFrame) -> DataFrame:
    """Receipts with their user, plain name (null for none) and number of lines (deleted lines count)."""
    items = line_items.where("receipt_id IS NOT NULL").groupBy("receipt_id").agg(F.count("*").alias("n_items"))
    name = F.when(F.length("store_name") > 0, plain_name(F.col("store_name"))).alias("name")  # once a receipt, not once a pair
    r = receipts.select(F.col("id"), "upload_id", name, "total_amount", "tax_amount", "transaction_date", "status")
    r = r.join(uploads.select(F.col("id").alias("upload_id"), "user_id"), "upload_id")
    return r.join(items, r.id == items.receipt_id, "left").withColumn("n_items", F.coalesce("n_items", F.lit(0))).drop("receipt_id")


def candidate_pairs(owned: DataFrame) -> DataFrame:
    """Each receipt with the processed receipts of its user within three days.

    The days are a key: a candidate stands in its bucket of three days, a receipt looks into its
    own and both neighbours, so a user with very many receipts is spread over their buckets. A
    receipt without a date has all of its user's processed receipts as candidates; these few are
    joined on the user alone. Null users match nothing.
    """
    bucket = F.floor(F.unix_date(F.to_date("transaction_date")) / DAYS)
    dated = owned.where("transaction_date IS NOT NULL").withColumn("look", F.explode(F.array(bucket - 1, bucket, bucket + 1))).alias("a")
    known = owned.where("status = 'processed' AND transaction_date IS NOT NULL").withColumn("bucket", bucket).alias("b")
    near = (
        (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.look") == F.col("b.bucket")) & (F.col("a.id") != F.col("b.id"))
        & F.col("b.transaction_date").between(F.col("a.transaction_date") - F.expr(f"INTERVAL {DAYS} DAYS"), F.col("a.transaction_date") + F.expr(f"INTERVAL {DAYS} DAYS"))
    )
    columns = ["id", "user_id", "name", "total_amount", "tax_amount", "transaction_date", "n_items"]
    both = [F.col(f"a.{c}").alias(c) for c in columns] + [F.col(f"b.{c}").alias(f"other_{c}") for c in columns]
    undated = owned.where("transaction_date IS NULL").alias("a")
    all_known = owned.where("status = 'processed'").alias("b")
    rest = undated.join(all_known, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.id") != F.col("b.id"))).select(*both)
    return dated.join(known, near).select(*both).unionAll(rest)


def scored_pairs(pairs: DataFrame) -> DataFrame:
    """Points of each factor, their sum, and whether all factors agree outright (score 99).

    A null amount or date gives no points but a difference of 0, so it does not stand against
    an outright match; a null date counts as one with a time of day.
    """
    # inline() of one struct works each of these out once, however often the points below use them
    apart = lambda c: F.round(F.abs(F.col(c).cast("double") - F.col(f"other_{c}").cast("double")), 6)
    measures = F.struct(
        plain_similarity(F.col("name"), F.col("other_name")).alias("similarity"), apart("total_amount").alias("amount_apart"), apart("tax_amount").alias("tax_apart"),
        day_difference(F.col("transaction_date"), F.col("other_transaction_date")).alias("days"), minutes_apart(F.col("transaction_date"), F.col("other_transaction_date")).alias("minutes"),
    )
    pairs = pairs.select("id", "other_id", "user_id", "transaction_date", "other_transaction_date", "n_items", "other_n_items", F.inline(F.array(measures)))
    similarity, days, minutes = F.col("similarity"), F.col("days"), F.col("minutes")
    timed = lambda c: (F.hour(c) != 0) | (F.minute(c) != 0)
    both_timed = timed("transaction_date") & timed("other_transaction_date")
    date_points = (
        F.when((days == 0) & both_timed & (minutes <= 5), 20).when((days == 0) & both_timed & (minutes <= 60), 17).when(days == 0, 12)
        .when(days == 1, 8).when(days <= 3, 4).otherwise(0)
    )
    items = F.abs(F.col("n_items") - F.col("other_n_items"))
    s = pairs.select(
        "id", F.col("other_id").alias("candidate_id"), "user_id",
        F.round(similarity, 6).alias("similarity"), "amount_apart", "days",
        tier(similarity, STORE, falling=False).alias("store_points"), tier(F.col("amount_apart"), AMOUNT).alias("amount_points"),
        date_points.alias("date_points"), tier(items, ITEMS).alias("item_points"), tier(F.col("tax_apart"), TAX).alias("tax_points"),
        (F.coalesce(timed("transaction_date"), F.lit(True)) & F.coalesce(timed("other_transaction_date"), F.lit(True))).alias("both_timed"),
        F.coalesce((days == 0) & both_timed & (minutes <= 5), F.lit(False)).alias("same_time"), items.alias("items_apart"),
    )
    outright = (
        (F.floor(F.col("similarity") + 0.5) >= 90) & (F.coalesce(F.floor(F.col("amount_apart") * 100 + 0.5), F.lit(0)) <= 1)
        & (F.coalesce("days", F.lit(0)) == 0) & (~F.col("both_timed") | F.col("same_time")) & (F.col("items_apart") == 0)
    )
    total = F.col("store_points") + F.col("amount_points") + F.col("date_points") + F.col("item_points") + F.col("tax_points")
    return s.withColumn("outright", outright).withColumn("score", total).select(
        "id", "candidate_id", "user_id", "store_points", "amount_points", "date_points", "item_points", "tax_points", "score", "outright"
    )


def best_matches(scored: DataFrame) -> DataFrame:
    """(id, candidate_id, score, class): an outright match first, else the highest score; of equals the smaller id."""
    final = F.when(F.col("outright"), 99).otherwise(F.col("score"))
    best = scored.withColumn("final", final).groupBy("id").agg(
        F.max_by(F.struct("candidate_id", "final"), F.struct(F.col("outright"), F.when(F.col("outright"), 0).otherwise(F.col("final")), -F.col("candidate_id"))).alias("m")
    )
    name = F.lit("NOT_DUPLICATE")
    for least, label in reversed(CLASSES):
        name = F.when(F.col("m.final") >= least, label).otherwise(name)
    return best.where("m.final > 0").select("id", "m.candidate_id", F.col("m.final").alias("score"), name.alias("class"))


def equal_images(uploads: DataFrame) -> DataFrame:
    """(upload_id, first_id): uploads whose image hash an earlier upload of the user has. No pairs are formed."""
    keyed = uploads.where("image_hash IS NOT NULL AND user_id IS NOT NULL")
    first = keyed.groupBy("user_id", "image_hash").agg(F.min("id").alias("first_id"))
    return keyed.join(first, ["user_id", "image_hash"]).where(F.col("id") > F.col("first_id")).select(F.col("id").alias("upload_id"), "first_id")


def near_images(uploads: DataFrame, most: int = 8) -> DataFrame:
    """(upload_id, near_id, bits): pairs of different hashes of a user at most ``most`` bits apart, by their first uploads.

    Nine bands of the 64 bits: two hashes with at most eight different bits agree in one. Equal
    hashes of a user are taken together first, as the smallest id among them.
    """
    points = uploads.where("perceptual_hash IS NOT NULL AND user_id IS NOT NULL").select("id", "user_id", hash_bits(F.col("perceptual_hash")).alias("h"))
    points = points.groupBy("user_id", "h").agg(F.min("id").alias("id"))
    cuts = [64 * i // (most + 1) for i in range(most + 2)]
    band = lambda i: F.shiftrightunsigned("h", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1))
    keyed = points.select("*", F.posexplode(F.array(*(band(i) for i in range(most + 1)))).alias("part", "bits"))
    a, b = keyed.alias("a"), keyed.alias("b")
    x = F.col("a.h").bitwiseXOR(F.col("b.h"))
    earlier = F.lit(False)
    first = F.lit(True)
    for i in range(most + 1):
        first = F.when(F.col("a.part") == i, ~earlier).otherwise(first)
        earlier = earlier | (F.shiftrightunsigned(x, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) == 0)
    same = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.bits") == F.col("b.bits"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.bit_count(x) <= most) & first).select(
        F.col("b.id").alias("upload_id"), F.col("a.id").alias("near_id"), bits_apart(F.col("a.h"), F.col("b.h")).alias("bits")
    )


def sources_of_duplicates(receipts: DataFrame, uploads: DataFrame) -> DataFrame:
    """For receipts marked as duplicates the source's upload number and receipt number; null where the source is gone or deleted."""
    d = receipts.where("is_duplicate").select("id", "duplicate_of_receipt_id")
    src = receipts.where("deleted_at IS NULL").select(F.col("id").alias("source_id"), F.col("upload_id").alias("source_upload_id"), F.col("user_receipt_number").alias("source_number"))
    up = uploads.select(F.col("id").alias("up_id"), F.col("upload_number").alias("up_number"))
    return (
        d.join(src, d.duplicate_of_receipt_id == src.source_id, "left").join(up, F.col("source_upload_id") == F.col("up_id"), "left")
        .select(F.col("id").alias("receipt_id"), "source_id", "source_number", F.when(F.col("source_id").isNotNull(), F.coalesce("up_number", F.lit(0))).alias("source_upload_number"))
    )
