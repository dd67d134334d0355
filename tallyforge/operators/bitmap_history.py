"""History of changing entity attributes (problem 3), by presence bitmaps.

Every second in which an attribute of an entity changed is a *snapshot*. For each (entity,
attribute, value) the snapshots that show the value are set as bits; a run of set bits is a
period in which the value was valid, so a change that only rewrites the value in force extends a
run, and a value that comes back later starts a new one (gaps need no special case).

Bitmaps are kept per (entity, attribute, value, day), in words of 64 snapshots, one row a word; the
row also has the seconds of its set bits, so the log itself is not read again. A day with a single
snapshot, the usual case, is one bit and needs no aggregation. Where runs begin
comes from the words alone: the bits that are set while the bit before is not, without the first
bit of a word if the word before ends on the same value. Versions are numbered by counting such
bits. Words are chained within their day and days by one summary row a day, so an attribute that
holds a third of all changes is spread over as many tasks as it has days; a task never holds more
than the seconds of one day or the days of one attribute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.storage import materialize

GROUP = ["entity_type", "entity_id", "field_name"]
#: The same with the number first, by which sorting is quickest, and the day.
DAY = ["entity_id", "field_name", "entity_type", "day"]
#: Fields compared as numbers and as instants; all others are compared as text.
NUMBER_FIELDS = ("totalAmount", "taxAmount", "totalPrice", "amount", "pricePerUnit")
INSTANT_FIELDS = ("transactionDate",)
WORD = 64


def value_meaning(field: Column, value: Column) -> Column:
    """A fingerprint that two spellings share when they mean the same value of ``field``.

    Null has a fingerprint of its own. Text that is no number (no instant) in such a field is
    compared as text, as are the numbers that do not fit decimal(38, 10).
    """
    text = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    number = F.concat(F.lit("n"), text.try_cast("decimal(38,10)").cast("string"))
    zoned = F.when(text.rlike(r":\d\d(\.\d+)?$"), F.concat(text, F.lit("Z"))).when(
        text.rlike(r"^\d{4}-\d\d?-\d\d?$"), F.concat(text, F.lit(" 00:00:00Z"))
    )
    instant = F.concat(F.lit("i"), F.unix_micros(F.coalesce(zoned, text).try_cast("timestamp")).cast("string"))
    as_text = F.concat(F.lit("t"), text)
    meant = (
        F.when(field.isin(*NUMBER_FIELDS), F.coalesce(number, as_text))
        .when(field.isin(*INSTANT_FIELDS), F.coalesce(instant, as_text))
        .otherwise(as_text)
    )
    return F.xxhash64(F.coalesce(meant, F.lit("0")))


def snapshots(changes: DataFrame) -> DataFrame:
    """One row for each second in which an attribute changed: fingerprints of the value before and
    after it (``before``, ``after``), and the ids of the changes that name them.

    Equal changes of one second count once. The changes of a second form a chain old -> new, so
    the value after it is the one that is reached but not left, the value before it the one that
    is left but not reached: found by in- and out-degrees, in whatever order the rows came. A
    chain that closes (A -> B -> A) leaves the value as it was. Where rows of a second do not fit
    together, the newest id decides. Rows without changed_at are ignored. All that is aggregated
    here is of fixed width; texts stay behind.
    """
    edges = (
        changes.where(F.col("changed_at").isNotNull())
        .select(
            *GROUP,
            F.to_date("changed_at").alias("day"),
            F.date_trunc("second", "changed_at").cast("timestamp_ntz").alias("sec"),
            "id",
            value_meaning(F.col("field_name"), F.col("old_value")).alias("old_v"),
            value_meaning(F.col("field_name"), F.col("new_value")).alias("new_v"),
        )
        .repartition(*DAY)
        .groupBy(*DAY, "sec", "old_v", "new_v")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"))
    )
    ends = F.array(
        F.struct(F.col("new_v").alias("v"), F.lit(1).alias("d"), F.lit(None).cast("long").alias("left_by"), F.col("last").alias("reached_by")),
        F.struct(F.col("old_v").alias("v"), F.lit(-1).alias("d"), F.col("first").alias("left_by"), F.lit(None).cast("long").alias("reached_by")),
    )
    degrees = (
        edges.select(*DAY, "sec", F.inline(ends))
        .groupBy(*DAY, "sec", "v")
        .agg(F.sum("d").alias("d"), F.min("left_by").alias("left_by"), F.max("reached_by").alias("reached_by"))
    )
    at_end, at_start = F.col("d") > 0, F.col("d") < 0
    ended = degrees.groupBy(*DAY, "sec").agg(
        F.max_by(F.when(at_end, F.col("v")), F.when(at_end, F.col("reached_by"))).alias("end_v"),
        F.max(F.when(at_end, F.col("reached_by"))).alias("end_id"),
        F.min_by(F.when(at_start, F.col("v")), F.when(at_start, F.col("left_by"))).alias("start_v"),
        F.min(F.when(at_start, F.col("left_by"))).alias("start_id"),
        # a circle: where its first change began
        F.min_by("v", "left_by").alias("circle_v"),
        F.min("left_by").alias("circle_id"),
        F.max("reached_by").alias("newest_id"),
    )
    return ended.select(
        *DAY,
        "sec",
        F.coalesce("end_v", "circle_v").alias("after"),
        F.coalesce("end_id", "newest_id").alias("after_id"),
        F.coalesce("start_v", "circle_v").alias("before"),
        F.coalesce("start_id", "circle_id").alias("before_id"),
    )


def placed(snaps: DataFrame) -> DataFrame:
    """The snapshots with their place ``pos`` in the day, and whether they are ``alone`` in it."""
    in_day = Window.partitionBy(*DAY).orderBy("sec")
    pos = F.row_number().over(in_day) - 1
    return snaps.select("*", pos.alias("pos"), ((pos == 0) & F.lead("sec").over(in_day).isNull()).alias("alone"))


def presence(places: DataFrame) -> DataFrame:
    """The bitmaps: one row for each (entity, attribute, day), word of 64 snapshots and value.

    ``bits`` has a bit for each snapshot of the word that shows the value, ``seen`` their places,
    seconds and change ids in order (at most 64), ``before`` the value before the day's first
    snapshot and ``before_id`` its change (in the first word).
    """
    first = F.col("pos") == 0
    return places.groupBy(*DAY, F.floor(F.col("pos") / WORD).cast("int").alias("word"), F.col("after").alias("value")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(pos % {WORD} AS INT))")).alias("bits"),
        F.array_sort(F.collect_list(F.struct((F.col("pos") % WORD).cast("int").alias("bit"), "sec", F.col("after_id").alias("id")))).alias("seen"),
        F.max(F.when(first, F.col("before"))).alias("before"),
        F.max(F.when(first, F.col("before_id"))).alias("before_id"),
    )


def word_runs(bitmaps: DataFrame) -> DataFrame:
    """One row a word: the runs that begin in it (``starts``: bit, sec, id, in order), its first and last value.

    A run that goes on from the word before does not begin again; the first run of a day is always
    there, as whether it goes on from another day is settled by the days.
    """
    begins = F.expr("bits & ~shiftleft(bits, 1)")
    own = F.filter("seen", lambda x: F.call_function("getbit", F.col("begins"), x["bit"]) == 1)
    last_bit = F.expr("seen[size(seen) - 1].bit")
    words = bitmaps.withColumn("begins", begins).groupBy(*DAY, "word").agg(
        F.array_sort(F.flatten(F.collect_list(own))).alias("starts"),
        F.max(F.when(F.col("bits").bitwiseAND(F.lit(1)) == 1, F.col("value"))).alias("first_v"),
        F.max_by("value", last_bit).alias("last_v"),
        F.max("before").alias("before"),
        F.max("before_id").alias("before_id"),
    )
    in_day = Window.partitionBy(*DAY).orderBy("word")
    goes_on = F.coalesce(F.lag("last_v").over(in_day) == F.col("first_v"), F.lit(False))
    return words.withColumn("starts", F.when(goes_on, F.expr("slice(starts, 2, size(starts))")).otherwise(F.col("starts")))


def attribute_history(changes: DataFrame) -> DataFrame:
    """Every version of every attribute: (entity_type, entity_id, field_name, version_no, change_id,
    valid_from, valid_to), the bounds null where open.

    ``changes`` is receipt_edit_history; extra columns are not looked at. ``change_id`` is the change
    that set the value; version 1 holds the value before the first change, which is the old value of
    that change (``with_values`` adds the texts). A null entity or field is a group of its own; a
    null value is a value. An empty log gives no rows.
    """
    # written once and read where it is needed; what follows reads it, not the log
    places = materialize(placed(snapshots(changes)), "snapshots")
    # a day of one snapshot is a bitmap of one bit, and a run: there is nothing to aggregate
    single = places.where("alone").select(
        *DAY, F.col("after").alias("first_v"), F.col("after").alias("last_v"), "before", "before_id", F.lit(1).cast("long").alias("n"),
        F.col("sec").alias("sec_1"), F.lit(None).cast("timestamp_ntz").alias("sec_2"), F.col("after_id").alias("only_id"),
    )
    bitmaps = materialize(presence(places.where("NOT alone")), "presence")
    in_day = Window.partitionBy(*DAY).orderBy("word")
    # a frame that grows with the rows, in either order, is worked out in one pass; one that shrinks is not
    sooner, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (in_day, Window.partitionBy(*DAY).orderBy(F.col("word").desc())))
    words = word_runs(bitmaps).select(
        "*",
        F.coalesce(F.sum(F.size("starts")).over(sooner), F.lit(0)).alias("earlier"),
        F.last(F.expr("get(starts, 0).sec"), ignorenulls=True).over(after).alias("next_sec"),
    )
    several = words.groupBy(*DAY).agg(
        F.max_by("first_v", -F.col("word")).alias("first_v"),
        F.max_by("last_v", "word").alias("last_v"),
        F.max("before").alias("before"),
        F.max("before_id").alias("before_id"),
        F.sum(F.size("starts")).alias("n"),
        F.min(F.expr("get(starts, 0).sec")).alias("sec_1"),
        F.min(F.when(F.col("word") == 0, F.coalesce(F.expr("get(starts, 1).sec"), F.col("next_sec")))).alias("sec_2"),
        F.lit(None).cast("long").alias("only_id"),
    )
    days = single.unionAll(several)
    onward = Window.partitionBy(*DAY[:3]).orderBy("day")
    backward = Window.partitionBy(*DAY[:3]).orderBy(F.col("day").desc())
    earlier, later = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (onward, backward))
    days = (
        days.withColumn("prev_v", F.lag("last_v").over(onward))
        .withColumn("same", F.coalesce("prev_v", "before") == F.col("first_v"))
        .withColumn("new", F.col("n") - F.col("same").cast("int"))
        .withColumn("start", F.when(F.col("same"), F.col("sec_2")).otherwise(F.col("sec_1")))
        .withColumn("offset", F.coalesce(F.sum("new").over(earlier), F.lit(0)) + 1)
        .withColumn("next_start", F.last("start", ignorenulls=True).over(later))
    )
    # read by three parts of the result
    days = materialize(days.withColumn("alone", F.col("sec_2").isNull() & (F.col("n") == 1) & F.col("only_id").isNotNull()), "attribute-days")
    first = days.where(F.col("prev_v").isNull()).select(
        *GROUP,
        F.lit(1).alias("version_no"),
        F.col("before_id").alias("change_id"),
        F.lit(None).cast("timestamp_ntz").alias("valid_from"),
        F.coalesce("start", "next_start").alias("valid_to"),
    )
    lone = days.where("alone AND NOT same").select(
        *GROUP, (F.col("offset") + 1).cast("int").alias("version_no"), F.col("only_id").alias("change_id"), F.col("sec_1").alias("valid_from"), F.col("next_start").alias("valid_to")
    )
    w, d = words.alias("w"), days.where("NOT alone").select(*DAY, "same", "offset", "next_start").alias("d")
    same_day = [F.col(f"w.{c}").eqNullSafe(F.col(f"d.{c}")) for c in DAY]
    number = F.col("offset") + F.col("earlier") + F.col("at") + 1 - F.col("same").cast("int")
    rest = (
        w.join(d, same_day)
        .select(*(F.col(f"w.{c}").alias(c) for c in GROUP), "word", "starts", "earlier", "next_sec", "same", "offset", "next_start", F.posexplode("starts").alias("at", "run"))
        .where((F.col("earlier") + F.col("at") > 0) | ~F.col("same"))
        .select(
            *GROUP,
            number.cast("int").alias("version_no"),
            F.col("run.id").alias("change_id"),
            F.col("run.sec").alias("valid_from"),
            F.coalesce(F.expr("get(starts, at + 1).sec"), "next_sec", "next_start").alias("valid_to"),
        )
    )
    return first.unionAll(lone).unionAll(rest)


def with_values(history: DataFrame, changes: DataFrame) -> DataFrame:
    """The versions with ``value``, the text as the change that set it spells it."""
    texts = changes.select(F.col("id").alias("change_id"), "old_value", "new_value").dropDuplicates(["change_id"])
    value = F.when(F.col("version_no") == 1, F.col("old_value")).otherwise(F.col("new_value")).alias("value")
    return history.join(texts, "change_id").select(*GROUP, "version_no", value, "valid_from", "valid_to")


def valid_at(history: DataFrame, moment: str) -> DataFrame:
    """The versions (with their values) in force at ``moment`` (a timestamp string)."""
    at = F.lit(moment).cast("timestamp_ntz")
    return history.where(
        (F.col("valid_from").isNull() | (F.col("valid_from") <= at))
        & (F.col("valid_to").isNull() | (F.col("valid_to") > at))
    ).select(*GROUP, "version_no", "value")
