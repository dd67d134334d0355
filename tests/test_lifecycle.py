"""Nulls, repeats, empty tables and clashing columns of the state changes, and clearing of written tables."""

from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import lifecycle
from tallyforge.storage import clear_tables, materialize

LINES = "id long, receipt_id long, item_type string, description string, amount decimal(10,3), unit string, price_per_unit decimal(13,4), total_price decimal(13,4), is_user_added boolean, deleted_at timestamp_ntz, named_id string"
HISTORY = "id long, entity_type string, entity_id long, field_name string, old_value string, new_value string, changed_by long, changed_at timestamp_ntz"
AT = datetime(2024, 1, 1)


def line(i, receipt, **more):
    row = dict(id=i, receipt_id=receipt, item_type="product", description="d", amount=Decimal(1), unit="pc", price_per_unit=None, total_price=Decimal(5), is_user_added=False, deleted_at=None, named_id="clash")
    return tuple((row | more).values())


def test_reset_items(spark):
    lines = [line(1, 1, deleted_at=AT), line(2, 1, is_user_added=True), line(3, None), line(4, 2, deleted_at=AT), line(5, 1, is_user_added=None), line(1, 1, deleted_at=AT)]
    edits = [(1, "line_item", 1, "description", None, "d", 1, AT), (2, "line_item", 1, "unit", None, "pc", 1, AT), (3, "line_item", 1, "totalPrice", "7.5", "5", 1, AT), (4, "line_item", 1, "amount", "many", "1", 1, AT),
             (5, "line_item", 1, "totalPrice", "9", "7.5", 1, datetime(2024, 2, 1))]
    named = spark.createDataFrame([(1,), (1,), (None,)], "id long")
    got = lifecycle.reset_items(spark.createDataFrame(lines, LINES), spark.createDataFrame(edits, HISTORY), named, F.lit("2025-01-01").cast("timestamp_ntz"))
    assert got.columns == [c.split()[0] for c in LINES.split(", ")]
    rows = sorted(got.select("id", "description", "amount", "unit", "total_price", F.col("deleted_at").isNotNull()).collect())
    first = (1, "d", None, None, Decimal("7.5"), False)
    assert [tuple(r) for r in rows] == [first, first, (2, "d", Decimal(1), "pc", Decimal(5), True), (3, "d", Decimal(1), "pc", Decimal(5), False), (4, "d", Decimal(1), "pc", Decimal(5), True), (5, "d", Decimal(1), "pc", Decimal(5), False)]


def test_appended_ids_and_empty_tables(spark):
    lines = spark.createDataFrame([line(7, 1), line(9, 2)], LINES)
    new = spark.createDataFrame([(3, "b", Decimal(2)), (3, "a", None), (None, None, None)], "receipt_id long, description string, total_price decimal(13,4)")
    got = lifecycle.with_new_items(lines, new)
    assert [(r.id, r.receipt_id, r.description, r.item_type, r.is_user_added) for r in got.where("id > 9").orderBy("id").collect()] == [
        (10, None, None, "product", True), (11, 3, "a", "product", True), (12, 3, "b", "product", True)
    ]
    assert lifecycle.with_new_items(lines, new.limit(0)).count() == 2
    assert [r.id for r in lifecycle.with_new_items(lines.limit(0), new).orderBy("id").collect()] == [1, 2, 3]
    after, changes = lifecycle.without_items(lines, spark.createDataFrame([(7,), (7,), (99,), (None,)], "id long"), F.lit(AT))
    assert sorted((r.id, r.deleted_at) for r in after.collect()) == [(7, AT), (9, None)] and [r.entity_id for r in changes.collect()] == [7]


def test_unnamed_rows_stay(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, None), (2, None)], "id long, named_id string")
    named = spark.createDataFrame([(2,), (None,)], "id long")
    assert sorted(lifecycle.without(rows, "id", named).select("id").collect(), key=str) == sorted([(1,), (None,)], key=str)
    assert lifecycle.without(rows, "id", named.limit(0)).count() == 4


def test_clear_tables(spark):
    clear_tables(spark)
    df = materialize(spark.range(3), "cleared")
    path = df.inputFiles()[0]
    assert clear_tables(spark) == 1 and clear_tables(spark) == 0
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
