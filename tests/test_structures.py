from datetime import date, datetime

from pyspark.sql import functions as F

from tallyforge.functions import structures as st
from tallyforge.operators.edits import change_rows
from tallyforge.sources.exports import ITEM_COLUMNS, item_rows, write_lines
from tallyforge.sources.images import image_files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_json_objects(spark):
    read = lambda t: one(spark, F.transform(st.json_objects(F.lit(t), "struct<a:int>"), lambda s: s["a"]))
    assert read('{"a": 1}') == [1] and read(' [{"a": 1}, {"a": 2}]') == [1, 2] and read("no") is None


def test_difference_bits(spark):
    falling, rising = [9 - i % 9 for i in range(72)], [i % 9 for i in range(72)]
    first = [5, 1] + [1] * 70
    bits = lambda g: one(spark, st.difference_bits(F.array(*map(F.lit, g))))
    assert bits(falling) == -1 and bits(rising) == 0 and bits(first) == -(2**63) and bits([1, 2]) is None


def test_boxes_days_turns(spark):
    box = one(spark, st.clamped_box(*map(F.lit, (500, 900, -5, 1200))))
    assert (box.x, box.y, box.width, box.height) == (900.0, 0.0, 100.0, 500.0)
    assert one(spark, st.clamped_box(*map(F.lit, (1, 1, 1, 5)))) is None
    assert one(spark, st.turn_back(F.lit(90), F.lit(3.0), 2.0)) == 270 and one(spark, st.turn_back(F.lit(90), F.lit(1.0), 2.0)) == 0
    assert one(spark, st.day_time(F.lit("2024-06-15"), F.lit(None).cast("string"))) == datetime(2024, 6, 15)
    swap = lambda d: one(spark, st.not_in_future(F.lit(d).cast("date"), F.lit("2026-05-01").cast("date")))
    assert swap("2026-07-04") == date(2026, 4, 7) and swap("2099-06-15") == date(2099, 6, 15) and swap("2020-01-01") == date(2020, 1, 1)


def test_image_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\x89PNG\r\n\x1a\n....")
    (tmp_path / "b").write_bytes(b"RIFF\x01\x02\x03\x04WEBPVP8 ")
    (tmp_path / "c").write_bytes(b"\xff\xd8\xff" + b"x" * 100)
    (tmp_path / "d").write_bytes(b"")
    (tmp_path / "e").write_bytes(b"text")
    got = {r.path[-1]: (r.kind, r.accepted, r.stored_name.endswith("." + (r.kind or "bin"))) for r in image_files(spark, str(tmp_path), 50).collect()}
    assert got == {"a": ("png", True, True), "b": ("webp", True, True), "c": ("jpeg", False, True), "e": (None, False, True)}


def test_changes_between_states(spark):
    schema = "id long, a string, b int"
    before = spark.createDataFrame([(1, "x", 1), (2, None, 2)], schema)
    after = spark.createDataFrame([(1, "x", 2), (2, "y", 2)], schema)
    assert sorted(map(tuple, change_rows(before, after, "id", ["a", "b"]).collect())) == [(1, "b", "1", "2"), (2, "a", None, "y")]


def test_export_files(spark, tmp_path):
    read = lambda n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet")
    users = read("users")
    rows = item_rows(read("receipts"), read("receipt_uploads"), users, read("line_items"))
    write_lines(rows, users, ITEM_COLUMNS, "item_id", str(tmp_path / "out"))
    for folder in (tmp_path / "out").glob("user_id=*"):
        files = list(folder.glob("*.txt"))
        assert len(files) == 1
        lines = files[0].read_text().splitlines()
        ids = [int(x.replace(";", ",").split(",")[0]) for x in lines if not x.startswith("Item ID")]
        assert ids == sorted(ids) and not any(x.startswith("Item ID") for x in lines[1:])
