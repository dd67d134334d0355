import pytest
from pyspark.sql import functions as F

from tallyforge.functions import numbers, ocr, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    ("written", "expected"),
    [
        ("1,99", [1.99]), ("1.99", [1.99]), ("1.234,56", [1234.56]), ("1,234.56", [1234.56]), ("1.485", [1.485, 1485.0]), ("42", [42.0]),
        ("Milk  1,50\nBread  2,00\nTOTAL  3,50", [1.5, 2.0, 3.5]), ("Total: 69, 99", [69.99]), ("€1.485/L", [1.485, 1485.0]), ("No prices here!", []), (None, []), ("", []),
    ],
)
def test_numbers_in_text(spark, written, expected):
    [(got,)] = values(spark, [(written,)], "t string", ocr.numbers_in(F.col("t")))
    assert got == expected


def test_similarity(spark):
    rows = [("Hofer", "HOFER!"), ("Hofer", None), ("", "x"), ("---", "***"), ("abcd", "abce")]
    got = [x for (x,) in values(spark, rows, "a string, b string", text.similarity_percent(F.col("a"), F.col("b")))]
    assert got == [100.0, 0.0, 0.0, 100.0, 75.0]


def test_amounts_and_dates(spark):
    rows = [("1.005", "decimal", ","), ("1.688", "cents", "."), ("1.688", "integer4dp", "."), (None, "decimal", "."), ("-2.5", "decimal", ".")]
    amount = numbers.formatted_amount(F.col("v").cast("decimal(13,4)"), F.col("s"), F.col("p"))
    assert [x for (x,) in values(spark, rows, "v string, s string, p string", amount)] == ["1,01", "169", "16880", "", "-2.50"]
    day = numbers.formatted_date(F.to_timestamp("d"), F.col("s"))
    rows = [("2024-06-15 10:00:00", "DD.MM.YYYY"), ("2024-06-15 10:00:00", "MM/DD/YYYY"), ("2024-06-15 10:00:00", None), (None, "x")]
    assert [x for (x,) in values(spark, rows, "d string, s string", day)] == ["15.06.2024", "06/15/2024", "2024-06-15", ""]


def test_day_difference_depends_on_the_direction(spark):
    rows = [("2024-06-15 10:00:00", "2024-06-15 10:02:00")]
    columns = [F.to_timestamp("a"), F.to_timestamp("b")]
    assert values(spark, rows, "a string, b string", numbers.day_difference(*columns), numbers.day_difference(*columns[::-1])) == [(1, 0)]


def test_text_helpers(spark):
    row = [('a "b"', "/files/x.webp", "/", "```json\n{}\n```", "x" * 200 + "Total" + "y" * 200)]
    [got] = values(
        spark, row, "q string, u string, e string, f string, t string", text.csv_quoted(F.col("q")), text.url_file_name(F.col("u")), text.url_file_name(F.col("e")),
        text.without_code_fence(F.col("f")), F.length(text.text_around(F.col("t"), "total")), text.path_of(F.lit("a.webp")), text.joined(F.array(F.lit("a"), F.lit(None), F.lit("b"))),
    )
    assert got == ('"a ""b"""', "x.webp", "unknown.jpg", "{}", 165, "uploads/a.webp", "a; b")


def test_hash_bits(spark):
    rows = [("ffffffffffffffff", "0000000000000000"), ("8000000000000000", "0000000000000000")]
    assert values(spark, rows, "a string, b string", numbers.bits_apart(numbers.hash_bits(F.col("a")), numbers.hash_bits(F.col("b")))) == [(64,), (1,)]
