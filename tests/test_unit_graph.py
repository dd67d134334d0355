import re
from decimal import ROUND_HALF_UP, Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyforge.operators.unit_graph import (
    CANONICAL, SPELLINGS, ConversionGraph, converted, default_graph, in_thousandths, normalised_quantities, spelling_list,
)

SCHEMA = "id long, item_type string, description string, amount decimal(10,3), unit string, price_per_unit decimal(13,4), total_price decimal(13,4), base_unit string"


def half_up(x: Fraction) -> int:
    return int((Decimal(x.numerator) / Decimal(x.denominator)).quantize(Decimal(1), ROUND_HALF_UP))


def brute(rows):
    """The statement of the problem row by row, with fractions and another way to parse."""
    factors = {s: (base, f.scale) for u, (base, f) in default_graph().to_canonical(CANONICAL).items() for s in spelling_list(SPELLINGS.get(u, u))}

    def number(t):
        total = Fraction(0)
        for x in t.split():
            total += Fraction(x)
        return total

    def measure(t):
        t = t.lower().replace("×", "x").replace("½", " 1/2").replace("¼", " 1/4").replace("¾", " 3/4")
        t = re.sub(r"(\d),(\d)", r"\1.\2", t)
        for m in re.finditer(r'(?<![\w./-])((?:\d+ ?x ?)?)((?:\d+ )?\d+/\d+|\d+(?:\.\d+)?)\s*("|[a-zöü]+\.?(?: oz| ounces?)?)', t):
            unit = m[3].strip(". ").replace(".", " ")
            for u in (unit, unit.split(" ")[0]):
                if u in factors:
                    base, f = factors[u]
                    content = f * number(m[2])
                    if u in spelling_list(SPELLINGS["lb"]) and (o := re.match(r"\s*(\d+)\s*(?:oz|ounce)", t[m.end(3):])):
                        content += int(o[1]) * factors["oz"][1]
                    return base, content * int(m[1].strip(" x") or 1)
        return None

    for r in rows:
        if r["item_type"] != "product":
            continue
        unit, amount, price, total = r["unit"] or "", r["amount"], r["price_per_unit"], r["total_price"]
        if unit.strip():
            plain = re.sub(r"\s+", " ", re.sub(r"\.(?!\d)", " ", unit.lower())).strip()
            found = factors.get(plain) or (measure(unit) if re.search(r"[\d½¼¾]", unit) else None)
            sized = plain not in factors
        else:
            found, sized = measure(r["description"] or ""), True
        if not found:
            continue
        base, content = found
        if amount is None and not sized:
            continue
        n = Fraction(amount) if amount is not None else Fraction(1)
        p = None if price is None else Fraction(price)
        if p and total is not None and amount is not None:
            due = n * p
            if abs(due - Fraction(total)) > Fraction(1, 100) >= abs(due / 1000 - Fraction(total)):
                yield r["id"], base, half_up(n), half_up(p * 100)
                continue
        yield r["id"], base, half_up(n * content * 1000), -1 if p is None else half_up(p / content * 100)


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in in_thousandths(normalised_quantities(df)).collect()}


def D(x):
    return None if x is None else Decimal(x)


def row(i, description, amount, unit, price=None, total=None, kind="product"):
    return (i, kind, description, D(amount), unit, D(price), D(total), "clash")


def test_cases(spark):
    rows = [
        row(1, "Apples", "0.703", "kgs", "2", "1.41"),
        row(2, "Apples", "743", "kg", "2.04", "1.52"),  # really grams
        row(3, "Rope", "3", "roll of 3 m", "17.61", "52.83"),
        row(4, "Jam", None, "1/2 kg", "3"),
        row(5, "Beef 3lb7oz", None, None),
        row(6, "Apple juice 2×500 ml @ 1,20", None, "  "),
        row(7, "Cable 3-core", None, None),
        row(8, "Cable 3-core 1 1/2 m", None, ""),
        row(9, "Pasta 1 kg", "2", "pcs", "1", "2"),
        row(10, "Wine", "2", "fl.oz", "1", "2"),
        row(11, "Tip 1 kg", "1", "kg", None, None, "tip"),
        row(12, None, None, None),
        row(13, "Milk", None, "l", "1"),
        row(14, "Plums ¾ kg", None, None),
        row(15, "Nails", "1", "col3", "1", "1"),
        row(16, "Tape", "2", '"', "1", "2"),
        row(17, "x " * 20000 + "0,5 l", None, None),
        row(19, "Penny", "1", "kg", "0.005", "0"),
        row(18, "Zero", "1", "0 g", "1", "1"),
        row(18, "Zero", "1", "kg", "1", "1"),
        row(18, "Zero", "1", "kg", "1", "1"),
    ]
    got = run(spark, rows)
    assert got == {
        (1, "kg", 703, 200), (2, "kg", 743, 204), (3, "m", 9000, 587), (4, "kg", 500, 600), (5, "kg", 1559, -1),
        (6, "l", 1000, -1), (8, "m", 1500, -1), (10, "l", 59, 3381), (14, "kg", 750, -1), (16, "m", 51, 3937),
        (17, "l", 500, -1), (18, "kg", 0, -1), (18, "kg", 1000, 100), (19, "kg", 1000, 1),
    }
    assert run(spark, []) == set()


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/line_items.parquet")
    rows = [r.asDict() for r in df.select("id", "item_type", "description", "amount", "unit", "price_per_unit", "total_price").collect()]
    want = set(brute(rows))
    got = {tuple(r) for r in in_thousandths(normalised_quantities(df)).collect()}
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])


def test_graph():
    g = ConversionGraph()
    g.add("C", "K", "1", "273.15")
    g.add("F", "C", Fraction(5, 9), Fraction(-160, 9))
    found = g.to_canonical(["K"])["F"][1]
    assert found.scale * 212 + found.offset == Fraction("373.15")
    g.add("F", "K", Fraction(5, 9))
    with pytest.raises(ValueError):
        g.to_canonical(["K"])
    with pytest.raises(ValueError):
        g.add("a", "b", "0")


def test_affine_units(spark):
    """Units with an offset are converted both ways, unknown ones and other dimensions give null, no row is lost."""
    graph = ConversionGraph()
    graph.add("c", "k", "1", "273.15")
    graph.add("f", "c", Fraction(5, 9), Fraction(-160, 9))
    graph.add("kg", "g", "1000")
    rows = [(1, 212.0, "F", "c"), (2, 0.0, "c", "f"), (3, 0.0, "k", "c"), (4, 2.0, "kg.", "g"), (5, 2.0, "kg", "c"), (6, 1.0, "stone", "g"), (7, None, "c", "k"), (8, 1.0, None, "k"), (1, 212.0, "F", "c")]
    df = spark.createDataFrame(rows, "id long, factor double, unit string, target string").withColumnRenamed("factor", "value")
    got = {r.id: r.converted for r in converted(df, "value", F.col("unit"), F.col("target"), graph, ["k", "kg"], {}).collect()}
    assert {k: None if v is None else round(v, 6) for k, v in got.items()} == {1: 100.0, 2: 32.0, 3: -273.15, 4: 2000.0, 5: None, 6: None, 7: None, 8: None}
    lines = [(1, "product", None, Decimal("20.000"), "c", None, None, "")]
    out = normalised_quantities(spark.createDataFrame(lines, SCHEMA), graph, ["k"]).collect()
    assert [(r.base_unit, float(r.quantity)) for r in out] == [("k", 293.15)]
