import random
from datetime import datetime, timedelta
from decimal import Decimal, InvalidOperation

from tallyforge.operators.bitmap_history import NUMBER_FIELDS, attribute_history, with_values

SCHEMA = "id long, entity_type string, entity_id long, field_name string, old_value string, new_value string, changed_at timestamp_ntz, day string, v string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    return sorted(
        ((r.entity_type or "", r.entity_id or 0, r.field_name or "", r.version_no, r.value, str(r.valid_from or ""), str(r.valid_to or "")) for r in with_values(attribute_history(df), df).collect()),
        key=str,
    )


def meaning(field, value):
    if value is None:
        return None
    text = " ".join(value.split())
    if field in NUMBER_FIELDS:
        try:
            return Decimal(text)
        except InvalidOperation:
            pass
    return text


def brute(rows):
    """Row by row: order the changes of a second as a chain, and open a version at each new meaning."""
    groups = {}
    for r in rows:
        if r[6] is not None:
            groups.setdefault((r[1] or "", r[2] or 0, r[3] or ""), []).append(r)
    out = []
    for (kind, entity, field), changes in groups.items():
        seconds = {}
        for r in changes:
            seconds.setdefault(r[6].replace(microsecond=0), set()).add((meaning(field, r[4]), meaning(field, r[5])))
        starts, now, first = [], None, True
        for at in sorted(seconds):
            edges = {e for e in seconds[at]}
            reached, left = [b for a, b in edges if a != b], [a for a, b in edges if a != b]
            if first:
                begin = [a for a in left if left.count(a) > reached.count(a)]
                now, first = begin[0] if begin else next(iter(edges))[0], False
            end = [b for b in reached if reached.count(b) > left.count(b)]
            after = end[0] if end else now
            if not reached:
                after = next(iter(edges))[1]
            if after != now:
                starts.append(at)
                now = after
        bounds = ["", *map(str, starts), ""]
        out += [(kind, entity, field, n + 1, bounds[n], bounds[n + 1]) for n in range(len(starts) + 1)]
    return sorted(out, key=str)


def test_cases(spark):
    at = lambda s: datetime(2024, 1, 1, 10, 0, s)
    rows = [
        (1, "receipt", 1, "totalAmount", "1.0", "1.00", at(1)),  # the same number
        (2, "receipt", 1, "totalAmount", "1.0", "+2", at(2)),
        (3, "receipt", 1, "totalAmount", "+2", "2.000", at(3)),
        (4, "receipt", 1, "totalAmount", "2", None, at(4)),
        (5, "receipt", 1, "totalAmount", None, "2", at(5)),
        (7, "receipt", 2, "unit", "b", "c", at(1)),  # b -> c after a -> b, although its id is smaller
        (8, "receipt", 2, "unit", "a", "b", at(1)),
        (9, "receipt", 2, "unit", "a", "b", at(1)),
        (10, None, None, None, "x", "y", at(1)),
        (11, "receipt", 3, "unit", "x", "y", None),
        (12, "receipt", 4, "storeName", "a  b", " a b", at(1)),
        (13, "receipt", 5, "transactionDate", "2024-01-01", "2024-01-01T00:00:00.000Z", at(1)),
        (14, "receipt", 6, "description", "x" * 100_000, "y" * 100_000, at(1)),
    ]
    got = [(r[0], r[1], r[2], r[3], r[5], r[6]) for r in run(spark, rows)]
    t = lambda s: f"2024-01-01 10:00:0{s}"
    assert got == sorted(
        [
            ("receipt", 1, "totalAmount", 1, "", t(2)), ("receipt", 1, "totalAmount", 2, t(2), t(4)), ("receipt", 1, "totalAmount", 3, t(4), t(5)),
            ("receipt", 1, "totalAmount", 4, t(5), ""), ("receipt", 2, "unit", 1, "", t(1)), ("receipt", 2, "unit", 2, t(1), ""),
            ("", 0, "", 1, "", t(1)), ("", 0, "", 2, t(1), ""), ("receipt", 4, "storeName", 1, "", ""), ("receipt", 5, "transactionDate", 1, "", ""),
            ("receipt", 6, "description", 1, "", t(1)), ("receipt", 6, "description", 2, t(1), ""),
        ],
        key=str,
    )
    values = {(r[1], r[2], r[3]): r[4] for r in run(spark, rows)}
    assert [values[1, "totalAmount", n] for n in (1, 2, 3, 4)] == ["1.0", "+2", None, "2"] and values[2, "unit", 1] == "a" and values[2, "unit", 2] == "c"
    assert run(spark, []) == []


def test_one_attribute_with_most_changes(spark):
    """A hot attribute over many days, more than 64 snapshots a day, against brute force."""
    r = random.Random(7)
    rows, value, at = [], "0", datetime(2024, 1, 1)
    for i in range(700):
        at += timedelta(seconds=r.choice([0, 1, 5, 60, 3600]))
        new = r.choice(["0", "1", "1.0", " 2", "+2", None])
        if rows and rows[-1][6] == at:
            new = str(1000 + i)  # chains of a second must not close
        rows.append((i, "receipt", 1, "totalAmount", value, new, at))
        value = new
    rows += [(1000 + i, "receipt", 2 + i, "unit", "a", "b", datetime(2024, 1, 1)) for i in range(20)]
    r.shuffle(rows)
    got = [(x[0], x[1], x[2], x[3], x[5], x[6]) for x in run(spark, rows)]
    assert got == brute(rows)
