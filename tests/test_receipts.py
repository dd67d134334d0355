from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from tallyforge.operators.receipt_duplicates import best_matches, candidate_pairs, owned_receipts, scored_pairs

AT = datetime(2024, 6, 15, 10, 0)
BASE = {"store": "Hofer", "total": "10.00", "tax": "1.00", "at": AT, "items": 5, "status": "processed"}


def best(spark, current, candidate=None, user=1):
    rows, items, uploads = [], [], [(1, 1), (2, user)]
    for i, r in ((1, BASE | current), (2, BASE | (candidate or {}))):
        rows.append((i, i, r["store"], r["total"] and Decimal(r["total"]), Decimal(r["tax"]), r["at"], r["status"]))
        items += [(100 * i + k, i) for k in range(r["items"])]
    receipts = spark.createDataFrame(rows, "id long, upload_id long, store_name string, total_amount decimal(13,4), tax_amount decimal(13,4), transaction_date timestamp_ntz, status string")
    owned = owned_receipts(receipts, spark.createDataFrame(uploads, "id long, user_id long"), spark.createDataFrame(items, "id long, receipt_id long"))
    got = {r.id: (r.score, r["class"]) for r in best_matches(scored_pairs(candidate_pairs(owned))).collect()}
    return got.get(1)


@pytest.mark.parametrize(
    ("current", "expected"),
    [
        ({}, (99, "DEFINITE_DUPLICATE")), ({"at": AT + timedelta(minutes=2)}, (99, "DEFINITE_DUPLICATE")), ({"at": AT - timedelta(minutes=2)}, (88, "LIKELY_DUPLICATE")),
        ({"at": AT + timedelta(minutes=30)}, (97, "DEFINITE_DUPLICATE")), ({"total": "10.01"}, (99, "DEFINITE_DUPLICATE")), ({"total": None}, (99, "DEFINITE_DUPLICATE")),
        ({"at": None}, (80, "POSSIBLE_DUPLICATE")), ({"items": 4}, (97, "DEFINITE_DUPLICATE")), ({"store": "Lidl"}, (70, "POSSIBLE_DUPLICATE")), ({"at": AT + timedelta(days=5)}, None),
    ],
)
def test_scores(spark, current, expected):
    assert best(spark, current) == expected


def test_who_is_a_candidate(spark):
    assert best(spark, {}, user=2) is None
    assert best(spark, {}, {"status": "failed"}) is None
    assert best(spark, {"at": None}, {"at": datetime(2024, 6, 15)}) == (99, "DEFINITE_DUPLICATE")
