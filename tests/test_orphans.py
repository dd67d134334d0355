from collections import Counter
from datetime import datetime

import pytest

from tallyforge.operators import orphans
from tallyforge.operators.orphans import OrphanCheck, Reference

D = datetime


def frames(spark, refs, targets):
    rows = spark.createDataFrame(refs, "id long, parent long, created_at timestamp_ntz, target_id long, deleted_at string")
    return rows, spark.createDataFrame(targets, "id long, deleted_at timestamp_ntz, created_at timestamp_ntz, row_id long")


def found(spark, refs, targets, **params):
    return sorted((tuple(r)[2:] for r in check(spark, refs, targets, **params).references().collect()), key=str)


def check(spark, refs, targets, **params):
    rows, t = frames(spark, refs, targets)
    return OrphanCheck({"rows": rows, "others": t}, (Reference("rows", "parent", "others"),), **params)


REFS = [
    (1, 10, D(2024, 1, 5), 0, ""), (2, 11, D(2024, 1, 5), 0, ""), (3, 12, D(2024, 2, 5), 0, ""), (4, 99, D(2024, 2, 5), 0, ""), (5, None, D(2024, 2, 5), 0, ""),
    (6, 11, D(2023, 1, 5), 0, ""), (7, 99, None, 0, ""), (8, 11, D(2024, 1, 1), 0, ""), (9, 13, D(2024, 1, 1), 0, ""), (4, 99, D(2024, 2, 5), 0, ""),
] + [(100 + i, 12, D(2024, 3, 1), 0, "") for i in range(30)] + [(200 + i, 98, D(2024, 3, 1), 0, "") for i in range(30)]
TARGETS = [(10, None, D(2024, 1, 1), 0), (11, D(2024, 1, 1), D(2023, 6, 1), 0), (12, None, D(2024, 2, 6), 0), (13, None, None, 0)]
WANT = sorted(
    [(2, "2024-01", "deleted"), (3, "2024-02", "late"), (4, "2024-02", "missing"), (4, "2024-02", "missing"), (6, "2023-01", "late"), (7, None, "missing"), (8, "2024-01", "deleted")]
    + [(200 + i, "2024-03", "missing") for i in range(30)],
    key=str,
)


def test_cases(spark):
    # row 6: created before the target, which was deleted later still
    assert sorted(found(spark, REFS, TARGETS), key=str) == WANT


@pytest.mark.parametrize("sent", [200_000, 0])
def test_heavy_keys_give_the_same(spark, monkeypatch, sent):
    """Heavy keys apart, and failing keys too many to be sent, which then are salted."""
    monkeypatch.setattr(orphans, "FAILING_SENT", sent)
    c = check(spark, REFS, TARGETS, heavy_share=0.1, heavy_floor=5)
    assert sorted(c.heavy) == [(0, 12), (0, 98)]
    assert sorted((tuple(r)[2:] for r in c.references().collect()), key=str) == WANT


def test_empty(spark):
    assert found(spark, [], TARGETS) == []
    assert found(spark, REFS[:1], []) == [(1, "2024-01", "missing")]


def test_report(spark):
    """The counts are those of the rows, for keys that fail throughout a month and in part of it."""
    report = {tuple(r)[2:]: r.n_refs for r in check(spark, REFS, TARGETS).counts().select("ref_table", "ref_field", "ref_month", "ref_kind", "n_refs").collect()}
    want = Counter((m, k) for _, m, k in WANT)
    assert {(m, k): n for (m, k, n), _ in report.items()} == want
