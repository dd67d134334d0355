import random

from pyspark.sql import functions as F

from tallyforge.operators.upload_stats import numbered
from tallyforge.streaming.jobs import after_limit


def test_numbers_over_many_buckets(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, None]), i * 3) for i in range(500)]
    got = {(x.owner, x.id): x.number for x in numbered(spark.createDataFrame(rows, "owner long, id long"), "owner", "id", span=40).collect()}
    seen = {}
    for owner, i in sorted(rows, key=lambda x: x[1]):
        seen[owner] = seen.get(owner, 0) + 1
        assert got[owner, i] == seen[owner]


def test_after_limit(spark):
    rows = [(1, 1, False), (1, 2, True), (1, 3, False), (1, 4, True), (2, 1, False), (None, 1, True), (None, 2, False), (3, None, False)]
    df = spark.createDataFrame(rows, "upload long, step long, hit boolean").withColumn("clash", F.lit(1))
    got = {(x.upload, x.step): x.skipped for x in after_limit(df, "upload", "step", "hit").collect()}
    assert got == {(1, 1): False, (1, 2): False, (1, 3): True, (1, 4): True, (2, 1): False, (None, 1): False, (None, 2): True, (3, None): False}
    assert after_limit(df.limit(0), "upload", "step", "hit").collect() == []
