import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import window_packing
from tallyforge.llm.window_packing import Limits, pack, packed_windows, window_use

WINDOWS = "window_id long, capacity_tokens int, tokens int"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_every_text_once_and_whole(spark, documents, monkeypatch):
    monkeypatch.setattr(window_packing, "SHARD_ITEMS", 40)
    extra = spark.createDataFrame([(900_001, None), (900_002, ""), (900_003, "word " * 30_000), (900_004, "a\nb"), (900_004, "a\nb")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionAll(extra).withColumn("container", F.lit("clash"))
    windows = spark.createDataFrame([(1, 256, 0), (2, 512, 0), (4, 8192, 0), (9, None, 0)], WINDOWS)
    got = rows_of(packed_windows(docs, windows))
    sizes = {r["doc_id"]: r["tokens"] for r in window_packing.measured(docs).collect()}
    capacity = {1: 256, 2: 512, 4: 8192}
    pieces, containers = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        if r["container"]:
            containers.setdefault(r["container"], []).append(r)
    assert set(pieces) == set(sizes)
    for doc, rows in pieces.items():
        times = 2 if doc == 900_004 else 1
        assert sum(r["n_tokens"] for r in rows) == sizes[doc] * times
        if 0 < sizes[doc] <= 8192:
            assert len(rows) == times
        if sizes[doc] == 0:
            assert rows[0]["container"] is None
    for rows in containers.values():
        top = Limits().of(capacity[rows[0]["window_id"]])
        assert sum(r["n_tokens"] for r in rows) <= top[0]
        assert len({r["window_id"] for r in rows}) == 1
        if len(rows) > 1:
            assert len(rows) <= top[1] and sum(r["loss_tokens"] for r in rows) <= top[2]
        rows.sort(key=lambda r: r["position"])
        at = 0
        for k, r in enumerate(rows):
            assert (r["position"], r["start_token"]) == (k, at)
            at += r["n_tokens"]


def test_little_room_is_left(spark, documents):
    windows = spark.read.parquet("/root/testdata/sf0.001/pack_windows.parquet")
    use = rows_of(window_use(packed_windows(documents, windows), windows))
    unused, used = sum(r["unused_tokens"] for r in use), sum(r["tokens"] for r in use)
    assert unused < 0.05 * used


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    windows = spark.createDataFrame([(1, 256, 0)], WINDOWS)
    assert rows_of(packed_windows(none, windows)) == []
    assert [r["container"] for r in rows_of(packed_windows(some, windows.limit(0)))] == [None]


def test_pack_keeps_the_limits():
    r = np.random.default_rng(1)
    tokens = r.integers(1, 4000, 400)
    loss = (tokens * r.random(400)).astype(int)
    where, closed = pack(tokens, loss, [512, 4096])
    for k, capacity in enumerate(closed):
        at = where == k
        assert tokens[at].sum() <= capacity and (at.sum() == 1 or (at.sum() <= Limits().of(capacity)[1] and loss[at].sum() <= Limits().of(capacity)[2]))
    assert (where >= 0).all() and tokens.sum() > 0.95 * sum(closed)


def test_many_capacities(spark):
    """The largest of thousands of capacities takes the text whole, and the smallest that fits is found."""
    docs = spark.createDataFrame([(1, "word " * 3_000)], "doc_id long, text string")
    tokens = window_packing.measured(docs).first().tokens
    windows = spark.createDataFrame([(c, c, 0) for c in range(tokens - 2_499, tokens + 1)], WINDOWS)
    got = [(r["piece_no"], r["n_tokens"], r["window_id"]) for r in rows_of(packed_windows(docs, windows))]
    assert got == [(0, tokens, tokens)]


def test_limits_are_parameters(spark, documents):
    """A container that takes two segments at most holds no more, whatever its tokens."""
    windows = spark.createDataFrame([(1, 64, 0), (4, 8192, 0)], WINDOWS)
    got = packed_windows(documents, windows, limits=Limits(tokens_a_segment=4096, loss_share=1.0)).where("container IS NOT NULL")
    assert got.groupBy("container").count().agg(F.max("count")).first()[0] == 2
