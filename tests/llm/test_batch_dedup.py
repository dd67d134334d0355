import random
from decimal import Decimal

import pytest

from tallyforge.llm import batch_dedup
from tallyforge.llm.batch_dedup import LinkageState, repeated_uploads, upload_fields

UPLOADS = "id long, user_id long, batch_no int, image_hash string, perceptual_hash string, total long, old boolean"
RECEIPTS = "id long, upload_id long, total_amount decimal(13,4), user_id string"


def world(seed, n=260):
    r = random.Random(seed)
    seeds = [r.getrandbits(64) for _ in range(12)]
    uploads, receipts = [], []
    for i in range(1, n + 1):
        h = r.choice(seeds)
        for _ in range(r.choice([0, 0, 1, 2, 3, 4, 7, 10, 11, 20])):
            h ^= 1 << r.randrange(64)
        p = f"{h:016x}"
        image = r.choice([f"{r.randrange(400):064x}", f"{r.getrandbits(200):064x}", None])
        uploads.append((
            i, r.choice([1, 1, 1, 1, 2, 3, None]), 0 if i < n // 2 else min(8, 1 + (i - n // 2) * 8 // (n // 2)),
            r.choice([str.upper, str, lambda x: f" {x} "])(image) if image else None, r.choice([p, p.upper(), f" {p}", None]), 5, True,
        ))
        for k in range(r.choice([0, 1, 1, 2])):
            receipts.append((1000 * i + k, i, r.choice([None, Decimal(r.randrange(990, 1010)) / 100, Decimal("5.00")]), "clash"))
    return uploads, receipts


def brute(uploads, receipts):
    totals = {}
    for _, u, t, _ in receipts:
        if t is not None:
            totals[u] = totals.get(u, 0) + t
    accepted, out = {}, set()
    for i, user, batch, image, p, *_ in sorted(uploads):
        image, p, t = image and int(image, 16), p and int(p, 16), totals.get(i)
        hit = None
        for j, image2, p2, t2 in accepted.get(user, []) if batch and user is not None else []:
            bits = 99 if p is None or p2 is None else (p ^ p2).bit_count()
            both = t is not None and t2 is not None
            if (image is not None and image == image2) or (both and abs(t - t2) <= Decimal("0.05") and bits <= 10) or (not both and bits <= 3):
                hit = j
                break
        if hit is None:
            accepted.setdefault(user, []).append((i, image, p, t))
        else:
            out.add((hit, i))
    return out


@pytest.mark.parametrize(("hot", "small"), [(2000, 20_000), (3, 20_000), (2000, 0), (3, 0)])
def test_against_brute_force(spark, monkeypatch, hot, small):
    monkeypatch.setattr(batch_dedup, "HOT", hot)
    monkeypatch.setattr(batch_dedup, "SMALL_BATCH", small)
    uploads, receipts = world(3)
    u, r = spark.createDataFrame(uploads, UPLOADS), spark.createDataFrame(receipts, RECEIPTS)
    assert {tuple(x) for x in repeated_uploads(u, r).collect()} == brute(uploads, receipts)


def test_batch_after_batch_is_the_same(spark):
    uploads, receipts = world(5, 160)
    fields = upload_fields(spark.createDataFrame(uploads, UPLOADS), spark.createDataFrame(receipts, RECEIPTS))
    state = LinkageState(spark)
    state.accept(fields.where("batch_no = 0"))
    got = set()
    for cut in ((1, 4), (5, 8)):
        got |= {(x.representative, x.upload_id) for x in state.add_batch(fields.where(f"batch_no BETWEEN {cut[0]} AND {cut[1]}")).collect()}
    assert got == brute(uploads, receipts)


def test_empty(spark):
    u, r = spark.createDataFrame([], UPLOADS), spark.createDataFrame([], RECEIPTS)
    assert repeated_uploads(u, r).collect() == []
    one = spark.createDataFrame([(1, 1, 3, "zz", "not hex", 0, False), (2, 1, 3, "zz", "not hex", 0, False)], UPLOADS)
    assert repeated_uploads(one, r).collect() == []


def test_another_session_goes_on(spark, monkeypatch, tmp_path):
    """The state is saved and loaded between batches, its keys in slots; the rows are those of one call."""
    monkeypatch.setattr(batch_dedup, "SLOT_KEYS", 20)
    uploads, receipts = world(7, 160)
    fields = upload_fields(spark.createDataFrame(uploads, UPLOADS), spark.createDataFrame(receipts, RECEIPTS))
    state = LinkageState(spark, str(tmp_path / "state"))
    state.accept(fields.where("batch_no = 0"))
    assert state.slots > 4
    state.save()
    got = set()
    for batch in range(1, 9):
        state = LinkageState.load(spark, str(tmp_path / "state"))
        got |= {(x.representative, x.upload_id) for x in state.add_batch(fields.where(f"batch_no = {batch}")).collect()}
        state.save()
    assert got == brute(uploads, receipts)
    assert sum(state.counts.values()) > 0


@pytest.mark.parametrize("times", [1, 10])
def test_cost_of_a_batch(spark, monkeypatch, times):
    """Ten times the history means ten times the slots, of which a batch of one upload reads as few."""
    monkeypatch.setattr(batch_dedup, "SLOT_KEYS", 50)
    r = random.Random(times)
    rows = [(i, i % 5, None, r.getrandbits(63), None) for i in range(100 * times)]
    fields = spark.createDataFrame(rows, "id long, user_id long, image string, hash long, total long")
    state = LinkageState(spark)
    state.accept(fields)
    asked = batch_dedup.block_keys(fields.limit(1), True)
    read = state.probed(asked)
    assert read.join(asked.select("key"), "key", "left_semi").select("key").distinct().count() == asked.select("key").distinct().count()
    assert state.slots == 10 * times and read.count() <= 5 * 50 * 3


def test_score_alone(spark):
    """Without the definition the learned weights decide: near hashes with near totals, not far ones."""
    uploads, receipts = world(3)
    fields = upload_fields(spark.createDataFrame(uploads, UPLOADS), spark.createDataFrame(receipts, RECEIPTS))
    state = LinkageState(spark, exact=False)
    state.accept(fields.where("batch_no = 0"))
    got = {(x.representative, x.upload_id) for x in state.add_batch(fields.where("batch_no > 0")).collect()}
    cases = {d for _, d in brute(uploads, receipts)}
    assert len({d for _, d in got} & cases) >= 0.8 * len(cases)
