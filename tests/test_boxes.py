import pytest

from tallyforge.operators.boxes import box_pairs, majority_orientation, merged, plausible_boxes, suppressed

SCHEMA = "image_id long, box_no int, x double, y double, width double, height double, rotation double, confidence double, n int"


def frame(spark, *boxes):
    return spark.createDataFrame([(1, i, *map(float, b[:4]), float(b[4]) if len(b) > 4 else 0.0, float(b[5]) if len(b) > 5 else 0.5, 0) for i, b in enumerate(boxes)], SCHEMA).drop("n")


@pytest.mark.parametrize(
    ("a", "b", "iou"),
    [((0, 0, 100, 100), (0, 0, 100, 100), 1.0), ((0, 0, 100, 100), (50, 0, 100, 100), 1 / 3), ((0, 0, 200, 200), (100, 100, 200, 200), 1 / 7), ((0, 0, 100, 100), (100, 0, 100, 100), None)],
)
def test_overlap(spark, a, b, iou):
    got = [r.iou for r in box_pairs(frame(spark, a, b)).collect()]
    assert got == ([] if iou is None else [pytest.approx(iou)])


@pytest.mark.parametrize(
    ("boxes", "kept"),
    [
        ([(0, 0, 500, 500)], {0}), ([(0, 0, 5, 5)], {0}), ([(0, 0, 50, 50), (0, 0, 400, 400)], {1}), ([(0, 0, 1000, 1000), (10, 10, 300, 400), (500, 10, 300, 400)], {1, 2}),
        ([(0, 0, 500, 500), (50, 50, 200, 200)], {0}), ([(0, 0, 400, 600), (500, 0, 400, 600)], {0, 1}),
    ],
)
def test_plausible(spark, boxes, kept):
    assert {r.box_no for r in plausible_boxes(frame(spark, *boxes)).collect()} == kept


@pytest.mark.parametrize(
    ("boxes", "expected"),
    [
        ([(0, 0, 100, 100, 10), (0, 0, 100, 100, 20)], [(0, 0, 100, 100, 15)]), ([(0, 0, 200, 200), (100, 0, 200, 200)], [(0, 0, 300, 200, 0)]),
        ([(0, 0, 100, 100), (95, 95, 100, 100)], [(0, 0, 100, 100, 0), (95, 95, 100, 100, 0)]), ([(0, 0, 100, 100)], [(0, 0, 100, 100, 0)]),
    ],
)
def test_merged(spark, boxes, expected):
    got = [tuple(r)[2:] for r in merged(frame(spark, *boxes)).orderBy("box_no").collect()]
    assert got == [tuple(map(float, e)) for e in expected]


def test_suppressed_and_orientation(spark):
    df = frame(spark, (0, 0, 100, 100, 0, 0.5), (5, 5, 100, 100, 0, 0.9), (300, 0, 100, 50, 0, 0.1), (300, 300, 50, 100, 0, 0.2))
    assert {r.box_no for r in suppressed(df).collect()} == {1, 2, 3}
    assert [r.box_no for r in majority_orientation(df).orderBy("place").collect()] == [0, 2, 1]


def test_empty(spark):
    df = frame(spark, (0, 0, 1, 1)).limit(0)
    for f in (box_pairs, plausible_boxes, merged, suppressed, majority_orientation):
        assert f(df).collect() == []
