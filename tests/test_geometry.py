import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docflow.functions import geometry as G
from docflow.operators import ocr as O

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def test_rectangles():
    assert G.min_area_rect(np.array(SQUARE))[1:] == (10, 10)
    a = np.radians(30)
    turned = np.array([(0, 0), (40, 0), (40, 20), (0, 20)]) @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
    _, w, h = G.min_area_rect(turned)
    assert sorted((w, h)) == pytest.approx([20, 40])
    assert G.min_area_rect(np.array([(3, 4)]))[1:] == (0, 0) and G.min_area_rect(np.empty((0, 2)))[1:] == (0, 0)
    box, side = G.mini_box(np.array(SQUARE))
    assert box.tolist() == [[0, 0], [10, 0], [10, 10], [0, 10]] and side == 10


def test_unclip():
    assert G.unclip(np.array([(0, 0), (1, 0), (1, 1), (0, 1)]), 2).tolist() == [[-0.5, -0.5], [1.5, -0.5], [1.5, 1.5], [-0.5, 1.5]]
    out = G.unclip(np.array([(0, 0), (3, 0), (3, 2), (0, 2)]), 1.0)
    assert np.ptp(out, 0).tolist() == pytest.approx([4.2, 3.2])
    assert G.unclip(np.ones((4, 2)), 2).tolist() == [[1, 1]] * 4


def test_scores():
    assert G.box_score(np.ones((5, 5), np.float32), np.array([(0, 0), (4, 0), (4, 4), (0, 4)])) == 1.0
    columns = np.tile(np.arange(5, dtype=np.float32), (5, 1))
    assert G.box_score(columns, np.array([(1, 0), (3, 0), (3, 4), (1, 4)])) == 2.0
    assert G.box_score(np.ones((5, 5), np.float32), np.array([(-5, -5), (20, -5), (20, 20), (-5, 20)])) == 1.0
    assert G.box_score(np.ones((5, 5), np.float32), np.array([(10, 10), (12, 10), (12, 12), (10, 12)])) == 0


points = st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=25)


@settings(max_examples=60, deadline=None)
@given(points)
def test_rectangle_holds_all_points_and_is_no_larger_than_the_axis_box(pts):
    p = np.array(pts, float)
    corners, w, h = G.min_area_rect(p)
    assert w * h <= np.ptp(p[:, 0]) * np.ptp(p[:, 1]) + 1e-6
    hull = G.convex_hull(p)
    assert set(map(tuple, hull)) <= set(map(tuple, p))
    if w and h:
        side, up = corners[1] - corners[0], corners[3] - corners[0]
        for axis, size in ((side, w), (up, h)):
            t = (p - corners[0]) @ axis / size
            assert t.min() > -1e-6 and t.max() < size + 1e-6


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=48, max_size=48))
def test_components_equal_flood_fill(bits):
    grid = np.array(bits).reshape(6, 8)
    want, seen = np.full(grid.shape, -1), set()
    for y, x in zip(*np.nonzero(grid), strict=True):
        stack = [(y, x)] if (y, x) not in seen else []
        while stack:
            a, b = stack.pop()
            if (a, b) in seen or not (0 <= a < 6 and 0 <= b < 8) or not grid[a, b]:
                continue
            seen.add((a, b))
            want[a, b] = y * 8 + x
            stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    assert (O.label_components(grid) == want).all()


def test_text_boxes():
    prob = np.zeros((40, 60), np.float32)
    prob[5:15, 5:35] = 0.9
    prob[20:30, 10:40] = 0.7
    prob[35, :] = 0.8  # a line has no area
    found = O.text_boxes(prob.ravel(), 40, 60, ratio_w=2, ratio_h=2)
    assert [round(s, 3) for _, s in found] == [0.9, 0.7]
    box = found[0][0]
    assert box[:, 0].min() < 10 and box[:, 0].max() > 68 and (box >= 0).all()


def test_tasks_that_sort_boxes_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    spark.range(20_000).select((F.col("id") % 5_000).alias("page_id"), F.col("id").alias("ord"), (F.col("id") * 7 % 40).alias("top"), (F.col("id") * 11 % 90).alias("left")).write.parquet(str(tmp_path / "boxes"))
    boxes = spark.read.parquet(str(tmp_path / "boxes"))
    want = sorted(map(tuple, O.reading_order(boxes).collect()))
    assert O.spread(boxes, "page_id") is boxes  # small inputs are left alone
    monkeypatch.setattr(O, "SORT_BYTES", 1 << 12)
    dealt = O.spread(boxes, "page_id").rdd.getNumPartitions()
    assert dealt > 10 and O.spread(boxes.union(boxes), "page_id").rdd.getNumPartitions() in (2 * dealt, 2 * dealt + 1)
    assert sorted(map(tuple, O.reading_order(boxes).collect())) == want
    assert "Exchange hashpartitioning(page_id" in (plan := O.reading_order(boxes)._jdf.queryExecution().executedPlan().toString()) and plan.count("Exchange") == 1
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(1, 2, 3, 4)]), "page_id long, ord long, top long, left long")
    assert O.spread(unknown, "page_id") is unknown
