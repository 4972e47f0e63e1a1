"""Matching and crop-size search."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fieldspark.functions import boxes as bx
from fieldspark.operators import fewshot, match


def side(spark, rows):
    df = spark.createDataFrame(rows, "image_path string, ord int, class string, score double, x1 double, y1 double, x2 double, y2 double")
    return df.withColumn("box", bx.make_box())


def test_first_in_list_wins_not_best_score(spark):
    gt = side(spark, [("a", 0, "c", None, 0.0, 0.0, 10.0, 10.0)])
    gen = side(spark, [("a", 0, "c", 0.6, 0.0, 0.0, 10.0, 9.0), ("a", 1, "c", 0.9, 0.0, 0.0, 10.0, 10.0)])
    assert [(r.gt_ord, r.gen_ord) for r in match.match_boxes(gt, gen).collect()] == [(0, 0)]


def test_class_is_ignored_and_missing_score_counts_as_one(spark):
    gt = side(spark, [("a", 0, "x", None, 0.0, 0.0, 10.0, 10.0)])
    gen = side(spark, [("a", 0, "y", None, 0.0, 0.0, 10.0, 10.0)])
    t = match.evaluate(gt, gen, 0.9)[0].first()
    assert (t.total_tp, t.total_fp, t.total_fn, t.f1) == (1, 0, 0, 1.0)


def test_zero_threshold_does_not_match_disjoint_boxes(spark):
    gt = side(spark, [("a", 0, "c", None, 0.0, 0.0, 10.0, 10.0)])
    gen = side(spark, [("a", 0, "c", 1.0, 50.0, 50.0, 60.0, 60.0)])
    t, per = match.evaluate(gt, gen, 0.0, 0.0)
    assert (t.first().total_tp, t.first().total_fp, t.first().total_fn) == (0, 1, 1)
    assert per.first().precision == 0.0


def test_images_of_one_side_only(spark):
    gt = side(spark, [("a", 0, "c", None, 0.0, 0.0, 10.0, 10.0)])
    gen = side(spark, [("b", 0, "c", 1.0, 0.0, 0.0, 10.0, 10.0)])
    per = {r.image_path: (r.num_gt, r.num_generated, r.num_fn, r.num_fp) for r in match.evaluate(gt, gen)[1].collect()}
    assert per == {"a": (1, 0, 1, 0), "b": (0, 1, 0, 1)}


@pytest.mark.parametrize("threshold", [0.0, 0.3])
def test_large_image_plan_equals_small(spark, threshold):
    rnd = random.Random(3)

    def rows(n):
        out = []
        for i in range(n):
            x, y = rnd.randint(0, 60), rnd.randint(0, 60)
            out.append(("a", i, "c", 1.0, float(x), float(y), float(x + rnd.randint(5, 20)), float(y + rnd.randint(5, 20))))
        return out

    gt, gen = side(spark, rows(60)), side(spark, rows(80))
    small = match.match_boxes(gt, gen, threshold)
    large = match.match_boxes(gt, gen, threshold, limit=10, pair_limit=100)
    whole = match.match_boxes(gt, gen, threshold, limit=10)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, large.select(whole.columns).collect()))
    key = ["image_path", "gt_ord", "gen_ord"]
    assert sorted(map(tuple, small.select(key).collect())) == sorted(map(tuple, large.select(key).collect()))
    n = small.count()
    t = match.evaluate(gt, gen, 0.0, threshold, limit=10)[0].first()
    assert t.total_tp == n and t.total_tp + t.total_fn == 60 and t.total_tp + t.total_fp == 80


def test_crop_search_from_annotations(spark):
    """Anchors are the crop's reference box, shrunk more for larger crops; the best is shifted back."""
    from pyspark.sql import functions as F

    from fieldspark.plans import labelling

    ann = spark.createDataFrame([("a", 1, 100.0, 100.0, 140.0, 140.0)], "image_path string, gt_ord int, x1 double, y1 double, x2 double, y2 double")
    ann = ann.select("image_path", "gt_ord", bx.make_box().alias("box"))
    images = spark.createDataFrame([("a", 300, 300)], "image_path string, width int, height int")
    sizes = spark.createDataFrame([(200,), (100,)], "size int")

    def anchors(crops):
        r, cut = F.col("ref"), F.col("size") / 10
        small = bx.make_box(r["x1"], r["y1"], r["x2"], r["y2"] - cut)
        far = bx.make_box(r["x1"] + 900, r["y1"], r["x2"] + 900, r["y2"])
        both = F.posexplode(F.array(far, small)).alias("ord", "box")
        return crops.drop("box").select("*", both)

    out = labelling.search_crop_size(ann, images, anchors, sizes)
    boxes = {r.size: tuple(r.box) for r in out.anchors.collect()}
    assert boxes == {200: (100.0, 100.0, 140.0, 120.0), 100: (100.0, 100.0, 140.0, 130.0)}
    assert [(r.size, r.avg_iou, r.improved) for r in out.sizes.collect()] == [(200, 0.5, True), (100, 0.75, True)]


def test_crop_size_search_stops_at_first_small_gain(spark):
    g = spark.createDataFrame([(1024, 0.4), (768, 0.5), (512, 0.52), (256, 0.9)], "size int, iou double")
    out = [(r.size, r.avg_iou, r.improved) for r in fewshot.crop_size_search(g).collect()]
    assert out == [(1024, 0.4, True), (768, 0.5, True), (512, 0.52, False)]


def test_crop_size_without_boxes_is_passed_over(spark):
    g = spark.createDataFrame([(1024, 0.4), (512, 0.8)], "size int, iou double")
    sizes = spark.createDataFrame([(1024,), (768,), (512,)], "size int")
    assert [r.size for r in fewshot.crop_size_search(g, sizes).collect()] == [1024, 512]


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.75, 1.0])
@pytest.mark.parametrize("pair_limit", [40, 500_000])
def test_large_images_with_copies_and_mixed_sizes(spark, threshold, pair_limit):
    """Boxes of very different sizes, repeated on both sides, equal to the plan for small images."""
    rnd = random.Random(11)

    def rows(n, image):
        out = []
        for i in range(n):
            w, h, x, y = 2 ** rnd.uniform(0, 9), 2 ** rnd.uniform(0, 9), rnd.uniform(-300, 300), rnd.uniform(-300, 300)
            box = rnd.choice([(x, y, x + w, y + h), (0.0, 0.0, 64.0, 64.0), (0.0, 0.0, 64.0, 60.0), (1.0, 0.0, 65.0, 64.0), (5.0, 5.0, 5.0, 9.0)])
            out.append((image, i, "c", 1.0, *box))
        return out

    gt = side(spark, rows(150, "a") + rows(30, "b") + rows(3, "c"))
    gen = side(spark, rows(200, "a") + rows(40, "b") + rows(3, "c"))
    key = ["image_path", "gt_ord", "gen_ord"]
    small = sorted(map(tuple, match.match_boxes(gt, gen, threshold).select(key).collect()))
    large = sorted(map(tuple, match.match_boxes(gt, gen, threshold, limit=10, pair_limit=pair_limit).select(key).collect()))
    assert small == large and small


def test_near_pairs_are_all_pairs(spark):
    from fieldspark.operators import spatial

    rnd = random.Random(12)

    def boxes(n):
        out = []
        for _ in range(n):
            w, h = 2 ** rnd.uniform(-3, 6), 2 ** rnd.uniform(-3, 6)
            x, y = rnd.choice([0, rnd.uniform(-40, 40)]), rnd.choice([0, rnd.uniform(-40, 40)])
            out.append((x, y, x + w, y + h))
        return out

    a, b = boxes(150), boxes(150)

    def iou(p, q):
        w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
        inter = max(w, 0) * max(h, 0)
        return inter / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - inter)

    left, right = (side(spark, [("a", i, "c", 1.0, *map(float, x)) for i, x in enumerate(s)]) for s in (a, b))
    for t in (0.1, 0.4, 0.5, 0.8):
        for cell_rows in (2, 1024):
            got = sorted((r.l_ord, r.r_ord) for r in spatial.near_pairs(left, right, ["image_path"], t, cell_rows).collect())
            assert got == sorted((i, j) for i, p in enumerate(a) for j, q in enumerate(b) if iou(p, q) >= t)


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.8, 1.0])
def test_streamed_images_equal_small_and_store_no_pairs(spark, threshold, monkeypatch):
    """Images over the limit are matched without a table of pairs; only those with too many true boxes store pairs."""
    rnd = random.Random(21)

    def rows(n, image, seed_box=(0.0, 0.0, 64.0, 64.0)):
        out = []
        for i in range(n):
            w, h, x, y = 2 ** rnd.uniform(-2, 8), 2 ** rnd.uniform(-2, 8), rnd.uniform(-200, 200), rnd.uniform(-200, 200)
            near = tuple(v + rnd.randint(-3, 3) for v in seed_box)
            out.append((image, 3 * i % n if n % 3 else i, "c", 1.0, *rnd.choice([(x, y, x + w, y + h), near, seed_box, (9.0, 9.0, 5.0, 5.0)])))
        return out

    gt = side(spark, rows(200, "a") + rows(50, "b") + rows(4, "c") + rows(40, "only"))
    gen = side(spark, rows(250, "a") + rows(50, "b") + rows(4, "c"))
    want = sorted(map(tuple, match.match_boxes(gt, gen, threshold).collect()))
    rounds = sorted(map(tuple, match.match_boxes(gt, gen, threshold, limit=10, held_truth=100).collect()))
    assert rounds == want and want
    monkeypatch.setattr(match.sp, "near_pairs", None)
    assert sorted(map(tuple, match.match_boxes(gt, gen, threshold, limit=10).collect())) == want


def test_rows_cross_the_exchange_packed():
    from fieldspark.operators.streamed import pack, unpack

    rng = np.random.default_rng(0)
    n = 40_000
    rows = pa.table({
        "_k": pa.array([None if k == 7 else f"img_{k:04d}.jpg" for k in rng.integers(0, 50, n)]), "_ord": pa.array(np.arange(n)),
        **{e: pa.array(rng.integers(0, 1000, n).astype(float)) for e in ("x1", "y1", "x2", "y2")}, "_task": pa.array(rng.integers(0, 6, n), pa.int32()),
    })
    packed = list(pack(iter(rows.to_batches(max_chunksize=7000))))
    assert sum(sum(len(b) for b in p.column(1).to_pylist()) for p in packed) < rows.nbytes / 3
    got = pa.Table.from_batches([b for p in packed for b in unpack(iter([p]))])
    assert got.sort_by("_ord") == rows.drop_columns("_task")
    for p in packed:
        for task, part in zip(p.column(0).to_pylist(), range(len(p)), strict=True):
            own = pa.Table.from_batches(unpack(iter([p.slice(part, 1)])))
            assert set(rows.column("_task").take(own.column("_ord")).to_pylist()) == {task}
