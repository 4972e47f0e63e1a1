"""Grids, components, outlines and levels."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldspark.functions import boxes as bx
from fieldspark.functions import geo, text
from fieldspark.operators import components as cc
from fieldspark.operators import grid, rings, runs
from fieldspark.plans import maps


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def spec(spark, n=2):
    return spark.createDataFrame([("f", 0.0, 0.0, float(n), float(n), n, n, 1.0, 1.0)], "field string, minx double, miny double, maxx double, maxy double, ncol int, nrow int, dx double, dy double")


def test_shared_corner_counts_in_four_cells(spark):
    p = spark.createDataFrame([("f", 1.0, 1.0)], "field string, longitude double, latitude double")
    hits = grid.points_in_cells(p, spec(spark), ["field"]).select("i", "j").collect()
    assert sorted(map(tuple, hits)) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_single_point_field(spark):
    p = spark.createDataFrame([(40.0, -83.0, 0.3)], "latitude double, longitude double, residue_fraction double")
    m = maps.residue_map(p)
    assert [(r.level, r.pt_count) for r in m.levels.collect()] == [("Low", 1)]


def test_grid_larger_than_field_is_one_cell(spark):
    p = spark.createDataFrame([(40.0, -83.0), (40.00001, -83.00001)], "latitude double, longitude double").withColumn("field", F.lit("f"))
    s = grid.grid_spec(grid.extent(p, ["field"], 0.0), (300.0, 300.0)).first()
    assert (s.ncol, s.nrow) == (1, 1)


def test_geodesic_known_line(spark):
    v = one(spark, geo.geodesic_m("-37.951033416667D", "144.424867888889D", "-37.652821138889D", "143.926495527778D"))
    assert abs(v - 54972.271) < 1e-3
    assert one(spark, geo.geodesic_m("40D", "-83D", "40D", "-83D")) == 0.0


@pytest.mark.parametrize("count,name,obj", [(0, "No", 0), (1, "Yes", 2), (5, "Yes", 2)])
def test_binary_levels(spark, count, name, obj):
    assert tuple(one(spark, geo.spray_level(F.lit(count)))) == (name, obj)


def test_level_lists_must_match():
    with pytest.raises(ValueError):
        geo.spray_levels("custom", ["a"], [1, 2])
    assert geo.spray_levels("custom") == geo.DEFAULT_LEVELS


def test_tag_chain_needs_references(spark):
    a = F.array(F.lit(40.0), F.lit(30.0), F.lit(0.0))
    n, w = F.lit("N"), F.lit("W")
    full = geo.gps_from_tags({"lat": a, "lon": a, "lat_ref": n, "lon_ref": w})
    assert tuple(one(spark, full)) == (40.5, -40.5)
    assert one(spark, geo.gps_from_tags({"lat": a, "lon": a, "lat_ref": n})) is None
    assert one(spark, geo.gps_from_tags({"lat": a, "lat_ref": n, "lon_ref": w})) is None
    d = F.array(F.lit(40.5))
    assert tuple(one(spark, geo.gps_from_tags({"lat_dec": d, "lon_dec": d, "lon_ref": w}))) == (40.5, -40.5)


def cells(spark, marks, level="Yes"):
    rows = [("f", level, i, j) for i, j in marks]
    return spark.createDataFrame(rows, "field string, level string, i int, j int")


def flood(marks):
    todo, sizes = set(marks), []
    while todo:
        stack, n = [todo.pop()], 0
        while stack:
            i, j = stack.pop()
            n += 1
            for c in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if c in todo:
                    todo.remove(c)
                    stack.append(c)
        sizes.append(n)
    return sorted(sizes)


@pytest.mark.parametrize("block", [3, 64])
def test_components_equal_flood_fill(spark, block):
    rnd = random.Random(7)
    marks = [(i, j) for i in range(20) for j in range(20) if rnd.random() < 0.6]
    got = cc.component_sizes(cc.components(cells(spark, marks), ["field"], block=block), ["field"])
    assert sorted(r.n_cells for r in got.collect()) == flood(marks)


def shoelace(body):
    total = 0.0
    for ring in re.findall(r"\(([^()]+)\)", body):
        pts = [tuple(map(float, p.split())) for p in ring.split(", ")]
        assert pts[0] == pts[-1]
        total += sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:])) / 2
    return total


@pytest.mark.parametrize("limit", [10**6, 20, 0])
def test_outlines_enclose_their_cells(spark, limit):
    """Outer rings are counter-clockwise, holes clockwise: the signed area is the number of cells. The limit changes nothing."""
    rnd = random.Random(11)
    marks = [(i, j) for i in range(15) for j in range(15) if rnd.random() < 0.7]
    labelled = cc.components(cells(spark, marks), ["field"])
    polys = rings.region_polygons(labelled, spec(spark, 15), ["field"], region_cells=limit).collect()
    area = {r.component: shoelace(r.body) for r in polys}
    plain = rings.region_polygons(labelled, spec(spark, 15), ["field"]).collect()
    assert sorted(map(tuple, polys)) == sorted(map(tuple, plain))
    want = {r.component: r.n_cells for r in cc.component_sizes(labelled, ["field"]).collect()}
    assert {k: round(v, 6) for k, v in area.items()} == {k: float(v) for k, v in want.items()}


def test_hole_and_pinch_make_separate_rings(spark):
    # a ring of cells whose hole touches the outside at a corner
    marks = [(i, j) for i in range(3) for j in range(3) if (i, j) not in {(1, 1), (2, 2)}]
    polys = rings.region_polygons(cc.components(cells(spark, marks), ["field"]), spec(spark, 3), ["field"]).collect()
    assert [(p.n_rings, round(shoelace(p.body), 6)) for p in polys] == [(2, 7.0)]


def test_counts_shared_between_parts(spark):
    labelled = cells(spark, [(0, 0), (5, 5)])
    labelled = labelled.withColumn("component", F.shiftleft(F.col("j").cast("bigint"), 32) + F.col("i"))
    c = cells(spark, [(0, 0), (5, 5)]).withColumn("crop_count", F.when(F.col("i") == 0, 3).otherwise(4))
    c = c.withColumn("obj_id", F.lit(2)).withColumn("target_rate", F.lit(15))
    assert cc.dissolve_counts(c, labelled, ["field"]).first().crop_count == 6
    assert cc.dissolve_counts(c, labelled, ["field"], exact_counts=True).first().crop_count == 7


def test_tiles_of_small_image(spark):
    im = spark.createDataFrame([("a", 100, 100)], "img string, width int, height int")
    assert grid.tiles(im).count() == 0
    assert [tuple(r)[3:] for r in grid.tiles(im, safe=True).collect()] == [(0, 0, 100, 100)]


def test_half_even_pixels(spark):
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((2.5, 3.5), (50.0, 3.5), (50.0, 50.0), (2.5, 50.0))])
    assert tuple(one(spark, bx.roi_to_pixels(pts, F.lit(100), F.lit(100))))[:2] == (2, 4)


@pytest.mark.parametrize("roi", ["1,2:3,4:5,6", "1,2:3,4:5,6:7,8:9,9"])
def test_roi_needs_four_points(spark, roi):
    with pytest.raises(Exception, match="four points"):
        one(spark, bx.parse_roi(F.lit(roi)))


def test_invalid_boxes(spark):
    def arr(*v):
        return F.array(*[F.lit(x).cast("double") for x in v])

    got = [one(spark, bx.valid_bbox(a)) for a in (arr(1, 1, 1, 2), arr(-1, 0, 2, 2), arr(1, 1, 2), arr(None, 1, 2, 2), arr(0, 0, 1, 1))]
    assert got == [False, False, False, False, True]
    assert one(spark, bx.valid_bbox(F.lit(None).cast("array<double>"))) is False


def test_strict_number_raises(spark):
    with pytest.raises(Exception):
        one(spark, text.to_double(F.lit("abc"), strict=True))
    assert one(spark, text.to_double(F.lit("abc"))) is None


@pytest.mark.parametrize("band_runs", [3, 40, 500_000])
def test_runs_label_the_grid_like_its_cells(spark, band_runs):
    """Every cell, empty ones and a cell with points of the empty level included, in one band or many."""
    rnd = random.Random(21)
    rows, sizes = [], {"a": (23, 19), "b": (7, 40), "c": (5, 3)}
    for field, (ncol, nrow) in sizes.items():
        for j in rnd.sample(range(nrow), max(1, nrow // 2)):
            for i in rnd.sample(range(ncol), rnd.randrange(1, ncol + 1)):
                rows.append((field, i, j, rnd.choice(["hi", "hi", "lo", "No"])))
    filled = spark.createDataFrame([r for r in rows if r[0] != "c"], "field string, i int, j int, level string")
    spec = spark.createDataFrame([(f, *s) for f, s in sizes.items()], "field string, ncol int, nrow int")
    covering = runs.field_runs(filled, spec, ["field"], "No")
    labelled = runs.run_components(covering, ["field"], band_runs)
    got = {(r.field, r.i, r.j): (r.level, r.component) for r in runs.cells_of(labelled).collect()}
    known = {(r.field, r.i, r.j): r.level for r in filled.collect()}
    dense = [(f, i, j, known.get((f, i, j), "No")) for f, (ncol, nrow) in sizes.items() for i in range(ncol) for j in range(nrow)]
    cells = spark.createDataFrame(dense, "field string, i int, j int, level string")
    want = {(r.field, r.i, r.j): (r.level, r.component) for r in cc.components(cells, ["field"]).collect()}
    assert got == want and len(got) == len(dense)


def test_a_stray_point_costs_no_cells(spark):
    """A point in another country makes a grid of 10^12 cells; the map is made from two dozen of them."""
    points = [("weed", 40.0 + k * 1e-3, -83.0 + (k % 5) * 1e-3) for k in range(20)] + [("weed", 49.0, -72.0)]
    p = spark.createDataFrame(points, "label string, latitude double, longitude double")
    spec = grid.grid_spec(grid.extent(p, ["label"]), (3.0, 3.0))
    size = spec.first()
    assert size.ncol * size.nrow > 10**11
    cells, labelled = maps.spray_runs(p, spec)
    out = {r.level: (r.crop_count, r.polygon_count) for r in cc.dissolve_counts(cells, labelled, ["label"], exact_counts=True).collect()}
    assert out == {"Yes": (21, 21), "No": (0, 1)} and labelled.count() < 100
