"""Field maps: detections or residue samples to dissolved level maps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import geo, text
from ..operators import components as cc
from ..operators import grid, rings, runs
from ..scale import bind, bounded_broadcast, cut_lineage


@dataclass
class FieldMap:
    """Results of a map job. ``levels`` is one row per group and level; ``features`` adds its WKT.

    Maps are made from the cells that hold points; the whole grid is formed only when ``cells`` is asked for, and
    outlines are traced when ``polygons`` or ``features`` is first asked for.
    """

    points: DataFrame
    boundary: DataFrame
    levels: DataFrame
    by: str
    grid_cells: Callable[[], DataFrame]
    outlines: Callable[[], DataFrame]
    missing: DataFrame | None = None
    without_gps: DataFrame | None = None

    @cached_property
    def cells(self) -> DataFrame:
        return cut_lineage(self.grid_cells())

    @cached_property
    def polygons(self) -> DataFrame:
        return cut_lineage(self.outlines())

    @cached_property
    def features(self) -> DataFrame:
        return self.levels.join(rings.level_geometry(self.polygons, [self.by]), [self.by, "level"])


def positions(tags: DataFrame, fields: dict, image: str = "img") -> DataFrame:
    """``img, latitude, longitude`` per row of a GPS tag table; ``fields`` maps tag names to columns."""
    held = bind(tags, **{f"_{n}": c for n, c in fields.items()})
    fix = geo.gps_from_tags({n: F.col(f"_{n}") for n in fields})
    return bind(held, _p=fix).select(image, "_p.latitude", "_p.longitude")


def locate(
    detections: DataFrame, gps: DataFrame, images: DataFrame | None = None, **projection
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(geo detections, image names missing, image names without GPS).

    ``detections``: ``img``, ``bounding_box``, ``label``, ...; ``gps``: ``img, latitude,
    longitude`` (null where the image has no usable tags); ``images``: the images that
    exist (default: those in ``gps``). The two name lists have one line per record.
    """
    det = detections.filter(F.col("img").isNotNull() & (F.col("img") != ""))
    fix = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct("latitude", "longitude"))
    # of several fixes of one image the southernmost, then westernmost counts: any fixed rule will do
    fixes = gps.groupBy("img").agg(F.min(fix).alias("_fix"))
    if images is not None:
        fixes = images.select("img").distinct().join(fixes, "img", "left")
    # one row per image: looked up once, whatever the number of boxes
    fixes = bounded_broadcast(cut_lineage(fixes.withColumn("_known", F.lit(True))))
    det = det.join(fixes, "img", "left")
    missing = det.filter(F.col("_known").isNull()).select("img")
    without = det.filter(F.col("_known") & F.col("_fix").isNull()).select("img")
    b = bx.box_of("bounding_box")
    placed = det.filter((F.size("bounding_box") == 4) & F.col("_fix").isNotNull())
    placed = bind(placed, _b=b)
    placed = bind(placed, _g=geo.to_ground(F.col("_fix.latitude"), F.col("_fix.longitude"), F.col("_b"), **projection))
    out = placed.select(
        *detections.columns, F.col("_g.latitude"), F.col("_g.longitude"),
        F.col("_g.lat1").alias("bbox_lat1"), F.col("_g.lon1").alias("bbox_lon1"),
        F.col("_g.lat2").alias("bbox_lat2"), F.col("_g.lon2").alias("bbox_lon2"),
    )
    return out, missing, without


def farm_boundary(spec: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """One extent box per group with the field's width and height in metres."""
    return spec.select(
        *by, F.col("width_m").alias("field_width_m"), F.col("height_m").alias("field_height_m"),
        rings.box_wkt(digits=digits).alias("wkt"),
    )


def _sprayed(counted: DataFrame, levels, by: str) -> DataFrame:
    counted = counted.withColumn("_l", geo.spray_level("crop_count", levels))
    return counted.select(
        by, "i", "j", "crop_count", F.col("_l.name").alias("level"), F.col("_l.obj_id").alias("obj_id"),
        geo.target_rate("crop_count").alias("target_rate"),
    )


def spray_cells(points: DataFrame, spec: DataFrame, levels=geo.BINARY_LEVELS, by: str = "label") -> DataFrame:
    """Counted grid cells with spray level, object id and target rate."""
    return _sprayed(grid.cell_counts(points.select(by, "latitude", "longitude"), spec, [by]), levels, by)


def spray_runs(
    points: DataFrame, spec: DataFrame, levels=geo.BINARY_LEVELS, by: str = "label", band_runs: int = runs.BAND_RUNS
) -> tuple[DataFrame, DataFrame]:
    """(cells that stand for all cells in sums and firsts, labelled runs) without forming the grid.

    Of cells without points only the first one of each run is among the cells.
    """
    filled = cut_lineage(_sprayed(grid.occupied_counts(points.select(by, "latitude", "longitude"), spec, [by]), levels, by))
    covering = cut_lineage(runs.field_runs(filled, spec, [by], "No"))
    gaps = runs.first_cells(covering, [by], "No").withColumn("crop_count", F.lit(0).cast("bigint"))
    return filled.unionByName(_sprayed(gaps, levels, by)), runs.run_components(covering, [by], band_runs)


def weed_map(
    detections: DataFrame, gps: DataFrame, images: DataFrame | None = None, cell_ft=(30.0, 30.0),
    spray_mode: str = "binary", level_names=None, level_thresholds=None, exact_counts: bool = False, **projection,
) -> FieldMap:
    """Detections and image positions to a spray map per label."""
    levels = geo.spray_levels(spray_mode, level_names, level_thresholds)
    points, missing, without = locate(detections, gps, images, **projection)
    # the extent is one row per label: kept, so that the points are scanned twice and not more
    spec = cut_lineage(grid.grid_spec(grid.extent(points, ["label"]), cell_ft))
    cells, labelled = spray_runs(points, spec, levels)
    summary = cc.dissolve_counts(cells, labelled, ["label"], exact_counts=exact_counts)
    summary = summary.withColumn("label_slug", text.slug("label"))
    return FieldMap(
        points, farm_boundary(spec, ["label"]), summary, "label", lambda: spray_cells(points, spec, levels),
        lambda: rings.region_polygons(runs.cells_of(labelled), spec, ["label"]), missing, without,
    )


def _covered(cells: DataFrame, by: str) -> DataFrame:
    cells = cells.withColumn("_l", geo.residue_level("avg_res", "pt_count"))
    return cells.select(
        by, "i", "j", "pt_count", "avg_res", "res_pct",
        F.col("_l.name").alias("level"), F.col("_l.obj_id").alias("obj_id"),
    )


def residue_cells(points: DataFrame, spec: DataFrame, by: str = "field") -> DataFrame:
    return _covered(grid.cell_means(points.select(by, "latitude", "longitude", "residue_fraction"), spec, [by]), by)


def residue_levels(filled: DataFrame, spec: DataFrame, by: str = "field") -> DataFrame:
    """One row per level from the cells that hold points; the others are only counted."""
    n = filled.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    left = (F.col("ncol").cast("bigint") * F.col("nrow") - F.coalesce("_n", F.lit(0))).alias("n_cells")
    none = spec.join(n, by, "left").select(by, F.lit("No_Data").alias("level"), left, F.lit(0).alias("obj_id"))
    return cc.dissolve_means(filled, [by], empty=none)


def residue_map(points: DataFrame, cell_ft=(30.0, 30.0), name: str = "output") -> FieldMap:
    """Residue samples (``latitude, longitude, residue_fraction``) to a level map."""
    points = points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    points = points.withColumn("field", text.slug(F.lit(name), "output"))
    points = points.withColumn("residue_fraction", F.coalesce("residue_fraction", F.lit(0.0)))
    spec = cut_lineage(grid.grid_spec(grid.extent(points, ["field"], pad=0.0), cell_ft))
    filled = cut_lineage(_covered(
        grid.occupied_means(points.select("field", "latitude", "longitude", "residue_fraction"), spec, ["field"]), "field"))
    summary = residue_levels(filled, spec).withColumn("label_slug", F.col("field"))

    def outlines() -> DataFrame:
        covering = cut_lineage(runs.field_runs(filled, spec, ["field"], "No_Data"))
        return rings.region_polygons(runs.cells_of(runs.run_components(covering, ["field"])), spec, ["field"])

    return FieldMap(points, farm_boundary(spec, ["field"]), summary, "field", lambda: residue_cells(points, spec), outlines)
