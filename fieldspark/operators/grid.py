"""Image tiles, field extents, metric grids and point-in-cell aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.boxes import lit
from ..scale import bounded_broadcast

SPEC = ("minx", "miny", "maxx", "maxy", "width_m", "height_m", "ncol", "nrow", "dx", "dy")


def tiles(images: DataFrame, size: int = 960, overlap: float = 0.2, safe: bool = False) -> DataFrame:
    """Overlapping square tiles of every image (columns ``width``, ``height``), edge tiles snapped.

    By default an image that is too small for a second stride start yields no tile.
    ``safe`` gives every image at least one tile and drops repeats.
    """
    stride = int(size * (1 - overlap))
    if safe:
        size, stride = max(1, int(size)), max(1, stride)

    def count(length: Column) -> Column:
        n = F.ceil((length - size) / F.lit(stride)).cast("int") + 1
        return F.greatest(n, F.lit(1)) if safe else n

    def spans(length: Column) -> Column:
        """Snapped [lo, hi) intervals along one axis."""
        n = count(length)

        def span(k: Column) -> Column:
            hi = F.least(k * stride + size, length)
            lo = F.when(hi == length, F.greatest(F.lit(0), length - size)).otherwise(k * stride)
            return F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

        out = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), span))
        # a tile is a pair of intervals, so distinct intervals give distinct tiles without a shuffle
        return F.array_distinct(out) if safe else out

    grid = images.withColumn("_y", F.explode(spans(F.col("height")))).withColumn("_x", F.explode(spans(F.col("width"))))
    return grid.select(
        *images.columns, F.col("_x.lo").alias("x1"), F.col("_y.lo").alias("y1"),
        F.col("_x.hi").alias("x2"), F.col("_y.hi").alias("y2"),
    )


def extent(points: DataFrame, by: list[str], pad: float = 0.1, lon: str = "longitude", lat: str = "latitude"):
    """Bounding box per group, widened by ``pad`` of each span. Null group keys are left out."""
    for k in by:
        points = points.filter(F.col(k).isNotNull())
    raw = points.groupBy(*by).agg(
        F.min(lon).alias("minx"), F.min(lat).alias("miny"), F.max(lon).alias("maxx"), F.max(lat).alias("maxy")
    ).filter(F.col("minx").isNotNull() & F.col("miny").isNotNull())
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return raw.select(
        *by,
        (F.col("minx") - pad * w).alias("minx"), (F.col("miny") - pad * h).alias("miny"),
        (F.col("maxx") + pad * w).alias("maxx"), (F.col("maxy") + pad * h).alias("maxy"),
    )


def grid_spec(bounds: DataFrame, cell_ft: tuple[float, float] = (30.0, 30.0)) -> DataFrame:
    """Field size in metres and the number and size of cells per extent row."""
    tw, th = cell_ft[0] / geo.FT_PER_M, cell_ft[1] / geo.FT_PER_M
    c = F.col
    measured = bounds.select(
        "*", geo.geodesic_m("miny", "minx", "miny", "maxx").alias("width_m"),
        geo.geodesic_m("miny", "minx", "maxy", "minx").alias("height_m"),
    )
    single = (F.lit(tw) > c("width_m")) | (F.lit(th) > c("height_m"))

    def cells(length: Column, side: float) -> Column:
        return F.when(single, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(length / F.lit(side)))).cast("int")

    return measured.withColumn("ncol", cells(c("width_m"), tw)).withColumn(
        "nrow", cells(c("height_m"), th)
    ).withColumn("dx", (c("maxx") - c("minx")) / c("ncol")).withColumn("dy", (c("maxy") - c("miny")) / c("nrow"))


def cell_bounds(df: DataFrame) -> DataFrame:
    """Corner coordinates of cell ``(i, j)``; neighbours compute bit-identical shared edges."""
    c = F.col
    return (
        df.withColumn("xmin", c("minx") + c("i") * c("dx")).withColumn("ymin", c("miny") + c("j") * c("dy"))
        .withColumn("xmax", c("minx") + (c("i") + 1) * c("dx")).withColumn("ymax", c("miny") + (c("j") + 1) * c("dy"))
    )


def grid_cells(spec: DataFrame, by: list[str]) -> DataFrame:
    """All cells of every grid: rows first, spread over the cluster, then columns."""
    rows = spec.select(*by, "ncol", F.explode(F.sequence(F.lit(0), F.col("nrow") - 1)).alias("j"))
    rows = rows.repartition(*[F.col(k) for k in by], F.col("j"))
    return rows.select(*by, F.explode(F.sequence(F.lit(0), F.col("ncol") - 1)).alias("i"), "j")


def _candidates(v: Column, origin: Column, step: Column) -> Column:
    """The index found by arithmetic, and its two neighbours."""
    guess = F.when(step > 0, F.floor((v - origin) / step).cast("int")).otherwise(F.lit(0))
    return F.explode(F.array(guess - 1, guess, guess + 1))


def _holds(v: Column, i: str, origin: Column, step: Column, n: Column) -> Column:
    """Inclusive test against the exact cell edges."""
    k = F.col(i)
    return (k >= 0) & (k < n) & (v >= origin + k * step) & (v <= origin + (k + 1) * step)


def points_in_cells(
    points: DataFrame, spec: DataFrame, by: list[str], lon: str = "longitude", lat: str = "latitude"
) -> DataFrame:
    """Range join without a range join: every point with each cell that covers it.

    Arithmetic finds the cell up to rounding; the comparison with the exact edges
    decides among three candidates per axis. Edges are inclusive, so a point on a
    shared edge appears once per touching cell.
    """
    grid = bounded_broadcast(spec.select(*by, "minx", "miny", "dx", "dy", "ncol", "nrow"))
    c = F.col
    joined = points.join(grid, by)
    x = joined.withColumn("i", _candidates(c(lon), c("minx"), c("dx"))).filter(
        _holds(c(lon), "i", c("minx"), c("dx"), c("ncol"))
    )
    xy = x.withColumn("j", _candidates(c(lat), c("miny"), c("dy"))).filter(
        _holds(c(lat), "j", c("miny"), c("dy"), c("nrow"))
    )
    return xy.select(*points.columns, "i", "j")


def _onto_grid(agg: DataFrame, spec: DataFrame, by: list[str]) -> DataFrame:
    return grid_cells(spec, by).join(agg, [*by, "i", "j"], "left")


def occupied_counts(points: DataFrame, spec: DataFrame, by: list[str]) -> DataFrame:
    """Points per cell that has any."""
    return points_in_cells(points, spec, by).groupBy(*by, "i", "j").agg(F.count(F.lit(1)).alias("crop_count"))


def cell_counts(points: DataFrame, spec: DataFrame, by: list[str]) -> DataFrame:
    """Points per cell, empty cells included."""
    n = occupied_counts(points, spec, by)
    return _onto_grid(n, spec, by).select(*by, "i", "j", F.coalesce("crop_count", F.lit(0)).alias("crop_count"))


def occupied_means(points: DataFrame, spec: DataFrame, by: list[str], value: str = "residue_fraction") -> DataFrame:
    """Points and mean value per cell that has points."""
    return points_in_cells(points, spec, by).groupBy(*by, "i", "j").agg(
        F.count(F.lit(1)).alias("pt_count"), F.avg(value).alias("avg_res")
    ).withColumn("res_pct", F.col("avg_res") * 100)


def cell_means(points: DataFrame, spec: DataFrame, by: list[str], value: str = "residue_fraction") -> DataFrame:
    """Points and mean value per cell; empty cells have 0 and 0.0."""
    out = _onto_grid(occupied_means(points, spec, by, value), spec, by)
    return out.select(
        *by, "i", "j", F.coalesce("pt_count", F.lit(0)).alias("pt_count"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("avg_res", "res_pct")],
    )


def batches(df: DataFrame, ord: str, size: int) -> DataFrame:
    """Batch number by list position."""
    return df.withColumn("batch", F.floor(F.col(ord) / lit(size)).cast("bigint"))
