"""Composed jobs round detections: relabelling, supports, stitching, prompts, crops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions import text
from ..functions.numbers import round_to
from ..operators import fewshot, grid, report
from ..operators import relabel as rl
from ..operators import segmetrics as sm
from ..operators.suppress import nms, nms_tiled
from ..sources.readers import pair_masks, select_images


@dataclass
class Relabelled:
    detections: DataFrame
    summary: DataFrame
    manifest: DataFrame


def relabel_detections(detections: DataFrame, images: DataFrame, prototypes: DataFrame, **plan) -> Relabelled:
    """Existing images and valid boxes only; then nearest prototype, counts and image manifest.

    ``detections`` carries ``img, label, bounding_box, embedding`` and any other columns.
    """
    usable = rl.usable_detections(detections, images)
    done = rl.relabel(usable, prototypes, **plan)
    hit = done.filter(F.col("classifier_confidence") > -1.0)
    return Relabelled(done, rl.class_summary(done), rl.manifest(hit, prototypes))


@dataclass
class Supports:
    vectors: DataFrame
    summary: DataFrame


def collect_supports(annotations: DataFrame, images: DataFrame, embed=None) -> Supports:
    """Annotated boxes clamped to their image, embedded (``embed(df) -> df with embedding``), summarised.

    ``annotations``: ``image_path, ord, class, box``; ``images``: ``image_path, width, height``.
    """
    clamped = annotations.join(images, "image_path").withColumn("box", bx.clamp_gt("box", "width", "height"))
    clamped = clamped.filter(F.col("box").isNotNull())
    vectors = clamped if embed is None else embed(clamped)
    return Supports(vectors, fewshot.build_supports(vectors))


@dataclass
class CropSearch:
    anchors: DataFrame
    sizes: DataFrame


def search_crop_size(annotations: DataFrame, images: DataFrame, anchors, sizes: DataFrame) -> CropSearch:
    """Crop-size search for anchor-based supports.

    For every size the crop round each annotation is planned and ``anchors(crops)``
    returns candidate boxes (``ord, box``) per crop in crop-local pixels; the best
    one by IoU is shifted back, and sizes are compared by their mean IoU.
    """
    sized = annotations.join(images, "image_path").join(F.broadcast(sizes.select("size").distinct()))
    crops = sized.withColumn("crop", _crop_for_size())
    c = F.col("crop")
    crops = crops.withColumn("ref", bx.make_box(c["rx1"], c["ry1"], c["rx2"], c["ry2"]))
    keys = ["size", "image_path", "gt_ord"]
    best = fewshot.best_anchor(anchors(crops), [*keys, "crop"])
    best = best.withColumn("box", bx.shift("box", F.col("crop.cx1"), F.col("crop.cy1"))).drop("crop")
    return CropSearch(best, fewshot.crop_size_search(best, sizes))


def _crop_for_size():
    """Centred crop with the size taken from a column."""
    b, w, h, size = F.col("box"), F.col("width"), F.col("height"), F.col("size")
    return bx.centered_crop(b, w, h, size)


def tile_plan(images: DataFrame, size: int = 960, overlap: float = 0.2, safe: bool = False) -> DataFrame:
    """Tiles with their number per image (row-major)."""
    t = grid.tiles(images, size, overlap, safe)
    return t.withColumn("tile", F.concat_ws("_", "x1", "y1")).withColumnRenamed("x1", "ox").withColumnRenamed(
        "y1", "oy"
    ).drop("x2", "y2")


def stitch_proposals(
    proposals: DataFrame, image: list[str], iou_threshold: float = 0.5, objectness: float | None = None, **plan
) -> DataFrame:
    """Tile-local proposals (``tile, ox, oy, ord, score, box``) to one de-duplicated set per image."""
    if objectness is not None:
        proposals = proposals.filter(F.col("score") > objectness)
    return nms_tiled(proposals, image, ["tile"], iou_threshold=iou_threshold, **plan)


@dataclass
class PromptMerge:
    """``boxes`` and their ``segmentation``, counts per prompt (``stats``) and per image (``totals``)."""

    boxes: DataFrame
    stats: DataFrame
    totals: DataFrame


def merge_prompt_boxes(candidates: DataFrame, image: list[str], iou_threshold: float = 0.5, **plan) -> PromptMerge:
    """Per-prompt boxes of tiles to image level: shift, round, suppress per prompt, count.

    ``candidates``: ``image, prompt_index, label, ord, score, box`` (tile-local), ``ox, oy``, and
    optionally ``segmentation`` (points ``[x, y]``), which moves with its box.
    Corners become whole pixels and the confidence 4 dp before suppression.
    """
    moved = candidates.withColumn("box", bx.shift("box", "ox", "oy"))
    if "segmentation" in candidates.columns:
        moved = moved.withColumn("segmentation", F.transform("segmentation", lambda p: F.array(
            F.get(p, F.lit(0)) + F.col("ox"), F.get(p, F.lit(1)) + F.col("oy"))))
    b = F.col("box")
    moved = moved.withColumn("box", bx.make_box(*[b[n].cast("int") for n in bx.EDGES]))
    moved = moved.withColumn("score", round_to("score", 4))
    keys = [*image, "prompt_index"]
    kept = nms(moved, keys, iou_threshold=iou_threshold, kind="clamped", **plan)
    stats = report.prompt_stats(moved, kept, keys)
    totals = stats.groupBy(*image).agg(
        F.count(F.lit(1)).alias("prompt_count"), F.sum("detections").alias("total_detections"))
    return PromptMerge(kept, stats, totals)


def plan_crops(images: DataFrame, roi: str) -> DataFrame:
    """Crop plan for every supported image: source, target name and pixel box.

    ``images``: ``image_key, width, height``; ``roi``: four percent points as text.
    """
    chosen = select_images(images, "one_level").withColumn("roi", bx.parse_roi(F.lit(roi)))
    crop = bx.roi_to_pixels("roi", "width", "height")
    return chosen.select(
        "image_key", text.output_name("image_key", "rectified_").alias("output_key"), crop.alias("crop")
    )


@dataclass
class SegReport:
    iou: DataFrame
    per_class: DataFrame
    dice: DataFrame
    unpaired: DataFrame | None


def seg_metrics(pixels: DataFrame, foreground: int = 1, images: DataFrame | None = None, masks: DataFrame | None = None):
    """IoU/accuracy per class and overall, and dice/IoU of one class as a binary mask."""
    binary = pixels.filter(F.col("gt") != sm.IGNORE).select(
        "batch", (F.col("gt") == foreground).cast("int").alias("gt"), (F.col("pred") == foreground).cast("int").alias("pred")
    )
    unpaired = None if images is None else pair_masks(images, masks)[1]
    return SegReport(sm.mean_iou(pixels), sm.class_scores(pixels), sm.dice_iou(binary), unpaired)
