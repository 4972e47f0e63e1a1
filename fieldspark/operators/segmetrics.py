"""Segmentation and classification metrics over long pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vec
from ..functions.numbers import round_to

IGNORE = 255


def confusion(pixels: DataFrame, ignore: int | None = IGNORE) -> DataFrame:
    """Counts per (gt, pred); pixels whose truth is ``ignore`` do not count."""
    if ignore is not None:
        pixels = pixels.filter(F.col("gt") != ignore)
    return pixels.groupBy("gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(pixels: DataFrame, ignore: int | None = IGNORE) -> DataFrame:
    """Per class: true positives, ground-truth and predicted pixels, IoU and accuracy.

    A class without ground truth has a null accuracy, one without any pixel is absent.
    """
    c = confusion(pixels, ignore)
    hit = F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    rows = c.select(F.col("gt").alias("class"), F.col("n").alias("g"), F.lit(0).alias("p"), hit.alias("t"))
    rows = rows.union(c.select("pred", F.lit(0), "n", F.lit(0)))
    per = rows.groupBy("class").agg(F.sum("t").alias("tp"), F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred"))
    union = F.col("n_gt") + F.col("n_pred") - F.col("tp")
    return per.withColumn("iou", F.try_divide(F.col("tp"), union)).withColumn(
        "accuracy", F.try_divide(F.col("tp"), F.col("n_gt"))
    )


def mean_iou(pixels: DataFrame, ignore: int | None = IGNORE) -> DataFrame:
    """One row: mean IoU and mean accuracy over classes present, overall accuracy (4 dp)."""
    means = class_scores(pixels, ignore).agg(
        F.avg("iou").alias("mean_iou"), F.avg("accuracy").alias("mean_accuracy"),
        F.try_divide(F.sum("tp"), F.sum("n_gt")).alias("overall_accuracy"),
    )
    return means.select(*[round_to(c, 4).alias(c) for c in means.columns])


def dice_iou(masks: DataFrame, batch: str = "batch", smooth: float = 1.0) -> DataFrame:
    """Dice and IoU of binary masks (``gt``, ``pred`` in 0/1), per batch then averaged."""
    g, p = F.col("gt").cast("double"), F.col("pred").cast("double")
    sums = masks.groupBy(batch).agg(F.sum(g * p).alias("i"), F.sum(g).alias("g"), F.sum(p).alias("p"))
    i, total = F.col("i"), F.col("g") + F.col("p")
    per = sums.select(
        ((2.0 * i + smooth) / (total + smooth)).alias("dice"), ((i + smooth) / (total - i + smooth)).alias("iou")
    )
    return per.agg(F.avg("dice").alias("dice"), F.avg("iou").alias("iou"))


def binarise(logits: DataFrame, col: str = "logit", threshold: float = 0.5) -> DataFrame:
    """``pred`` = sigmoid over the threshold."""
    return logits.withColumn("pred", (vec.sigmoid(F.col(col)) > threshold).cast("int"))


def accuracy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """Share of rows whose largest logit (first on ties) is at the label."""
    return df.agg(F.avg((vec.argmax(F.col(logits)) == F.col(label)).cast("double")).alias("accuracy"))


def infer_classes(pixels: DataFrame, ignore: int | None = None) -> DataFrame:
    """Distinct class ids in masks; the name is the id as text."""
    if ignore is not None:
        pixels = pixels.filter(F.col("gt") != ignore)
    ids = pixels.select(F.col("gt").alias("id")).distinct()
    return ids.withColumn("name", F.col("id").cast("string"))


def mask_bbox(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Bounding box of the foreground (``value`` > 0); masks without any give no row."""
    return pixels.filter(F.col("value") > 0).groupBy(*keys).agg(
        F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max")
    )


def best_mask(masks: DataFrame, keys: list[str], score: str = "score", ord: str = "ord") -> DataFrame:
    """The candidate mask with the best score, first on ties."""
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(ord).alias("o"))).alias("_b")
    return masks.groupBy(*keys).agg(best).select(
        *keys, F.col("_b.o").alias(ord), (-F.col("_b.s")).alias(score)
    )
