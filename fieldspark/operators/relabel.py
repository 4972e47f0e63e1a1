"""Re-labelling detections by their nearest class prototype."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..scale import bounded_broadcast
from .similarity import similarity


def resolve_prototypes(prototypes: DataFrame) -> DataFrame:
    """One prototype per class name: the last one listed, at the position of the first."""
    return prototypes.groupBy("class").agg(
        F.min("cls_ord").alias("cls_ord"), F.max_by("embedding", "cls_ord").alias("embedding")
    )


def relabel(detections: DataFrame, prototypes: DataFrame, **plan) -> DataFrame:
    """Detections with ``label`` replaced by the best prototype's class and ``classifier_confidence``.

    ``detections``: ``label``, ``embedding`` and any other columns (the embedding is not
    returned); ``prototypes``: ``class, cls_ord, embedding``. Scores start at -1 and must
    rise above it; the earlier class wins ties. Without a better class the label stays
    and the confidence is -1. Detections are neither shuffled nor joined.
    """
    # sortable text of the list position, so that the first name on ties is the earlier class
    code = F.format_string("%012d", "cls_ord")
    protos = resolve_prototypes(prototypes)
    everywhere = F.lit(0).alias("_all")
    refs = protos.select(everywhere, code.alias("class"), "embedding")
    kept = [c for c in detections.columns if c != "embedding"]
    best = similarity(
        detections.select("*", everywhere), refs, ["_all"], kept, mode="add", best_only=F.lit(True),
        keep_unmatched=True, **plan,
    ).withColumnRenamed("class", "_code")
    names = bounded_broadcast(protos.select(code.alias("_code"), F.col("class").alias("_class")))
    out = best.join(names, "_code", "left")
    better = F.col("similarity") > -1.0
    return out.select(
        *[F.when(better, F.col("_class")).otherwise(F.col(c)).alias(c) if c == "label" else F.col(c) for c in kept],
        F.when(better, F.col("similarity")).otherwise(F.lit(-1.0)).alias("classifier_confidence"),
    )


def usable_detections(detections: DataFrame, images: DataFrame) -> DataFrame:
    """Detections of images that exist, with a valid box."""
    known = bounded_broadcast(images.select("img").distinct())
    return detections.join(known, "img", "left_semi").filter(bx.valid_bbox("bounding_box"))


def class_summary(classified: DataFrame) -> DataFrame:
    """Objects and distinct images per label."""
    return classified.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_objects"), F.count_distinct("img").alias("n_images")
    )


def classes_per_image(classified: DataFrame) -> DataFrame:
    return classified.select("img", "label").distinct()


def manifest(classified: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct (class, image); every configured class is listed, with a null image when empty."""
    pairs = classified.select(F.col("label").alias("class"), "img").distinct()
    return classes.select("class").distinct().join(pairs, "class", "left")
