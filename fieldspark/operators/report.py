"""Run reports: timings, throughput, prompts and dataset sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def profile_summary(timings: DataFrame, top: int | None = 10) -> DataFrame:
    """Count, total, mean, min and max per operation, share of the grand total; ``top`` by total.

    The window runs over one row per operation name.
    """
    per = timings.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ms").alias("total_ms"), F.avg("ms").alias("avg_ms"),
        F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"),
    )
    grand = timings.agg(F.sum("ms").alias("_grand"))
    shared = per.join(F.broadcast(grand)).withColumn(
        "share", F.coalesce(F.try_divide(F.col("total_ms"), F.col("_grand")), F.lit(0.0))
    ).drop("_grand")
    return shared if top is None else shared.orderBy(F.col("total_ms").desc(), "name").limit(top)


def throughput(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Images, rows and wall seconds with images/s and s/image. ``runs``: ``n_images, n_rows, wall_s``."""
    return runs.groupBy(*keys).agg(
        F.sum("n_images").alias("images"), F.sum("n_rows").alias("rows"), F.sum("wall_s").alias("wall_s")
    ).withColumn("img_per_s", F.coalesce(F.try_divide(F.col("images"), F.col("wall_s")), F.lit(0.0))).withColumn(
        "s_per_img", F.coalesce(F.try_divide(F.col("wall_s"), F.col("images")), F.lit(0.0))
    )


def prompt_stats(raw: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Raw and kept detections per prompt."""
    rows = raw.select(*keys, F.lit(1).alias("r"), F.lit(0).alias("k")).union(
        kept.select(*keys, F.lit(0), F.lit(1))
    )
    return rows.groupBy(*keys).agg(F.sum("r").alias("raw_detections"), F.sum("k").alias("detections"))


def split_counts(samples: DataFrame) -> DataFrame:
    """Samples and classes per split."""
    return samples.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("class").alias("n_classes")
    )


def class_ids(samples: DataFrame, split: str = "train") -> DataFrame:
    """Class number of every sample: position among the sorted class names of one split."""
    names = samples.filter(F.col("split") == split).select("class").distinct()
    # one row per class name
    ids = names.withColumn("class_idx", (F.dense_rank().over(Window.orderBy("class")) - 1).cast("int"))
    return samples.join(ids, "class", "left")
