"""Few-shot classification of proposals by similarity to class supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions.numbers import round_to
from ..scale import bounded_broadcast, cut_lineage
from .similarity import similarity
from .suppress import nms

TOP_K = 100
IMAGE = ["backend", "image_key"]


def topk_proposals(props: DataFrame, k: int = TOP_K, objectness: float = 0.1, keys: list[str] | None = None):
    """The ``k`` best proposals of each image among those above the objectness threshold."""
    keys = keys or IMAGE
    rank = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "ord")
    passing = props.filter(F.col("score") > objectness)
    return passing.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= k).drop("_r")


def orient_supports(supports: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable supports, report of skipped classes) for the proposals' dimension per backend.

    ``supports``: ``backend, class, vectors array<array<float>>``; ``dims``:
    ``backend, dim``. A matrix stored (D, N) is transposed; any other shape is skipped.
    """
    m = F.col("vectors")
    first = F.get(m, F.lit(0))
    cols = F.size(first)
    flipped = F.transform(F.sequence(F.lit(0), cols - 1), lambda c: F.transform(m, lambda row: F.get(row, c)))
    joined = supports.join(dims, "backend").withColumn(
        "_fit",
        F.when(cols == F.col("dim"), m).when(F.size(m) == F.col("dim"), flipped),
    )
    good = joined.filter(F.col("_fit").isNotNull()).select(
        "backend", "class", F.posexplode("_fit").alias("ord", "embedding")
    )
    bad = joined.filter(F.col("_fit").isNull()).select(
        "backend", "class", F.size(m).alias("rows"), cols.alias("cols"), "dim"
    )
    return good, bad


def split_by_dim(supports: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(supports whose dimension agrees with ``dims`` per backend, report of the others)."""
    sized = supports.withColumn("dim", F.size("embedding"))
    good = sized.join(dims.select("backend", "dim").distinct(), ["backend", "dim"], "left_semi")
    bad = sized.join(dims.select("backend", "dim").distinct(), ["backend", "dim"], "left_anti")
    return good.drop("dim"), bad.groupBy("backend", "class", "dim").agg(F.count(F.lit(1)).alias("n_vectors"))


def fit_supports(supports: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable supports, report of skipped classes) for support rows ``backend, class, ord, embedding``.

    ``dims``: ``backend, dim`` of the proposals. A class whose vectors have that dimension is used as it is. One
    that has exactly ``dim`` vectors of another common length was stored transposed and is turned; any other is skipped and
    reported with its number of vectors, their shortest and longest length and the dimension asked for. A backend without
    dimension has no proposals, so its classes are neither used nor reported.
    """
    keys = ["backend", "class"]
    length = F.size("embedding")
    shapes = supports.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_vectors"), F.min(length).alias("shortest"), F.max(length).alias("longest")
    ).join(dims.select("backend", "dim").distinct(), "backend")
    even = F.col("shortest") == F.col("longest")
    shapes = cut_lineage(shapes.withColumn("_fit", F.when(even & (F.col("longest") == F.col("dim")), "used").when(
        even & (F.col("n_vectors") == F.col("dim")), "turned").otherwise("skipped")))

    def of(kind: str) -> DataFrame:
        return bounded_broadcast(shapes.filter(F.col("_fit") == kind).select(*keys))

    used = supports.join(of("used"), keys, "left_semi").select(*keys, "ord", "embedding")
    # one value of each vector per new row; only classes with as many rows as a vector has values come here
    values = supports.join(of("turned"), keys, "left_semi").select(*keys, "ord", F.posexplode("embedding").alias("_k", "_v"))
    turned = values.groupBy(*keys, "_k").agg(F.array_sort(F.collect_list(F.struct("ord", "_v"))).alias("_column"))
    turned = turned.select(*keys, F.col("_k").cast(supports.schema["ord"].dataType).alias("ord"),
                           F.transform("_column", lambda e: e["_v"]).alias("embedding"))
    skipped = shapes.filter("_fit = 'skipped'").select(*keys, "n_vectors", "shortest", "longest", "dim")
    return used.unionByName(turned), skipped


def classify_repaired(props: DataFrame, supports: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(detections of ``classify``, report of ``fit_supports``): supports are turned or skipped to fit the proposals."""
    dims = props.groupBy("backend").agg(F.max(F.size("embedding")).alias("dim"))
    usable, skipped = fit_supports(supports, dims)
    return classify(props, usable, **options), skipped


def classify(
    props: DataFrame, supports: DataFrame, objectness: float = 0.1, similarity_threshold: float = 0.2,
    nms_iou: float = 0.5, k: int = TOP_K, **plan,
) -> DataFrame:
    """Detections ``backend, image_key, box, class, score`` after class-agnostic suppression.

    ``props``: ``backend, image_key, ord, score, x1..y2, embedding``. Every class above
    the threshold gives a detection; suppression then keeps the best of each place.
    An image has at most ``k`` proposals here, so its group is bounded.
    """
    top = topk_proposals(props, k, objectness)
    # equal boxes overlap fully, so of a box with an area only the best class can survive
    solid = bx.area(bx.make_box()) > 0 if nms_iou < 1.0 else None
    scored = similarity(top, supports, ["backend"], [*IMAGE, "ord", *bx.EDGES], best_only=solid, **plan)
    hits = scored.filter(F.col("similarity") > similarity_threshold)
    hits = hits.withColumn("box", bx.make_box()).withColumn("_o", F.struct("class", "ord"))
    kept = nms(hits, IMAGE, "box", "similarity", "_o", nms_iou, bounded=True)
    return kept.select(*IMAGE, "ord", "box", "class", F.col("similarity").alias("score"))


def build_supports(vectors: DataFrame, prototype: bool = False) -> DataFrame:
    """Support vectors per (backend, class): count, dimension, and optionally their mean.

    The vectors themselves stay rows; only their summary is aggregated.
    """
    keys = ["backend", "class"]
    summary = vectors.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")
    )
    if not prototype:
        return summary
    means = (
        vectors.select(*keys, F.posexplode("embedding").alias("k", "v"))
        .groupBy(*keys, "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
        .groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("_m"))
    )
    return summary.join(means, keys).select(*keys, "n", "dim", F.transform("_m", lambda e: e["m"]).alias("prototype"))


def best_anchor(anchors: DataFrame, keys: list[str], box: str = "box", ref: str = "ref", ord: str = "ord"):
    """The anchor with the greatest IoU to the reference box; the first one on ties."""
    score = bx.iou(F.col(box), F.col(ref), "union_guard")
    best = F.min(F.struct((-score).alias("s"), F.col(ord).alias("o"), F.col(box).alias("b"))).alias("_b")
    return anchors.groupBy(*keys).agg(best).select(
        *keys, F.col("_b.o").alias(ord), F.col("_b.b").alias(box), (-F.col("_b.s")).alias("iou")
    )


def crop_size_search(generated: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Crop sizes in descending order with their mean IoU and the early-stop decision.

    ``generated``: ``size, iou``; ``sizes`` lists sizes to try, also those without boxes.
    Each size's mean (3 dp) is kept; the search goes on while there is no previous
    value or the mean improves on it by more than a tenth. A size without boxes is passed
    over. The fold runs over one row per size.
    """
    avg = generated.groupBy("size").agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("avg_iou"))
    if sizes is not None:
        avg = sizes.select("size").distinct().join(avg, "size", "left")
    ordered = avg.agg(
        F.sort_array(F.collect_list(F.struct("size", "avg_iou")), asc=False).alias("_l")
    )
    start = F.struct(
        F.lit(0.0).alias("prev"), F.lit(True).alias("go"),
        F.filter(
            F.array(F.struct(
                F.lit(0).cast("int").alias("size"), F.lit(0.0).alias("avg_iou"), F.lit(True).alias("improved")
            )),
            lambda _x: F.lit(False),
        ).alias("seen"),
    )

    def step(acc: Column, item: Column) -> Column:
        mean = item["avg_iou"]
        better = (acc["prev"] == 0) | (
            (mean > acc["prev"]) & (F.abs(mean - acc["prev"]) / F.nullif(acc["prev"], F.lit(0.0)) > 0.1)
        )
        better = F.coalesce(better, F.lit(False))
        row = F.struct(item["size"].cast("int").alias("size"), round_to(mean, 3).alias("avg_iou"), better.alias("improved"))
        moved = F.struct(
            round_to(mean, 3).alias("prev"), better.alias("go"), F.array_append(acc["seen"], row).alias("seen")
        )
        return F.when(~acc["go"] | mean.isNull(), acc).otherwise(moved)

    folded = ordered.select(F.aggregate("_l", start, step, lambda acc: acc["seen"]).alias("_s"))
    return folded.select(F.inline("_s"))
