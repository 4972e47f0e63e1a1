"""Greedy one-to-one matching of generated boxes to ground truth, and its metrics.

Generated boxes are visited in list order; each takes the unused ground-truth box of
its image with the greatest IoU (lowest index on ties) if that reaches the
threshold. Classes are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import boxes as bx
from ..scale import GROUP_LIMIT, bounded_broadcast, cut_lineage
from . import spatial as sp
from .streamed import FreeBoxes, box_rows, group_parts, in_order
from .suppress import field_array, overlap_join

PAIR = "struct<gt:array<int>,iou:array<double>>"
#: Largest number of candidate pairs of one image that is held in one array.
PAIR_LIMIT = 500_000
#: Largest number of true boxes of one image that one task holds, as an index of the free ones.
HELD_TRUTH = 2_000_000


def greedy(gt: np.ndarray, gen: np.ndarray, threshold: float):
    """Per generated box the matched ground-truth position (-1: none) and the IoU."""
    free = np.ones(len(gt), dtype=bool)
    area = (gt[:, 2] - gt[:, 0]) * (gt[:, 3] - gt[:, 1])
    pos, best = np.full(len(gen), -1, dtype=np.int32), np.zeros(len(gen))
    for k, g in enumerate(gen):
        w = np.minimum(g[2], gt[:, 2]) - np.maximum(g[0], gt[:, 0])
        h = np.minimum(g[3], gt[:, 3]) - np.maximum(g[1], gt[:, 1])
        inter = np.maximum(w, 0.0) * np.maximum(h, 0.0)
        union = area + (g[2] - g[0]) * (g[3] - g[1]) - inter
        iou = np.divide(inter, union, out=np.zeros_like(inter), where=free & (union != 0.0))
        at = int(iou.argmax())
        if iou[at] > 0.0 and iou[at] >= threshold:
            pos[k], best[k], free[at] = at, iou[at], False
    return pos, best


def _match_udf(threshold: float):
    @F.pandas_udf(PAIR)
    def run(
        g1: pd.Series, g2: pd.Series, g3: pd.Series, g4: pd.Series,
        p1: pd.Series, p2: pd.Series, p3: pd.Series, p4: pd.Series,
    ) -> pd.DataFrame:
        def boxes(parts):
            return np.column_stack([np.asarray(v, dtype=np.float64) for v in parts])

        found = [
            greedy(boxes(gt), boxes(gen), threshold)
            for gt, gen in zip(zip(g1, g2, g3, g4), zip(p1, p2, p3, p4))
        ]
        return pd.DataFrame({"gt": [f[0] for f in found], "iou": [f[1] for f in found]})

    return run


def _lists(df: DataFrame, image: str, name: str) -> DataFrame:
    body = sp.pack(("ord", F.col("ord")), *sp.flat(F.col("box"), "b"))
    return df.groupBy(image).agg(F.array_sort(F.collect_list(body)).alias(name))


def _small(gt: DataFrame, gen: DataFrame, image: str, threshold: float) -> DataFrame:
    both = _lists(gt, image, "_gt").join(_lists(gen, image, "_gen"), image)

    def edges(name: str):
        return [field_array(name, f"b_{e}") for e in bx.EDGES]

    found = both.withColumn("_m", _match_udf(threshold)(*edges("_gt"), *edges("_gen")))
    per_gen = found.select(
        image, "_gt",
        F.explode(
            F.arrays_zip(
                F.transform("_gen", lambda row: row["ord"]).alias("gen_ord"),
                F.col("_m.gt").alias("pos"), F.col("_m.iou").alias("iou"),
            )
        ).alias("z"),
    ).filter(F.col("z.pos") >= 0)
    return per_gen.select(
        image, F.get(F.col("_gt"), F.col("z.pos"))["ord"].alias("gt_ord"), F.col("z.gen_ord"), F.col("z.iou")
    )


def take_pairs(gen: np.ndarray, gt: np.ndarray) -> np.ndarray:
    """Positions of the pairs taken, for candidate pairs in visiting order."""
    used_gen, used_gt, taken = set(), set(), []
    for k, (p, g) in enumerate(zip(gen.tolist(), gt.tolist())):
        if p not in used_gen and g not in used_gt:
            used_gen.add(p)
            used_gt.add(g)
            taken.append(k)
    return np.asarray(taken, dtype=np.int32)


def _take_udf():
    @F.pandas_udf("array<int>")
    def run(gen: pd.Series, gt: pd.Series) -> pd.Series:
        return pd.Series([take_pairs(np.asarray(p), np.asarray(g)) for p, g in zip(gen, gt)])

    return run


def _finish(pairs: DataFrame, image: str) -> DataFrame:
    """Greedy choice over the candidate pairs of each image, held in one array."""
    body = F.struct("gen_ord", (-F.col("iou")).alias("neg"), "gt_ord")
    lists = pairs.groupBy(image).agg(F.array_sort(F.collect_list(body)).alias("_p"))
    lists = lists.select(image, "_p", _take_udf()(field_array("_p", "gen_ord"), field_array("_p", "gt_ord")).alias("_k"))
    rows = lists.select(image, F.explode(F.transform("_k", lambda pos: F.get(F.col("_p"), pos))).alias("_r"))
    return rows.select(image, F.col("_r.gt_ord"), F.col("_r.gen_ord"), (-F.col("_r.neg")).alias("iou"))


def _streamed(gt: DataFrame, gen: DataFrame, image: str, threshold: float) -> DataFrame:
    """Images read in list order by one task each: the true boxes are held, the generated ones pass by. No pair is stored."""
    fields = gt.schema
    schema = StructType([StructField("gt_ord", fields["ord"].dataType), StructField("gen_ord", gen.schema["ord"].dataType),
                         StructField("iou", DoubleType()), StructField(image, fields[image].dataType)])

    def rows(df: DataFrame, kind: int) -> DataFrame:
        flat = [F.col("box")[e].alias(e) for e in bx.EDGES]
        return df.select(F.col(image).alias("_k"), F.lit(kind).alias("_kind"), F.col("ord").cast("bigint").alias("_ord"), *flat).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        truth: list[tuple[np.ndarray, np.ndarray]] = []
        free: FreeBoxes | None = None
        for begins, part in group_parts(batches):
            if begins:
                truth, free = [], None
            kinds, ords, boxes = part.column(1).to_numpy(), part.column(2).to_numpy(), box_rows(part, 3)
            first = int(np.searchsorted(kinds, 1))
            if first:
                truth.append((boxes[:first], ords[:first]))
            if first == len(kinds) or not (truth or free):
                continue
            if free is None:
                free, truth = FreeBoxes(*(np.concatenate(column) for column in zip(*truth, strict=True)), threshold), []
            found = [(ord_, *pair) for ord_, box in zip(ords[first:].tolist(), boxes[first:], strict=True) if (pair := free.take(box))]
            if found:
                gen_ord, gt_ord, iou = zip(*found, strict=True)
                same = pa.DictionaryArray.from_arrays(pa.array([0] * len(found), pa.int32()), part.column(0)[:1]).dictionary_decode()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gt_ord, pa.int64()).cast(to_gt), pa.array(gen_ord, pa.int64()).cast(to_gen), pa.array(iou), same], schema.names)

    to_gt, to_gen = (pa.int32() if schema[k].dataType.typeName() == "integer" else pa.int64() for k in ("gt_ord", "gen_ord"))
    return in_order(rows(gt, 0).unionByName(rows(gen, 1)), ["_kind", "_ord"], run, schema).select(image, "gt_ord", "gen_ord", "iou")


def take_copies(pairs: list, gens: list, gts: list) -> tuple[list[int], list[int], list[float]]:
    """Greedy choice over different boxes: ``pairs`` (gen box, gt box, iou), and the list positions of each box's copies."""
    copies = {g["first"]: g["ords"] for g in gts}
    used = dict.fromkeys(copies, 0)
    partners: dict[int, list[tuple[float, int]]] = {}
    for p in pairs:
        partners.setdefault(p["gen"], []).append((-p["iou"], p["gt"]))
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for found in partners.values():
        found.sort(reverse=True)  # best last, so that exhausted ones are popped
    for ord_, first in sorted((o, g["first"]) for g in gens if g["first"] in partners for o in g["ords"]):
        found = partners[first]
        while found and used[found[-1][1]] == len(copies[found[-1][1]]):
            found.pop()
        if not found:
            continue
        best = found[-1][0]
        at, k = None, len(found)
        while k and found[k - 1][0] == best:
            k -= 1
            box = found[k][1]
            if used[box] < len(copies[box]) and (at is None or copies[box][used[box]] < copies[at][used[at]]):
                at = box
        for column, value in zip(out, (ord_, copies[at][used[at]], -best), strict=True):
            column.append(value)
        used[at] += 1
    return out


def _copies(df: DataFrame, image: str) -> DataFrame:
    """Different boxes of each image under the ``ord`` of their first copy, with the number of copies."""
    return df.groupBy(image, "box").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))


def _with_copies(pairs: DataFrame, gt: DataFrame, gen: DataFrame, image: str) -> DataFrame:
    """Pairs of images with many copies, decided from one row per pair of different boxes."""
    images = pairs.select(image).distinct()

    def lists(df: DataFrame, name: str) -> DataFrame:
        of_box = df.join(images, image, "left_semi").groupBy(image, "box").agg(F.array_sort(F.collect_list("ord")).alias("ords"))
        return of_box.groupBy(image).agg(F.collect_list(F.struct(F.element_at("ords", 1).alias("first"), "ords")).alias(name))

    @F.pandas_udf("struct<gen:array<bigint>,gt:array<bigint>,iou:array<double>>")
    def take(p: pd.Series, gens: pd.Series, gts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([take_copies(*row) for row in zip(p, gens, gts)], columns=["gen", "gt", "iou"])

    body = F.struct(F.col("gen_ord").alias("gen"), F.col("gt_ord").alias("gt"), "iou")
    both = pairs.groupBy(image).agg(F.collect_list(body).alias("_p")).join(lists(gen, "_gen"), image).join(lists(gt, "_gt"), image)
    taken = both.select(image, take("_p", "_gen", "_gt").alias("_t"))
    return taken.select(image, F.inline(F.arrays_zip(F.col("_t.gt").alias("gt_ord"), F.col("_t.gen").alias("gen_ord"), F.col("_t.iou").alias("iou"))))


def _large(gt: DataFrame, gen: DataFrame, image: str, threshold: float, pair_limit: int) -> DataFrame:
    """The same result for images with more true boxes than one task holds, and for thresholds below ``sp.LEAST_IOU``.

    Only pairs that reach the threshold are formed, between different boxes, in cells that follow the boxes' sizes. An
    image whose boxes repeat so often that their copies make more than ``pair_limit`` pairs, but the different ones do not,
    is decided from those (its list positions, not its pairs, are held by one task). All others go on in rounds.
    """
    if threshold < sp.LEAST_IOU:
        pairs = overlap_join(gen, gt, [image], max(threshold, 0.0), strict=threshold <= 0.0)
        return _rounds(cut_lineage(pairs.select(image, F.col("l_ord").alias("gen_ord"), F.col("r_ord").alias("gt_ord"), "iou")), image, pair_limit)
    gts, gens = cut_lineage(_copies(gt, image)), cut_lineage(_copies(gen, image))
    once = sp.near_pairs(gens, gts, [image], threshold)
    once = cut_lineage(once.select(image, F.col("l_ord").alias("gen_ord"), F.col("r_ord").alias("gt_ord"), "iou"))
    if gts.filter("n > 1").isEmpty() and gens.filter("n > 1").isEmpty():
        return _rounds(once, image, pair_limit)
    counted = once
    for side, name in ((gens, "gen_ord"), (gts, "gt_ord")):
        counted = counted.join(side.select(image, F.col("ord").alias(name), F.col("n").alias(f"{name}_n")), [image, name])
    load = counted.groupBy(image).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col("gen_ord_n") * F.col("gt_ord_n")).alias("rows"))
    copied = bounded_broadcast(cut_lineage(load.filter((F.col("rows") > pair_limit) & (F.col("pairs") <= pair_limit)).select(image)))
    rows = once.join(copied, image, "left_anti")
    for df, name in ((gen, "gen_ord"), (gt, "gt_ord")):
        # every copy in place of the first one
        own = df.select(image, "box", F.col("ord").alias("_own"))
        firsts = _copies(df, image).select(image, "box", F.col("ord").alias(name))
        rows = rows.join(own.join(firsts, [image, "box"]).drop("box"), [image, name]).drop(name).withColumnRenamed("_own", name)
    rows = cut_lineage(rows.select(image, "gen_ord", "gt_ord", "iou"))
    return _rounds(rows, image, pair_limit).unionByName(_with_copies(once.join(copied, image, "left_semi"), gt, gen, image))


def _rounds(pairs: DataFrame, image: str, pair_limit: int) -> DataFrame:
    """Greedy choice over candidate pairs of any number.

    An image with up to ``pair_limit`` open pairs is finished in one pass. Larger ones go on in rounds of two exact steps: a
    generated box takes its best free partner if no earlier undecided box has that partner among its
    candidates; and the pairs of the first boxes in list order, about half of ``pair_limit``, are
    settled together. Each round drops the pairs of boxes that are taken or passed.
    """
    parts: list[DataFrame] = []

    def settle(new: DataFrame, passed: DataFrame) -> DataFrame:
        parts.append(new.select(image, "gt_ord", "gen_ord", "iou"))
        open_ = pairs.join(passed, [image, "gen_ord"], "left_anti")
        return cut_lineage(open_.join(new.select(image, "gt_ord"), [image, "gt_ord"], "left_anti"))

    while True:
        open_pairs = pairs.groupBy(image).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > pair_limit)
        open_pairs = cut_lineage(open_pairs)
        if open_pairs.isEmpty():
            break
        best = pairs.groupBy(image, "gen_ord").agg(
            F.max(F.struct("iou", (-F.col("gt_ord")).alias("neg"))).alias("b")
        ).select(image, "gen_ord", (-F.col("b.neg")).alias("gt_ord"), F.col("b.iou").alias("iou"))
        first = pairs.groupBy(image, "gt_ord").agg(F.min("gen_ord").alias("gen_ord"))
        new = cut_lineage(best.join(first, [image, "gt_ord", "gen_ord"]))
        pairs = settle(new, new.select(image, "gen_ord"))
        share = F.lit(pair_limit / 2.0) / F.greatest(F.max("n"), F.lit(pair_limit))
        part = open_pairs.agg(share.alias("s")).first().s
        cut = pairs.groupBy(image).agg(F.percentile_approx("gen_ord", F.lit(part), F.lit(10_000)).alias("_cut"))
        early = pairs.join(bounded_broadcast(cut), image).filter(F.col("gen_ord") <= F.col("_cut")).drop("_cut")
        pairs = settle(cut_lineage(_finish(early, image)), early.select(image, "gen_ord").distinct())
    out = _finish(pairs, image)
    for p in parts:
        out = out.unionByName(p)
    return out


def image_sizes(gt: DataFrame, gen: DataFrame, image: str, counted: Column | None = None) -> DataFrame:
    """Boxes per image and side; images of either side appear, also where no generated box is ``counted``."""
    one = F.lit(1) if counted is None else F.when(counted, 1).otherwise(0)
    rows = gt.select(image, F.lit(1).alias("g"), F.lit(0).alias("p")).union(gen.select(image, F.lit(0), one))
    return rows.groupBy(image).agg(F.sum("g").alias("num_gt"), F.sum("p").alias("num_generated"))


def match_boxes(
    gt: DataFrame, gen: DataFrame, iou_threshold: float = 0.5, image: str = "image_path",
    limit: int = GROUP_LIMIT, sizes: DataFrame | None = None, pair_limit: int = PAIR_LIMIT, held_truth: int = HELD_TRUTH,
) -> DataFrame:
    """Matched pairs ``(image, gt_ord, gen_ord, iou)``.

    Both inputs carry the image key, ``ord`` (list position, an integer) and ``box``. ``sizes`` may
    give the counts per image (``image_sizes``) if they are at hand. Images over ``limit`` boxes are streamed through one task
    each, those with more than ``held_truth`` true boxes are matched in rounds over stored pairs.
    """
    gt, gen = gt.select(image, "ord", "box"), gen.select(image, "ord", "box")
    sizes = image_sizes(gt, gen, image) if sizes is None else sizes
    large_one = (F.col("num_gt") > limit) | (F.col("num_generated") > limit)
    hot = cut_lineage(sizes.filter(large_one).select(image))
    if hot.isEmpty():
        return _small(gt, gen, image, iou_threshold)
    hot = bounded_broadcast(hot)
    out = _small(gt.join(hot, image, "left_anti"), gen.join(hot, image, "left_anti"), image, iou_threshold)
    gt, gen = gt.join(hot, image, "left_semi"), gen.join(hot, image, "left_semi")
    if iou_threshold >= sp.LEAST_IOU:
        huge = cut_lineage(sizes.filter(F.col("num_gt") > held_truth).select(image))
        if huge.isEmpty():
            return out.unionByName(_streamed(gt, gen, image, iou_threshold))
        huge = bounded_broadcast(huge)
        out = out.unionByName(_streamed(gt.join(huge, image, "left_anti"), gen.join(huge, image, "left_anti"), image, iou_threshold))
        gt, gen = gt.join(huge, image, "left_semi"), gen.join(huge, image, "left_semi")
    return out.unionByName(_large(gt, gen, image, iou_threshold, pair_limit))


def _ratio(n, d):
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def evaluate(
    gt: DataFrame, gen: DataFrame, similarity_threshold: float = 0.5, iou_threshold: float = 0.5,
    image: str = "image_path", with_pairs: bool = False, limit: int = GROUP_LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """(totals, per image) with TP/FP/FN, precision and recall; totals add F1.

    Every image of either side appears, also one whose generated boxes all score too low. ``with_pairs`` adds the matched pairs of each
    image as an array; the pairs as rows come from ``match_boxes``.
    """
    scored = similarity_threshold > 0 and "score" in gen.columns
    passes = F.coalesce(F.col("score"), F.lit(1.0)) >= similarity_threshold if scored else F.lit(similarity_threshold <= 1.0)
    # one row per image, read again for the large-image check and for the result
    sizes = cut_lineage(image_sizes(gt, gen, image, passes))
    gen = gen.filter(passes)
    pairs = match_boxes(gt, gen, iou_threshold, image, limit, sizes)
    aggs = [F.count(F.lit(1)).alias("num_tp")]
    if with_pairs:
        pair = F.struct(
            F.col("gt_ord").cast("bigint").alias("gt"), F.col("gen_ord").cast("bigint").alias("gen"), F.col("iou")
        )
        aggs.append(F.array_sort(F.collect_list(pair)).alias("matched_pairs"))
    per_image = sizes.join(pairs.groupBy(image).agg(*aggs), image, "left").withColumn(
        "num_tp", F.coalesce("num_tp", F.lit(0))
    )
    if with_pairs:
        empty = F.array().cast(per_image.schema["matched_pairs"].dataType)
        per_image = per_image.withColumn("matched_pairs", F.coalesce("matched_pairs", empty))
    tp, n_gt, n_gen = F.col("num_tp"), F.col("num_gt"), F.col("num_generated")
    per_image = (
        per_image.withColumn("num_fp", n_gen - tp)
        .withColumn("num_fn", n_gt - tp)
        .withColumn("precision", _ratio(tp, n_gen))
        .withColumn("recall", _ratio(tp, n_gt))
    )
    totals = per_image.agg(
        *[F.coalesce(F.sum(f"num_{k}"), F.lit(0)).alias(f"total_{k}") for k in ("tp", "fp", "fn")]
    )
    t, fp, fn = F.col("total_tp"), F.col("total_fp"), F.col("total_fn")
    totals = totals.withColumn("precision", _ratio(t, t + fp)).withColumn("recall", _ratio(t, t + fn))
    p, r = F.col("precision"), F.col("recall")
    return totals.withColumn("f1", _ratio(2 * (p * r), p + r)), per_image
