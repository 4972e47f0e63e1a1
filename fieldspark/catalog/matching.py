"""Matching generated boxes to ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import view, with_views
from ..functions import boxes as bx
from ..operators import match
from . import query
from .detections import overlap_sql

# One generated box of every image per step; ``used`` lists the ground truth taken so far.
MATCH = f"""
, gen as (select *, dense_rank() over (order by img) gid, row_number() over (partition by img order by ord) rn from fx_detections where score >= 0.5e0),
cand as (select d.gid, d.rn, list({{'iou': {overlap_sql('g.', 'd.')}, 'neg': -g.ord}}) c from gen d join fx_gt g on g.img = d.img
  where {overlap_sql('g.', 'd.')} >= 0.5e0 group by d.gid, d.rn),
walk(gid, rn, used, hit) as (
  select distinct gid, cast(0 as bigint), list_filter([cast(0 as bigint)], lambda z: false), cast(null as struct(iou double, neg bigint)) from gen
  union all
  select w.gid, w.rn + 1, case when best is null then w.used else list_append(w.used, best.neg) end, best
  from (select w.gid, w.rn, w.used, list_max(list_filter(c.c, lambda z: not list_contains(w.used, z.neg))) best
    from walk w join gen g on g.gid = w.gid and g.rn = w.rn + 1 left join cand c on c.gid = g.gid and c.rn = g.rn) w),
pairs as (select g.img, -w.hit.neg gt_ord, g.ord gen_ord, w.hit.iou iou from walk w join gen g on g.gid = w.gid and g.rn = w.rn where w.hit is not null)"""


def sides(spark, sf):
    gt = view(spark, sf, "fx_gt").withColumn("box", bx.make_box())
    gen = view(spark, sf, "fx_detections").withColumn("box", bx.make_box())
    return gt, gen


@query(
    "matched_pairs",
    with_views("fx_gt", recursive=True, body=MATCH + " select img, gt_ord, gen_ord, round(iou, 6) as iou from pairs"),
)
def matched_pairs(spark, sf):
    gt, gen = sides(spark, sf)
    return match.match_boxes(gt, gen.filter(F.col("score") >= 0.5), 0.5, "img").withColumn("iou", F.round("iou", 6))


@query(
    "evaluation_totals",
    with_views("fx_gt", recursive=True, body=MATCH + """
, c as (select (select count(*) from pairs) tp, (select count(*) from gen) p, (select count(*) from fx_gt) g)
select tp as total_tp, p - tp as total_fp, g - tp as total_fn, round(cast(tp as double) / p, 6) as "precision", round(cast(tp as double) / g, 6) as recall,
  round(2 * (cast(tp as double) / p) * (cast(tp as double) / g) / (cast(tp as double) / p + cast(tp as double) / g), 6) as f1 from c"""),
)
def evaluation_totals(spark, sf):
    totals, _ = match.evaluate(*sides(spark, sf), 0.5, 0.5, "img")
    ratios = [F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]
    return totals.select("total_tp", "total_fp", "total_fn", *ratios)


@query(
    "evaluation_per_image",
    with_views("fx_gt", recursive=True, body=MATCH + """
, k as (select img, count(*) tp from pairs group by img), p as (select img, count(*) p from gen group by img),
g as (select img, count(*) g from fx_gt group by img),
i as (select img from fx_gt union select img from fx_detections),
a as (select img, coalesce(g, 0) g, coalesce(p, 0) p, coalesce(tp, 0) tp from i left join g using (img) left join p using (img) left join k using (img))
select img, g as num_gt, p as num_generated, tp as num_tp, p - tp as num_fp, g - tp as num_fn,
  round(case when p > 0 then cast(tp as double) / p else 0e0 end, 6) as "precision", round(case when g > 0 then cast(tp as double) / g else 0e0 end, 6) as recall
from a"""),
)
def evaluation_per_image(spark, sf):
    _, per = match.evaluate(*sides(spark, sf), 0.5, 0.5, "img")
    ratios = [F.round(c, 6).alias(c) for c in ("precision", "recall")]
    return per.select("img", "num_gt", "num_generated", "num_tp", "num_fp", "num_fn", *ratios)


# A fifth of the images has no truth, and there every other one has only boxes that score too low.
_NUMBER = "cast(substr(img, 5, 4) as int)"
_SPARSE = f"""
, some_gt as (select * from fx_gt where {_NUMBER} % 5 <> 0),
some_gen as (select img, ord, x1, y1, x2, y2, case when {_NUMBER} % 10 = 0 then score * 0.4e0 else score end score from fx_detections)"""


@query(
    "evaluation_sparse_images",
    with_views("fx_gt", recursive=True, body=_SPARSE + MATCH.replace("from fx_detections", "from some_gen").replace("fx_gt", "some_gt") + """
, k as (select img, count(*) tp from pairs group by img), p as (select img, count(*) p from gen group by img),
g as (select img, count(*) g from some_gt group by img), i as (select img from some_gt union select img from some_gen),
a as (select img, coalesce(g, 0) g, coalesce(p, 0) p, coalesce(tp, 0) tp from i left join g using (img) left join p using (img) left join k using (img))
select img, g as num_gt, p as num_generated, tp as num_tp, p - tp as num_fp, g - tp as num_fn,
  round(case when p > 0 then cast(tp as double) / p else 0e0 end, 6) as "precision", round(case when g > 0 then cast(tp as double) / g else 0e0 end, 6) as recall
from a"""),
)
def evaluation_sparse_images(spark, sf):
    """Images stay in the report although none of their boxes counts."""
    gt, gen = sides(spark, sf)
    number = F.substring("img", 5, 4).cast("int")
    gt = gt.filter(number % 5 != 0)
    gen = gen.withColumn("score", F.when(number % 10 == 0, F.col("score") * 0.4).otherwise(F.col("score")))
    _, per = match.evaluate(gt, gen, 0.5, 0.5, "img")
    ratios = [F.round(c, 6).alias(c) for c in ("precision", "recall")]
    return per.select("img", "num_gt", "num_generated", "num_tp", "num_fp", "num_fn", *ratios)


@query(
    "image_union",
    with_views("fx_gt", body="select img from fx_gt union select img from fx_detections"),
)
def image_union(spark, sf):
    return match.image_sizes(*sides(spark, sf), "img").select("img").orderBy("img")


# One of forty boxes lies in one image, which goes through cells of size classes.
_HOT = """
, hot_gt as (select case when ord % 40 = 0 then 'img_hot.jpg' else img end as img, ord, x1, y1, x2, y2 from fx_gt),
hot_gen as (select case when ord % 40 = 0 then 'img_hot.jpg' else img end as img, ord, x1, y1, x2, y2, score from fx_detections)"""


@query(
    "evaluation_hot_image",
    with_views("fx_gt", recursive=True, body=_HOT + MATCH.replace("from fx_detections", "from hot_gen").replace("fx_gt", "hot_gt") + """
, k as (select img, count(*) tp, round(sum(iou), 4) as iou_sum from pairs group by img), p as (select img, count(*) p from gen group by img),
g as (select img, count(*) g from hot_gt group by img)
select img, g as num_gt, p as num_generated, coalesce(tp, 0) as num_tp, coalesce(iou_sum, 0) as iou_sum from g join p using (img) left join k using (img)"""),
)
def evaluation_hot_image(spark, sf):
    """One image holds one of forty boxes, whatever the scale; images over 20 boxes are matched through cells."""
    name = F.when(F.col("ord") % 40 == 0, "img_hot.jpg").otherwise(F.col("img"))
    gt, gen = (side.withColumn("img", name).select("img", "ord", "box", *more) for side, more in zip(sides(spark, sf), ((), ("score",))))
    gen = gen.filter(F.col("score") >= 0.5)
    found = match.match_boxes(gt, gen, 0.5, "img", limit=20).groupBy("img").agg(
        F.count(F.lit(1)).alias("num_tp"), F.round(F.sum("iou"), 4).alias("iou_sum"))
    return match.image_sizes(gt, gen, "img").join(found, "img", "left").filter("num_gt > 0 AND num_generated > 0").select(
        "img", "num_gt", "num_generated", F.coalesce("num_tp", F.lit(0)).alias("num_tp"), F.coalesce("iou_sum", F.lit(0.0)).alias("iou_sum"))
