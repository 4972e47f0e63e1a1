"""Segmentation metrics, dataset tables and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view, with_views
from ..operators import report
from ..operators import segmetrics as sm
from ..plans import labelling
from ..sources import readers
from . import query
from .detections import round_sql


@query(
    "confusion_counts",
    with_views("fx_pixels", body="select gt, pred, count(*) as n from fx_pixels where gt <> 255 group by gt, pred"),
)
def confusion_counts(spark, sf):
    return sm.confusion(view(spark, sf, "fx_pixels"))


CLASSES = """
, p as (select gt, pred from fx_pixels where gt <> 255),
c as (select k as class, sum(case when gt = k and pred = k then 1 else 0 end) tp, sum(case when gt = k then 1 else 0 end) g,
   sum(case when pred = k then 1 else 0 end) q from p, (select distinct gt k from p union select distinct pred from p) group by k),
s as (select class, tp, g, q, cast(tp as double) / (g + q - tp) iou, cast(tp as double) / nullif(g, 0) acc from c)"""


@query(
    "class_scores",
    with_views("fx_pixels", body=CLASSES + """
select class, cast(tp as bigint) as tp, cast(g as bigint) as n_gt, cast(q as bigint) as n_pred, round(iou, 6) as iou, round(acc, 6) as accuracy from s"""),
)
def class_scores(spark, sf):
    s = sm.class_scores(view(spark, sf, "fx_pixels"))
    return s.select("class", "tp", "n_gt", "n_pred", F.round("iou", 6).alias("iou"), F.round("accuracy", 6).alias("accuracy"))


@query(
    "mean_iou",
    with_views("fx_pixels", body=CLASSES + f"""
, m as (select avg(iou) a, avg(acc) b, cast(sum(tp) as double) / sum(g) o from s)
select {round_sql("a", 4)} as mean_iou, {round_sql("b", 4)} as mean_accuracy, {round_sql("o", 4)} as overall_accuracy from m"""),
)
def mean_iou(spark, sf):
    return labelling.seg_metrics(view(spark, sf, "fx_pixels")).iou


@query(
    "dice_scores",
    with_views("fx_pixels", body="""
, b as (select batch, sum(case when gt = 1 and pred = 1 then 1e0 else 0e0 end) i, sum(case when gt = 1 then 1e0 else 0e0 end) g,
   sum(case when pred = 1 then 1e0 else 0e0 end) p from fx_pixels where gt <> 255 group by batch)
select round(avg((2 * i + 1) / (p + g + 1)), 6) as dice, round(avg((i + 1) / (p + g - i + 1)), 6) as iou from b"""),
)
def dice_scores(spark, sf):
    d = labelling.seg_metrics(view(spark, sf, "fx_pixels")).dice
    return d.select(F.round("dice", 6).alias("dice"), F.round("iou", 6).alias("iou"))


@query(
    "binary_masks",
    """
with b as (select label as batch, unnest(embedding) x, unnest(range(0, 64)) % 3 = 0 as g from embeddings),
m as (select batch, g, 1 / (1 + exp(-cast(x as double) * 20)) > 0.5e0 as p from b),
s as (select batch, sum(case when g and p then 1e0 else 0e0 end) i, sum(case when g then 1e0 else 0e0 end) g, sum(case when p then 1e0 else 0e0 end) p from m group by batch)
select round(avg((2 * i + 1) / (p + g + 1)), 6) as dice, round(avg((i + 1) / (p + g - i + 1)), 6) as iou from s""",
)
def binary_masks(spark, sf):
    long = table(spark, sf, "embeddings").select(F.col("label").alias("batch"), F.posexplode("embedding").alias("k", "v"))
    masks = long.select("batch", (F.col("k") % 3 == 0).cast("int").alias("gt"), (F.col("v").cast("double") * 20).alias("logit"))
    d = sm.dice_iou(sm.binarise(masks))
    return d.select(F.round("dice", 6).alias("dice"), F.round("iou", 6).alias("iou"))


@query(
    "logit_accuracy",
    """
select round(avg(case when (list_position(embedding, list_max(embedding)) - 1) % 10 = label then 1e0 else 0e0 end), 6) as accuracy from embeddings""",
)
def logit_accuracy(spark, sf):
    # the greatest of all 64 values names one of the ten classes
    e = table(spark, sf, "embeddings")
    wide = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.array_max(F.filter("embedding", lambda v, i: i % 10 == c)))
    return sm.accuracy(e.select(wide.alias("logits"), "label")).select(F.round("accuracy", 6).alias("accuracy"))


@query(
    "mask_classes",
    with_views("fx_pixels", body="select distinct gt as id, cast(gt as varchar) as name from fx_pixels"),
)
def mask_classes(spark, sf):
    return sm.infer_classes(view(spark, sf, "fx_pixels"))


@query(
    "mask_boxes",
    with_views("fx_pixels", body="""
select image, min(pix % 97) as x_min, min(pix // 97) as y_min, max(pix % 97) as x_max, max(pix // 97) as y_max from fx_pixels where pred > 2 group by image"""),
)
def mask_boxes(spark, sf):
    p = view(spark, sf, "fx_pixels").select(
        "image", (F.col("pix") % 97).alias("x"), F.floor(F.col("pix") / 97).alias("y"), (F.col("pred") > 2).cast("int").alias("value")
    )
    return sm.mask_bbox(p, ["image"])


@query(
    "best_masks",
    """
select user_id, event_id as ord, value as score from (select *, row_number() over (partition by user_id order by value desc, event_id) rn from events) where rn = 1""",
)
def best_masks(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("ord"), F.col("value").alias("score"))
    return sm.best_mask(e, ["user_id"])


@query(
    "profile_summary",
    with_views("fx_timings", body="""
select name, count(*) as n, round(sum(ms), 4) as total_ms, round(avg(ms), 6) as avg_ms, min(ms) as min_ms, max(ms) as max_ms,
  round(sum(ms) / (select sum(ms) from fx_timings), 6) as share from fx_timings group by name order by sum(ms) desc limit 10"""),
)
def profile_summary(spark, sf):
    s = report.profile_summary(view(spark, sf, "fx_timings"))
    digits = {"total_ms": 4, "avg_ms": 6, "share": 6}
    return s.select("name", "n", "min_ms", "max_ms", *[F.round(c, d).alias(c) for c, d in digits.items()])


def samples(spark, sf):
    """Image keys ``split/class/name`` derived from documents."""
    split = F.when(F.col("doc_id") % 5 == 0, F.lit("val")).otherwise(F.lit("train"))
    return table(spark, sf, "documents").select(
        F.concat_ws("/", split, "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("image_key")
    )


@query(
    "folder_classes",
    """
with d as (select case when doc_id % 5 = 0 then 'val' else 'train' end split, lang as class, doc_id from documents),
c as (select class, row_number() over (order by class) - 1 idx from (select distinct class from d where split = 'train'))
select split, d.class, concat(split, '/', d.class, '/', doc_id, '.jpg') as image_key, cast(idx as int) as class_idx from d left join c on c.class = d.class""",
)
def folder_classes(spark, sf):
    return report.class_ids(readers.folder_samples(samples(spark, sf)))


@query(
    "split_counts",
    """
select case when doc_id % 5 = 0 then 'val' else 'train' end as split, count(*) as n_samples, count(distinct lang) as n_classes from documents group by 1""",
)
def split_counts(spark, sf):
    return report.split_counts(readers.folder_samples(samples(spark, sf)))


@query(
    "mask_pairs",
    """
with i as (select page_id, concat('images/', page_id, case when page_id % 2 = 0 then '.jpg' else '.PNG' end) image_key from pages),
m as (select page_id, concat('masks/', page_id, '.png') mask_key from pages where page_id % 3 <> 0)
select image_key, mask_key from i left join m using (page_id)""",
)
def mask_pairs(spark, sf):
    """Pairs, and the unmatched images with a null mask."""
    name = F.col("page_id").cast("string")
    suffix = F.when(F.col("page_id") % 2 == 0, F.lit(".jpg")).otherwise(F.lit(".PNG"))
    pages = table(spark, sf, "pages")
    images = pages.select(F.concat(F.lit("images/"), name, suffix).alias("image_key"))
    masks = pages.filter(F.col("page_id") % 3 != 0).select(F.concat(F.lit("masks/"), name, F.lit(".png")).alias("mask_key"))
    pairs, lone = readers.pair_masks(images, masks)
    return pairs.select("image_key", "mask_key").union(lone.select("image_key", F.lit(None).cast("string")))


@query(
    "first_of_split",
    """
select o_custkey % 7 as split, o_orderkey as ord from orders
qualify row_number() over (partition by o_custkey % 7 order by o_orderkey) <= 100""",
)
def first_of_split(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 7).alias("split"), F.col("o_orderkey").alias("ord"))
    return readers.take_split(o, 100, "ord", ["split"])
