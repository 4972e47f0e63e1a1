"""Few-shot classification, relabelling and supports over embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view, with_views
from ..functions import boxes as bx
from ..operators import fewshot, udf
from ..operators import relabel as rl
from ..operators.similarity import similarity
from ..plans import labelling
from . import query
from .boxes import edges, r6
from .detections import BOX, greedy_sql, overlap_sql, round_sql

TOP = """
, top as (select * from fx_proposals where score > 0.1e0
  qualify row_number() over (partition by backend, image_key order by score desc, ord) <= 100)"""
UNIT = """
, pu as (select {cols}, list_transform(embedding::double[], lambda z: z / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-12)) e from {props}),
su as (select class, list_transform(embedding::double[], lambda z: z / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-12)) e from fx_supports),
sim as (select {cols}, su.class, max(list_dot_product(pu.e, su.e)) similarity from pu, su group by all)"""
COLS = "backend, image_key, ord, score, x1, y1, x2, y2, label"


def proposals(spark, sf):
    return view(spark, sf, "fx_proposals")


def supports(spark, sf):
    return view(spark, sf, "fx_supports")


@query("top_proposals", with_views("fx_proposals", body=TOP + " select image_key, ord, score from top"))
def top_proposals(spark, sf):
    return fewshot.topk_proposals(proposals(spark, sf)).select("image_key", "ord", "score")


ALL_SIM = UNIT.format(cols=COLS, props="fx_proposals")


@query(
    "class_similarity",
    with_views("fx_proposals", "fx_supports", body=ALL_SIM + " select ord, class, round(similarity, 6) as similarity from sim"),
)
def class_similarity(spark, sf):
    s = similarity(proposals(spark, sf), supports(spark, sf), ["backend"], ["backend", "ord"])
    return s.select("ord", "class", r6("similarity").alias("similarity"))


@query(
    "class_similarity_sliced",
    with_views("fx_proposals", "fx_supports", body=ALL_SIM + " select ord, class, round(similarity, 6) as similarity from sim"),
)
def class_similarity_sliced(spark, sf):
    """The plan for support tables beyond the broadcast budget, forced by a small one."""
    s = similarity(
        proposals(spark, sf), supports(spark, sf), ["backend"], ["backend", "ord"], budget=1, chunk_bytes=64 * 1024
    )
    return s.select("ord", "class", r6("similarity").alias("similarity"))


CLASSIFIED = TOP + UNIT.format(cols=COLS, props="top") + ", hits as (select * from sim where similarity > 0.2e0)" + greedy_sql(
    "hits", "backend, image_key", "similarity desc, class, ord", BOX, overlap_sql("k.", "r.") + " > 0.5e0"
)


@query(
    "fewshot_detections",
    with_views("fx_proposals", "fx_supports", recursive=True, body=CLASSIFIED + """
select image_key, ord, class, round(similarity, 6) as score, x1 as b_x1, y1 as b_y1, x2 as b_x2, y2 as b_y2 from kept"""),
)
def fewshot_detections(spark, sf):
    d = fewshot.classify(proposals(spark, sf), supports(spark, sf))
    return d.select("image_key", "ord", "class", r6("score").alias("score"), *edges(F.col("box"), "b"))


def mixed_supports(spark, sf):
    """Supports as they arrive: one class stored transposed, one cut short in part."""
    s = supports(spark, sf).select("backend", "class", "ord", "embedding")
    turned = s.filter("class = 'class_3'").select("backend", "class", "ord", F.posexplode("embedding").alias("k", "v"))
    turned = turned.groupBy("backend", "class", "k").agg(F.array_sort(F.collect_list(F.struct("ord", "v"))).alias("c"))
    turned = turned.select("backend", "class", F.col("k").cast("bigint").alias("ord"), F.transform("c", lambda e: e["v"]).alias("embedding"))
    short = F.when((F.col("class") == "class_5") & (F.col("ord") % 20 == 0), F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return s.filter("class <> 'class_3'").withColumn("embedding", short).unionByName(turned)


# class_5 is skipped if its lengths differ, and whole if they do not
_SHORT = "(select count(distinct ord % 20 = 0) = 2 or min(ord % 20) = 0 as is_short from fx_supports where class = 'class_5')"


@query(
    "fewshot_repaired",
    with_views("fx_proposals", "fx_supports", recursive=True, body=f"""
, s as (select * from fx_supports where class <> 'class_5' or not (select is_short from {_SHORT}))""" + CLASSIFIED.replace("fx_supports", "s") + """
select image_key, ord, class, round(similarity, 6) as score from kept"""),
)
def fewshot_repaired(spark, sf):
    found, _ = fewshot.classify_repaired(proposals(spark, sf), mixed_supports(spark, sf))
    return found.select("image_key", "ord", "class", r6("score").alias("score"))


@query(
    "fewshot_skipped",
    with_views("fx_proposals", "fx_supports", body="""
select backend, class, count(*) as n_vectors, cast(min(l) as int) as shortest, cast(max(l) as int) as longest, 64 as dim
from (select backend, class, case when ord % 20 = 0 then 60 else 64 end l from fx_supports where class = 'class_5') group by backend, class having min(l) = 60"""),
)
def fewshot_skipped(spark, sf):
    return fewshot.classify_repaired(proposals(spark, sf), mixed_supports(spark, sf))[1]


BEST = UNIT.format(cols=COLS, props="top") + """
, best as (select * from sim where similarity > 0.2e0 qualify row_number() over (partition by backend, image_key, ord order by similarity desc, class) = 1)"""


@query(
    "fewshot_precision",
    with_views("fx_proposals", "fx_supports", body=TOP + BEST + """
select class, count(*) as n, cast(sum(case when class = concat('class_', label) then 1 else 0 end) as bigint) as n_right,
  round(avg(case when class = concat('class_', label) then 1e0 else 0e0 end), 6) as "precision" from best group by class"""),
)
def fewshot_precision(spark, sf):
    """Objectness filter, top 100 per image, similarity, best class, and precision against the truth."""
    top = fewshot.topk_proposals(proposals(spark, sf))
    ids = ["backend", "image_key", "ord", "label"]
    scored = similarity(top, supports(spark, sf), ["backend"], ids, best_only=F.lit(True))
    best = scored.filter(F.col("similarity") > 0.2)
    right = (F.col("class") == F.concat(F.lit("class_"), F.col("label").cast("string"))).cast("int")
    return best.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_right"), F.round(F.avg(right), 6).alias("precision")
    )


@query(
    "supports_by_dim",
    with_views("fx_supports", body="""
, d as (select backend, class, ord, case when ord % 30 = 0 then 32 else 64 end dim from fx_supports)
select class, count(*) as n_vectors, 'used' as status from d where dim = 64 group by class
union all select class, count(*), 'skipped' from d where dim = 32 group by class"""),
)
def supports_by_dim(spark, sf):
    s = supports(spark, sf)
    s = s.withColumn("embedding", F.when(F.col("ord") % 30 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))
    dims = proposals(spark, sf).select("backend", F.size("embedding").alias("dim")).distinct()
    good, bad = fewshot.split_by_dim(s, dims)
    used = good.groupBy("class").agg(F.count(F.lit(1)).alias("n_vectors")).withColumn("status", F.lit("used"))
    return used.unionByName(bad.select("class", "n_vectors", F.lit("skipped").alias("status")))


@query(
    "support_summary",
    with_views("fx_supports", body="""
, k as (select class, unnest(embedding) v, unnest(range(0, 64)) k from fx_supports), m as (select class, k, avg(cast(v as double)) m from k group by class, k),
s as (select class, sum(m * (k + 1)) w from m group by class), n as (select class, count(*) n, max(len(embedding)) dim from fx_supports group by class)
select class, n, cast(dim as int) as dim, round(w, 5) as weighted from n join s using (class)"""),
)
def support_summary(spark, sf):
    s = fewshot.build_supports(supports(spark, sf), prototype=True)
    weighted = F.aggregate(
        F.zip_with("prototype", F.sequence(F.lit(1), F.size("prototype")), lambda v, k: v * k), F.lit(0.0), lambda acc, v: acc + v
    )
    return s.select("class", "n", "dim", F.round(weighted, 5).alias("weighted"))


RELABEL = """
, proto as (select concat('c', vec_id % 13) class, vec_id cls, embedding from embeddings where vec_id % 40 = 0),
named as (select class, min(cls) cls_ord, arg_max(embedding, cls) embedding from proto group by class),
det as (select vec_id det_id, concat('img_', vec_id % 50, '.jpg') img, 'old' label, embedding from embeddings where vec_id % 40 <> 0 and vec_id % 50 <> 7 and vec_id % 9 <> 0),
du as (select det_id, img, label, list_transform(embedding::double[], lambda z: z / (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-8)) e from det),
nu as (select class, cls_ord, list_transform(embedding::double[], lambda z: z / (sqrt(list_dot_product(embedding::double[], embedding::double[])) + 1e-8)) e from named),
best as (select det_id, img, class, s from (select det_id, img, class, cls_ord, list_dot_product(du.e, nu.e) s from du, nu) where s > -1
  qualify row_number() over (partition by det_id order by s desc, cls_ord) = 1),
done as (select det_id, du.img, coalesce(class, label) label, coalesce(s, -1e0) conf from du left join best using (det_id))"""


def relabelled(spark, sf):
    e = table(spark, sf, "embeddings")
    v = F.col("vec_id")
    protos = e.filter(v % 40 == 0).select(
        F.concat(F.lit("c"), (v % 13).cast("string")).alias("class"), v.alias("cls_ord"), "embedding"
    )
    box = F.when(v % 9 == 0, F.array(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(9.0))).otherwise(
        F.array(F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(9.0))
    )
    img = F.concat(F.lit("img_"), (v % 50).cast("string"), F.lit(".jpg"))
    det = e.filter(v % 40 != 0).select(
        v.alias("det_id"), img.alias("img"), F.lit("old").alias("label"), box.alias("bounding_box"), "embedding"
    )
    images = det.filter(F.col("det_id") % 50 != 7).select("img")
    return labelling.relabel_detections(det, images, protos)


@query("relabelled", f"with {RELABEL[3:]} select det_id, img, label, round(conf, 6) as classifier_confidence from done")
def relabelled_detections(spark, sf):
    d = relabelled(spark, sf).detections
    return d.select("det_id", "img", "label", r6("classifier_confidence").alias("classifier_confidence"))


@query(
    "relabelled_counts",
    f"with {RELABEL[3:]} select label, count(*) as n_objects, count(distinct img) as n_images from done group by label",
)
def relabelled_counts(spark, sf):
    return relabelled(spark, sf).summary


@query(
    "class_manifest",
    f"with {RELABEL[3:]} select n.class, d.img from named n left join (select distinct label, img from done) d on d.label = n.class",
)
def class_manifest(spark, sf):
    return relabelled(spark, sf).manifest


@query(
    "classes_per_image",
    with_views("fx_detections", body="select distinct img, term as label from fx_detections"),
)
def classes_per_image(spark, sf):
    return rl.classes_per_image(view(spark, sf, "fx_detections").withColumnRenamed("term", "label"))


@query(
    "best_anchors",
    with_views("fx_gt", body=f"""
, a as (select g.img, g.ord gt_ord, l.l_partkey * 10 + l.l_linenumber ord, g.x1 gx1, g.y1 gy1, g.x2 gx2, g.y2 gy2,
   g.x1 + l.l_partkey % 41 - 20 dx1, g.y1 + l.l_suppkey % 31 - 15 dy1, g.x2 + l.l_partkey % 37 - 18 dx2, g.y2 + l.l_suppkey % 29 - 14 dy2
  from fx_gt g join lineitem l on l.l_orderkey = g.ord),
p as (select *, {overlap_sql("g", "d").replace("case when", "case when dx2 <= dx1 or dy2 <= dy1 then 0e0 when", 1)} iou from a)
select img, gt_ord, ord, round(iou, 9) as iou from p qualify row_number() over (partition by img, gt_ord order by iou desc, ord) = 1"""),
)
def best_anchors(spark, sf):
    """Line items as anchor candidates of their order's box."""
    c = F.col
    gt = view(spark, sf, "fx_gt").select("img", c("ord").alias("gt_ord"), bx.make_box().alias("ref"))
    r = c("ref")
    box = bx.make_box(
        r["x1"] + c("l_partkey") % 41 - 20, r["y1"] + c("l_suppkey") % 31 - 15,
        r["x2"] + c("l_partkey") % 37 - 18, r["y2"] + c("l_suppkey") % 29 - 14,
    )
    items = table(spark, sf, "lineitem").select(c("l_orderkey").alias("gt_ord"), "l_partkey", "l_suppkey", "l_linenumber")
    anchors = gt.join(items, "gt_ord").select(
        "img", "gt_ord", "ref", (c("l_partkey") * 10 + c("l_linenumber")).alias("ord"), box.alias("box")
    )
    best = fewshot.best_anchor(anchors, ["img", "gt_ord"])
    return best.select("img", "gt_ord", "ord", F.round("iou", 9).alias("iou"))


SIZES = (1280, 1024, 768, 512, 256)
_SIZE_OF = "case event_id % 5 when 0 then 1280 when 1 then 768 when 2 then 768 when 3 then 512 else 256 end"
_IOU_OF = "case event_id % 5 when 0 then 0.2e0 when 1 then 0.3e0 when 2 then 0.4e0 when 3 then 0.41e0 else 0.9e0 end + value / 100000"


@query(
    "crop_size_search",
    f"""
with recursive g as (select {_SIZE_OF} size, {_IOU_OF} iou from events),
a as (select size, avg(iou) m, row_number() over (order by size desc) rn from g group by size),
w(rn, size, avg_iou, improved, prev) as (
  select a.rn, size, {round_sql("m", 3)}, true, {round_sql("m", 3)} from a where rn = 1
  union all select a.rn, a.size, {round_sql("a.m", 3)}, w.prev = 0 or (a.m > w.prev and abs(a.m - w.prev) / w.prev > 0.1e0), {round_sql("a.m", 3)}
  from w join a on a.rn = w.rn + 1 where w.improved)
select cast(size as int) as size, avg_iou, improved from w""",
)
def crop_size_search(spark, sf):
    k = F.col("event_id") % 5
    e = table(spark, sf, "events")

    def pick(values):
        out = F.when(k == 0, F.lit(values[0]))
        for i, v in enumerate(values[1:], 1):
            out = out.when(k == i, F.lit(v))
        return out

    used = tuple(768 if s == 1024 else s for s in SIZES)
    g = e.select(pick(used).alias("size"), (pick((0.2, 0.3, 0.4, 0.41, 0.9)) + F.col("value") / 100000).alias("iou"))
    # all listed sizes are tried; 1024 has no boxes and is passed over
    sizes = e.select(pick(SIZES).alias("size"))
    return fewshot.crop_size_search(g, sizes)


@query(
    "model_embeddings",
    with_views("fx_gt", "fx_images", body="""
, b as (select g.img, g.ord, least(i.width, trunc(g.x2)) - greatest(0, least(trunc(g.x1), i.width - 1)) w,
   least(i.height, trunc(g.y2)) - greatest(0, least(trunc(g.y1), i.height - 1)) h from fx_gt g join fx_images i using (img))
select img, count(*) as n, round(sum(w / sqrt(w*w + h*h + 1)), 2) as e0, round(sum(h / sqrt(w*w + h*h + 1)), 2) as e1 from b where w > 0 and h > 0 group by img"""),
)
def model_embeddings(spark, sf):
    """A stand-in model through the embedder contract: (width, height, 1) of the clamped box."""

    def factory():
        import numpy as np

        def fn(rows):
            box = rows["box"]
            w = np.array([b["x2"] - b["x1"] for b in box])
            h = np.array([b["y2"] - b["y1"] for b in box])
            return np.column_stack([w, h, np.ones(len(w))])

        return fn

    gt = view(spark, sf, "fx_gt").select(F.col("img").alias("image_path"), "ord", "class", bx.make_box().alias("box"))
    images = view(spark, sf, "fx_images").withColumnRenamed("img", "image_path")
    done = labelling.collect_supports(
        gt.withColumn("backend", F.lit("size")), images, lambda df: udf.embed(df, factory, ["box"], 3, batch=512)
    )
    at = [F.round(F.sum(F.get("embedding", F.lit(i)).cast("double")), 2).alias(f"e{i}") for i in range(2)]
    return done.vectors.groupBy(F.col("image_path").alias("img")).agg(F.count(F.lit(1)).alias("n"), *at)


@query(
    "model_proposals",
    with_views("fx_images", body="""
, p as (select img, width, height, unnest([0, 1, 2]) k from fx_images)
select img, cast(k as bigint) as ord, cast(k * width / 4e0 as double) as x1, cast((k + 1) * width / 4e0 as double) as x2, 1 / (k + 2e0) as score from p"""),
)
def model_proposals(spark, sf):
    """A stand-in proposer: three boxes per image."""

    def factory():
        def fn(rows):
            for k in range(3):
                yield rows.assign(
                    ord=k, x1=k * rows["width"] / 4.0, x2=(k + 1) * rows["width"] / 4.0, score=1 / (k + 2.0)
                )[["img", "ord", "x1", "x2", "score"]]

        return fn

    images = view(spark, sf, "fx_images")
    return udf.propose(images, factory, "img string, ord bigint, x1 double, x2 double, score double")


@query(
    "stitched_proposals",
    with_views("fx_images", recursive=True, body="""
, n as (select img, width w, height h, cast(ceil((width - 960) / 768e0) as int) + 1 nc, cast(ceil((height - 960) / 768e0) as int) + 1 nr from fx_images),
rr as (select img, w, h, nc, unnest(range(0, nr)) * 768 y from n),
cc as (select img, w, h, y, unnest(range(0, nc)) * 768 x from rr),
e as (select *, least(x + 960, w) x2, least(y + 960, h) y2 from cc),
t as (select img, cast(case when x2 = w then greatest(0, w - 960) else x end as bigint) ox, cast(case when y2 = h then greatest(0, h - 960) else y end as bigint) oy from e),
p as (select img, ox, oy, unnest(range(0, 4)) k from t),
b as (select img, ox, oy, (oy * 100000 + ox) * 4 + k as ord, 0.2e0 + ((ox + 3 * oy + 7 * k) % 100) / 200e0 score,
  ox + k * 150e0 x1, oy + (k % 2) * 300e0 y1, ox + k * 150e0 + 400 x2, oy + (k % 2) * 300e0 + 350 y2 from p)""" + greedy_sql(
        "b", "img, ox, oy", "score desc, ord", BOX, overlap_sql("k.", "r.") + " > 0.3e0") + """
, moved as (select img, ord, score, x1, y1, x2, y2 from kept)""" + greedy_sql(
        "moved", "img", "score desc, ord", BOX, overlap_sql("k.", "r.") + " > 0.3e0"
    ).replace("ranked", "ranked2").replace("walk", "walk2").replace("kept", "kept2") + """
select img, ord, round(score, 6) as score, x1 as b_x1, y1 as b_y1, x2 as b_x2, y2 as b_y2 from kept2"""),
)
def stitched_proposals(spark, sf):
    """Tiles of every image, a stand-in proposer with four boxes per tile, suppression per tile and image."""

    def factory():
        def fn(rows):
            for k in range(4):
                x, y = k * 150.0, (k % 2) * 300.0
                yield rows.assign(
                    ord=(rows["oy"].astype("int64") * 100000 + rows["ox"]) * 4 + k,
                    score=0.2 + ((rows["ox"] + 3 * rows["oy"] + 7 * k) % 100) / 200.0, x1=x, y1=y, x2=x + 400, y2=y + 350,
                )[["img", "tile", "ox", "oy", "ord", "score", "x1", "y1", "x2", "y2"]]

        return fn

    tiles = labelling.tile_plan(view(spark, sf, "fx_images"))
    schema = "img string, tile string, ox int, oy int, ord bigint, score double, x1 double, y1 double, x2 double, y2 double"
    raw = udf.propose(tiles, factory, schema, batch=1024).withColumn("box", bx.make_box())
    out = labelling.stitch_proposals(raw, ["img"], 0.3, objectness=0.1)
    return out.select("img", "ord", r6("score").alias("score"), *edges(F.col("box"), "b"))
