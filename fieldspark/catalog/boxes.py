"""Box, tile, text and vector functions over detections, images and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view, with_views
from ..functions import boxes as bx
from ..functions import text
from ..functions import vectors as vec
from ..operators import grid
from ..scale import bounded_broadcast, cut_lineage
from . import query


def detections(spark, sf):
    return view(spark, sf, "fx_detections").withColumn("box", bx.make_box())


def sized(spark, sf):
    """Detections with the size of their image; the image table is counted once and sent to the tasks, so detections stay in place."""
    images = bounded_broadcast(cut_lineage(view(spark, sf, "fx_images")))
    return detections(spark, sf).join(images, "img")


def r6(c):
    return F.round(c, 6)


def edges(b, prefix, digits=6):
    return [F.round(b[n], digits).alias(f"{prefix}_{n}") for n in bx.EDGES]


@query(
    "iou_variants",
    with_views("fx_detections", "fx_gt", body="""
, pairs as (
  select d.ord, d.x1 ax1, d.y1 ay1, d.x2 ax2, d.y2 ay2, g.x1 bx1, g.y1 by1, g.x2 bx2, g.y2 by2,
    greatest(0e0, least(d.x2, g.x2) - greatest(d.x1, g.x1)) * greatest(0e0, least(d.y2, g.y2) - greatest(d.y1, g.y1)) as inter
  from fx_detections d join fx_gt g on d.ord = g.ord),
parts as (
  select *, (ax2-ax1)*(ay2-ay1) sa, (bx2-bx1)*(by2-by1) sb,
    greatest(0e0, ax2-ax1)*greatest(0e0, ay2-ay1) ca, greatest(0e0, bx2-bx1)*greatest(0e0, by2-by1) cb from pairs)
select ord,
  round(case when inter <= 0 then 0e0 else inter / (sa + sb - inter + 1e-9) end, 6) as iou_eps,
  round(case when sa + sb - inter > 0 then inter / (sa + sb - inter) else 0e0 end, 6) as iou_union_guard,
  round(case when inter <= 0 or ca + cb - inter <= 0 then 0e0 else inter / (ca + cb - inter) end, 6) as iou_clamped,
  round(coalesce(inter / nullif(sa + sb - inter, 0e0), 0e0), 6) as iou_plain
from parts"""),
)
def iou_variants(spark, sf):
    d = view(spark, sf, "fx_detections").select("ord", bx.make_box().alias("a"))
    g = view(spark, sf, "fx_gt").select("ord", bx.make_box().alias("b"))
    kinds = ("eps", "union_guard", "clamped", "plain")
    return d.join(g, "ord").select("ord", *[r6(bx.iou("a", "b", k)).alias(f"iou_{k}") for k in kinds])


@query(
    "area_inside",
    with_views("fx_detections", "fx_gt", body="""
select d.ord, round(greatest(0e0, d.x2-d.x1) * greatest(0e0, d.y2-d.y1), 6) as area,
  d.x1 >= g.x1 and d.y1 >= g.y1 and d.x2 <= g.x2 and d.y2 <= g.y2 as inside
from fx_detections d join fx_gt g on d.ord = g.ord"""),
)
def area_inside(spark, sf):
    d = view(spark, sf, "fx_detections").select("ord", bx.make_box().alias("a"))
    g = view(spark, sf, "fx_gt").select("ord", bx.make_box().alias("b"))
    return d.join(g, "ord").select("ord", r6(bx.area("a")).alias("area"), bx.inside("a", "b").alias("inside"))


CLIPPED = """
, s as (select d.*, i.width, i.height, cast(i.width - 1 as double) xm, cast(i.height - 1 as double) ym
  from fx_detections d join fx_images i on d.img = i.img),
c as (select img, ord, score, term, width, height, xm, ym,
  greatest(0e0, least(x1, xm)) x1, greatest(0e0, least(y1, ym)) y1,
  greatest(0e0, least(x2, xm)) x2, greatest(0e0, least(y2, ym)) y2 from s),
g as (select *, x1 + (x2-x1)/2 cx, y1 + (y2-y1)/2 cy,
  (x2-x1)/2 + (x2-x1)*0.1e0 hw, (y2-y1)/2 + (y2-y1)*0.1e0 hh from c),
e as (select *, greatest(0e0, least(cx-hw, xm)) ex1, greatest(0e0, least(cy-hh, ym)) ey1,
  greatest(0e0, least(cx+hw, xm)) ex2, greatest(0e0, least(cy+hh, ym)) ey2 from g)
"""


@query(
    "clip_expand",
    with_views("fx_detections", "fx_images", body=CLIPPED + """
select ord, round(x1,6) c_x1, round(y1,6) c_y1, round(x2,6) c_x2, round(y2,6) c_y2,
  round(ex1,6) e_x1, round(ey1,6) e_y1, round(ex2,6) e_x2, round(ey2,6) e_y2 from e"""),
)
def clip_expand(spark, sf):
    s = sized(spark, sf).withColumn("c", bx.clip("box", "width", "height"))
    s = s.withColumn("e", bx.expand("c", 0.1, "width", "height"))
    return s.select("ord", *edges(F.col("c"), "c"), *edges(F.col("e"), "e"))


@query(
    "shift_box",
    with_views("fx_detections", body="""
select ord, x1 + ord % 7 * 100 as s_x1, y1 + ord % 5 * 100 as s_y1, x2 + ord % 7 * 100 as s_x2, y2 + ord % 5 * 100 as s_y2
from fx_detections"""),
)
def shift_box(spark, sf):
    s = detections(spark, sf).withColumn("s", bx.shift("box", F.col("ord") % 7 * 100, F.col("ord") % 5 * 100))
    return s.select("ord", *edges(F.col("s"), "s"))


@query(
    "letterbox_roundtrip",
    with_views("fx_detections", "fx_images", body="""
, m as (select d.ord, d.x1, d.y1, d.x2, d.y2, i.width w, i.height h, least(960e0/i.height, 960e0/i.width) scale
  from fx_detections d join fx_images i on d.img = i.img),
n as (select *, cast(trunc(w*scale) as int) new_w, cast(trunc(h*scale) as int) new_h from m),
p as (select *, (960-new_w)//2 pad_left, (960-new_h)//2 pad_top from n)
select ord, round(scale, 9) as scale, new_w, new_h, cast(pad_left as int) pad_left, cast(pad_top as int) pad_top,
  round(greatest(0e0, least((x1-pad_left)*(cast(w as double)/new_w), cast(w as double))), 6) u_x1,
  round(greatest(0e0, least((y1-pad_top)*(cast(h as double)/new_h), cast(h as double))), 6) u_y1,
  round(greatest(0e0, least((x2-pad_left)*(cast(w as double)/new_w), cast(w as double))), 6) u_x2,
  round(greatest(0e0, least((y2-pad_top)*(cast(h as double)/new_h), cast(h as double))), 6) u_y2
from p"""),
)
def letterbox_roundtrip(spark, sf):
    s = sized(spark, sf).withColumn("m", bx.letterbox("width", "height")).withColumn("u", bx.unletterbox("box", "m"))
    m = F.col("m")
    return s.select(
        "ord", F.round(m["scale"], 9).alias("scale"), *[m[n].alias(n) for n in ("new_w", "new_h", "pad_left", "pad_top")],
        *edges(F.col("u"), "u"),
    )


@query(
    "centre_size_boxes",
    with_views("fx_detections", "fx_images", body="""
, m as (select d.ord, i.width w, i.height h, cast(greatest(i.width, i.height) as double) s,
   d.x1/1000 cx, d.y1/1000 cy, (d.x2-d.x1)/1000 bw, (d.y2-d.y1)/1000 bh
  from fx_detections d join fx_images i on d.img = i.img)
select ord, round(cx*s - bw*s/2, 6) f_x1, round(cy*s - bh*s/2, 6) f_y1, round(cx*s + bw*s/2, 6) f_x2, round(cy*s + bh*s/2, 6) f_y2,
  round(greatest(0e0, least(cx*s - bw*s/2, w)), 6) p_x1, round(greatest(0e0, least(cy*s - bh*s/2, h)), 6) p_y1,
  round(greatest(0e0, least(cx*s + bw*s/2, w)), 6) p_x2, round(greatest(0e0, least(cy*s + bh*s/2, h)), 6) p_y2
from m"""),
)
def centre_size_boxes(spark, sf):
    c = F.col
    args = (c("x1") / 1000, c("y1") / 1000, (c("x2") - c("x1")) / 1000, (c("y2") - c("y1")) / 1000, "width", "height")
    s = sized(spark, sf).withColumn("p", bx.cxcywh_to_xyxy(*args)).withColumn("f", bx.cxcywh_to_xyxy(*args, clamp=False))
    return s.select("ord", *edges(c("f"), "f"), *edges(c("p"), "p"))


@query(
    "xywh_boxes",
    with_views("fx_detections", body="""
select ord, x1 b_x1, y1 b_y1, x1 + (x2 - x1) b_x2, y1 + (y2 - y1) b_y2,
  case when ord % 3 = 0 then cast(ord as double) else (x2-x1)*(y2-y1) end as area
from fx_detections"""),
)
def xywh_boxes(spark, sf):
    d = detections(spark, sf).withColumn("xywh", bx.xyxy_to_xywh("box"))
    given = F.when(F.col("ord") % 3 == 0, F.col("ord"))
    return d.select("ord", *edges(bx.xywh_to_xyxy("xywh"), "b"), bx.xywh_area("xywh", given).alias("area"))


@query(
    "roi_pixels",
    with_views("fx_images", body="""
, k as (select img, width w, height h, width % 40 a, height % 30 b from fx_images)
select img, cast(greatest(0, round_even(cast(a as double)/100*w, 0)) as int) x1, cast(greatest(0, round_even(cast(b as double)/100*h, 0)) as int) y1,
  cast(least(w, round_even(cast(a+37 as double)/100*w, 0)) as int) x2, cast(least(h, round_even(cast(b+50 as double)/100*h, 0)) as int) y2
from k"""),
)
def roi_pixels(spark, sf):
    a, b = F.col("width") % 40, F.col("height") % 30
    roi = F.concat_ws(
        ":", F.concat_ws(",", a, b), F.concat_ws(",", a + 37, b), F.concat_ws(",", a + 37, b + 50), F.concat_ws(",", a, b + 50)
    )
    i = view(spark, sf, "fx_images").withColumn("p", bx.parse_roi(roi))
    return i.select("img", bx.roi_to_pixels("p", "width", "height").alias("c")).select("img", "c.*")


@query(
    "centre_crops",
    with_views("fx_detections", "fx_images", body="""
, s as (select d.ord, i.width w, i.height h, cast(d.x1 as int) cx, cast(d.y1 as int) cy,
   least(512, i.width) cw, least(512, i.height) ch from fx_detections d join fx_images i on d.img = i.img),
a as (select *, least(w, greatest(0, cx - cw//2) + cw) x2, least(h, greatest(0, cy - ch//2) + ch) y2 from s)
select ord, cast(greatest(0, x2 - cw) as int) x1, cast(greatest(0, y2 - ch) as int) y1, cast(x2 as int) x2, cast(y2 as int) y2 from a"""),
)
def centre_crops(spark, sf):
    crop = bx.center_crop("width", "height", F.col("x1").cast("int"), F.col("y1").cast("int"), F.lit(512))
    return sized(spark, sf).select("ord", crop.alias("c")).select("ord", "c.*")


@query(
    "centred_crops",
    with_views("fx_gt", "fx_images", body="""
, s as (select g.ord, i.width w, i.height h,
   cast(greatest(0, least(trunc(g.x1), i.width-1)) as int) gx1, cast(greatest(0, least(trunc(g.y1), i.height-1)) as int) gy1,
   cast(greatest(0, least(trunc(g.x2), i.width)) as int) gx2, cast(greatest(0, least(trunc(g.y2), i.height)) as int) gy2
  from fx_gt g join fx_images i on g.img = i.img),
c as (select *, cast(greatest(0, trunc((gx1+gx2)/2e0 - 512)) as int) cx1, cast(least(w, trunc((gx1+gx2)/2e0 + 512)) as int) cx2,
   cast(greatest(0, trunc((gy1+gy2)/2e0 - 512)) as int) cy1, cast(least(h, trunc((gy1+gy2)/2e0 + 512)) as int) cy2 from s),
k as (select *, case when cx2-cx1 < 1024 then case when cx1 = 0 then 0 else greatest(0, cx2-1024) end else cx1 end kx1,
   case when cy2-cy1 < 1024 then case when cy1 = 0 then 0 else greatest(0, cy2-1024) end else cy1 end ky1 from c),
z as (select *, case when cx2-cx1 < 1024 then least(w, kx1+1024) else cx2 end kx2,
   case when cy2-cy1 < 1024 then least(h, ky1+1024) else cy2 end ky2 from k)
select ord, kx1 as cx1, ky1 as cy1, kx2 as cx2, ky2 as cy2, greatest(0, gx1-kx1) rx1, greatest(0, gy1-ky1) ry1,
  least(kx2-kx1, gx2-kx1) rx2, least(ky2-ky1, gy2-ky1) ry2 from z"""),
)
def centred_crops(spark, sf):
    g = view(spark, sf, "fx_gt").withColumn("box", bx.make_box()).join(view(spark, sf, "fx_images"), "img")
    return g.select("ord", bx.centered_crop("box", "width", "height", 1024).alias("c")).select("ord", "c.*")


@query(
    "clamped_truth",
    with_views("fx_gt", "fx_images", body="""
, s as (select g.ord, greatest(0, least(trunc(g.x1*3-200), i.width-1)) x1, greatest(0, least(trunc(g.y1*3-200), i.height-1)) y1,
   greatest(0, least(trunc(g.x2*3-200), i.width)) x2, greatest(0, least(trunc(g.y2*3-200), i.height)) y2
  from fx_gt g join fx_images i on g.img = i.img)
select ord, cast(x1 as double) b_x1, cast(y1 as double) b_y1, cast(x2 as double) b_x2, cast(y2 as double) b_y2 from s where x2 > x1 and y2 > y1"""),
)
def clamped_truth(spark, sf):
    c = F.col
    far = bx.make_box(*[c(n) * 3 - 200 for n in bx.EDGES])
    g = view(spark, sf, "fx_gt").withColumn("box", far).join(view(spark, sf, "fx_images"), "img")
    g = g.withColumn("b", bx.clamp_gt("box", "width", "height")).filter(c("b").isNotNull())
    return g.select("ord", *edges(c("b"), "b"))


@query(
    "embedder_crops",
    with_views("fx_gt", "fx_images", body="""
, s as (select g.ord, greatest(0, trunc(g.x1*3-200)) x1, greatest(0, trunc(g.y1*3-200)) y1,
   least(i.width, trunc(g.x2*3-200)) x2, least(i.height, trunc(g.y2*3-200)) y2 from fx_gt g join fx_images i on g.img = i.img)
select ord, cast(x1 as int) x1, cast(y1 as int) y1, cast(x2 as int) x2, cast(y2 as int) y2, x2 <= x1 or y2 <= y1 as empty from s"""),
)
def embedder_crops(spark, sf):
    far = bx.make_box(*[F.col(n) * 3 - 200 for n in bx.EDGES])
    g = view(spark, sf, "fx_gt").withColumn("box", far).join(view(spark, sf, "fx_images"), "img")
    return g.select("ord", bx.crop_clamp("box", "width", "height").alias("c")).select("ord", "c.*")


@query(
    "valid_boxes",
    with_views("fx_detections", body="""
select ord, case when ord % 11 = 0 then false when ord % 13 = 0 then false
  else x1 - ord % 50 >= 0 and y1 >= 0 and x1 - ord % 50 < x2 and y1 < y2 end as valid from fx_detections"""),
)
def valid_boxes(spark, sf):
    c = F.col
    short = F.array("x1", "y1", "x2")
    holed = F.array(c("x1"), F.lit(None).cast("double"), c("x2"), c("y2"))
    full = F.array(c("x1") - c("ord") % 50, c("y1"), c("x2"), c("y2"))
    arr = F.when(c("ord") % 11 == 0, short).when(c("ord") % 13 == 0, holed).otherwise(full)
    return detections(spark, sf).select("ord", bx.valid_bbox(arr).alias("valid"))


@query(
    "tiny_and_large_boxes",
    with_views("fx_detections", "fx_images", body="""
, s as (select d.ord, cast(i.width as double) w, cast(i.height as double) h, d.x1, d.y1,
   case when d.ord % 5 = 0 then d.x1 + 1 when d.ord % 5 = 1 then d.x2 + 700 else d.x2 end x2, d.y2 + case when d.ord % 5 = 1 then 500 else 0 end y2
  from fx_detections d join fx_images i on d.img = i.img)
select ord,
  case when x2-x1 < 2 or y2-y1 < 2 then greatest(0e0, (x1+x2)/2 - 2) else x1 end v_x1,
  case when x2-x1 < 2 or y2-y1 < 2 then greatest(0e0, (y1+y2)/2 - 2) else y1 end v_y1,
  case when x2-x1 < 2 or y2-y1 < 2 then least(w, (x1+x2)/2 + 2) else x2 end v_x2,
  case when x2-x1 < 2 or y2-y1 < 2 then least(h, (y1+y2)/2 + 2) else y2 end v_y2,
  x2-x1 <= 0 or y2-y1 <= 0 or (x2-x1)*(y2-y1)/(w*h + 1e-9) > 0.4e0 or greatest(x2-x1, y2-y1) > 0.9e0*greatest(w, h) + 1e-6 as too_large
from s"""),
)
def tiny_and_large_boxes(spark, sf):
    c = F.col
    kind = c("ord") % 5
    x2 = F.when(kind == 0, c("x1") + 1).when(kind == 1, c("x2") + 700).otherwise(c("x2"))
    y2 = c("y2") + F.when(kind == 1, F.lit(500)).otherwise(F.lit(0))
    s = sized(spark, sf).withColumn("box", bx.make_box(c("x1"), c("y1"), x2, y2))
    s = s.withColumn("v", bx.min_visible("box", "width", "height"))
    return s.select("ord", *edges(c("v"), "v"), bx.too_large("box", "width", "height").alias("too_large"))


def _tiles_sql(size: int, overlap: float, safe: bool) -> str:
    stride = int(size * (1 - overlap))
    guard = (lambda n: f"greatest(1, {n})") if safe else (lambda n: n)
    cols = guard(f"cast(ceil((width - {size}) / {float(stride)}) as int) + 1")
    rows = guard(f"cast(ceil((height - {size}) / {float(stride)}) as int) + 1")
    return with_views("fx_images", body=f"""
, n as (select img, width w, height h, {cols} nc, {rows} nr from fx_images),
r as (select img, w, h, nc, unnest(range(0, nr)) * {stride} y from n),
c as (select img, w, h, y, unnest(range(0, nc)) * {stride} x from r),
e as (select *, least(x + {size}, w) x2, least(y + {size}, h) y2 from c)
select {"distinct" if safe else ""} img, cast(case when x2 = w then greatest(0, w - {size}) else x end as int) x1,
  cast(case when y2 = h then greatest(0, h - {size}) else y end as int) y1, cast(x2 as int) x2, cast(y2 as int) y2 from e""")


@query("tiles_snapped", _tiles_sql(1600, 0.2, False))
def tiles_snapped(spark, sf):
    return grid.tiles(view(spark, sf, "fx_images"), 1600, 0.2).select("img", *bx.EDGES)


@query("tiles_safe", _tiles_sql(960, 0.5, True))
def tiles_safe(spark, sf):
    return grid.tiles(view(spark, sf, "fx_images"), 960, 0.5, safe=True).select("img", *bx.EDGES)


@query("position_batches", "select o_orderkey as ord, o_orderkey // 32 as batch from orders")
def position_batches(spark, sf):
    return grid.batches(table(spark, sf, "orders").select(F.col("o_orderkey").alias("ord")), "ord", 32)


@query(
    "lenient_numbers",
    """
select event_id, case event_id % 5 when 0 then null when 1 then null when 2 then cast(event_id as double)
  when 3 then null else event_id + 0.5e0 end as v from events""",
)
def lenient_numbers(spark, sf):
    k = F.col("event_id") % 5
    s = F.col("event_id").cast("string")
    raw = (
        F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit("n"), s)).when(k == 2, F.concat(F.lit(" "), s, F.lit(" ")))
        .when(k == 3, F.lit(None).cast("string")).otherwise(F.concat(s, F.lit(".5")))
    )
    return table(spark, sf, "events").select("event_id", text.to_double(raw).alias("v"))


@query(
    "slugs",
    """
select p_partkey, regexp_replace(replace(lower(concat(p_name, ' #', p_brand)), ' ', '_'), '[^a-z0-9_\\-]', '', 'g') as slug,
  coalesce(nullif(case when p_partkey % 2 = 0 then '' else 'x' end, ''), 'output') as named from part""",
)
def slugs(spark, sf):
    junk = F.when(F.col("p_partkey") % 2 == 0, F.lit("#!")).otherwise(F.lit("X"))
    return table(spark, sf, "part").select(
        "p_partkey", text.slug(F.concat("p_name", F.lit(" #"), "p_brand")).alias("slug"), text.slug(junk, "output").alias("named")
    )


@query(
    "phrase_terms",
    """
, terms as (select * from (values (0, 'click'), (1, ' View'), (2, 'purch'), (3, 'e')) t(pos, term)),
p as (select distinct event_type phrase from events),
x as (select phrase, min(pos) pos from p join terms on lower(trim(phrase)) = lower(trim(term)) group by phrase),
y as (select phrase, min(pos) pos from p join terms on contains(lower(trim(phrase)), lower(trim(term)))
  or contains(lower(trim(term)), lower(trim(phrase))) group by phrase)
select event_id, cast(coalesce(x.pos, y.pos) as int) as term_idx from events left join x on event_type = x.phrase
left join y on event_type = y.phrase""".replace(", terms", "with terms", 1),
)
def phrase_terms(spark, sf):
    terms = F.array(*[F.lit(t) for t in ("click", " View", "purch", "e")])
    return table(spark, sf, "events").select("event_id", text.phrase_to_term("event_type", terms).alias("term_idx"))


@query(
    "output_names",
    with_views("fx_images", body="""
select img, concat('field_', width % 3, '/rectified_', img) as rectified, concat('annotated_', img) as annotated from fx_images"""),
)
def output_names(spark, sf):
    key = F.concat(F.lit("field_"), F.col("width") % 3, F.lit("/"), "img")
    i = view(spark, sf, "fx_images")
    return i.select(
        "img", text.output_name(key, "rectified_").alias("rectified"), text.output_name("img", "annotated_").alias("annotated")
    )


REQUESTS = """
, r as (select event_id,
  case when event_id % 4 = 0 then null when event_id % 4 = 1 then ['  ', ''] else [concat(' ', event_type, ' '), ''] end prompts,
  case when event_id % 3 = 0 then cast(user_id as int) end x, case when event_id % 3 <> 1 then 5 end y,
  cast(event_id % 9 * 100 as int) - 100 p, case when event_id % 5 = 0 then cast(event_id % 9 * 100 as int) - 100 when event_id % 5 = 1 then 300 end c,
  case when event_id % 7 = 0 then null when event_id % 7 = 1 then 1.0e0 else 0.3e0 end o,
  case when event_id % 17 = 0 then 1.5e0 else 0.5e0 end t from events),
v as (select *, list_filter(list_transform(prompts, lambda q: trim(q)), lambda q: q <> '') cleaned from r),
w as (select *, coalesce(len(cleaned), 0) > 0 has_text, x is not null and y is not null has_point, coalesce(o, 0.2e0) ov from v)
select event_id, case when len(cleaned) > 0 then array_to_string(cleaned, '|') end as prompts, coalesce(p, c) as effective_patch, ov as overlap_ratio,
  case when p <= 0 or c <= 0 then 'patch_size/crop_size must be > 0' when ov < 0 or ov >= 1 then 'overlap_ratio must be in [0, 1)'
    when t < 0 or t > 1 then 'thresholds must be in [0, 1]' when p <> c then 'patch_size and crop_size differ'
    when not has_text and not has_point then 'neither prompts nor a point given'
    when has_text and has_point then 'give prompts or a point, not both' end as reject_reason
from w""".replace(", r as", "with r as", 1)


def requests(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    null = F.lit(None)
    side = (k % 9 * 100).cast("int") - 100
    return e.select(
        "event_id",
        F.when(k % 4 == 0, null.cast("array<string>")).when(k % 4 == 1, F.array(F.lit("  "), F.lit("")))
        .otherwise(F.array(F.concat(F.lit(" "), "event_type", F.lit(" ")), F.lit(""))).alias("text_prompts"),
        F.when(k % 3 == 0, F.col("user_id").cast("int")).alias("x"), F.when(k % 3 != 1, F.lit(5)).alias("y"),
        side.alias("patch_size"), F.when(k % 5 == 0, side).when(k % 5 == 1, F.lit(300)).alias("crop_size"),
        F.when(k % 7 == 0, null.cast("double")).when(k % 7 == 1, F.lit(1.0)).otherwise(F.lit(0.3)).alias("overlap_ratio"),
        F.when(k % 17 == 0, F.lit(1.5)).otherwise(F.lit(0.5)).alias("threshold"), F.lit(0.1).alias("mask_threshold"),
    )


@query("request_checks", REQUESTS)
def request_checks(spark, sf):
    return text.check_requests(requests(spark, sf)).select(
        "event_id", F.array_join("text_prompts", "|").alias("prompts"), "effective_patch", "overlap_ratio", "reject_reason"
    )


@query(
    "unit_vectors",
    """
with v as (select vec_id, embedding::double[] e from embeddings),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) n from v),
u as (select vec_id, unnest(e) / greatest(n, 1e-12) a, unnest(e) / (n + 1e-8) b from n)
select vec_id, round(sum(a), 6) as sum_max, round(sum(b), 6) as sum_add, round(sum(a * a), 6) as sq from u group by vec_id""",
)
def unit_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    u = e.withColumn("a", vec.l2_normalize("embedding")).withColumn("b", vec.l2_normalize("embedding", mode="add"))

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)

    return u.select("vec_id", r6(total("a")).alias("sum_max"), r6(total("b")).alias("sum_add"), r6(vec.dot("a", "a")).alias("sq"))


@query(
    "vector_dots",
    """
select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as dot
from embeddings a join embeddings b on a.vec_id = b.vec_id + 1""",
)
def vector_dots(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", r6(vec.dot("embedding", "other")).alias("dot"))


@query(
    "sigmoids",
    """
select vec_id, round(1 / (1 + exp(-cast(embedding[1] as double))), 6) as p,
  1 / (1 + exp(-cast(embedding[2] as double))) > 0.5e0 as positive,
  cast(list_position(embedding, list_max(embedding)) - 1 as int) as top from embeddings""",
)
def sigmoids(spark, sf):
    e = F.col("embedding")
    x, y = F.get(e, F.lit(0)).cast("double"), F.get(e, F.lit(1)).cast("double")
    return table(spark, sf, "embeddings").select(
        "vec_id", r6(vec.sigmoid(x)).alias("p"), (vec.sigmoid(y) > 0.5).alias("positive"), vec.argmax("embedding").alias("top")
    )


@query(
    "polyline_subsample",
    """
with p as (select vec_id, unnest(range(0, 16)) k, embedding e from embeddings),
s as (select vec_id, k, e[cast(round_even(k * (63e0 / 15e0), 0) as int) + 1] v from p)
select vec_id, round(sum(cast(v as double) * (k + 1)), 6) as weighted, count(*) as n from s group by vec_id""",
)
def polyline_subsample(spark, sf):
    s = table(spark, sf, "embeddings").select("vec_id", F.posexplode(vec.subsample("embedding", 16)).alias("k", "v"))
    return s.groupBy("vec_id").agg(
        r6(F.sum(F.col("v").cast("double") * (F.col("k") + 1))).alias("weighted"), F.count(F.lit(1)).alias("n")
    )
