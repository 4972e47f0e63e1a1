"""Suppression and the detection table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view, with_views
from ..functions import boxes as bx
from ..functions.numbers import round_to
from ..operators import detect, report, suppress
from ..plans import labelling
from . import query
from .boxes import CLIPPED, detections, edges, sized


def round_sql(x: str, digits: int) -> str:
    """Half-to-even on the exact binary value, as an error-free product (see ``round_to``)."""
    s = float(10**digits)
    t = 2 * s * 134217729.0
    bh = t - (t - 2 * s)
    bl = 2 * s - bh
    hi = f"(({x}) * 134217729e0 - (({x}) * 134217729e0 - ({x})))"
    lo = f"(({x}) - {hi})"
    p = f"(({x}) * {2 * s!r}::double)"
    err = f"((({hi} * {bh!r}::double - {p}) + {hi} * {bl!r}::double + {lo} * {bh!r}::double) + {lo} * {bl!r}::double)"
    n = f"floor(({x}) * {s!r}::double)"
    d = f"(({p} - (2 * {n} + 1)) + {err})"
    return f"(case when {d} > 0 then {n} + 1 when {d} < 0 then {n} when {n} % 2 = 0 then {n} else {n} + 1 end / {s!r}::double)"


PLAIN = "greatest(0e0, least({a}2, {b}2) - greatest({a}1, {b}1))"


def overlap_sql(a: str, b: str, eps: str = "") -> str:
    """IoU of boxes with fields x1..y2 under prefixes ``a`` and ``b``; 0 without an intersection."""
    w = f"greatest(0e0, least({a}x2, {b}x2) - greatest({a}x1, {b}x1))"
    h = f"greatest(0e0, least({a}y2, {b}y2) - greatest({a}y1, {b}y1))"
    union = f"(({a}x2-{a}x1)*({a}y2-{a}y1) + ({b}x2-{b}x1)*({b}y2-{b}y1) - {w}*{h}{eps})"
    return f"(case when {w}*{h} <= 0 then 0e0 else {w}*{h} / {union} end)"


def greedy_sql(source: str, group: str, order: str, keep: str, conflict: str) -> str:
    """CTE ``kept``: the greedy survivors of ``source``, one row of each group per step.

    ``keep`` is the struct put on the list; ``conflict`` tests list element ``k`` against row ``r``.
    """
    return f"""
, ranked as (select *, dense_rank() over (order by {group}) gid, row_number() over (partition by {group} order by {order}) rn from {source}),
walk(gid, rn, held, took) as (
  select gid, cast(0 as bigint), list_filter([{keep}], lambda k: false), false from ranked r where r.rn = 1
  union all
  select r.gid, r.rn, case when len(list_filter(w.held, lambda k: {conflict})) = 0 then list_append(w.held, {keep}) else w.held end,
    len(list_filter(w.held, lambda k: {conflict})) = 0
  from walk w join ranked r on r.gid = w.gid and r.rn = w.rn + 1),
kept as (select r.* from ranked r join walk w on w.gid = r.gid and w.rn = r.rn where w.took)"""


BOX = "{'x1': r.x1, 'y1': r.y1, 'x2': r.x2, 'y2': r.y2}"


@query(
    "nms_per_image",
    with_views("fx_detections", recursive=True, body=greedy_sql(
        "fx_detections", "img", "score desc, ord", BOX, overlap_sql("k.", "r.") + " > 0.5e0") + """
select img, ord, term, score from kept"""),
)
def nms_per_image(spark, sf):
    return suppress.nms(detections(spark, sf), ["img"], iou_threshold=0.5).select("img", "ord", "term", "score")


def _guarded_sql(t: float, cov: float, guard: str) -> str:
    ok = f"x2-x1 > 0 and y2-y1 > 0 and ex2-ex1 > 0 and ey2-ey1 > 0 and (x2-x1)*(y2-y1)/(cast(width as double)*height + 1e-9) <= {cov}e0 and {guard}"
    keep = "{'x1': r.ex1, 'y1': r.ey1, 'x2': r.ex2, 'y2': r.ey2}"
    inside = "r.x1 >= k.x1 and r.y1 >= k.y1 and r.x2 <= k.x2 and r.y2 <= k.y2"
    around = "k.x1 >= r.x1 and k.y1 >= r.y1 and k.x2 <= r.x2 and k.y2 <= r.y2"
    conflict = f"({overlap_sql('k.', 'r.', ' + 1e-9')} >= {t}e0 or ({inside}) or ({around}))"
    return CLIPPED + f", good as (select *, {ok} as ok from e), fine as (select * from good where ok)" + greedy_sql(
        "fine", "img, term", "score desc, ord", keep, conflict
    ) + f"""
, final as (select img, ord, term, {round_sql('score', 6)} score, {round_sql('ex1', 2)} bx1, {round_sql('ey1', 2)} by1, {round_sql('ex2', 2)} bx2,
    {round_sql('ey2', 2)} by2, cast(width as double) w, cast(height as double) h from kept
  union all select s.img, s.ord, s.term, s.score, s.x1, s.y1, s.x2, s.y2, cast(s.width as double), cast(s.height as double)
    from s where s.img not in (select img from fine))"""


SIDE = "greatest(x2-x1, y2-y1) <= 700 and greatest(ex2-ex1, ey2-ey1) <= 700"


def _large(p: str) -> str:
    w, h = f"({p}x2-{p}x1)", f"({p}y2-{p}y1)"
    area = f"{w}*{h}/(cast(width as double)*height + 1e-9)"
    return f"{area} <= 0.4e0 and greatest({w}, {h}) <= cast(greatest(width, height) as double)*0.9e0 + 1e-6"


BOX_OUT = "img, ord, term, score, bx1 as b_x1, by1 as b_y1, bx2 as b_x2, by2 as b_y2"
GUARDS = {
    "owlv2": (0.2, 0.95, SIDE), "grounding_dino": (0.25, 0.95, SIDE), "yoloe": (0.25, 0.95, SIDE),
    "sam3": (0.25, 0.99, _large("") + " and " + _large("e")),
}


def _add_guarded(name: str) -> None:
    @query(
        f"nms_guarded_{name}",
        with_views("fx_detections", "fx_images", recursive=True, body=_guarded_sql(*GUARDS[name]) + f" select {BOX_OUT} from final"),
    )
    def run(spark, sf):
        kept = suppress.nms_guarded(sized(spark, sf), name)
        return kept.select("img", "ord", "term", "score", *edges(F.col("box"), "b", 2))


for _name in GUARDS:
    _add_guarded(_name)


FIRST_CONFIG = ", first as (select term, arg_min(class_name, cfg_ord) class_name, arg_min(prediction_value, cfg_ord) prediction_value from fx_terms group by term)"


@query(
    "term_classes",
    with_views("fx_detections", "fx_terms", body=FIRST_CONFIG + """
select d.ord, d.term, f.class_name, cast(f.prediction_value as int) as prediction_value from fx_detections d join first f on d.term = f.term"""),
)
def term_classes(spark, sf):
    out = detect.map_terms(detections(spark, sf), view(spark, sf, "fx_terms"))
    return out.select("ord", "term", "class_name", "prediction_value")


@query(
    "all_search_terms",
    """
with c as (select user_id as cfg_ord, list(event_type order by event_id) terms from events group by user_id)
select cfg_ord, cast(unnest(range(0, len(terms))) as int) as term_ord, unnest(terms) as term from c""",
)
def all_search_terms(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    configs = table(spark, sf, "events").groupBy(F.col("user_id").alias("cfg_ord")).agg(
        F.transform(ordered, lambda e: e["event_type"]).alias("search_terms")
    )
    configs = configs.withColumn("class_name", F.lit("c")).withColumn("prediction_value", F.lit(0))
    return detect.search_terms(configs).select("cfg_ord", "term_ord", "term")


PHRASED = """
, d as (select ord, case when ord % 3 = 0 then concat(' ', upper(term), ' ') when ord % 3 = 1 then concat('young ', term) else left(term, 3) end phrase from fx_detections),
t as (select *, row_number() over (order by cfg_ord, term_ord) pos from fx_terms),
p as (select distinct phrase from d),
x as (select phrase, min(pos) pos from p join t on lower(trim(phrase)) = lower(trim(term)) group by phrase),
y as (select phrase, min(pos) pos from p join t on contains(lower(trim(phrase)), term) or contains(term, lower(trim(phrase))) group by phrase),
z as (select phrase, coalesce(x.pos, y.pos) pos from y left join x using (phrase)),
named as (select ord, d.phrase, t.term from d join z on d.phrase = z.phrase join t on t.pos = z.pos)"""


def phrased(spark, sf):
    """Detections that carry a model's phrase instead of a search term."""
    k, term = F.col("ord") % 3, F.col("term")
    phrase = (
        F.when(k == 0, F.concat(F.lit(" "), F.upper(term), F.lit(" "))).when(k == 1, F.concat(F.lit("young "), term))
        .otherwise(F.left(term, F.lit(3)))
    )
    return detections(spark, sf).withColumn("phrase", phrase).drop("term")


@query("named_phrases", with_views("fx_detections", "fx_terms", body=PHRASED + " select ord, phrase, term from named"))
def named_phrases(spark, sf):
    return detect.name_phrases(phrased(spark, sf).select("ord", "phrase"), view(spark, sf, "fx_terms"))


def _final_sql(name: str, cmp: str, limit: float, side: str, shown: str) -> str:
    score = round_sql("score", 2)
    box = ", ".join(f"{round_sql(f'b{e}', 2)} b{e}" for e in ("x1", "y1", "x2", "y2"))
    return _guarded_sql(*GUARDS[name]) + FIRST_CONFIG + f"""
, out as (select img, ord, term, {score} confidence, {box}, w, h from final),
big as (select *, bx2-bx1 bw, by2-by1 bh from out where {side})
select b.img, b.ord, cast(f.prediction_value as int) as prediction, f.class_name as label, confidence, {shown}
from big b join first f on b.term = f.term where confidence {cmp} {limit}e0"""


_TINY = ", ".join(
    f"case when bw < 2 or bh < 2 then {grown} else b{e} end as b_{e}" for e, grown in (
        ("x1", "greatest(0e0, (bx1+bx2)/2 - 2)"), ("y1", "greatest(0e0, (by1+by2)/2 - 2)"),
        ("x2", "least(w, (bx1+bx2)/2 + 2)"), ("y2", "least(h, (by1+by2)/2 + 2)"),
    )
)
_ASIS = "bx1 as b_x1, by1 as b_y1, bx2 as b_x2, by2 as b_y2"
_SAM_SIDE = (
    "bx2-bx1 > 0 and by2-by1 > 0 and (bx2-bx1)*(by2-by1)/(w*h + 1e-9) <= 0.4e0"
    " and greatest(bx2-bx1, by2-by1) <= greatest(w, h)*0.9e0 + 1e-6"
)
FINAL = {
    "owlv2": (">=", 0.10, "greatest(bx2-bx1, by2-by1) <= 700", _TINY),
    "yoloe": (">", 0.12, "greatest(bx2-bx1, by2-by1) <= 700", _ASIS),
    "sam3": (">=", 0.10, _SAM_SIDE, _ASIS),
}


def _add_final(name: str) -> None:
    @query(
        f"final_detections_{name}",
        with_views("fx_detections", "fx_images", "fx_terms", recursive=True, body=_final_sql(name, *FINAL[name])),
    )
    def run(spark, sf):
        out = detect.finalize_detections(
            detections(spark, sf), view(spark, sf, "fx_images"), view(spark, sf, "fx_terms"), name
        )
        boxes = [F.get("bounding_box", F.lit(i)).alias(f"b_{n}") for i, n in enumerate(bx.EDGES)]
        return out.select("img", "ord", "prediction", "label", "confidence", *boxes)


for _name in FINAL:
    _add_final(_name)


def _boxes_out(out, *more):
    boxes = [F.get("bounding_box", F.lit(i)).alias(f"b_{n}") for i, n in enumerate(bx.EDGES)]
    return out.select("img", "ord", "prediction", "label", "confidence", *more, *boxes)


_FROM_PHRASES = PHRASED + """
, spoken as (select v.img, v.ord, n.term, v.score, v.x1, v.y1, v.x2, v.y2 from fx_detections v join named n on v.ord = n.ord)"""


@query(
    "final_detections_grounding_dino",
    with_views("fx_detections", "fx_images", "fx_terms", recursive=True, body=_FROM_PHRASES + _final_sql(
        "grounding_dino", ">", 0.12, "greatest(bx2-bx1, by2-by1) <= 700", "cast(ord % 50 as double) / 1000 as latency, " + _ASIS,
    ).replace("fx_detections", "spoken").replace("ord % 50", "b.ord % 50")),
)
def final_detections_grounding_dino(spark, sf):
    """From phrases to the detection table, with the model's latency carried along."""
    raw = phrased(spark, sf).withColumn("latency", (F.col("ord") % 50).cast("double") / 1000)
    out = detect.finalize_detections(raw, view(spark, sf, "fx_images"), view(spark, sf, "fx_terms"), "grounding_dino")
    return _boxes_out(out, "latency")


_UNBOXED = """
, m as (select d.*, i.width w, i.height h, least(960e0/i.height, 960e0/i.width) scale from fx_detections d join fx_images i on d.img = i.img),
n as (select *, cast(trunc(w*scale) as int) nw, cast(trunc(h*scale) as int) nh from m),
q as (select *, (960-nw)//2 pl, (960-nh)//2 pt, cast(w as double)/nw sx, cast(h as double)/nh sy from n),
unboxed as (select img, ord, term, score, greatest(0e0, least((x1-pl)*sx, cast(w as double))) x1, greatest(0e0, least((y1-pt)*sy, cast(h as double))) y1,
  greatest(0e0, least((x2-pl)*sx, cast(w as double))) x2, greatest(0e0, least((y2-pt)*sy, cast(h as double))) y2 from q)"""


@query(
    "final_detections_letterboxed",
    with_views("fx_detections", "fx_images", "fx_terms", recursive=True,
               body=_UNBOXED + _final_sql("owlv2", *FINAL["owlv2"]).replace("fx_detections", "unboxed")),
)
def final_detections_letterboxed(spark, sf):
    """Boxes in 960-pixel letterbox coordinates."""
    return _boxes_out(detect.finalize_detections(
        detections(spark, sf), view(spark, sf, "fx_images"), view(spark, sf, "fx_terms"), "owlv2", letterboxed=True))


@query(
    "suppressed_by",
    with_views("fx_detections", recursive=True, body=greedy_sql(
        "fx_detections", "img", "score desc, ord", BOX, overlap_sql("k.", "r.") + " > 0.5e0") + f"""
, pairs as (select r.img, r.ord, k.ord by_ord, k.score, {overlap_sql("k.", "r.")} iou from fx_detections r join kept k on k.img = r.img
  where r.ord not in (select ord from kept))
select img, ord, by_ord, round(iou, 9) as iou from (
  select *, row_number() over (partition by img, ord order by score desc, by_ord) rn from pairs where iou > 0.5e0) where rn = 1"""),
)
def suppressed_by(spark, sf):
    d = detections(spark, sf)
    kept = suppress.nms(d, ["img"], iou_threshold=0.5)
    return suppress.suppressed_by(d, kept, ["img"], 0.5).withColumn("iou", F.round("iou", 9))


def tiled(spark, sf):
    """Detections spread over four overlapping tile origins per image."""
    c = F.col
    d = detections(spark, sf).withColumn("ox", c("ord") % 2 * 200).withColumn("oy", c("ord") % 3 * 150)
    return d.withColumn("tile", F.concat_ws("_", "ox", "oy"))


_TILED = """
, t as (select *, ord % 2 * 200 ox, ord % 3 * 150 oy from fx_detections)"""
_TILE_STEP = greedy_sql("t", "img, ox, oy", "score desc, ord", BOX, overlap_sql("k.", "r.") + " > 0.4e0")
_IMAGE_STEP = greedy_sql("moved", "img", "score desc, ord", BOX, overlap_sql("k.", "r.") + " > 0.4e0")
for _word in ("ranked", "walk", "kept"):
    _IMAGE_STEP = _IMAGE_STEP.replace(_word, _word + "2")


@query(
    "tiled_nms",
    with_views("fx_detections", recursive=True, body=_TILED + _TILE_STEP + """
, moved as (select img, ord, score, x1 + ox x1, y1 + oy y1, x2 + ox x2, y2 + oy y2 from kept)""" + _IMAGE_STEP + """
select img, ord, score, x1 as b_x1, y1 as b_y1, x2 as b_x2, y2 as b_y2 from kept2"""),
)
def tiled_nms(spark, sf):
    out = labelling.stitch_proposals(tiled(spark, sf), ["img"], 0.4)
    return out.select("img", "ord", "score", *edges(F.col("box"), "b"))


_PROMPT = f"""
, m as (select img, ord, term, ord % 3 prompt_index, trunc(x1 * 1.3e0 + ord % 2 * 200) x1, trunc(y1 * 1.3e0 + ord % 3 * 150) y1,
   trunc(x2 * 1.3e0 + ord % 2 * 200) x2, trunc(y2 * 1.3e0 + ord % 3 * 150) y2, {round_sql("score / 3", 4)} score from fx_detections)""" + greedy_sql(
    "m", "img, prompt_index", "score desc, ord", BOX, overlap_sql("k.", "r.") + " > 0.5e0"
)


def prompted(spark, sf):
    c = F.col
    d = tiled(spark, sf).withColumn("prompt_index", c("ord") % 3).withColumn("score", c("score") / 3)
    return d.withColumn("box", bx.make_box(*[c(n) * 1.3 for n in bx.EDGES]))


@query(
    "prompt_boxes",
    with_views("fx_detections", recursive=True, body=_PROMPT + """
select img, prompt_index, ord, score, x1 as b_x1, y1 as b_y1, x2 as b_x2, y2 as b_y2 from kept"""),
)
def prompt_boxes(spark, sf):
    out = labelling.merge_prompt_boxes(prompted(spark, sf), ["img"]).boxes
    return out.select("img", "prompt_index", "ord", "score", *edges(F.col("box"), "b"))


@query(
    "prompt_stats",
    with_views("fx_detections", recursive=True, body=_PROMPT + """
, n as (select img, prompt_index, count(*) r from m group by img, prompt_index),
k as (select img, prompt_index, count(*) k from kept group by img, prompt_index)
select img, prompt_index, r as raw_detections, coalesce(k, 0) as detections from n left join k using (img, prompt_index)"""),
)
def prompt_stats(spark, sf):
    return labelling.merge_prompt_boxes(prompted(spark, sf), ["img"]).stats


@query(
    "prompt_segments",
    with_views("fx_detections", recursive=True, body=_PROMPT + """
select k.img, k.prompt_index, k.ord, unnest([0, 1]) as point,
  unnest([cast(trunc(d.x1) as int) + cast(k.ord % 2 * 200 as int), cast(trunc(d.x2) as int) + cast(k.ord % 2 * 200 as int)]) as x,
  unnest([cast(trunc(d.y1) as int) + cast(k.ord % 3 * 150 as int), cast(trunc(d.y2) as int) + cast(k.ord % 3 * 150 as int)]) as y
from kept k join fx_detections d on d.ord = k.ord"""),
)
def prompt_segments(spark, sf):
    """Polygons of the kept boxes, moved with them to image coordinates."""
    def point(x, y):
        return F.array(F.col(x).cast("int"), F.col(y).cast("int"))

    c = prompted(spark, sf).withColumn("segmentation", F.array(point("x1", "y1"), point("x2", "y2")))
    out = labelling.merge_prompt_boxes(c, ["img"]).boxes
    rows = out.select("img", "prompt_index", "ord", F.posexplode("segmentation").alias("point", "p"))
    return rows.select("img", "prompt_index", "ord", "point", *[F.get("p", F.lit(i)).cast("int").alias(n) for i, n in enumerate("xy")])


@query(
    "prompt_totals",
    with_views("fx_detections", recursive=True, body=_PROMPT + """
, n as (select img, count(distinct prompt_index) as prompt_count from m group by img),
k as (select img, count(*) as total_detections from kept group by img)
select img, prompt_count, total_detections from n join k using (img)"""),
)
def prompt_totals(spark, sf):
    return labelling.merge_prompt_boxes(prompted(spark, sf), ["img"]).totals


@query(
    "exact_rounding",
    with_views("fx_detections", body=f"""
select ord, {round_sql("score", 2)} as r2, {round_sql("x1 / 8", 2)} as q2, {round_sql("score / 7", 4)} as r4 from fx_detections"""),
)
def exact_rounding(spark, sf):
    d = view(spark, sf, "fx_detections").select("ord", "score", (F.col("x1") / 8).alias("q"), (F.col("score") / 7).alias("r"))
    return d.select("ord", round_to("score", 2).alias("r2"), round_to("q", 2).alias("q2"), round_to("r", 4).alias("r4"))


@query(
    "crop_plan",
    with_views("fx_images", body="""
select concat('plot_', width % 4, '/', img) as image_key, concat('plot_', width % 4, '/rectified_', img) as output_key,
  cast(round_even(0.125e0 * width, 0) as int) x1, cast(round_even(0.1e0 * height, 0) as int) y1,
  cast(round_even(0.905e0 * width, 0) as int) x2, cast(round_even(0.95e0 * height, 0) as int) y2 from fx_images"""),
)
def crop_plan(spark, sf):
    key = F.concat(F.lit("plot_"), F.col("width") % 4, F.lit("/"), "img")
    images = view(spark, sf, "fx_images").select(key.alias("image_key"), "width", "height")
    return labelling.plan_crops(images, "12.5,10:90.5,10:90.5,95:12.5,95").select("image_key", "output_key", "crop.*")


@query(
    "throughput",
    """
with b as (select user_id % 4 backend, count(distinct event_id) n, sum(1) r, sum(value) ms from events group by user_id % 4, user_id)
select backend, cast(sum(n) as bigint) as images, cast(sum(r) as bigint) as rows, round(sum(ms) / 1000, 6) as wall_s,
  round(sum(n) / (sum(ms) / 1000), 4) as img_per_s, round(sum(ms) / 1000 / sum(n), 6) as s_per_img from b group by backend""",
)
def throughput(spark, sf):
    e = table(spark, sf, "events")
    runs = e.groupBy((F.col("user_id") % 4).alias("backend"), "user_id").agg(
        F.count_distinct("event_id").alias("n_images"), F.count(F.lit(1)).alias("n_rows"), (F.sum("value") / 1000).alias("wall_s")
    )
    out = report.throughput(runs, ["backend"])
    return out.select(
        "backend", "images", "rows", F.round("wall_s", 6).alias("wall_s"), F.round("img_per_s", 4).alias("img_per_s"),
        F.round("s_per_img", 6).alias("s_per_img"),
    )
