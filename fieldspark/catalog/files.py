"""Readers and writers: documents derived from the tables, parsed or written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import table, view, with_views
from ..functions import boxes as bx
from ..operators import match
from ..plans import maps
from ..scale import scratch_path
from ..sources import readers, writers
from . import query
from .boxes import r6
from .detections import FIRST_CONFIG
from .field import gps, located
from .matching import MATCH, sides


def grouped_json(df, key, order, fields):
    """One JSON list per value of ``key`` (groups of bounded size)."""
    items = F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("v"))))
    return df.groupBy(key).agg(F.transform(items, lambda e: e["v"]).alias("items"))


@query(
    "detection_documents",
    with_views("fx_detections", body="""
select ord // 50 as doc, cast(row_number() over (partition by ord // 50 order by ord) - 1 as bigint) as ord, img as key, term as label,
  score as confidence, x1, y2 from fx_detections"""),
)
def detection_documents(spark, sf):
    d = view(spark, sf, "fx_detections").withColumn("doc", F.floor(F.col("ord") / 50))
    fields = (
        F.concat(F.lit("field/a/"), "img").alias("img"), F.col("term").alias("label"), F.col("score").alias("confidence"),
        F.array("x1", "y1", "x2", "y2").alias("bounding_box"),
    )
    docs = grouped_json(d, "doc", "ord", fields).select("doc", F.to_json("items").alias("value"))
    out = readers.parse_detections(docs)
    b = F.col("bounding_box")
    return out.select("doc", "ord", "key", "label", "confidence", F.get(b, F.lit(0)).alias("x1"), F.get(b, F.lit(3)).alias("y2"))


@query(
    "annotation_documents",
    with_views("fx_gt", body="""
select ord // 50 as doc, cast(row_number() over (partition by ord // 50 order by ord) - 1 as bigint) as ord, img as image_path, class,
  case when ord % 2 = 0 then 0.5e0 end as score, x2 from fx_gt where (ord // 50) % 10 <> 3"""),
)
def annotation_documents(spark, sf):
    """Every tenth document lacks the annotations key."""
    g = view(spark, sf, "fx_gt").withColumn("doc", F.floor(F.col("ord") / 50))
    fields = (
        F.col("img").alias("image_path"), F.array("x1", "y1", "x2", "y2").alias("bounding_box"), "class",
        F.when(F.col("ord") % 2 == 0, F.lit(0.5)).alias("score"),
    )
    docs = grouped_json(g, "doc", "ord", fields)
    text = F.when(F.col("doc") % 10 == 3, F.lit('{"other": []}')).otherwise(F.to_json(F.struct(F.col("items").alias("annotations"))))
    out = readers.parse_annotations(docs.select("doc", text.alias("value")))
    return out.select("doc", "ord", "image_path", "class", "score", F.get("bounding_box", F.lit(2)).alias("x2"))


@query(
    "residue_documents",
    with_views("fx_residue", body="""
select id, latitude, longitude, case when id % 7 in (3, 6) then 0e0 else residue_fraction end as residue_fraction from fx_residue where id % 7 <> 5 and id % 11 <> 0"""),
)
def residue_documents(spark, sf):
    """One document per sample: lists, wrapped lists, single objects, numeric text; case 5 has a boolean latitude."""
    k = F.col("id") % 7
    c = F.col

    def num(name):
        return c(name).cast("string")

    lat = F.when(c("id") % 11 == 0, F.lit('""')).when(k == 5, F.lit("true")).when(
        k == 2, F.concat(F.lit('" '), num("latitude"), F.lit(' "'))
    ).otherwise(num("latitude"))
    frac = F.when(k == 1, F.concat(F.lit(', "residue_frac": '), num("residue_fraction"))).when(k == 3, F.lit("")).when(
        k == 6, F.lit(', "residue_fraction": null')
    ).otherwise(F.concat(F.lit(', "residue_fraction": '), num("residue_fraction")))
    one = F.concat(F.lit('{"lat": '), lat, F.lit(', "lon": '), num("longitude"), frac, F.lit("}"))
    doc = (
        F.when(k == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k == 1, F.concat(F.lit('{"data": ['), one, F.lit("]}")))
        .when(k == 2, F.concat(F.lit('{"results": {}, "items": ['), one, F.lit("]}"))).otherwise(one)
    )
    out = readers.parse_residue_points(view(spark, sf, "fx_residue").select("id", doc.alias("value")))
    return out.select("id", "latitude", "longitude", "residue_fraction")


@query(
    "class_config_documents",
    """
select n_nationkey as id, cast(k as int) as cfg_ord, concat(n_name, k) as class_name, concat('t', k, '|', n_name) as terms, cast(k + n_regionkey as int) as prediction_value
from (select *, unnest([0, 1]) k from nation)""",
)
def class_config_documents(spark, sf):
    n = table(spark, sf, "nation")

    def cfg(k):
        return F.struct(
            F.concat("n_name", F.lit(str(k))).alias("class_name"), F.array(F.lit(f"t{k}"), "n_name").alias("search_terms"),
            (F.col("n_regionkey") + k).alias("prediction_value"),
        )

    docs = n.select(F.col("n_nationkey").alias("id"), F.base64(F.to_json(F.array(cfg(0), cfg(1))).cast("binary")).alias("value"))
    out = readers.decode_class_configs(docs, "value")
    return out.select("id", "cfg_ord", "class_name", F.array_join("search_terms", "|").alias("terms"), "prediction_value")


_EXT = ".jpg .JPEG .Png .tif .TIFF .bmp .txt .jpg.bak".split()


@query(
    "image_discovery",
    f"""
with k as (select doc_id, list_element({_EXT}, cast(doc_id % 8 as int) + 1) ext, doc_id % 3 d from documents),
p as (select concat(case when d > 0 then 'a/' else '' end, case when d > 1 then 'b/' else '' end, doc_id, ext) image_key, ext, d from k)
select 'recursive' as policy, image_key from p where lower(ext) in ('.jpg', '.jpeg', '.png', '.bmp', '.tiff')
union all select 'flat', image_key from p where d = 0 and ext in ('.jpg', '.JPEG', '.tif', '.TIFF', '.bmp')
union all select 'one_level', image_key from p where d < 2 and lower(ext) in ('.jpg', '.jpeg', '.png', '.tif', '.tiff')""",
)
def image_discovery(spark, sf):
    d = F.col("doc_id") % 3
    ext = F.element_at(F.array(*[F.lit(e) for e in _EXT]), (F.col("doc_id") % 8 + 1).cast("int"))
    folder = F.when(d == 0, F.lit("")).when(d == 1, F.lit("a/")).otherwise(F.lit("a/b/"))
    keys = table(spark, sf, "documents").select(F.concat(folder, F.col("doc_id").cast("string"), ext).alias("image_key"))
    parts = [readers.select_images(keys, p).select(F.lit(p).alias("policy"), "image_key") for p in readers.SUFFIXES]
    return parts[0].union(parts[1]).union(parts[2])


@query(
    "support_matrices",
    """
select concat('c', vec_id // 10) as class, cast(row_number() over (partition by vec_id // 10 order by vec_id) - 1 as int) as ord,
  round(cast(embedding[1] as double), 6) as v0, round(cast(embedding[64] as double), 6) as v63 from embeddings""",
)
def support_matrices(spark, sf):
    """Matrices of ten vectors; every second one stored transposed."""
    e = table(spark, sf, "embeddings").withColumn("g", F.floor(F.col("vec_id") / 10))
    m = e.groupBy("g").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda r: r["embedding"]
    ).alias("m"))
    turned = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.transform("m", lambda row: F.get(row, k)))
    stored = m.select(
        F.lit("dinov3").alias("backend"), F.concat(F.lit("c"), F.col("g").cast("string")).alias("class"),
        F.when(F.col("g") % 2 == 1, turned).otherwise(F.col("m")).alias("vectors"),
    )
    out = readers.repair_supports(stored)
    return out.select(
        "class", "ord", r6(F.get("embedding", F.lit(0)).cast("double")).alias("v0"), r6(F.get("embedding", F.lit(63)).cast("double")).alias("v63")
    )


@query(
    "coco_tables",
    """
with i as (select o_orderkey id, concat(o_orderkey, '.jpg') f from orders),
a as (select o_orderkey image_id, o_orderkey % 3 category_id, o_orderkey % 40 + 1 w, o_orderkey % 30 + 1 h, case when o_orderkey % 2 = 0 then 7e0 end area from orders where o_orderkey % 4 <> 0)
select i.id as image_id, f as file_name, category_id, 'cat' || category_id as name, coalesce(area, cast(w * h as double)) as area,
  case when category_id is not null then 0 end as iscrowd from i left join a on a.image_id = i.id""",
)
def coco_tables(spark, sf):
    """One document per image; a quarter of the images has no annotation."""
    k = F.col("o_orderkey")
    ann = F.struct(
        k.alias("image_id"), (k % 3).alias("category_id"),
        F.array(F.lit(1.0), F.lit(2.0), (k % 40 + 1).cast("double"), (k % 30 + 1).cast("double")).alias("bbox"),
        F.when(k % 2 == 0, F.lit(7.0)).alias("area"),
    )
    doc = F.struct(
        F.array(F.struct(k.alias("id"), F.concat(k.cast("string"), F.lit(".jpg")).alias("file_name"))).alias("images"),
        F.when(k % 4 != 0, F.array(ann)).otherwise(F.array().cast(
            "array<struct<image_id:bigint,category_id:bigint,bbox:array<double>,area:double>>")).alias("annotations"),
        F.array(F.struct((k % 3).alias("id"), F.concat(F.lit("cat"), (k % 3).cast("string")).alias("name"))).alias("categories"),
    )
    docs = table(spark, sf, "orders").select(k.alias("doc"), F.to_json(doc).alias("value"))
    out = readers.join_coco(*readers.parse_coco(docs), keys=["doc"])
    return out.select("image_id", "file_name", "category_id", "name", "area", "iscrowd")


@query(
    "proposal_store",
    with_views("fx_proposals", body="""
select image_key, ord, score, round(cast(embedding[1] as double), 6) as v0 from fx_proposals where proposer = 'sam3'"""),
)
def proposal_store(spark, sf):
    path = scratch_path(spark, "proposals")
    writers.write_proposals(view(spark, sf, "fx_proposals"), path)
    back = readers.read_proposals(spark, path).filter((F.col("backend") == "dinov3") & (F.col("proposer") == "sam3"))
    return back.select("image_key", "ord", "score", r6(F.get("embedding", F.lit(0)).cast("double")).alias("v0"))


@query(
    "detection_file",
    with_views("fx_detections", "fx_terms", body=FIRST_CONFIG + """
select d.img as key, cast(f.prediction_value as int) as prediction, f.class_name as label, d.score as confidence, x1, y2
from fx_detections d join first f on d.term = f.term"""),
)
def detection_file(spark, sf):
    from ..operators.detect import map_terms

    d = map_terms(view(spark, sf, "fx_detections"), view(spark, sf, "fx_terms"))
    rows = d.select(
        F.concat(F.lit("in/"), "img").alias("img"), F.col("prediction_value").alias("prediction"), F.col("class_name").alias("label"),
        F.lit(0.1).alias("latency"), F.col("score").alias("confidence"), F.array("x1", "y1", "x2", "y2").alias("bounding_box"),
    )
    path = scratch_path(spark, "detections")
    writers.write_detections(rows, path)
    back = readers.read_detections(spark, path, lines=True)
    b = F.col("bounding_box")
    return back.select("key", "prediction", "label", "confidence", F.get(b, F.lit(0)).alias("x1"), F.get(b, F.lit(3)).alias("y2"))


@query(
    "detection_lists",
    with_views("fx_detections", body="select img as key, term as label, score as confidence, x1, y2 from fx_detections"),
)
def detection_lists(spark, sf):
    """Lists of any size, written one per task and read in blocks."""
    d = view(spark, sf, "fx_detections").select(
        F.concat(F.lit("in/"), "img").alias("img"), F.col("term").alias("label"), F.col("score").alias("confidence"),
        F.array("x1", "y1", "x2", "y2").alias("bounding_box"))
    path = scratch_path(spark, "detection-lists")
    writers.write_list_documents(d, path)
    b = F.col("bounding_box")
    return readers.read_detections(spark, path, split=True).select(
        "key", "label", "confidence", F.get(b, F.lit(0)).alias("x1"), F.get(b, F.lit(3)).alias("y2"))


@query(
    "annotation_lists",
    with_views("fx_gt", body="""
select img as image_path, class, case when ord % 2 = 0 then 0.5e0 end as score, x2 from fx_gt"""),
)
def annotation_lists(spark, sf):
    g = view(spark, sf, "fx_gt").select(
        F.col("img").alias("image_path"), F.array("x1", "y1", "x2", "y2").alias("bounding_box"), "class",
        F.when(F.col("ord") % 2 == 0, F.lit(0.5)).alias("score"))
    path = scratch_path(spark, "annotation-lists")
    writers.write_list_documents(g, path, "annotations")
    return readers.read_annotations(spark, path, split=True).select(
        "image_path", "class", "score", F.get("bounding_box", F.lit(2)).alias("x2"))


@query(
    "detections_by_backend",
    with_views("fx_detections", body="select case when ord % 3 = 0 then 'a' else 'b' end as backend, count(*) as n, sum(x1) as sx from fx_detections group by 1"),
)
def detections_by_backend(spark, sf):
    path = scratch_path(spark, "by-backend")
    backend = F.when(F.col("ord") % 3 == 0, F.lit("a")).otherwise(F.lit("b"))
    writers.write_by_backend(view(spark, sf, "fx_detections").withColumn("backend", backend), path)
    back = spark.read.schema("img string, ord bigint, x1 double, backend string").json(path)
    return back.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.sum("x1").alias("sx"))


@query(
    "geo_file",
    with_views("fx_detections", "fx_gps", "fx_images", body="""
select term as label, count(*) as n from fx_detections where img in (select img from fx_images where width % 50 <> 0) and img in (select img from fx_gps) group by term"""),
)
def geo_file(spark, sf):
    path = scratch_path(spark, "geo")
    writers.write_geo(located(spark, sf)[0], path)
    back = spark.read.schema("label string, latitude double, bbox_lat1 double").json(path)
    return back.filter(F.col("latitude") >= F.col("bbox_lat1")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "diagnostic_files",
    with_views("fx_detections", "fx_gps", "fx_images", body="""
, seen as (select img from fx_images where width % 50 <> 0)
select 'missing_images' as list, img, count(*) as n from fx_detections where img not in (select img from seen) group by img
union all select 'no_gps_data', img, count(*) from fx_detections where img in (select img from seen) and img not in (select img from fx_gps) group by img"""),
)
def diagnostic_files(spark, sf):
    _, missing, without = located(spark, sf)
    path = scratch_path(spark, "diagnostics")
    writers.write_diagnostics(missing, without, path)
    parts = [
        spark.read.text(f"{path}/{n}").groupBy(F.lit(n).alias("list"), F.col("value").alias("img")).agg(F.count(F.lit(1)).alias("n"))
        for n in ("missing_images", "no_gps_data")
    ]
    return parts[0].union(parts[1])


@query(
    "evaluation_files",
    with_views("fx_gt", recursive=True, body=MATCH + """
, c as (select (select count(*) from pairs) tp, (select count(*) from gen) p, (select count(*) from fx_gt) g),
k as (select count(distinct img) n from (select img from fx_gt union all select img from fx_detections))
select tp as total_tp, p - tp as total_fp, g - tp as total_fn, n as images, tp as listed_pairs from c, k"""),
)
def evaluation_files(spark, sf):
    totals, per = match.evaluate(*sides(spark, sf), 0.5, 0.5, "img", with_pairs=True)
    path = scratch_path(spark, "evaluation")
    writers.write_evaluation(totals, per, path)
    s = spark.read.schema("total_tp bigint, total_fp bigint, total_fn bigint").json(f"{path}/summary")
    d = spark.read.schema("img string, matched_pairs array<struct<gt:bigint>>").json(f"{path}/detailed_results")
    counts = d.agg(F.count(F.lit(1)).alias("images"), F.sum(F.size("matched_pairs")).alias("listed_pairs"))
    return s.join(counts)


@query("map_layer_files")
def map_layer_files(spark, sf):
    """Level features written per label folder and read back with their outline text."""
    d = view(spark, sf, "fx_detections")
    det = d.select("img", F.col("term").alias("label"), bx.to_array(bx.make_box()).alias("bounding_box"))
    m = maps.weed_map(det, gps(spark, sf), cell_ft=(20.0, 20.0))
    path = scratch_path(spark, "layer")
    writers.write_layer(m.features, path)
    writers.write_boundary(m.boundary, path)
    layer = spark.read.parquet(f"{path}/heatmap").select("label_slug", "level", "crop_count", F.length("wkt").alias("wkt_chars"))
    edge = spark.read.parquet(f"{path}/farm_boundary").select("label", "field_width_m")
    return layer.join(edge, F.col("label_slug") == F.col("label")).drop("label")


@query(
    "run_metrics_log",
    """
select cast(user_id as varchar) as task, 'spark' as framework, count(*) as n, round(avg(value), 6) as mean from events group by user_id""",
)
def run_metrics_log(spark, sf):
    """Two appends of run records, read back as one table."""
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    rows = per.select(
        F.col("user_id").cast("string").alias("task"), F.lit("spark").alias("framework"),
        F.create_map(F.lit("n"), F.col("n").cast("double"), F.lit("mean"), F.col("mean")).alias("metrics"),
        F.create_map(F.lit("parity"), (F.col("user_id") % 2).cast("string")).alias("metadata"), F.current_timestamp().alias("ts"),
    )
    path = scratch_path(spark, "metrics")
    for parity in ("0", "1"):
        writers.append_metrics_table(rows.filter(F.element_at("metadata", "parity") == parity), path)
    back = spark.read.parquet(path)
    m = F.col("metrics")
    return back.select("task", "framework", m["n"].cast("bigint").alias("n"), r6(m["mean"]).alias("mean"))
