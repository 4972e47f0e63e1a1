"""Structured Streaming jobs over the given tables, drained with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import VIEWS, table, view, with_views
from ..scale import scratch_path
from ..streaming import encode
from . import query

ENCODES = """
, k as (select event_id, pipe_id, image_id, ts, row_number() over (partition by pipe_id, image_id order by ts, event_id) rn from fx_requests),
w(pipe_id, image_id, rn, event_id, last, hit) as (
  select pipe_id, image_id, rn, event_id, ts, true from k where rn = 1
  union all
  select k.pipe_id, k.image_id, k.rn, k.event_id, case when k.ts >= w.last + interval 3600 seconds then k.ts else w.last end, k.ts >= w.last + interval 3600 seconds
  from w join k on k.pipe_id = w.pipe_id and k.image_id = w.image_id and k.rn = w.rn + 1)
select pipe_id, image_id, event_id from w where hit"""


def stream_of(spark, sf, name):
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("encode_once_stream", with_views("fx_requests", recursive=True, body=ENCODES))
def encode_once_stream(spark, sf):
    stream_of(spark, sf, "events").createOrReplaceTempView("events")
    requests = spark.sql(VIEWS["fx_requests"][1]).withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "encodes")
    encode.drain(encode.encode_once(requests), path)
    return spark.read.parquet(f"{path}/table").select("pipe_id", "image_id", "event_id")


@query("encode_once_batch", with_views("fx_requests", recursive=True, body=ENCODES))
def encode_once_batch(spark, sf):
    requests = view(spark, sf, "fx_requests").withColumn("ts", F.col("ts").cast("timestamp"))
    return encode.encode_once_batch(requests).select("pipe_id", "image_id", "event_id")


@query(
    "running_label_counts",
    with_views("fx_detections", "fx_terms", body="""
, first as (select term, arg_min(class_name, cfg_ord) class_name from fx_terms group by term)
select f.class_name as label, count(*) as n from fx_detections d join first f on d.term = f.term group by f.class_name"""),
)
def running_label_counts(spark, sf):
    terms = view(spark, sf, "fx_terms")
    stream_of(spark, sf, "orders").createOrReplaceTempView("orders")
    detections = spark.sql(VIEWS["fx_detections"][1])
    path = scratch_path(spark, "counts")
    encode.drain(encode.running_label_counts(detections, terms), path, mode="complete")
    return spark.read.parquet(f"{path}/table")
