"""Writers. Tables are Parquet or JSON lines, partitioned where readers prune."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def write_geo(points: DataFrame, path: str, fmt: str = "json") -> None:
    """Enriched geo detections."""
    points.write.mode("overwrite").format(fmt).save(path)


def write_diagnostics(missing: DataFrame, without_gps: DataFrame, path: str) -> None:
    """Image names, one line per record, not de-duplicated."""
    missing.select("img").write.mode("overwrite").text(f"{path}/missing_images")
    without_gps.select("img").write.mode("overwrite").text(f"{path}/no_gps_data")


def geojson_lines(features: DataFrame, wkt: str = "wkt") -> DataFrame:
    """One GeoJSON feature per row: the other columns as properties, the (multi-)polygon as geometry."""
    props = [c for c in features.columns if c != wkt]
    text = F.col(wkt)
    kind = F.when(text.startswith("MULTI"), "MultiPolygon").otherwise("Polygon")
    pairs = F.regexp_replace(F.regexp_extract(text, r"[(].*", 0), r"(-?[0-9.]+) (-?[0-9.]+)", "[$1,$2]")
    geometry = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), F.translate(pairs, "()", "[]"), F.lit("}"))
    return features.select(F.concat(
        F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*props)), F.lit(',"geometry":'),
        F.coalesce(geometry, F.lit("null")), F.lit("}"),
    ).alias("value"))


def write_layer(features: DataFrame, path: str, slug: str = "label_slug") -> None:
    """Map layer: Parquet with WKT, one folder per label slug, and GeoJSON lines beside it."""
    features.write.mode("overwrite").partitionBy(slug).parquet(f"{path}/heatmap")
    geojson_lines(features).write.mode("overwrite").text(f"{path}/heatmap_geojson")


def write_boundary(boundary: DataFrame, path: str) -> None:
    boundary.write.mode("overwrite").parquet(f"{path}/farm_boundary")


def write_detections(detections: DataFrame, path: str) -> None:
    detections.write.mode("overwrite").json(path)


def write_proposals(props: DataFrame, path: str) -> None:
    props.write.mode("overwrite").partitionBy("backend", "proposer").parquet(path)


def write_supports(supports: DataFrame, path: str) -> None:
    supports.write.mode("overwrite").partitionBy("backend").parquet(path)


def write_by_backend(detections: DataFrame, path: str) -> None:
    """One folder of detections per backend."""
    detections.write.mode("overwrite").partitionBy("backend").json(path)


def write_evaluation(totals: DataFrame, per_image: DataFrame, path: str) -> None:
    totals.write.mode("overwrite").json(f"{path}/summary")
    per_image.write.mode("overwrite").json(f"{path}/detailed_results")


def append_metrics(spark: SparkSession, path: str, task: str, framework: str, metrics: dict, metadata: dict) -> None:
    """Adds one run record to the metrics table."""
    row = spark.createDataFrame(
        [(task, framework, {k: float(v) for k, v in metrics.items()}, {k: str(v) for k, v in metadata.items()})],
        schemas.RUN_METRICS.rsplit(",", 1)[0],
    )
    row.withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)


def append_metrics_table(rows: DataFrame, path: str) -> None:
    """Adds many run records at once."""
    rows.write.mode("append").parquet(path)


def write_list_documents(df: DataFrame, path: str, key: str | None = None) -> None:
    """Rows as JSON documents, one per task: a list of objects, under ``key`` if one is given. Tasks stream their rows."""
    head, tail = ("[", "]") if key is None else (f'{{"{key}": [', "]}")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = head
        for batch in batches:
            out = []
            for value in batch.column(0).to_pylist():
                out.append(lead + value)
                lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([tail if lead == "," else head + tail])], ["value"])

    items = df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
    items.mapInArrow(lines, "value string").write.mode("overwrite").text(path)
