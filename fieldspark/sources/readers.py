"""Readers. Each ``read_*`` has a ``parse_*`` twin that works on a text column.

Whole JSON documents are one record each; ``lines=True`` reads JSON lines, which
Spark can split, and ``split=True`` documents of any size by many tasks. Image bytes are never read when only paths are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions import text
from .lists import read_list_items

FAIL = {"mode": "FAILFAST"}


def _documents(spark: SparkSession, path) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _carried(df: DataFrame, col: str) -> list[str]:
    return [c for c in df.columns if c != col]


def parse_detections(df: DataFrame, col: str = "value") -> DataFrame:
    """Top-level detection lists -> rows with list position ``ord`` and the basename ``key``."""
    items = F.from_json(F.col(col), f"array<struct<{schemas.DETECTION}>>", FAIL)
    out = df.select(*_carried(df, col), F.posexplode(items).alias("ord", "_d"))
    return out.select(*_carried(df, col), F.col("ord").cast("bigint"), "_d.*").withColumn("key", text.basename("img"))


def _split(spark: SparkSession, path, section: str, fields: str) -> DataFrame:
    """The objects of one list as rows with ``file`` and their position."""
    items = read_list_items(spark, path).filter(F.col("section") == section)
    return items.select("file", "ord", F.from_json("value", fields, FAIL).alias("_d")).select("file", "ord", "_d.*")


def read_detections(spark: SparkSession, path, lines: bool = False, split: bool = False) -> DataFrame:
    if split:
        return _split(spark, path, "", schemas.DETECTION).drop("file").withColumn("key", text.basename("img"))
    if lines:
        rows = spark.read.schema(schemas.DETECTION).json(path, mode="FAILFAST")
        return rows.withColumn("key", text.basename("img"))
    return parse_detections(_documents(spark, path))


def parse_annotations(df: DataFrame, col: str = "value") -> DataFrame:
    """``{"annotations": [...]}`` -> rows with list position ``ord``; a missing key gives none."""
    doc = F.from_json(F.col(col), f"annotations array<struct<{schemas.ANNOTATION}>>", FAIL)
    out = df.select(*_carried(df, col), F.posexplode(doc["annotations"]).alias("ord", "_a"))
    return out.select(*_carried(df, col), F.col("ord").cast("bigint"), "_a.*")


def read_annotations(spark: SparkSession, path, split: bool = False) -> DataFrame:
    if split:
        return _split(spark, path, "annotations", schemas.ANNOTATION).drop("file")
    return parse_annotations(_documents(spark, path))


def _variant(v: str, path: str, kind: str = "variant") -> Column:
    return F.expr(f"variant_get({v}, '{path}', '{kind}')")


def _is_list(v: str) -> Column:
    return F.expr(f"schema_of_variant({v}) like 'ARRAY%'")


def _number(v: str, name: str) -> Column:
    """JSON number or numeric text -> DOUBLE; booleans, blanks and absent values -> null."""
    field = f"try_variant_get({v}, '$.{name}', 'variant')"
    value = text.to_double(F.expr(f"try_variant_get({v}, '$.{name}', 'string')"), strict=True)
    return F.when(F.expr(f"coalesce(schema_of_variant({field}) <> 'BOOLEAN', false)"), value)


def parse_residue_points(df: DataFrame, col: str = "value") -> DataFrame:
    """Residue samples from a list, an object holding one, or a single object.

    The first list-valued key of results, data, records, items counts. Samples without
    both coordinates are dropped; a missing fraction is 0.
    """
    keep = _carried(df, col)
    doc = df.select(*keep, F.expr(f"parse_json({col})").alias("_v"))
    chosen = F.when(_is_list("_v"), F.expr("cast(_v as array<variant>)"))
    for name in ("results", "data", "records", "items"):
        part = f"try_variant_get(_v, '$.{name}', 'variant')"
        chosen = chosen.when(_is_list(part), F.expr(f"cast({part} as array<variant>)"))
    chosen = chosen.when(F.expr("schema_of_variant(_v) like 'OBJECT%'"), F.array("_v")).otherwise(
        F.raise_error(F.lit("samples need a list or an object")).cast("array<variant>")
    )
    rows = doc.select(*keep, F.posexplode(chosen).alias("ord", "_r"))
    null_key = "try_variant_get(_r, '$.residue_fraction', 'variant')"
    fraction = F.when(
        F.expr(f"{null_key} is null or is_variant_null({null_key})"), _number("_r", "residue_frac")
    ).otherwise(_number("_r", "residue_fraction"))
    out = rows.select(
        *keep, F.col("ord").cast("bigint"), _number("_r", "lat").alias("latitude"), _number("_r", "lon").alias("longitude"),
        F.coalesce(fraction, F.lit(0.0)).alias("residue_fraction"),
    )
    return out.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def read_residue_points(spark: SparkSession, path) -> DataFrame:
    return parse_residue_points(_documents(spark, path))


def decode_class_configs(df: DataFrame, col: str, kind: str = "detector") -> DataFrame:
    """Base64 JSON lists of class configs -> rows with ``cfg_ord``; anything but a non-empty list is an error."""
    fields = {"detector": schemas.DETECTOR_CONFIG, "classifier": schemas.CLASSIFIER_CONFIG}[kind]
    items = F.from_json(F.decode(F.unbase64(F.col(col)), "UTF-8"), f"array<struct<{fields}>>")
    checked = F.when(F.size(items) > 0, items).otherwise(
        F.raise_error(F.lit("class configs must be a non-empty JSON list")).cast(f"array<struct<{fields}>>")
    )
    out = df.select(*_carried(df, col), F.posexplode(checked).alias("cfg_ord", "_c"))
    return out.select(*_carried(df, col), "cfg_ord", "_c.*")


# Image suffixes per discovery policy.
SUFFIXES = {
    "recursive": r"(?i)\.(jpg|jpeg|png|bmp|tiff)$",
    "flat": r"\.(jpg|jpeg|JPG|JPEG|png|PNG|bmp|BMP|tiff|TIFF|tif|TIF)$",
    "one_level": r"(?i)\.(jpeg|jpg|png|tif|tiff)$",
}


def select_images(paths: DataFrame, policy: str = "recursive") -> DataFrame:
    """Image keys (relative paths in ``image_key``) that a policy accepts."""
    depth = F.size(F.split("image_key", "/"))
    out = paths.filter(F.col("image_key").rlike(SUFFIXES[policy]))
    limit = {"recursive": None, "flat": 1, "one_level": 2}[policy]
    return out if limit is None else out.filter(depth <= limit)


def discover_images(spark: SparkSession, root: str, policy: str = "recursive") -> DataFrame:
    """``image_key, path, length`` of the images under ``root``, sorted by key; no bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", policy != "flat").load(root)
    base = root.rstrip("/") + "/"
    marker = base[base.index("/"):] if "/" in base else base
    key = F.expr(f"substring(path, locate('{marker.lstrip(':/')}', path) + {len(marker.lstrip(':/'))})")
    found = files.select(key.alias("image_key"), "path", "length")
    return select_images(found, policy).orderBy("image_key")


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Proposal vectors: ``backend, proposer`` (partitions), ``image_key, ord, box, score, embedding``."""
    return spark.read.parquet(path)


def repair_supports(df: DataFrame) -> DataFrame:
    """``backend, class, vectors array<array<float>>`` -> one row per vector.

    A matrix with more than four times as many rows as columns was stored transposed.
    """
    m = F.col("vectors")
    cols = F.size(F.get(m, F.lit(0)))
    flipped = F.transform(F.sequence(F.lit(0), cols - 1), lambda c: F.transform(m, lambda row: F.get(row, c)))
    fixed = F.when(F.size(m) > 4 * cols, flipped).otherwise(m)
    return df.select("backend", "class", F.posexplode(fixed).alias("ord", "embedding"))


def read_supports(spark: SparkSession, path: str) -> DataFrame:
    """Support vectors as rows; tables of whole matrices are repaired."""
    df = spark.read.parquet(path)
    return repair_supports(df) if "vectors" in df.columns else df


def _with_defaults(anns: DataFrame) -> DataFrame:
    box_area = F.get("bbox", F.lit(2)) * F.get("bbox", F.lit(3))
    return anns.withColumn("area", F.coalesce("area", box_area)).withColumn("iscrowd", F.coalesce("iscrowd", F.lit(0)))


def parse_coco(df: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations with defaults, categories)."""
    keep = _carried(df, col)
    doc = df.select(*keep, F.from_json(F.col(col), schemas.COCO, FAIL).alias("_c"))
    images = doc.select(*keep, F.explode("_c.images").alias("r")).select(*keep, F.col("r.id").alias("image_id"), "r.file_name")
    anns = _with_defaults(doc.select(*keep, F.explode("_c.annotations").alias("r")).select(*keep, "r.*"))
    cats = doc.select(*keep, F.explode("_c.categories").alias("r")).select(*keep, F.col("r.id").alias("category_id"), "r.name")
    return images, anns, cats


def join_coco(images: DataFrame, anns: DataFrame, cats: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Images left-joined to their annotations, with category names."""
    keys = keys or []
    return images.join(anns, [*keys, "image_id"], "left").join(cats, [*keys, "category_id"], "left")


def read_coco(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Images with their annotations of every file; ids count within their ``file``, so files never mix."""
    if split:
        lists = T.StructType.fromDDL(schemas.COCO)
        images, anns, cats = (
            _split(spark, path, name, lists[name].dataType.elementType.simpleString()).drop("ord")
            for name in ("images", "annotations", "categories"))
        return join_coco(
            images.withColumnRenamed("id", "image_id"), _with_defaults(anns),
            cats.withColumnRenamed("id", "category_id"), keys=["file"])
    docs = _documents(spark, path).select(F.col("_metadata.file_path").alias("file"), "value")
    return join_coco(*parse_coco(docs), keys=["file"])


def folder_samples(paths: DataFrame) -> DataFrame:
    """``split/class/.../file`` keys -> ``split, class, image_key``."""
    parts = F.split("image_key", "/")
    return paths.filter(F.size(parts) >= 3).select(
        F.get(parts, F.lit(0)).alias("split"), F.get(parts, F.lit(1)).alias("class"), "image_key"
    )


def read_image_folder(spark: SparkSession, root: str) -> DataFrame:
    """Class-per-folder dataset with the class number taken from the train split."""
    from ..operators.report import class_ids

    return class_ids(folder_samples(discover_images(spark, root, "recursive")))


def stem(path) -> Column:
    return F.regexp_replace(text.basename(path), r"\.[^.]*$", "")


def pair_masks(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(image, mask) pairs by file stem, masks being ``.png``; and the images without a mask."""
    left = images.filter(F.col("image_key").rlike(r"(?i)\.(jpg|jpeg|png)$")).withColumn("stem", stem("image_key"))
    right = masks.filter(F.col("mask_key").rlike(r"\.png$")).withColumn("stem", stem("mask_key"))
    return left.join(right, "stem"), left.join(right, "stem", "left_anti")


def take_split(df: DataFrame, n: int, ord: str = "ord", keys: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by position (per ``keys``, if given)."""
    if not keys:
        return df.orderBy(ord).limit(n)
    w = Window.partitionBy(*keys).orderBy(ord)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
