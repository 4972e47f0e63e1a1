"""Files on disk, streaming against its batch twin, models, metrics edge cases."""

import base64
import json
import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.operators import fewshot, relabel, segmetrics, udf
from fieldspark.operators.detect import first_config
from fieldspark.operators.similarity import similarity
from fieldspark.sources import readers, writers
from fieldspark.streaming import encode


def put(path, obj):
    path.write_text(json.dumps(obj))
    return str(path)


def test_detection_file(spark, tmp_path):
    p = put(tmp_path / "d.json", [{"img": "a/b.jpg", "bounding_box": [1, 2, 3, 4], "label": "x"}, {"label": "y"}])
    rows = readers.read_detections(spark, p).orderBy("ord").collect()
    assert [(r.ord, r.key, r.bounding_box) for r in rows] == [(0, "b.jpg", [1.0, 2.0, 3.0, 4.0]), (1, None, None)]


def test_annotation_file_without_key(spark, tmp_path):
    assert readers.read_annotations(spark, put(tmp_path / "a.json", {"x": 1})).count() == 0


@pytest.mark.parametrize(
    "doc,n",
    [
        ([{"lat": 1, "lon": 2}], 1),
        ({"data": [{"lat": "1", "lon": " 2 ", "residue_frac": "0.5"}]}, 1),
        ({"results": {}, "items": [{"lat": 1, "lon": 2}, {"lat": "", "lon": 2}, {"lat": True, "lon": 2}]}, 1),
        ({"lat": 1, "lon": 2}, 1),
        ({"data": []}, 0),
    ],
)
def test_residue_documents(spark, tmp_path, doc, n):
    assert readers.read_residue_points(spark, put(tmp_path / "r.json", doc)).count() == n


def test_residue_scalar_document_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="list or an object"):
        readers.read_residue_points(spark, put(tmp_path / "r.json", 3)).collect()


def test_class_configs(spark):
    def decode(obj):
        text = base64.b64encode(json.dumps(obj).encode()).decode()
        return readers.decode_class_configs(spark.createDataFrame([(text,)], "v string"), "v").collect()

    rows = decode([{"class_name": "weed", "search_terms": ["a"], "prediction_value": 1}])
    assert rows[0].class_name == "weed"
    with pytest.raises(Exception, match="non-empty"):
        decode([])


def test_discovery_policies(spark, tmp_path):
    for name in ("a.jpg", "b.JPG", "c.Jpg", "d.tif", "s/e.png", "s/t/f.jpeg", "g.txt"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    got = {p: [r.image_key for r in readers.discover_images(spark, str(tmp_path), p).collect()] for p in readers.SUFFIXES}
    assert got["recursive"] == ["a.jpg", "b.JPG", "c.Jpg", "s/e.png", "s/t/f.jpeg"]
    assert got["flat"] == ["a.jpg", "b.JPG", "d.tif"]
    assert got["one_level"] == ["a.jpg", "b.JPG", "c.Jpg", "d.tif", "s/e.png"]


def test_image_bytes_are_not_read(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    plan = readers.discover_images(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_image_folder_classes(spark, tmp_path):
    for name in ("train/b/1.jpg", "train/a/2.jpg", "val/b/3.jpg", "val/z/4.jpg"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    rows = {r.image_key: r.class_idx for r in readers.read_image_folder(spark, str(tmp_path)).collect()}
    assert rows == {"train/b/1.jpg": 1, "train/a/2.jpg": 0, "val/b/3.jpg": 1, "val/z/4.jpg": None}


def test_run_metrics_append(spark, tmp_path):
    for k in range(2):
        writers.append_metrics(spark, str(tmp_path / "m"), "detect", "hf", {"map": k}, {"k": k})
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_stream_over_several_batches_equals_batch_twin(spark, tmp_path):
    rnd, start = random.Random(4), datetime(2024, 1, 1)
    times = sorted(rnd.randint(0, 40_000) for _ in range(300))
    rows = [(f"p{rnd.randint(0, 2)}", "i", k, start + timedelta(seconds=t)) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "pipe_id string, image_id string, event_id long, ts timestamp")
    src = str(tmp_path / "src")
    for k in range(3):
        df.filter((F.col("event_id") >= k * 100) & (F.col("event_id") < (k + 1) * 100)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    encode.drain(encode.encode_once(stream), str(tmp_path / "out"))
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out/table")).collect())
    assert got == sorted(r.event_id for r in encode.encode_once_batch(df).collect())


@pytest.mark.parametrize("buckets", [1, 3])
def test_stream_keys_of_one_bucket_stay_apart(spark, tmp_path, buckets):
    rnd, start = random.Random(5), datetime(2024, 1, 1)
    times = sorted(rnd.randint(0, 60_000) for _ in range(600))
    rows = [(rnd.choice(["p", "q", None]), rnd.choice(["i", "j", None]), k, start + timedelta(seconds=t)) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "pipe_id string, image_id string, event_id long, ts timestamp")
    src = str(tmp_path / "src")
    for k in range(3):
        df.filter((F.col("event_id") >= k * 200) & (F.col("event_id") < (k + 1) * 200)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    encode.drain(encode.encode_once(stream, buckets=buckets), str(tmp_path / "out"))
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out/table")).collect())
    last, want = {}, []
    for pipe, image, k, ts in rows:
        if (pipe, image) not in last or ts >= last[pipe, image] + timedelta(seconds=3600):
            last[pipe, image] = ts
            want.append(k)
    assert got == want


def test_first_config_in_list_order(spark):
    t = spark.createDataFrame([("a", "late", 2, 1, 0), ("a", "early", 1, 0, 5)], "term string, class_name string, prediction_value int, cfg_ord int, term_ord int")
    assert first_config(t).first().class_name == "early"


def vectors(rows):
    return [(k, [float(x) for x in v]) for k, v in rows]


def test_relabel_ties_and_no_prototype(spark):
    det = spark.createDataFrame([(1, "old", [1.0, 0.0]), (2, "old", [-1.0, 0.0])], "det_id int, label string, embedding array<float>")
    protos = spark.createDataFrame([("b", 0, [1.0, 0.0]), ("a", 1, [1.0, 0.0])], "class string, cls_ord int, embedding array<float>")
    out = {r.det_id: (r.label, round(r.classifier_confidence, 3)) for r in relabel.relabel(det, protos).collect()}
    assert out[1] == ("b", 1.0)
    none = relabel.relabel(det, protos.filter("false")).collect()
    assert {(r.label, r.classifier_confidence) for r in none} == {("old", -1.0)}


def test_repeated_class_takes_last_vector_and_first_place(spark):
    protos = spark.createDataFrame([("a", 0, [1.0]), ("b", 1, [2.0]), ("a", 2, [3.0])], "class string, cls_ord int, embedding array<float>")
    out = {r["class"]: (r.cls_ord, r.embedding) for r in relabel.resolve_prototypes(protos).collect()}
    assert out == {"a": (0, [3.0]), "b": (1, [2.0])}


def test_similarity_plans_agree_and_mismatched_dims_are_skipped(spark):
    rnd = np.random.default_rng(1)
    v = spark.createDataFrame([("x", i, rnd.normal(size=8).tolist()) for i in range(50)], "backend string, ord int, embedding array<float>")
    refs = [("x", f"c{i % 4}", rnd.normal(size=8).tolist()) for i in range(20)] + [("x", "odd", [1.0, 2.0])]
    refs = spark.createDataFrame(refs, "backend string, class string, embedding array<float>")

    def rows(**kw):
        s = similarity(v, refs, ["backend"], ["backend", "ord"], **kw)
        return sorted((r.ord, r["class"], round(r.similarity, 9)) for r in s.collect())

    small = rows()
    assert small == rows(budget=1, chunk_bytes=400)
    assert len(small) == 200


def test_zero_area_proposals_keep_all_classes(spark):
    p = spark.createDataFrame(
        [("x", "i", 0, 0.9, 0.0, 0.0, 0.0, 5.0, [1.0, 1.0])],
        "backend string, image_key string, ord int, score double, x1 double, y1 double, x2 double, y2 double, embedding array<float>",
    )
    s = spark.createDataFrame([("x", "a", [1.0, 0.5]), ("x", "b", [0.5, 1.0])], "backend string, class string, embedding array<float>")
    assert fewshot.classify(p, s).count() == 2
    assert fewshot.classify(p.withColumn("x2", F.lit(5.0)), s).count() == 1


def test_transposed_supports(spark):
    m = [[float(10 * r + c) for c in range(2)] for r in range(9)]
    df = spark.createDataFrame([("x", "a", m)], "backend string, class string, vectors array<array<float>>")
    rows = readers.repair_supports(df).orderBy("ord").collect()
    assert [len(r.embedding) for r in rows] == [9, 9] and rows[1].embedding[0] == 1.0
    dims = spark.createDataFrame([("x", 9)], "backend string, dim int")
    good, bad = fewshot.orient_supports(df, dims)
    assert good.count() == 2 and bad.count() == 0


def test_embedder_checks_shape(spark):
    df = spark.range(5)
    ok = udf.embed(df, lambda: (lambda rows: np.ones((len(rows), 4))), ["id"], 4, batch=2)
    assert {tuple(r.embedding) for r in ok.collect()} == {(0.5, 0.5, 0.5, 0.5)}
    with pytest.raises(Exception, match="expected"):
        udf.embed(df, lambda: (lambda rows: np.ones((len(rows), 3))), ["id"], 4).collect()


def test_empty_masks_score_one(spark):
    df = spark.createDataFrame([(0, 0, 0)], "batch int, gt int, pred int")
    assert tuple(segmetrics.dice_iou(df).first()) == (1.0, 1.0)


def test_python_rounding(spark):
    from fieldspark.functions.numbers import round_to

    rnd = random.Random(2)
    values = [0.285, 0.125, 0.375, 2.675, -1.005, 0.0, 699.995] + [rnd.randint(-10**6, 10**6) / 1000 for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (2, 3, 4, 6):
        got = [r.r for r in df.select(round_to("v", digits).alias("r")).collect()]
        assert got == [round(v, digits) + 0.0 for v in values]


def test_coco_files_keep_their_ids_apart(spark, tmp_path):
    from fieldspark.sources import readers

    for split, label in (("train", "weed"), ("val", "crop")):
        doc = {
            "images": [{"id": 1, "file_name": f"{split}.jpg"}], "categories": [{"id": 0, "name": label}],
            "annotations": [{"image_id": 1, "category_id": 0, "bbox": [0.0, 0.0, 2.0, 3.0]}],
        }
        (tmp_path / f"{split}.json").write_text(json.dumps(doc))
    got = readers.read_coco(spark, str(tmp_path)).collect()
    assert sorted((r.file_name, r.name, r.area, r.file.rsplit("/", 1)[1]) for r in got) == [
        ("train.jpg", "weed", 6.0, "train.json"), ("val.jpg", "crop", 6.0, "val.json")]


def test_broken_lines_fail(spark, tmp_path):
    from fieldspark.sources import readers

    (tmp_path / "a.json").write_text('{"img": "x/a.jpg", "confidence": 0.5}\n{"img": \n')
    with pytest.raises(Exception):
        readers.read_detections(spark, str(tmp_path), lines=True).collect()


def test_relabel_keeps_alike_rows_beyond_the_budget(spark):
    from fieldspark.operators import relabel as rl

    det = spark.createDataFrame(
        [("a.jpg", "weed", [1.0, 0.0]), ("a.jpg", "weed", [1.0, 0.0]), ("a.jpg", "weed", [0.0, 1.0]), ("b.jpg", "crop", [0.6, 0.8])],
        "img string, label string, embedding array<double>")
    protos = spark.createDataFrame([("p", 0, [1.0, 0.0]), ("q", 1, [0.0, 1.0])], "class string, cls_ord int, embedding array<double>")
    small, sliced = (sorted(map(tuple, rl.relabel(det, protos, **o).collect())) for o in ({}, {"budget": 1, "chunk_bytes": 16}))
    assert small == sliced and len(small) == 4


def test_unsettled_lengths_are_null(spark):
    from fieldspark.functions import geo

    row = spark.sql("select 0.0D a, 0.0D b, 0.5D c, 179.7D d, 40.0D e, -83.0D f, 40.01D g").select(
        geo.geodesic_m("a", "b", "c", "d").alias("far"), geo.geodesic_m("e", "f", "g", "f").alias("near")).first()
    assert row.far is None and abs(row.near - 1110.36) < 0.1


def test_geojson_opens(spark):
    rows = spark.createDataFrame([
        ("a", 3, "POLYGON ((0.5 -1.0, 2.0 0.0, 0.5 -1.0), (1.0 1.0, 1.5 1.0, 1.0 1.0))"), ("b", 4, "MULTIPOLYGON (((0 0, 1 0, 0 0)), ((5 5, 6 5, 5 5)))"),
        ("c", 5, None)], "level string, n int, wkt string")
    got = [json.loads(r.value) for r in writers.geojson_lines(rows).collect()]
    assert got[0]["geometry"] == {"type": "Polygon", "coordinates": [[[0.5, -1.0], [2.0, 0.0], [0.5, -1.0]], [[1.0, 1.0], [1.5, 1.0], [1.0, 1.0]]]}
    assert got[1]["geometry"] == {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [0, 0]]], [[[5, 5], [6, 5], [5, 5]]]]}
    assert got[2]["geometry"] is None and got[2]["properties"] == {"level": "c", "n": 5}


def test_streamed_similarity_keeps_rows_ties_and_unmatched(spark):
    """Vectors of two lengths, repeated rows, null vectors, several keys, best class only for some."""
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(6, 5))
    rows = [(f"b{i % 2}", i // 2, (centres[i % 6] + rnd.normal(scale=0.05, size=5)).round(2).tolist()) for i in range(60)]
    rows += [rows[0]] * 5 + [("b0", 99, None), ("b2", 98, [1.0] * 5), ("b0", 97, [1.0, 2.0]), ("b1", 96, [0.0] * 5)]
    v = spark.createDataFrame(rows, "backend string, ord int, embedding array<float>")
    refs = [(f"b{i % 2}", f"c{i % 6}", (centres[i % 6] + rnd.normal(scale=0.05, size=5)).tolist()) for i in range(240)]
    refs += [("b0", "same", refs[0][2]), ("b0", "c00", refs[0][2]), ("b1", "none", None)]
    refs = spark.createDataFrame(refs, "backend string, class string, embedding array<float>")
    for one in (None, F.col("ord") % 2 == 0, F.lit(True)):
        for keep in (False, True):
            def found(**kw):
                s = similarity(v, refs, ["backend"], ["backend", "ord"], best_only=one, keep_unmatched=keep, **kw)
                return sorted((r.backend, r.ord, r["class"] or "", -9 if r.similarity is None else round(r.similarity, 9)) for r in s.collect())

            whole = found()
            assert whole == found(budget=1, chunk_bytes=300) == found(budget=1) and len(whole) > 60


def test_supports_are_turned_or_skipped(spark):
    p = spark.createDataFrame([("x", "i", 0, 0.9, 0.0, 0.0, 5.0, 5.0, [1.0, 1.0, 0.0])],
                              "backend string, image_key string, ord int, score double, x1 double, y1 double, x2 double, y2 double, embedding array<float>")
    s = spark.createDataFrame([("x", "a", 0, [1.0, 0.5, 0.0]), ("x", "t", 0, [1.0, 0.0]), ("x", "t", 1, [1.0, 0.0]), ("x", "t", 2, [0.0, 1.0]),
                               ("x", "m", 0, [1.0]), ("x", "m", 1, [1.0, 1.0, 0.0]), ("y", "a", 0, [1.0])],
                              "backend string, class string, ord int, embedding array<float>")
    usable, skipped = fewshot.fit_supports(s, spark.createDataFrame([("x", 3)], "backend string, dim int"))
    assert sorted((r["class"], r.ord, list(r.embedding)) for r in usable.collect()) == [
        ("a", 0, [1.0, 0.5, 0.0]), ("t", 0, [1.0, 1.0, 0.0]), ("t", 1, [0.0, 0.0, 1.0])]
    assert [tuple(r) for r in skipped.collect()] == [("x", "m", 2, 1, 3, 3)]
    found, skipped = fewshot.classify_repaired(p, s)
    assert [(r["class"], round(r.score, 6)) for r in found.collect()] == [("t", 1.0)] and skipped.count() == 1


def test_similarity_products_and_copies_are_bounded():
    """Memory follows the vectors, not vectors times references; copies of the references follow the vectors."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from fieldspark.operators import similarity as sim

    rng = np.random.default_rng(3)
    refs, rows = rng.normal(size=(6000, 16)), rng.normal(size=(4000, 16))
    blocks = {("b", 16): (sim.unit(refs), np.array([0, 2500]), np.array(["p", "q"], object))}
    group = sim._Group()
    group.vectors, group.rows, group.of, group.one = {v.tobytes(): k for k, v in enumerate(rows)}, [*range(4000)], [*range(4000)], [True] * 4000
    group.close("max")
    tracemalloc.start()
    got = sim._search(blocks, pd.DataFrame({"backend": ["b"] * 4000}), pd.Series(list(rows)), np.zeros(4000, bool), "max")
    group.compare(sim.unit(refs))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 6000 * 8 / 3
    whole = sim.unit(rows) @ sim.unit(refs).T
    assert np.allclose(np.stack(got["similarity"]), np.stack([whole[:, :2500].max(1), whole[:, 2500:].max(1)], 1))
    assert np.allclose(group.now, whole.max(1))
    for n in (10**6, 10**8, 10**10):
        assert sim.chunk_count(9 * n, n, 64 * 1024) * n <= 9 * sim.COPIES * n + n or n > sim.COPIES * sim.CHUNK_BYTES
        assert sim.chunk_count(9 * n, n, sim.CHUNK_BYTES) == -(-9 * n // sim.CHUNK_BYTES) or n > sim.COPIES * sim.CHUNK_BYTES


def test_chunk_of_vectors_is_held_about_once():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from fieldspark.operators.similarity import _Chunk

    n, dim = 20_000, 64
    values = np.random.default_rng(0).normal(size=n * dim).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(values))
    ids = pa.StructArray.from_arrays([pa.array(np.arange(n))], ["ord"])
    columns = [pa.array(["b"] * n), pa.array(["c"] * n), lists, pa.array([True] * n), ids]
    batch = pa.RecordBatch.from_arrays(columns, ["backend", "class", "embedding", "_one", "_row"])
    chunk = _Chunk(0, ["backend"], "max", False)
    tracemalloc.start()
    chunk.add(batch)
    chunk.close()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * n * dim * 8
    assert not list(chunk.compare(batch.slice(0, 100)))
    out, = chunk.rest()
    got = np.zeros(n)
    got[out.column("c0").to_numpy()] = out.column("similarity").to_numpy()
    rows = values.reshape(n, dim).astype(float)
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    assert np.allclose(got, (rows @ rows[:100].T).max(axis=1))
