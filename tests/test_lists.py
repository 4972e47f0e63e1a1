"""Large JSON documents read in many blocks, against the plain parser."""

import json
import random

import pytest

from fieldspark.sources import lists, readers


def _value(rng, deep=0):
    kinds = [1, 2.5, None, True, "plain", 'q"u}o{t]e\\', "ü} \\\"", "", "\\\\"]
    if deep < 3 and rng.random() < 0.4:
        return {f"k{i}": _value(rng, deep + 1) for i in range(rng.randint(0, 3))}
    if deep < 3 and rng.random() < 0.3:
        return [_value(rng, deep + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice(kinds)


def _object(rng, i):
    return {"i": i, "v": _value(rng), "w": _value(rng), **({"long": "x} " * 400} if i % 97 == 0 else {})}


@pytest.fixture
def small_blocks(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("ascii_only,moved", [(True, False), (False, True)])
def test_blocks_give_the_objects_of_the_plain_parser(spark, tmp_path, small_blocks, monkeypatch, ascii_only, moved):
    if moved:
        monkeypatch.setattr(lists, "BLOCKS", 0)
    rng = random.Random(int(ascii_only))
    documents = {
        "list.json": [_object(rng, i) for i in range(300)],
        "keys.json": {
            "info": {"a": {"b": [{"c": {}}]}, "d": [{"e": 1}]}, "one": [_object(rng, i) for i in range(120)], "empty": [], "n": 3, "s": "}]",
            "two": [_object(rng, i) for i in range(150)], "end": {"x": [{}]}},
        "none.json": [], "single.json": {"lat": 1}, "tiny.json": [{}],
    }
    want = []
    for name, doc in documents.items():
        text = json.dumps(doc, ensure_ascii=ascii_only, indent=1 if name == "keys.json" else None)
        (tmp_path / name).write_text(text + ("\n" if name == "list.json" else ""), encoding="utf-8")
        found = {"": doc} if isinstance(doc, list) else {k: v for k, v in doc.items() if isinstance(v, list)}
        want += [(name, s, n, json.dumps(v)) for s, items in found.items() for n, v in enumerate(items)]
    got = lists.read_list_items(spark, str(tmp_path))
    rows = sorted((r.file.rsplit("/", 1)[1], r.section, r.ord, json.dumps(json.loads(r.value))) for r in got.collect())
    assert rows == sorted(want)
    assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 20


def test_broken_documents_fail(spark, tmp_path):
    for n, text in enumerate(('[{"a": 1}, {"b": ', '[{"a": "x}', '[{"a": 1}, 2]', '{"k": [[{}]]}', '{"k": ["x"]}')):
        (tmp_path / f"{n}.json").write_text(text)
        with pytest.raises(Exception, match="cut off|no object"):
            lists.read_list_items(spark, str(tmp_path / f"{n}.json")).collect()


def test_split_readers_equal_the_plain_ones(spark, tmp_path, small_blocks):
    found = [{"img": f"a/{i}.jpg", "label": "we}ed", "bounding_box": [i, 0, 1, 2]} for i in range(200)]
    (tmp_path / "d.json").write_text(json.dumps(found))
    (tmp_path / "a.json").write_text(json.dumps({"other": [{"x": 1}], "annotations": [{"image_path": str(i), "iou": 0.5} for i in range(90)]}))
    coco = {"images": [{"id": i, "file_name": f"{i}.jpg"} for i in range(60)], "categories": [{"id": 1, "name": "crop"}],
            "annotations": [{"image_id": i % 60, "category_id": 1, "bbox": [0, 0, 2, 3 + i]} for i in range(90)]}
    (tmp_path / "c.json").write_text(json.dumps(coco))
    for read, name in ((readers.read_detections, "d"), (readers.read_annotations, "a"), (readers.read_coco, "c")):
        plain, split = read(spark, str(tmp_path / f"{name}.json")), read(spark, str(tmp_path / f"{name}.json"), split=True)
        assert set(plain.columns) == set(split.columns)
        columns = sorted(plain.columns)
        assert sorted(map(str, split.select(columns).collect())) == sorted(map(str, plain.select(columns).collect())), name
