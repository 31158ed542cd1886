"""JSON lists read by many tasks."""

import json
import random

import pytest

from verigauge.sources import files as FS
from verigauge.sources import json_lists as J

KEYS = FS.WRAPPER_KEYS


def records(n, seed=0):
    rng = random.Random(seed)
    nasty = ["}", "{", "]", "[", '"', "\\", '\\"', "},{", "é😀", "a\nb", "", "x" * 50, '"}],[{"', "\\\\"]
    return [{"path": f"p/{i}.jpg", "label": i % 2, "note": "".join(rng.choice(nasty) for _ in range(rng.randint(0, 6))),
             "more": {"deep": [{"k": rng.choice(nasty)}, [1, "}"]], "none": None}} for i in range(n)]


def write(path, text):
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return str(path)


@pytest.mark.parametrize("split", [None, "4096b", "900b"])
@pytest.mark.parametrize("shape", ["list", "wide", "wrapped", "tail"])
def test_same_rows_for_any_number_of_splits(spark, tmp_path, split, shape):
    rows = records(120, 1)
    text = {"list": json.dumps(rows), "wide": json.dumps(rows, indent=3, ensure_ascii=False) + "\n",
            "wrapped": json.dumps({"about": {"n": [1, {"x": "[{"}]}, "images": rows}),
            "tail": json.dumps({"items": rows, "about": {"more": [{"path": "no"}] * 300}})}[shape]
    path = write(tmp_path / "m.json", text)
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        parts = spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions()
        got = sorted((r.row_no, r.text) for r in J.list_objects(spark, path, KEYS).collect())
        assert split is None or parts >= 4
        assert [json.loads(t) for _, t in got] == rows
        back = FS.read_manifest(spark, path).orderBy("row_no").collect()
        assert [(r.path, r.label, r.note) for r in back] == [(r["path"], r["label"], r["note"]) for r in rows]
        assert back[0].more.deep is not None
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_other_documents(spark, tmp_path):
    def found(text, keys=KEYS):
        df = J.list_objects(spark, write(tmp_path / "x.json", text), keys)
        return None if df is None else [json.loads(r.text) for r in df.orderBy("row_no").collect()]
    assert found("[]") == [] and found(" [ ] ") == []
    assert found('[1, "}{", null, {"a": 1}, [2, [{"no": 1}]], {"b": "x"}, true]') == [{"a": 1}, {"b": "x"}]
    assert found('{"a.jpg": 1, "b.jpg": 0}') is None and found("{broken") is None and found("") is None and found("text") is None
    assert found('{"path": "x", "label": 1}') is None
    assert found('{"x": {"items": [{"no": 1}]}, "items": [{"yes": 1}]}') == [{"yes": 1}]
    # two lists: the caller decides between them by reading the whole document
    assert found('{"items": [{"a": 1}], "records": [{"b": 1}]}') is None
    # cut off: the objects that are whole
    assert found('[{"a": 1}, {"b": {"c": 2}') == [{"a": 1}]
    assert found("﻿" + '[{"a": "ü"}]') == [{"a": "ü"}]


def test_predictions_in_many_splits(spark, tmp_path):
    rows = [{"image_path": f"/r/real/{i}.jpg", "pred": None if i % 7 == 0 else i / 500} for i in range(500)]
    path = write(tmp_path / "p.json", json.dumps(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000b")
    try:
        got = {r.path: r.score for r in FS.read_predictions(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {r["image_path"]: r["pred"] for r in rows}


def test_scan_in_both_cases():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(['"', "\\\\", '\\"', "{", "}", "[", "]", "a", ","]) for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            out, now, skip = "", inside, False
            for c in text:
                if skip:
                    skip = False
                elif now and c == "\\":
                    skip = True
                elif c == '"':
                    now = not now
                elif not now and c in "[]{}":
                    out += c
            # a backslash outside a string is no JSON
            if not inside and "\\" not in text or inside and "\\" not in text[text.find('"') + 1:]:
                assert J.scan(text, inside) == (out, now), (text, inside)
